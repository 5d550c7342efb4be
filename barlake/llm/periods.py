"""Periodic runs of words, found by seeds that are extended along diagonals.

A run with smallest period q and length L is a diagonal at lag q: words i and i+q are equal for L-q words in a
row, at least max(LEAST - q, q) of them. Lags are taken in classes [2k, 4k), k = 6, 12, 24, ..., in which at least
2k words agree, and one class of lags 1 to 11, in which at least 6 do. The index has the k-grams of all words whose
six-gram repeats in its document. In every agreeing stretch of 2k words lies a k-gram that starts at a multiple of
k, so only those are seeds, and a seed's partners are looked up in the index among the words 2k to 4k further on: at most
2k for each of the n/k seeds, that is 2n pairs per class however often a k-gram occurs, and no
pair of occurrences outside the class's lags is made.

The pairs of a class are ordered by lag and place. For each lag a table holds how far the last pair reached: a pair
whose seed begins within that reach, or right at its end, is of the same stretch and is not extended again. The rest, one pair per
stretch, are extended both ways by comparing hashes of 2^t words, largest first, as many as there are bits in
the length. What is long enough is a run if no smaller period has the same ends: a run whose length is twice
a lag that is no smallest period has the same ends under the smallest one.

Texts are searched in slices of some `WORDS_AT_ONCE` words, laid end to end with a word between them that occurs once,
so no run crosses. A longer text is a slice of its own: about 200 bytes of memory per word. Words are compared by their codes in the
slice's dictionary, stretches of words by 64-bit hashes of these. Nothing is shuffled.

Null and empty texts have no words and no runs; what is left of them is the empty text. Repeated rows are rows of
their own. A null doc_id is left as null and its text is not changed by `repeat_words`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import mix64, rows, slices, table

LEAST = 12
WORDS_AT_ONCE = 400_000
BASE = LEAST // 2

RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@dataclass
class Runs:
    """Runs of a slice: the document's number in it, first word in the document, length, period; ordered by these."""

    document: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class _Stream:
    """Documents' words as one array of codes, and hashes of 2^t words from every place."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        self.sizes = sizes
        ends = np.cumsum(sizes + 1)
        self.first = ends - sizes - 1
        self.n = int(ends[-1]) if len(ends) else 0
        self.document = np.repeat(np.arange(len(sizes)), sizes + 1)
        words = np.zeros(self.n + 1, np.uint64)
        between = np.zeros(self.n + 1, bool)
        between[ends - 1] = True
        between[-1] = True
        words[~between] = codes
        words[between] = int(codes.max(initial=0)) + 1 + np.arange(between.sum())
        self.between = between
        self.grams = [mix64(words, 1)]
        longest = int(sizes.max(initial=0))
        while 2 ** len(self.grams) <= longest:
            half = 2 ** (len(self.grams) - 1)
            last = self.grams[-1]
            self.grams.append(_paired(last, _ahead(last, half), len(self.grams)))

    def kgrams(self, level: int) -> np.ndarray:
        """Hashes of 6 * 2^level words from every place."""
        t = level + 2
        return _paired(self.grams[t], _ahead(self.grams[t - 1], 2**t), 64)

    def agree_ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on."""
        size = np.zeros(len(a), np.int64)
        for t in range(len(self.grams) - 1, -1, -1):
            here = self.grams[t]
            # b + size never passes the single word that ends its document
            size += (here[a + size] == here[b + size]).astype(np.int64) << t
        return size

    def agree_behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b; a is less than b."""
        size = np.zeros(len(a), np.int64)
        for t in range(len(self.grams) - 1, -1, -1):
            here, low = self.grams[t], a - size - (1 << t)
            inside = low >= 0
            at = np.where(inside, low, 0)
            size += (inside & (here[at] == here[at + b - a])).astype(np.int64) << t
        return size


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """The values some places further on; behind the end stands the last one."""
    out = np.full_like(values, values[-1])
    out[: max(0, len(values) - by)] = values[by:]
    return out


def _paired(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(left, salt) + right, salt + 1)


def _repeated(stream: _Stream) -> np.ndarray:
    """Places whose six-gram occurs more than once in its document."""
    own = mix64(stream.kgrams(0)[: stream.n] ^ mix64(stream.document.astype(np.uint64), 200), 201)
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    more = np.zeros(stream.n, bool)
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    return np.flatnonzero(more)


def _pairs(stream: _Stream, places: np.ndarray, k: int, level: int, stride: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, lag) of all k-grams that occur again low to high - 1 words on, ordered by lag and seed."""
    own = stream.kgrams(level)[places]
    kinds, kind = np.unique(own, return_inverse=True)
    span = stream.n + high + 1
    index = np.sort(kind * span + places)
    place = index % span
    seeds = np.flatnonzero(place % stride == 0)
    lo = np.searchsorted(index, index[seeds] + low)
    # keys of the next k-gram begin a whole span higher, so none of them is below the bound
    hi = np.searchsorted(index, index[seeds] + high)
    n = hi - lo
    seed = np.repeat(place[seeds], n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    partner = place[np.repeat(lo, n) + within]
    lag = partner - seed
    order = np.lexsort((seed, lag))
    return seed[order], lag[order]


def _uncovered(seed: np.ndarray, lag: np.ndarray, stride: int) -> np.ndarray:
    """Which pairs open a stretch: no pair of the same lag reaches up to the seed.

    Every seed of a stretch is in the list, so its pairs follow each other at the stride of the seeds.
    """
    fresh = np.ones(len(seed), bool)
    fresh[1:] = (lag[1:] != lag[:-1]) | (seed[1:] > seed[:-1] + stride)
    return fresh


def find_runs(codes: np.ndarray, sizes: Sequence[int]) -> Runs:
    """All runs of documents whose words' codes are given one after another."""
    sizes = np.asarray(sizes, np.int64)
    stream = _Stream(codes, sizes)
    nothing = np.zeros(0, np.int64)
    starts, lengths, lags = [nothing], [nothing], [nothing]
    places = _repeated(stream) if int(sizes.max(initial=0)) >= LEAST else nothing
    level, k, stride, low, high = 0, BASE, 1, 1, LEAST
    while len(places) and 2 * low <= sizes.max():
        seed, lag = _pairs(stream, places, k, level, stride, low, high)
        fresh = _uncovered(seed, lag, stride)
        seed, lag = seed[fresh], lag[fresh]
        before = stream.agree_behind(seed, seed + lag)
        length = before + stream.agree_ahead(seed, seed + lag) + lag
        long = length >= np.maximum(LEAST, 2 * lag)
        starts.append((seed - before)[long])
        lengths.append(length[long])
        lags.append(lag[long])
        low, high = high, 2 * high
        k = low // 2
        stride, level = k, (k // BASE).bit_length() - 1
        # a document needs room for twice the least lag
        places = places[sizes[stream.document[places]] >= 2 * low]
    start, length, lag = map(np.concatenate, (starts, lengths, lags))
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, lag = start[smallest], length[smallest], lag[smallest]
    order = np.lexsort((lag, start))
    start, length, lag = start[order], length[order], lag[order]
    document = stream.document[start] if len(start) else nothing
    return Runs(document, start - stream.first[document], length, lag)


def repeat_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of n words stands at each place after a tenth of the documents got a repeated end; None if unchanged."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def collapsed(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay when of each run only the first period is kept."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:n]) == 0


def word_codes(words: list[bytes]) -> np.ndarray:
    """A number per word, equal for equal words."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.uint64)


def described(ids: list[int | None], several: list[str | None], changed: bool) -> Iterator[tuple]:
    """Per document: its words, which are kept, and its runs' starts, lengths and periods."""
    for lo, hi in slices([len(t or "") // 6 + 1 for t in several], WORDS_AT_ONCE):
        own = [(t or "").encode().split() for t in several[lo:hi]]
        sizes = [len(w) for w in own]
        codes = word_codes([w for words in own for w in words])
        edges = np.cumsum([0, *sizes])
        if changed:
            for k, doc_id in enumerate(ids[lo:hi]):
                at = repeat_words(doc_id, sizes[k])
                if at is not None:
                    codes[edges[k] : edges[k + 1]] = codes[edges[k] + at]
                    own[k] = [own[k][i] for i in at.tolist()]
        found = find_runs(codes, sizes)
        bounds = np.searchsorted(found.document, np.arange(len(own) + 1)).tolist()
        for k, words in enumerate(own):
            a, b = bounds[k], bounds[k + 1]
            yield words, found.start[a:b], found.length[a:b], found.period[a:b]


def runs(docs: DataFrame, changed: bool = False) -> DataFrame:
    """Per document its runs in number, the longest one, and digests of all of them and of the text without repeats.

    changed: first give a tenth of the documents a repeated end (`repeat_words`).
    """
    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in (c.split()[0] for c in RUNS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            out: dict[str, list] = {n: [] for n in schema.names}
            for doc_id, (words, start, length, period) in zip(ids, described(ids, b.column("text").to_pylist(), changed), strict=True):
                best: tuple[int | None, ...] = (None, None, None, None)
                listed = b""
                if len(start):
                    longest = int(length.max())
                    s, q = min(zip(start[length == longest].tolist(), period[length == longest].tolist(), strict=True))
                    best = (s, longest, q, 1000 * longest // q)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)).encode()
                    words = [words[i] for i in np.flatnonzero(collapsed(len(words), start, length, period)).tolist()]
                values = (doc_id, len(start), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())
                for name, value in zip(schema.names, values, strict=True):
                    out[name].append(value)
            yield rows(out, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RUNS)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The contract's runs of all documents, a tenth of which get a repeated end first."""
    return runs(table(spark, sf_dir, "documents"), changed=True)
