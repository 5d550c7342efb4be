"""Order-preserving packing of token streams into windows by dynamic programming.

Documents are tokenized and laid end to end in the order in which their partition reads them. A window is a
run of at most `WINDOW` tokens. Windows may be cut at a document's end for nothing, at a sentence's end for
`SENTENCE_COST` and elsewhere for `FORCED_COST`; a window costs its padding besides. Padding is what is missing to
`WINDOW` tokens, nothing if the window's length is a power of two; then it costs `missing / SHORT_SHARE` for being short. With p the token positions at which a cut is
allowed, the least cost f(j) of cutting off everything before p[j] is

    cut cost(j) + min( WINDOW - p[j] + min over i in the window of (f(i) + p[i]),
                       min over powers of two q of f(i) + (WINDOW - q) / SHORT_SHARE, p[i] = p[j] - q )

The inner minimum slides with j and is kept in a monotone queue, so a transition costs constant time. Cuts
elsewhere are allowed every `FORCED_STEP` tokens of a sentence without an end.

Each task packs its own partition as a stream: the programme runs over some `SEGMENT` tokens at a time, takes
the cheapest cut within a window of the segment's end, and the rest opens the next segment. Nothing is shuffled, memory is bounded by the segment, and
a task that is run again makes the same windows. sequence_id is the partition's number times 2^32 plus the
window's number in it.

Null and empty texts are documents of the end token alone. Repeated rows are packed each for itself.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import rows, slices, table, texts

WINDOW = 4096
END_ID = 2
SENTENCE_COST = 4
FORCED_COST = 64
SHORT_SHARE = 32
FORCED_STEP = 64
SEGMENT = 1 << 19
WORDS_HELD = 400_000
CHARS_AT_ONCE = 8_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_outer = ".,;:!?*%$#&()-\""


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] one after another."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class WordTokenizer:
    """Ids of whole texts, put together from the ids of their words, which no token crosses.

    Texts are split and their words told apart column by column. A word of letters is looked up without its outer ASCII
    punctuation, which is looked up by itself; any other word as it is. What is known is kept; when the table
    is full, what the texts at hand use again stays. New words of letters are tokenized in one call for many: each ends with the
    one token that has the word-end mark.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.sentence_ends = np.array(sorted(i for t, i in vocabulary.items() if re.fullmatch(r"[^\w\s]*[.!?]+[^\w\s]*(</w>)?", t)), np.int64)
        #: Row of each known string; a row is a run of `flat`.
        self.row: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        own = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in own for i in ids], np.uint32), np.fromiter(map(len, own), np.int64, len(own))

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words):  # a letter that lower-casing takes apart
            return self._encode(words)
        return ids, np.diff(ends, prepend=0)

    def _rows(self, wanted: list[str], letters: np.ndarray) -> np.ndarray:
        """The table's row of each of the distinct strings; unknown ones are tokenized, those of letters together."""
        found = np.fromiter(map(self.row.get, wanted, repeat(-1)), np.int64, len(wanted))
        if len(self.row) + int((found < 0).sum()) > WORDS_HELD:
            again = np.flatnonzero(found > 0)
            old = found[again]
            self.row = {"": 0} | {wanted[k]: n for n, k in enumerate(again.tolist(), 1)}
            self.flat = _gathered(self.flat, self.starts[old], self.sizes[old])
            self.sizes = np.r_[0, self.sizes[old]]
            self.starts = np.cumsum(self.sizes) - self.sizes
            found[again] = np.arange(1, len(again) + 1)
        for which, encode in ((letters, self._encode_letters), (~letters, self._encode)):
            new = np.flatnonzero((found < 0) & which)
            if len(new):
                words = [wanted[k] for k in new.tolist()]
                ids, sizes = encode(words)
                found[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
                self.row.update(zip(words, found[new].tolist(), strict=True))
                self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
                self.flat, self.sizes = np.r_[self.flat, ids], np.r_[self.sizes, sizes]
        return found

    def _parts(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Two rows for each of the distinct words: what is looked up first, and what follows it."""
        core = pc.ascii_rtrim(words, characters=_outer)
        ascii_ = pc.string_is_ascii(core).to_numpy(zero_copy_only=False)
        letters = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False).copy()
        other = np.flatnonzero(letters & ~ascii_)
        letters[other] = [c.lower().isalpha() for c in core.take(pa.array(other)).to_pylist()]
        mask = pa.array(letters)
        keys = pc.if_else(mask, pc.if_else(pa.array(ascii_), pc.ascii_lower(core), core), words).dictionary_encode()
        # A word that is not all letters keeps its punctuation, a word of letters has none: no key is both.
        key_of, is_letters = keys.indices.to_numpy(), np.zeros(len(keys.dictionary), bool)
        is_letters[key_of] = letters
        kept = pc.binary_length(core).to_numpy().astype(np.int64)
        rest = pc.binary_length(words).to_numpy() - kept
        tailed = np.flatnonzero(letters & (rest > 0))
        offsets, data = (np.frombuffer(x, t) if x else np.zeros(0, t) for x, t in zip(words.buffers()[1:], (np.int32, np.uint8), strict=True))
        tail_bytes = _gathered(data, offsets[words.offset :][tailed] + kept[tailed], rest[tailed])
        tail_ends = np.r_[0, np.cumsum(rest[tailed])].astype(np.int32)
        tails = pa.StringArray.from_buffers(len(tailed), pa.py_buffer(tail_ends), pa.py_buffer(tail_bytes)).dictionary_encode()
        # A tail can be a word as well; it gets one row only.
        place = pc.index_in(tails.dictionary, value_set=keys.dictionary)
        missing = tails.dictionary.filter(place.is_null())
        of_tail = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        of_tail[of_tail < 0] = len(keys.dictionary) + np.arange(len(missing))
        row = self._rows(keys.dictionary.to_pylist() + missing.to_pylist(), np.r_[is_letters, np.zeros(len(missing), bool)])
        tail = np.zeros(len(words), np.int64)
        tail[tailed] = row[of_tail[tails.indices.to_numpy()]]
        return row[key_of], tail

    def ids(self, several: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; words are learned for some `CHARS_AT_ONCE` characters at a time."""
        for lo, hi in slices(map(len, several), CHARS_AT_ONCE):
            split = pc.ascii_split_whitespace(pa.array(several[lo:hi], pa.string()))
            words = split.values.dictionary_encode()
            first, second = self._parts(words.dictionary)
            both = np.c_[first, second].ravel()
            flat = _gathered(self.flat, self.starts[both], self.sizes[both])
            sizes = self.sizes[first] + self.sizes[second]
            at = words.indices.to_numpy()
            ends = np.r_[0, np.cumsum(sizes[at])][split.offsets.to_numpy()]
            stream = _gathered(flat, (np.cumsum(sizes) - sizes)[at], sizes[at])
            for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                yield stream[a:b]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer and what it knows; Python workers are used again by later tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut_points(ids: np.ndarray, document_ends: np.ndarray, sentence_ends: np.ndarray, step: int = FORCED_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the stream may be cut, 0 first and its length last, and the cost of each cut."""
    cost = np.full(len(ids) + 1, -1, np.int32)
    cost[1:][np.isin(ids, sentence_ends)] = SENTENCE_COST
    cost[document_ends] = 0
    cost[0] = cost[-1] = 0
    at = np.flatnonzero(cost >= 0)
    for k in np.flatnonzero(np.diff(at) > step):
        cost[at[k] + step : at[k + 1] : step] = FORCED_COST
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int = WINDOW, ends: bool = True) -> list[int]:
    """The cheapest cut positions, 0 first; neighbours are at most a window apart.

    The last is the stream's end, or, if the stream goes on, the cheapest one within a window of it.
    """
    n = len(at)
    powers = [1 << k for k in range(window.bit_length() - 2, 5, -1)]
    exact: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for p in powers:
        i = np.minimum(np.searchsorted(at, at - p), n - 1)
        for j in np.flatnonzero((at[i] == at - p) & (at >= p)):
            exact[j].append((int(i[j]), (window - p) // SHORT_SHARE))
    position, price = at.tolist(), cost.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, n):
        here = position[j]
        while position[queue[0][1]] < here - window:
            queue.popleft()
        least, via = queue[0]
        least += window - here
        for i, short in exact[j]:
            if best[i] + short < least:
                least, via = best[i] + short, i
        least += price[j]
        best[j], back[j] = least, via
        key = least + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = n - 1
    if not ends:
        last = [k for k in range(int(np.searchsorted(at, at[-1] - window)), n - 1) if k]
        j = min(last, key=lambda k: (best[k], -k)) if last else n - 1
    cuts = [position[j]]
    while j:
        j = back[j]
        cuts.append(position[j])
    return cuts[::-1]


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """The pieces of all documents: a row for each part of a document in each window."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def pieces(stream: np.ndarray, held: list[list[int]], cuts: list[int], first: int) -> pa.RecordBatch:
        """held: doc_id, tokens of the document before this stream, its tokens in it, all its tokens."""
        out: dict[str, list[int]] = {n: [] for n in schema.names}
        raw = stream.tobytes()
        edges = np.cumsum([0] + [h[2] for h in held])
        d = 0
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            at = lo
            while at < hi:
                while edges[d + 1] <= at:
                    d += 1
                end = min(hi, int(edges[d + 1]))
                doc, before, _, total = held[d]
                for name, value in zip(schema.names, (doc, before + at - int(edges[d]), end - at, zlib.crc32(raw[4 * at : 4 * end]), total, first + k, at - lo), strict=True):
                    out[name].append(value)
                at = end
        return rows(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer_path)
        buffer: list[np.ndarray] = []
        held: list[list[int]] = []
        size, sequence = 0, None

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal buffer, held, size, sequence
            stream = np.concatenate(buffer)
            ends = np.cumsum([h[2] for h in held])
            open_end = held[-1][1] + held[-1][2] < held[-1][3]
            cuts = best_cuts(*cut_points(stream, ends[: -1 if open_end else None], words.sentence_ends), window, last)
            yield pieces(stream, held, cuts, sequence)
            sequence += len(cuts) - 1
            done = cuts[-1]
            rest = [[h[0], h[1] + max(0, done - (e - h[2])), e - max(done, e - h[2]), h[3]] for h, e in zip(held, map(int, ends), strict=True) if e > done]
            buffer, held, size = [stream[done:]], rest, size - done

        for b in batches:
            part = b.column("part")
            for doc, tokens in zip(b.column("doc_id").to_pylist(), words.ids(texts(b, "text")), strict=True):
                if sequence is None:
                    sequence = part[0].as_py() << 32
                ids = np.append(tokens, np.uint32(END_ID))
                for at in range(0, len(ids), segment):
                    some = ids[at : at + segment]
                    buffer.append(some)
                    held.append([doc, at, len(some), len(ids)])
                    size += len(some)
                    if size >= segment:
                        yield from cut(last=False)
        if size:
            yield from cut(last=True)

    part = F.spark_partition_id().cast("long").alias("part")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part).mapInArrow(run, PIECES)


def default_tokenizer() -> str:
    """The public 49k word vocabulary of the installed vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_window_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's pieces of all documents."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
