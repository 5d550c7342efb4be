"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level (`parse`). At each level runs of equal symbols become one symbol;
then deterministic coin tossing gives every symbol a label that depends on it and a few symbols before it: twice
the place of the lowest bit in which it differs from its left neighbour, plus that bit. Four rounds leave labels
below six that still differ between neighbours. Local maxima of the labels begin phrases, and a phrase's name,
a hash of its symbols, is a symbol of the next level. So equal substrings are parsed alike except near their
ends, wherever they stand.

A fingerprint keeps, for the levels of `LEVELS`, the `KEPT` smallest hashed names. `likeness` compares two: the
share of common names among the smallest of both estimates the Jaccard similarity J of a level, 2J/(1+J) is the
shared part of texts of like length, and levels count by how many names they have. The finest level counts only
if either text has fewer than `FEW` names at the next one.

`with_next` pairs each document with the next in descending order of doc_id, the last with the first. The texts are
shuffled once, to as many id ranges as there are shuffle partitions; only the ids' quantiles and each range's
largest id, bounded by that number, reach the driver.

Null and empty texts have an empty fingerprint; two of these have likeness 1, one of these and another text 0. Rows
with a null doc_id come last in the order; equal ids are ordered by a hash of the text. Repeated rows are documents
of their own. Very long texts are parsed whole. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import mix64, rows, slices, table, texts

LEVELS = (1, 2, 3, 4)
KEPT = 48
FEW = 12
MOST_RANGES = 2000
CHARS_AT_ONCE = 300_000

_first_left = np.uint64(2**64 - 1)


def _toss_table() -> np.ndarray:
    """Label of (left neighbour's label, own label), both below 128."""
    left, own = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    differ = left ^ own
    place = np.bitwise_count((differ & -differ) - 1)
    return (2 * place + (own >> np.minimum(place, 7) & 1)).astype(np.uint8).ravel()


_TOSS = _toss_table()
_ODD = mix64(np.arange(64, dtype=np.uint64), 11) | np.uint64(1)


def parse(symbols: np.ndarray, starts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of several symbol strings laid end to end, and where each string starts in them."""
    n = len(symbols)
    first = np.zeros(n, bool)
    first[starts] = True
    head = first.copy()
    head[1:] |= symbols[1:] != symbols[:-1]
    heads = np.flatnonzero(head)
    length = np.diff(np.r_[heads, n]).astype(np.uint64)
    with np.errstate(over="ignore"):
        s = mix64(symbols[heads] + length * np.uint64(0xA24BAED4963EE407), level)
    first = first[heads]
    left = np.empty_like(s)
    left[1:] = s[:-1]
    left[first] = _first_left
    differ = left ^ s
    with np.errstate(over="ignore"):
        place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    label = (2 * place + ((s >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8) & 127
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        # no label is 127 after a round, so a string's first symbol differs from this in some bit
        before[first] = 127
        label = _TOSS[before.astype(np.uint16) * 128 + label]
    begin = np.zeros(len(s), bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    begin[:-1] &= ~first[1:]
    begin[1:] &= ~first[:-1]
    begin |= first
    at = np.flatnonzero(begin)
    offset = np.arange(len(s)) - np.repeat(at, np.diff(np.r_[at, len(s)]))
    with np.errstate(over="ignore"):
        names = np.add.reduceat(s * _ODD[offset & 63], at) if len(at) else s
    return mix64(names, 64 + level), np.flatnonzero(first[at])


def fingerprints(own: list[str]) -> list[str]:
    """The fingerprint of each text: per level its smallest names in hex, levels parted by a dot."""
    out = [""] * len(own)
    some = [k for k, t in enumerate(own) if t]
    for lo, hi in slices((len(own[k]) for k in some), CHARS_AT_ONCE):
        group = some[lo:hi]
        symbols = np.frombuffer("".join(own[k] for k in group).encode("utf-32-le"), np.uint32).astype(np.uint64)
        starts = np.cumsum([0, *(len(own[k]) for k in group[:-1])])
        parts: list[list[str]] = [[] for _ in group]
        for level in range(1, max(LEVELS) + 1):
            symbols, starts = parse(symbols, starts, level)
            if level in LEVELS:
                small = (mix64(symbols, 200) >> np.uint64(32)).astype(">u4")
                for part, name in zip(parts, np.split(small, starts[1:]), strict=True):
                    part.append(np.unique(name)[:KEPT].tobytes().hex())
        for k, part in zip(group, parts, strict=True):
            out[k] = ".".join(part)
    return out


def _levels(fingerprint: str) -> list[set[str]]:
    return [{x[k : k + 8] for k in range(0, len(x), 8)} for x in fingerprint.split(".")]


def likeness(a: str, b: str) -> float:
    """Between 0 and 1 from two fingerprints; 1 for equal ones."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    pairs = list(zip(_levels(a), _levels(b), strict=True))
    if min(len(pairs[1][0]), len(pairs[1][1])) >= FEW:
        pairs = pairs[1:]
    total = weight = 0.0
    for x, y in pairs:
        w = min(len(x), len(y))
        least = sorted(x | y)[: max(w, KEPT if max(len(x), len(y)) == KEPT else len(x | y))]
        shared = sum(v in x and v in y for v in least) / len(least)
        total += w * 2 * shared / (1 + shared)
        weight += w
    return total / weight


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by bisection."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    return between(0, len(bounds))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, extra, doc_id, text) in order inside each bucket; after a bucket's own rows comes, with
    `extra` 1, the document that follows its last one. Buckets are whole in a partition."""
    spark = docs.sparkSession
    lowest = -(2**63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    ranges = max(1, min(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = sorted({int(x) for x in docs.select("doc_id").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []
    docs = docs.withColumn("bucket", _bucket(F.col("key"), bounds))
    tops = sorted((r.bucket, r.top) for r in docs.groupBy("bucket").agg(F.max("key").alias("top")).collect())
    after = spark.createDataFrame([(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)] or [(0, -1)], "key long, before int")
    own = F.array(F.struct("bucket", F.lit(0).alias("extra")))
    both = F.array(F.struct("bucket", F.lit(0).alias("extra")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("extra")))
    dealt = docs.join(F.broadcast(after), "key", "left").withColumn("to", F.explode(F.when(F.col("before").isNull(), own).otherwise(both)))
    dealt = dealt.select("to.bucket", "to.extra", "doc_id", "text", F.xxhash64("text").alias("tie"))
    placed = dealt.repartitionById(ranges, "bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "tie")
    return placed.select("bucket", "extra", "doc_id", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first code points of another, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next one's."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int | None, str, str] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            own = texts(b, "text")
            new = list(zip(b.column("bucket").to_pylist(), b.column("extra").to_pylist(), b.column("doc_id").to_pylist(), own, fingerprints(own), strict=True))
            all_ = new if held is None else [held, *new]
            pairs = [(x, y) for x, y in zip(all_, all_[1:], strict=False) if not x[1]]
            changed = [edited(x[3], y[3]) for x, y in pairs]
            prints = fingerprints(changed)
            yield rows(
                {
                    "doc_id": [x[2] for x, _ in pairs],
                    "n_chars": [len(x[3]) for x, _ in pairs],
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                    "fingerprint": [x[4] for x, _ in pairs],
                    "edited_fingerprint": prints,
                    "near_edited": [likeness(x[4], p) for (x, _), p in zip(pairs, prints, strict=True)],
                    "near_next": [likeness(x[4], y[4]) for x, y in pairs],
                },
                schema,
            )
            held = new[-1]

    return with_next(docs).mapInArrow(run, RESULT)


def op3_phrase_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract's result for every document."""
    return compared(table(spark, sf_dir, "documents"))
