"""Quality by ordinal cumulative-link regression on graded ratings.

A rating has an ordered grade: here 0 for toxic, 1 for poor, 2 for good. One weight per hashed text feature
is shared by all grades, and ordered thresholds t0 < t1 < ... cut the score line: P(grade <= k) =
sigmoid(t_k - score). The fit gives the expected grade and the tail probability P(grade > k), by which
documents are selected.

Features of a text, hashed into `BUCKETS`: each distinct word (lower case, outer punctuation off); stepped
shares of word shapes (capitals, symbol runs, no letters, letters with digits, over-long), of repeated words,
of repeated lines, of the commonest word; stepped length. A feature is present or absent, so a long text
weighs no more than a short one for the same traits.

The model is fitted on a bounded sample: the `SAMPLE` rated documents with the smallest id hash. Of the
features only the `KEPT` that tell the grades apart best (between-grade over within-grade variance) get a
weight. Both are documented bounds of the model; scoring covers every document and its whole text.

Null and empty texts have no word features and are scored by their length step. Ratings with a null grade
or doc_id are left out; a document rated twice counts twice. Without any rating, or with one grade only, all
documents have score 0 and the thresholds are those of equal odds. Extra columns pass through; the added
ones (`score`, `expected_grade`, `tail`) replace columns of that name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake import session
from barlake.llm.common import bounded_sample, fixed_hash, rows, sampled_texts, table, texts

BUCKETS = 1 << 18
SAMPLE = 16_000
KEPT = 2_000
#: A feature of fewer rated documents gets no weight.
LEAST_ROWS = 3
#: A document is selected if P(good) is at least this.
LEAST_TAIL = 0.5

STEPS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
LENGTHS = (1, 3, 5, 10, 20, 50, 100)
SHAPES = ("plain", "capitals", "symbols", "letterless", "mixed", "overlong")
WORDS_HELD = 300_000

_run = re.compile(r"([^\w\s])\1")


def _shape(word: str, core: str) -> int:
    """The class of a word in SHAPES; core is the word without outer punctuation."""
    if core.isalpha() and len(word) - len(core) < 2 and (len(word) < 3 or not word.isupper()) and len(word) <= 40:
        return 0
    if len(word) > 40:
        return 5
    if not any(map(str.isalpha, word)):
        return 3
    if _run.search(word):
        return 2
    if len(word) > 2 and word.isupper():
        return 1
    if any(map(str.isdigit, word)):
        return 4
    return 0


class Features:
    """Hashed features of texts; what is known of a word is kept for the next text that has it."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.bucket = np.empty(WORDS_HELD, np.int64)
        self.shape = np.empty(WORDS_HELD, np.int8)
        names = [f"{kind}>={q}" for kind in (*SHAPES, "repeated", "lines", "commonest") for q in STEPS]
        self.steps = (fixed_hash(names) % BUCKETS).astype(np.int64).reshape(-1, len(STEPS))
        self.lengths = (fixed_hash([f"length<{n}" for n in LENGTHS]) % BUCKETS).astype(np.int64)

    def _learn(self, words: Counter[str]) -> None:
        if new := [w for w in words if w not in self.known]:
            if len(self.known) + len(new) > len(self.bucket):
                self.known.clear()
                new = list(words)
                if len(new) > len(self.bucket):
                    self.bucket, self.shape = np.empty(2 * len(new), np.int64), np.empty(2 * len(new), np.int8)
            at = len(self.known)
            cores = [w.strip(".,;:!?\"'()") for w in new]
            self.bucket[at : at + len(new)] = fixed_hash(["word " + c.lower() for c in cores]) % BUCKETS
            self.shape[at : at + len(new)] = list(map(_shape, new, cores))
            self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def of(self, text: str) -> np.ndarray:
        """The buckets of a text's features, each once."""
        words = text.split()
        n = len(words)
        short = self.lengths[np.array(LENGTHS) > n]
        if not n:
            return np.unique(short)
        counted = Counter(words)
        self._learn(counted)
        own = np.fromiter(map(self.known.__getitem__, counted), np.int64, len(counted))
        each = np.fromiter(counted.values(), np.int64, len(counted))
        lines = [x for x in text.split("\n") if x]
        shares = np.append(
            np.bincount(self.shape[own], each, len(SHAPES)) / n,
            [1 - len(own) / n if n >= 20 else 0, 1 - len(set(lines)) / len(lines) if lines else 0, each.max() / n if n >= 20 else 0],
        )
        stepped = self.steps[shares[:, None] >= np.array(STEPS)]
        return np.unique(np.concatenate([self.bucket[own], stepped, short]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class OrdinalModel:
    """Weights of the kept buckets and ordered thresholds, of which there is one less than grades."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(BUCKETS)
        w[self.buckets] = self.weights
        return w

    def expected(self, score: np.ndarray) -> np.ndarray:
        return sigmoid(score[:, None] - self.thresholds).sum(axis=1)

    def tail(self, score: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= grade)."""
        return sigmoid(score - self.thresholds[grade - 1])


def telling(counts: np.ndarray, members: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The buckets, in order, that tell grades apart best, given the rows of each grade that have them (grades x buckets) and all rows of each grade."""
    count, n = counts.sum(axis=0), int(members.sum())
    between, mean = np.zeros(counts.shape[1]), count / n
    for own, m in zip(counts, members.tolist(), strict=True):
        if m:
            between += m * (own / m - mean) ** 2
    worth = between / np.maximum(mean * (1 - mean), 1 / n) * (count >= LEAST_ROWS)
    chosen = np.sort(np.argsort(-worth, kind="stable")[:kept])
    return chosen[worth[chosen] > 0]


def fit_rows(features: list[np.ndarray], grades: np.ndarray, levels: int, kept: int = KEPT, rounds: int = 150, ridge: float = 1e-4, rate: float = 0.2) -> OrdinalModel:
    """Fit by full-batch adaptive gradient steps on the negative log likelihood."""
    start = np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1))
    n = len(grades)
    if n == 0 or len(np.unique(grades)) < 2:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), start)
    sizes = np.array([len(f) for f in features])
    column, row = np.concatenate(features), np.repeat(np.arange(n), sizes)
    counts = np.stack([np.bincount(column[(grades == g)[row]], minlength=BUCKETS) for g in range(levels)])
    chosen = telling(counts, np.bincount(grades, minlength=levels), kept)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    w, t = np.zeros(len(chosen)), start.copy()
    sw, st = np.full(len(w), 1e-8), np.full(len(t), 1e-8)
    top = levels - 1
    for _ in range(rounds):
        z = np.bincount(row, w[column], n)
        upper = np.where(grades < top, sigmoid(t[np.minimum(grades, top - 1)] - z), 1.0)
        lower = np.where(grades > 0, sigmoid(t[np.maximum(grades - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = np.where(grades < top, upper * (1 - upper), 0) / p, np.where(grades > 0, lower * (1 - lower), 0) / p
        gw = np.bincount(column, (du - dl)[row], len(w)) / n + ridge * w
        gt = np.array([dl[grades == k + 1].sum() - du[grades == k].sum() for k in range(top)]) / n
        sw, st = sw + gw**2, st + gt**2
        w, t = w - rate * gw / np.sqrt(sw), np.sort(t - rate * gt / np.sqrt(st))
    return OrdinalModel(chosen, w, t)


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade of the rated documents: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL")


def _bucket_counts(found: DataFrame, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Of found (grade, features): the rows of each grade that have a bucket (grades x buckets), and all rows of each grade."""
    schema = pa.schema([("bucket", pa.int32()), ("grade", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((levels, BUCKETS + 1), np.int64)
        for b in batches:
            for grade, own in zip(b.column("grade").to_pylist(), b.column("features"), strict=True):
                held[grade, np.append(np.frombuffer(own.as_py(), np.int32), BUCKETS)] += 1
        grade, bucket = np.nonzero(held)
        yield rows({"bucket": bucket.astype(np.int32), "grade": grade.astype(np.int32), "n": held[grade, bucket]}, schema)

    each = [F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in range(levels)]
    got = found.mapInArrow(run, "bucket int, grade int, n long").groupBy("bucket").agg(*each, F.sum("n").alias("n"))
    # buckets of fewer rows are not chosen
    got = got.filter((F.col("n") >= LEAST_ROWS) | (F.col("bucket") == BUCKETS)).toArrow()
    counts = np.zeros((levels, BUCKETS + 1), np.int64)
    counts[:, got.column("bucket").to_numpy()] = [got.column(f"n{g}").to_numpy() for g in range(levels)]
    return counts[:, :-1], counts[:, -1]


def fit(docs: DataFrame, graded: DataFrame, levels: int = 3, sample: int = SAMPLE) -> OrdinalModel:
    """The model of at most `sample` rated documents. Spark tasks take their features and count them; only features that get a weight reach the driver."""
    chosen = bounded_sample(graded.select("doc_id", "grade"), F.col("doc_id"), sample)
    rated = sampled_texts(docs, chosen).select("grade", "text")
    schema = pa.schema([("grade", pa.int32()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            found = [features.of(t).astype(np.int32).tobytes() for t in texts(b, "text")]
            yield rows({"grade": b.column("grade").cast(pa.int32()), "features": found}, schema)

    found = session.cut(rated.mapInArrow(run, "grade int, features binary"))
    counts, members = _bucket_counts(found, levels)
    if np.count_nonzero(members) < 2:
        return fit_rows([], np.empty(0, np.int64), levels)
    weighted = np.zeros(BUCKETS, bool)
    weighted[telling(counts, members)] = True

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x, np.int32) for x in b.column("features").to_pylist()]
            yield rows({"grade": b.column("grade"), "features": [x[weighted[x]].tobytes() for x in own]}, schema)

    # tasks end in any order; sums of floats must not depend on it. A sort samples its keys on the driver, so they are short
    got = found.orderBy(F.xxhash64("features"), "grade").mapInArrow(kept, "grade int, features binary").toArrow()
    return fit_rows([np.frombuffer(x, np.int32) for x in got.column("features").to_pylist()], got.column("grade").to_numpy().astype(np.int64), levels)


ADDED = ("score", "expected_grade", "tail")


def score(docs: DataFrame, model: OrdinalModel, grade: int = 2, names: Sequence[str] = ADDED) -> DataFrame:
    """docs with the score, the expected grade and the probability of at least the grade, under these names.

    Columns of docs that have one of the names are replaced.
    """
    docs = docs.drop(*names)
    out = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(), model.dense()
        for b in batches:
            z = np.array([weights[features.of(t)].sum() for t in texts(b, "text")], float)
            added = (z, model.expected(z), model.tail(z, grade))
            fields = [*b.schema, *(pa.field(n, pa.float64()) for n in names)]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, added)], schema=pa.schema(fields))

    return docs.mapInArrow(run, out)


def op2_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, score, expected_grade, tail and whether the document is selected, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, grades(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", "score", "expected_grade", "tail", (F.col("tail") >= LEAST_TAIL).alias("selected"))
