"""Language identification, word first with backoff to character n-grams.

A known word adds its log frequency in each language. An unknown one is covered from its start by known character
n-grams: at each place the one of length `LONGEST`, else of the next shorter length, at a penalty of `BACKOFF` per
step; the next one begins where it ends. A text goes to the language of the largest sum.

The model is learned from the rows with a language that `learn` is given, of which at most `SAMPLE` are taken,
those with the smallest id hash: the model's documented bound. Of their words the `WORDS` and of their n-grams the
`GRAMS` most frequent ones are kept; ties go by the text. Counts are taken by Spark tasks and added by a
shuffle. Prediction covers every row and its whole text and sees nothing but the text.

A null text, or one without a letter, is `und` with score 0. A tie of languages goes to the first by name. Without any
row to learn from all is `und`. Repeated rows are predicted each for itself. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake import session
from barlake.llm.common import bounded_sample, rows, table, texts

SAMPLE = 6_000
WORDS = 60_000
GRAMS = 60_000
LONGEST = 4
BACKOFF = 0.7
#: So many words or n-grams, spread as in all languages together, are added to each language's counts.
SMOOTHING = 200.0
HELD = 300_000

_word = re.compile(r"[^\W\d_]+")


def _grams(word: str) -> Iterator[str]:
    padded = f" {word} "
    for n in range(1, LONGEST + 1):
        for k in range(len(padded) - n + 1):
            yield padded[k : k + n]


@dataclass
class LanguageModel:
    """Log frequencies by language (columns) of words and n-grams (rows)."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    _known: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_scores": None}

    def word(self, word: str) -> np.ndarray:
        """A word's log frequencies, of the whole word or by backoff."""
        k = self.words.get(word)
        if k is not None:
            return self.word_scores[k]
        padded = f" {word} "
        found, penalty, at = [], 0, 0
        get = self.grams.get
        while at < len(padded):
            for n in range(LONGEST, 0, -1):
                g = get(padded[at : at + n])
                if g is not None:
                    found.append(g)
                    penalty += LONGEST - n
                    at += n
                    break
            else:
                penalty += LONGEST
                at += 1
        # the pieces make up one word; their mean weighs like one
        return (self.gram_scores[found].sum(axis=0) - BACKOFF * penalty) / max(1, len(found)) * 2

    def score(self, text: str) -> np.ndarray | None:
        """Mean log score of a text's words by language; None without a letter."""
        counted = Counter(_word.findall(text.lower()))
        if not counted or not self.languages:
            return None
        known = self._known
        if new := [w for w in counted if w not in known]:
            if self._scores is None or len(known) + len(new) > len(self._scores):
                known.clear()
                new = list(counted)
                self._scores = np.empty((max(HELD, 2 * len(new)), len(self.languages)))
            for w in new:
                self._scores[len(known)] = self.word(w)
                known[w] = len(known)
        times = np.fromiter(counted.values(), float, len(counted))
        return times @ self._scores[np.fromiter(map(known.__getitem__, counted), np.int64, len(counted))] / times.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        mean = self.score(text or "")
        if mean is None:
            return "und", 0.0
        best = int(np.argmax(mean))
        return self.languages[best], float(1 / np.exp(np.minimum(mean - mean[best], 0)).sum())


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id's text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(labelled: DataFrame, sample: int = SAMPLE, most_words: int = WORDS, most_grams: int = GRAMS) -> LanguageModel:
    """The model of rows (doc_id, text, lang)."""
    chosen = bounded_sample(labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang"), F.col("doc_id"), sample)
    own = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    schema = pa.schema([("lang", pa.string()), ("gram", pa.bool_()), ("item", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()

        def spend() -> pa.RecordBatch:
            grams: Counter[tuple[str, str]] = Counter()
            for (lang, w), n in counts.items():
                for g in _grams(w):
                    grams[lang, g] += n
            all_ = [(lang, False, w, n) for (lang, w), n in counts.items()] + [(lang, True, g, n) for (lang, g), n in grams.items()]
            counts.clear()
            return rows(dict(zip(schema.names, zip(*all_, strict=True), strict=True)), schema)

        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), texts(b, "text"), strict=True):
                counts.update((lang, w) for w in _word.findall(t.lower()))
                if len(counts) > HELD:
                    yield spend()
        if counts:
            yield spend()

    added = own.mapInArrow(run, "lang string, gram boolean, item string, n long").groupBy("gram", "item", "lang").agg(F.sum("n").alias("n"))
    added = session.cut(added)
    ranked = added.groupBy("gram", "item").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    totals = {(r.gram, r.lang): r.n for r in added.groupBy("gram", "lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for _, lang in totals})
    place = {lang: k for k, lang in enumerate(languages)}
    scores = {}
    for gram, most in ((False, most_words), (True, most_grams)):
        top = ranked.filter(F.col("gram") == gram).orderBy(F.desc("total"), "item").limit(most).select("item", *(F.col("by")[x].alias(f"n{k}") for x, k in place.items())).toArrow()
        items = top.column("item").to_pylist()
        counts = np.zeros((len(items), len(languages)))
        for k in place.values():
            counts[:, k] = top.column(f"n{k}").fill_null(0).to_numpy()
        whole = np.array([totals.get((gram, x), 0) for x in languages], float)
        pooled = counts.sum(axis=1, keepdims=True) / max(1.0, whole.sum())
        scores[gram] = {x: k for k, x in enumerate(items)}, np.log((counts + SMOOTHING * pooled) / (whole + SMOOTHING))
    return LanguageModel(languages, *scores[False], *scores[True])


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t) for t in b.column("text").to_pylist()]
            yield rows({"doc_id": b.column("doc_id"), "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}, schema)

    text = F.col("text").cast("string").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_word_backoff_language(spark, sf_dir: str) -> DataFrame:
    """The contract's result: doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
