"""Licence scan: a trained paragraph classifier, calibrated, with template comparison.

Paragraphs are the lines of a text. Their features are the presence of word unigrams and bigrams. A multinomial logistic
regression over `FAMILIES` and the class `unknown` is trained here: positives are the notices below with words left
out, cut short and set among other words; negatives are paragraphs of a bounded corpus sample (the `SAMPLE`
documents with the smallest id hash) that resemble no notice, and the same with single words of notices strewn
in. A part held back from training fits the temperature of the probabilities. A paragraph whose best family has a
probability below `LEAST_PROBABILITY` is `unknown` and not reported; for the others, the notice that agrees best (share of
its words found in order) confirms the prediction from `LEAST_SIMILARITY` on.

Only n-grams of notices have weights, so a paragraph without one of a family's words scores as the bias alone,
which is `unknown`: documents that share no word with the notices' telling words need no paragraph looked at. Every
document and whole text is scanned.

Null and empty texts have no paragraphs. Repeated rows and equal paragraphs are reported each for itself, in text
order. Without a corpus sample the strewn words alone are the negatives. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import bounded_sample, rows, sampled_texts, table, texts

SAMPLE = 300
COPIES = 60
LEAST_PROBABILITY = 0.5
LEAST_SIMILARITY = 0.7
UNKNOWN = "unknown"

#: Notices by licence family. Fixed values.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
FAMILIES = sorted(NOTICES)
#: Words of general use, which alone do not make a document worth a look. Fixed values.
COMMON = frozenset("a an and are as be by file files following for free from in is it of on or person related see source terms that the this to under use version with work you".split())

_word = re.compile(r"[^\W_]+")


def grams(words: list[str]) -> set[str]:
    """Unigrams and bigrams of a paragraph's words."""
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def words_of(paragraph: str) -> list[str]:
    return _word.findall(paragraph.lower())


def similarity(paragraph: list[str], notice: list[str]) -> float:
    """Share of the notice's words that the paragraph has in the notice's order."""
    best = [0] * (len(notice) + 1)
    for w in paragraph:
        left = 0
        for k, own in enumerate(notice, 1):
            above = best[k]
            best[k] = left + 1 if w == own else max(above, best[k - 1])
            left = above
    return best[-1] / len(notice)


@dataclass
class LicenceModel:
    """Weights of n-grams (rows) for unknown and each family (columns), and the temperature."""

    places: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    telling: frozenset[str]
    notices: list[tuple[str, list[str]]]

    def probabilities(self, words: list[str]) -> np.ndarray:
        own = [self.places[g] for g in grams(words) if g in self.places]
        z = (self.bias + self.weights[own].sum(axis=0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def find(self, text: str) -> list[tuple[str, int, int, float, float]]:
        """Family, start, end, probability and similarity of each licence paragraph of a text."""
        if self.telling.isdisjoint(_word.findall(text.lower())):
            return []
        out, at = [], 0
        for paragraph in text.split("\n"):
            words = words_of(paragraph)
            if not self.telling.isdisjoint(words):
                p = self.probabilities(words)
                k = int(np.argmax(p))
                if k and p[k] >= LEAST_PROBABILITY:
                    family = FAMILIES[k - 1]
                    alike = max(similarity(words, n) for f, n in self.notices if f == family)
                    out.append((family, at, at + len(paragraph), float(p[k]), alike))
            at += len(paragraph) + 1
        return out


def _examples(corpus: list[list[str]], rng: np.random.Generator) -> list[tuple[list[str], int]]:
    """Words and class (0 unknown) of training paragraphs."""
    notices = [(k, words_of(n)) for k, f in enumerate(FAMILIES, 1) for n in NOTICES[f]]
    spread = sorted({w for _, n in notices for w in n})
    plain = corpus or [[]]

    def some(n: int) -> list[str]:
        own = plain[rng.integers(len(plain))]
        at = int(rng.integers(max(1, len(own) - n + 1)))
        return own[at : at + n]

    out: list[tuple[list[str], int]] = [(w, 0) for w in corpus]
    for k, notice in notices:
        for c in range(COPIES):
            keep = [w for w in notice if c < 5 or len(notice) < 8 or rng.random() > 0.1]
            if c % 4 == 3 and len(keep) >= 12:
                part = int(len(keep) * rng.uniform(0.4, 1))
                at = int(rng.integers(len(keep) - part + 1))
                keep = keep[at : at + part]
            before, behind = (some(int(rng.integers(0, 30))), some(int(rng.integers(0, 30)))) if c % 3 == 2 else ([], [])
            out.append(([*before, *keep, *behind], k))
            strewn = list(some(25))
            for w in rng.choice(spread, int(rng.integers(1, 4)), replace=False):
                strewn.insert(int(rng.integers(len(strewn) + 1)), str(w))
            out.append((strewn, 0))
    return out


def train(corpus: list[list[str]], rounds: int = 200, ridge: float = 1e-3, rate: float = 0.2) -> LicenceModel:
    """The model of negatives from the corpus' paragraphs (as words) and positives from the notices."""
    rng = np.random.default_rng(11)
    notices = [(f, words_of(n)) for f in FAMILIES for n in NOTICES[f]]
    corpus = [w for w in corpus if max(similarity(w, n) for _, n in notices) < LEAST_SIMILARITY]
    examples = _examples(corpus, rng)
    places = {g: k for k, g in enumerate(sorted({g for _, n in notices for g in grams(n)}))}
    rng.shuffle(examples)
    held = len(examples) // 5
    y = np.array([k for _, k in examples])
    x = np.zeros((len(examples), len(places)), np.float32)
    for row, (words, _) in enumerate(examples):
        x[row, [places[g] for g in grams(words) if g in places]] = 1
    classes = len(FAMILIES) + 1
    w, b = np.zeros((len(places), classes)), np.zeros(classes)
    sw, sb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    target = np.eye(classes)[y[held:]]

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        off = softmax(x[held:] @ w + b) - target
        gw, gb = x[held:].T @ off / len(off) + ridge * w, off.mean(axis=0)
        sw, sb = sw + gw**2, sb + gb**2
        w, b = w - rate * gw / np.sqrt(sw), b - rate * gb / np.sqrt(sb)
    z = x[:held] @ w + b
    scales = np.geomspace(0.25, 4, 33)
    loss = [-np.log(softmax(z / t)[np.arange(held), y[:held]] + 1e-12).sum() for t in scales]
    telling = frozenset(g for g in places if " " not in g and g not in COMMON)
    return LicenceModel(places, w, b, float(scales[int(np.argmin(loss))]), telling, notices)


FOUND = "doc_id long, family string, start long, end long, probability double, similarity double, confirmed boolean"


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row for each licence paragraph: doc_id, family, span in code points, probability, similarity, confirmed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = bounded_sample(docs.select("doc_id"), F.col("doc_id"), sample)
    sampled = sampled_texts(docs, chosen).toArrow().column("text").to_pylist()
    model = train(sorted(w for t in sampled for p in (t or "").split("\n") if (w := words_of(p))))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(d, *x, x[4] >= LEAST_SIMILARITY) for d, t in zip(b.column("doc_id").to_pylist(), texts(b, "text"), strict=True) for x in model.find(t)]
            if found:
                yield rows(dict(zip(schema.names, zip(*found, strict=True), strict=True)), schema)

    return docs.mapInArrow(run, FOUND)


def op8_licence_paragraphs(spark, sf_dir: str) -> DataFrame:
    """All licence paragraphs of all documents."""
    return scan(table(spark, sf_dir, "documents"))
