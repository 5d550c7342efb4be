import numpy as np
import pytest

import corpus_pipeline
from barlake.llm import decontaminate, packing
from edge_rows import EDGE, frame
from test_text_operators import checked_pieces, plain_spans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        made = stage(spark, docs, SF)
        if name != "packing":
            assert made.columns == docs.columns
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_quality(spark, stages):
    kept = {r.doc_id for r in stages[1]}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality and not r.toxic]
    bad = [r.doc_id not in kept for r in labels if r.toxic or not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) >= 0.9 * len(bad)


def test_near_copies(stages):
    before, kept = {r.doc_id: shingles(r.text) for r in stages[1]}, {r.doc_id for r in stages[2]}
    ids = sorted(before)
    nearest = {i: 0.0 for i in ids}
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(before[i] & before[j])
            if both:
                alike = both / (len(before[i]) + len(before[j]) - both)
                nearest[i], nearest[j] = max(nearest[i], alike), max(nearest[j], alike)
                assert alike < 0.8 or not (i in kept and j in kept)
    assert all(nearest[i] >= 0.5 for i in ids if i not in kept)


def test_decontamination(spark, stages):
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = {}
    for n, w in enumerate(items):
        for k in range(len(w) - 4):
            runs.setdefault(tuple(w[k : k + 5]), []).append((n, k))
    kept = {r.doc_id for r in stages[3]}
    for r in stages[2]:
        w, seen = decontaminate.words_of(r.text), {}
        for k in range(len(w) - 4):
            for n, at in runs.get(tuple(w[k : k + 5]), ()):
                seen.setdefault(n, set()).add(at)
        share = max((len(s) / (len(items[n]) - 4) for n, s in seen.items()), default=0)
        assert (r.doc_id not in kept) if share >= 0.8 else (r.doc_id in kept) if share < 0.3 else True


def test_personal_data(stages):
    before = {r.doc_id: r.text for r in stages[3]}
    assert {r.doc_id for r in stages[4]} == set(before)
    for r in stages[4]:
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_packing_and_run(spark, stages):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r.doc_id: np.array([*whole.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in stages[4]}
    checked_pieces(stages[5], ids)
    made = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        made[r.doc_id] = made.get(r.doc_id, 0) + r.length
    assert made == {i: len(x) for i, x in ids.items()}


def test_edges(spark, tmp_path):
    for rows in (EDGE, []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            if name != "packing":
                assert made.columns == docs.columns
            path = str(tmp_path / f"{name}-{len(rows)}")
            made.write.parquet(path)
            docs = spark.read.parquet(path)
        if not rows:
            assert docs.count() == 0
