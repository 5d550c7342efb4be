import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.llm import copies, decontaminate, language, licences, ordinal, packing, phrases, sanitise
from edge_rows import EDGE, LONG, frame

SMALL = "/root/testdata/sf0.001"


def documents(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet")


# packing


def checked_pieces(pieces, ids):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            part = ids[doc][at : at + p.length]
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[doc]), zlib.crc32(part.tobytes()))
            at += p.length
        assert at == len(ids[doc])
    lengths = []
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        lengths.append(at)
    return lengths


@pytest.mark.parametrize("segment", [packing.SEGMENT, 15_000])
def test_packing_round_trip(spark, segment):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    docs = documents(spark)
    ids = {r.doc_id: np.array([*whole.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    lengths = checked_pieces(packing.pack(docs.coalesce(1), packing.default_tokenizer(), segment=segment).collect(), ids)
    padding = sum(4096 - n for n in lengths if n & (n - 1))
    assert padding < 0.01 * sum(lengths)


def test_best_cuts_equal_plain_programme():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randint(1, 400)
        at = sorted({0, n, *(rng.randint(1, n) for _ in range(n // 3))})
        at = sorted({*at, *(x for x in range(0, n, 50))})
        cost = [0, *(rng.choice((0, 4, 64)) for _ in at[2:]), 0]
        best = [0.0] + [float("inf")] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                size = at[j] - at[i]
                if size <= 128:
                    padding = 128 - size
                    if size >= 64 and size & (size - 1) == 0:
                        padding = min(padding, (128 - size) // packing.SHORT_SHARE)
                    best[j] = min(best[j], best[i] + padding + cost[j])
        cuts = packing.best_cuts(np.array(at), np.array(cost), 128)
        total = 0
        for lo, hi in zip(cuts, cuts[1:]):
            size = hi - lo
            assert size <= 128
            padding = 128 - size
            if size >= 64 and size & (size - 1) == 0:
                padding = min(padding, (128 - size) // packing.SHORT_SHARE)
            total += padding + cost[at.index(hi)]
        assert total == best[-1]


def test_packing_words_equal_whole_texts():
    words = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(3)
    parts = ["a", "B", "é", "é", "İ", "Σ", "ß", "1", "²", " ", "\n", "\x1c", "\x85", "\xa0", ".", ",", "!", "'s", "'", "_", "中", "\U0001f600", "-", "&", "*", "́"]
    several = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text, ids in zip(several, words.ids(several)):
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_edges(spark):
    got = packing.pack(frame(spark), packing.default_tokenizer()).collect()
    sizes = {}
    for p in got:
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.length
    assert sizes[1] == sizes[2] == sizes[3] == 1 and sizes[5] == 4 and None in sizes
    assert packing.pack(frame(spark, []), packing.default_tokenizer()).collect() == []


# personal data

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            luhn = sum(d - 9 * (d > 9) for d in double) % 10 == 0
            good = {"email": True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if good.get(kind, kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@-+ 0 25().5_é٣_x42") for _ in range(rng.randint(0, 60)))
        assert sanitise._listed(sanitise.base_spans(text)) == ",".join(plain_spans(text))


def test_spans_of_all_documents(spark):
    got = {r.doc_id: r for r in sanitise.op9_disclosure_spans(spark, SMALL).collect()}
    for d in documents(spark).collect():
        want = plain_spans(d.text)
        assert got[d.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in got[d.doc_id].spans.split(",") if x and not x.startswith("term:")] == want


def test_disclosing_terms(spark):
    near = "today {} zorblax wrote to ann.b@c.example.com about {}"
    rows = [(k, near.format(f"x{k}", f"y{k}"), "en") for k in range(4)]
    rows += [(10 + k, f"nothing about today and wrote {k}", "en") for k in range(400)]
    got = {r.doc_id: r.spans for r in sanitise.spans(frame(spark, rows)).collect()}
    text = rows[0][1]
    marked = {text[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[0].split(",")) if k == "term"}
    assert "zorblax" in marked and "today" not in marked and got[10] == ""
    clean = {r.doc_id: r.text for r in sanitise.masked(frame(spark, rows)).collect()}
    assert "zorblax" not in clean[0] and "<email>" in clean[0] and clean[10] == rows[4][1]


@pytest.mark.parametrize(("rows", "holders"), [(100, 2), (140, 2), (3000, 2), (3000, 1000), (90, 30)])
def test_disclosure_does_not_depend_on_the_number_of_rows(spark, rows, holders):
    """A term that stands by one entity only, in a few documents, against a plain count over all documents."""
    told = min(holders, 24)
    texts = [f"w{k} zorblax says ann.b@c.example.com v{k}" if k < told else f"w{k} common says ann.b@c.example.com v{k}" for k in range(holders)]
    texts += [f"w{k} common says nothing v{k}" for k in range(holders, rows)]
    docs = frame(spark, [(k, t, "en") for k, t in enumerate(texts)])
    got = {r.doc_id: r.spans for r in sanitise.spans(docs).collect()}
    n, df_e = len(texts), holders
    want = set()
    for term in ("zorblax", "common", "says"):
        df = sum(term in t.split() for t in texts)
        both = sum(term in t.split() and "@" in t for t in texts)
        b = df_e / n
        if df and both > 1 and both / df >= 0.5 and (both / df - b) / (b * (1 - b) / df) ** 0.5 >= 4:
            want.add(term)
    marked = {texts[d][int(a) : int(b)] for d, s in got.items() for k, a, b in (x.split(":") for x in s.split(",") if x) if k == "term"}
    assert marked == want == {"zorblax"}


def test_clashing_names_keep_their_values(spark):
    schema = "doc_id long, text string, `row` int, marks string, _row int, _near_copy_row int"
    docs = spark.createDataFrame([(1, "call +49 151 2345678 now", 7, "x", 8, 9)], schema)
    got = sanitise.masked(docs).collect()[0]
    assert (got["row"], got.marks, got["_row"]) == (7, "x", 8) and "<phone>" in got.text
    assert [tuple(r) for r in copies.dropped(docs).collect()] == [tuple(r) for r in docs.collect()]


def test_sanitise_edges(spark):
    docs = frame(spark)
    got = sanitise.spans(docs).collect()
    assert len(got) == len(EDGE) and sum(r.n_email for r in got) == 1 and sum(r.n_phone for r in got) == 1
    clean = sanitise.masked(docs)
    assert clean.columns == docs.columns and clean.count() == len(EDGE)
    assert sanitise.spans(frame(spark, [])).collect() == [] and sanitise.masked(frame(spark, [])).collect() == []


# decontamination


def test_recall_against_shared_word_runs(spark):
    sf = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op6_latent_decontamination(spark, sf).collect()}
    runs = {}
    for r in items.collect():
        w = decontaminate.words_of(r.text)
        for k in range(len(w) - 4):
            runs.setdefault(tuple(w[k : k + 5]), []).append((r.item_id, k))
    lengths = {r.item_id: len(decontaminate.words_of(r.text)) - 4 for r in items.collect()}
    want = set()
    for d in documents(spark, sf).collect():
        w, seen = decontaminate.words_of(d.text), {}
        for k in range(len(w) - 4):
            for item, at in runs.get(tuple(w[k : k + 5]), ()):
                seen.setdefault(item, set()).add(at)
        want |= {(d.doc_id, i) for i, s in seen.items() if len(s) >= 0.6 * lengths[i]}
    assert len(want) > 10 and len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got)


def test_paraphrase_and_edges(spark):
    item = "Every zelkova tree near the quarry lost its copper leaves before winter came. The answer was the salted northern wind."
    changed = item.replace("near the quarry", "by the old quarry").replace("before winter came", "as winter came")
    filler = " ".join(f"filler{k}" for k in range(300))
    rows = [*EDGE, (50, f"{filler} {changed} {filler}", "en"), (51, filler, "en")]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    got = decontaminate.pairs(frame(spark, rows), items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(50, 1)]
    kept = decontaminate.decontaminated(frame(spark, rows), items)
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows) - 1
    none = spark.createDataFrame([], items.schema)
    assert decontaminate.pairs(frame(spark), none).collect() == [] and decontaminate.decontaminated(frame(spark), none).count() == len(EDGE)
    assert decontaminate.pairs(frame(spark, []), items).collect() == []


def test_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert abs(decontaminate.Sequence(a).share(b, 0) - plain(a, b) / len(a)) < 1e-12


# quality


def test_ordinal_accuracy_on_held_out_ratings(spark):
    sf = "/root/testdata/sf0.1"
    docs = documents(spark, sf).select("doc_id", "text")
    graded = ordinal.grades(spark.read.parquet(f"{sf}/labels.parquet"))
    model = ordinal.fit(docs, graded.filter("doc_id % 4 <> 0"))
    held = ordinal.score(docs.join(graded.filter("doc_id % 4 = 0"), "doc_id"), model).select("grade", "tail", "expected_grade").collect()
    good = [r.tail >= 0.5 for r in held if r.grade == 2]
    bad = [r.tail < 0.5 for r in held if r.grade < 2]
    assert sum(good) >= 0.98 * len(good) and sum(bad) >= 0.9 * len(bad)
    assert list(model.thresholds) == sorted(model.thresholds)


def test_ordinal_edges(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 1, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    got = ordinal.score(docs, ordinal.fit(docs, ordinal.grades(labels)))
    assert got.count() == len(EDGE) and set(docs.columns) <= set(got.columns)
    assert all(0 <= r["tail"] <= 1 and 0 <= r.expected_grade <= 2 for r in got.collect())
    none = ordinal.fit(docs, ordinal.grades(labels.limit(0)))
    assert {r.score for r in ordinal.score(docs, none).collect()} == {0.0}
    assert ordinal.score(frame(spark, []), none).collect() == []


def test_ordinal_brings_only_weighted_features_to_the_driver(spark, monkeypatch):
    kinds = ("rude", "dull", "fine")
    texts = [f"{kinds[k % 3]} {' '.join(f'w{k}x{i}' for i in range(500))}" for k in range(60)]
    docs = frame(spark, [(k, t, "en") for k, t in enumerate(texts)])
    graded = spark.createDataFrame([(k, k % 3) for k in range(60)], "doc_id long, grade int")
    brought, real = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: brought.append(real(self)) or brought[-1])
    model = ordinal.fit(docs, graded)
    assert sum(t.nbytes for t in brought) < 20_000
    of = ordinal.Features().of
    whole = ordinal.fit_rows([of(t) for t in texts], np.arange(60) % 3, 3)
    assert len(model.buckets) and np.array_equal(model.buckets, whole.buckets)
    assert np.allclose(model.weights, whole.weights, atol=1e-9) and np.allclose(model.thresholds, whole.thresholds, atol=1e-9)


# fingerprints


def test_phrases_of_all_documents(spark):
    docs = sorted(documents(spark).select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in phrases.op3_phrase_fingerprints(spark, SMALL).collect()}
    assert len(got) == len(docs)
    better = 0
    for k, d in enumerate(docs):
        following = docs[(k + 1) % len(docs)]
        changed, own = phrases.edited(d.text, following.text), got[d.doc_id]
        prints = phrases.fingerprints([d.text, changed, following.text])
        assert own.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and own.n_chars == len(d.text)
        assert [own.fingerprint, own.edited_fingerprint] == prints[:2]
        assert own.near_next == phrases.likeness(prints[0], prints[2])
        better += own.near_edited > own.near_next
    assert better >= 0.95 * len(docs)


def test_each_range_of_documents_has_its_own_task(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        placed = phrases.with_next(frame(spark, [(k, f"text {k}", "en") for k in range(2400)]))
        tasks = placed.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("bucket").alias("buckets"), F.count("bucket").alias("rows")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(tasks) >= 20 and max(r.buckets for r in tasks) == 1 and max(r.rows for r in tasks) < 200


def test_equal_substrings_share_phrases():
    rng = random.Random(6)
    middle = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    a, b = ("".join(rng.choice("xyz") for _ in range(n)) + middle for n in (17, 400))
    assert phrases.likeness(*phrases.fingerprints([a, b])) > 0.8
    assert phrases.likeness(*phrases.fingerprints([a, "".join(rng.choice("abcdefgh ") for _ in range(3000))])) < 0.3


def test_phrase_edges(spark):
    got = phrases.compared(frame(spark)).collect()
    assert len(got) == len(EDGE) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[7].fingerprint == by[8].fingerprint and by[8].near_next == 1.0 and by[1].fingerprint == ""
    assert by[4].n_chars == len(LONG)
    assert phrases.compared(frame(spark, [])).collect() == []
    assert [r.near_next for r in phrases.compared(frame(spark, [(1, "alone", "en")])).collect()] == [1.0]


# language


def test_language_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in documents(spark, sf).select("doc_id", "lang").collect()}
    got = language.op5_word_backoff_language(spark, sf).collect()
    assert {r.doc_id for r in got} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert sum(held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    docs = frame(spark)
    got = {r.doc_id: r for r in language.predicted(docs, language.learn(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and got[5].lang_pred == "en"
    nothing = language.learn(frame(spark, []))
    assert {r.lang_pred for r in language.predicted(docs, nothing).collect()} == {"und"}
    assert language.predicted(frame(spark, []), nothing).collect() == []


# licences


def test_licence_lines_of_all_documents(spark):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
    }
    sf = "/root/testdata/sf0.01"
    want = sorted((d.doc_id, lines[x]) for d in documents(spark, sf).collect() for x in d.text.split("\n") if x in lines)
    got = licences.op8_licence_paragraphs(spark, sf).collect()
    assert want and sorted((r.doc_id, r.family) for r in got) == want and all(r.confirmed for r in got)


def test_licence_edges(spark):
    rows = [*EDGE, (20, "intro\nReleased under the MIT License.\nReleased under the MIT License.", "en"), (21, "the license of a public mozilla version", "en")]
    got = licences.scan(frame(spark, rows)).collect()
    assert [(r.doc_id, r.family, r.start) for r in sorted(got, key=lambda r: r.start)] == [(20, "MIT", 6), (20, "MIT", 38)]
    assert licences.scan(frame(spark, [])).collect() == []
