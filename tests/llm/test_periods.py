import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from barlake.llm import periods
from edge_rows import EDGE, frame

SMALL = "/root/testdata/sf0.001"


def plain_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(12, 2 * q):
                own = words[s : s + length]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    found.append((s, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = (None,) * 4
    if runs:
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    return (doc_id, len(runs), *best, digest, hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = {d.doc_id for d in docs if len(d.text or "") < 12_000}
    got = periods.op13_periodic_runs(spark, SMALL).collect()
    assert len(got) == len(docs) and len(short) > 150
    assert sorted(tuple(r) for r in got if r.doc_id in short) == sorted(plain_row(d.doc_id, d.text) for d in docs if d.doc_id in short)


def made(rng):
    letters, n = rng.choice([1, 2, 3, 5, 50]), rng.randint(0, 160)
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 3:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a, min(n, a + p * rng.randint(2, 6))):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_many_documents_equal_brute_force(seed):
    rng = random.Random(seed)
    docs = [made(rng) for _ in range(rng.randint(1, 12))]
    found = periods.find_runs(np.array([w for d in docs for w in d], np.uint64), [len(d) for d in docs])
    got = {}
    for d, *run in zip(found.document.tolist(), found.start.tolist(), found.length.tolist(), found.period.tolist()):
        got.setdefault(d, []).append(tuple(run))
    assert [got.get(k, []) for k in range(len(docs))] == [plain_runs(d) for d in docs]


def test_pairs_stay_linear_where_one_word_repeats(monkeypatch):
    made_pairs = []
    pairs = periods._pairs
    monkeypatch.setattr(periods, "_pairs", lambda *a: made_pairs.append(len((out := pairs(*a))[0])) or out)
    n = 30_000
    found = periods.find_runs(np.zeros(n, np.uint64), [n])
    assert (found.start.tolist(), found.length.tolist(), found.period.tolist()) == ([0], [n], [1])
    assert max(made_pairs) <= 11 * n and sum(made_pairs) <= 11 * n + 2 * n * len(made_pairs)


def test_each_stretch_is_extended_once(monkeypatch):
    extended = []
    ahead = periods._Stream.agree_ahead
    monkeypatch.setattr(periods._Stream, "agree_ahead", lambda self, a, b: extended.append(len(a)) or ahead(self, a, b))
    rng = random.Random(3)
    block = [rng.randrange(10**6) for _ in range(1000)]
    found = periods.find_runs(np.array(block * 2, np.uint64), [2000])
    assert found.period.tolist() == [1000] and sum(extended) == 1


def test_edges(spark):
    rows = [*EDGE, (40, "a b " * 500, "en"), (41, " ".join(["x\x1cy", "z"] * 9), "en"), (42, "\x0b".join("abcdefabcdefa"), "de")]
    got = sorted((tuple(r) for r in periods.runs(frame(spark, rows), changed=True).collect() if r.doc_id != 4), key=repr)
    assert got == sorted((plain_row(r[0], r[1]) for r in rows if r[0] != 4), key=repr)
    long = [r for r in periods.runs(frame(spark, rows)).collect() if r.doc_id == 4][0]
    assert (long.start, long.length, long.period) == (0, 45_000, 5)
    assert periods.runs(frame(spark, [])).collect() == []
