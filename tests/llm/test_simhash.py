import re

import numpy as np
import xxhash

from barlake.llm import simhash
from edge_rows import EDGE, frame


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, prints, radius):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x in range(len(ids)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= radius:
                a, b = find(ids[x]), find(ids[y])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in simhash.op10_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids, prints = [d.doc_id for d in docs], [plain_fingerprint(d.text) for d in docs]
    assert {i: got[i].fingerprint for i in ids} == {i: f"{p:016x}" for i, p in zip(ids, prints)}
    assert {i: got[i].component_id for i in ids} == plain_components(ids, prints, 4)


def test_dense_and_split_cells_keep_all_links(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = {int(centres[k % 12]) ^ sum(1 << int(b) for b in rng.choice(64, k % 5, replace=False)) for k in range(400)}
    values |= {int(v) for v in rng.integers(0, 2**63, 200, dtype=np.uint64)}
    rows = [(k, bytearray(v.to_bytes(8, "big"))) for k, v in enumerate(sorted(values))]
    prints = spark.createDataFrame(rows, "doc_id long, fp binary")
    want = plain_components([r[0] for r in rows], [int.from_bytes(r[1], "big") for r in rows], 4)
    for cell_rows in (4096, 16):
        got = simhash.components(prints, 4, simhash.block_keys(64, 4, 6), cell_rows)
        assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_edges_and_empty_table(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and bytes(by[1].fp) == bytes(8)
    assert by[8].component_id == 7 and by[5].component_id == 5
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_similar_texts_meet_at_the_wide_radius(spark):
    rng = np.random.default_rng(2)
    rows, pairs = [], []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        changed = list(words)
        for at in rng.choice(400, 6, replace=False):
            changed[at] = "other"
        rows += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(changed), "en")]
        a, b = ({tuple(w[i : i + 5]) for i in range(396)} for w in (words, changed))
        pairs.append(len(a & b) / len(a | b))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows), **simhash.SIMILAR).collect()}
    found = [got[2 * k] == got[2 * k + 1] for k in range(40)]
    assert min(pairs) >= 0.8 and sum(found) >= 39
    assert len(set(got.values())) >= 40


def test_no_table_is_broadcast(spark):
    """Tables of few bytes as Parquet are many rows, which the driver could not hold."""
    values = [0, 1, 3, *(1 << k for k in range(20, 60, 10)), *(0xFFFF << 4 * k for k in range(0, 12, 2))]
    # chains of stars: their labels are propagated
    chain = [(1 << 63) | sum(1 << b for b in range(60 - k, 60)) for k in range(0, 60, 3)]
    rows = [(k, bytearray(v.to_bytes(8, "big"))) for k, v in enumerate(values + chain[::2] + chain[1::2])]
    prints = spark.createDataFrame(rows, "doc_id long, fp binary")
    key = "spark.sql.maxBroadcastTableSize"
    most = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        got = simhash.components(prints, 4, simhash.block_keys(64, 4, 6)).collect()
    finally:
        spark.conf.set(key, most)
    assert {r.doc_id: r.component_id for r in got} == plain_components([r[0] for r in rows], [int.from_bytes(r[1], "big") for r in rows], 4)
