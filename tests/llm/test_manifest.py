import hashlib
import zlib

import pytest

from barlake.llm import merkle
from edge_rows import EDGE, frame

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, lowered=False):
    text = row["text"]
    if lowered and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def climb(digests, fanout=8):
    """The top digest, and per leaf its path: (siblings before, siblings after) by level."""
    paths = [[] for _ in digests]
    below = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        parents, covered = [], []
        for at in range(0, len(digests), fanout):
            run = digests[at : at + fanout]
            for k in range(len(run)):
                for i in below[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(sha("".join(run)))
            covered.append([i for b in below[at : at + fanout] for i in b])
        digests, below = parents, covered
    return digests[0], paths


def brute_force(rows, fanout=8):
    if not rows:
        return []
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = []
    for name in names:
        placed = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        own.append((placed, *climb([leaf(r) for r in placed], fanout)))
    root, upper = climb([o[1] for o in own], fanout)
    out = []
    for (placed, subroot, lower), above in zip(own, upper):
        for r, path in zip(placed, lower):
            path = path + above
            lowered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            seen = leaf(r, lowered)
            for before, after in path:
                seen = sha(before + seen + after)
            out.append((r["doc_id"], leaf(r), subroot, root, sha("".join(b + a for b, a in path)), seen, seen == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_query_equals_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = merkle.op11_interval_manifest(spark, SMALL)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows)


@pytest.mark.parametrize("rows", [EDGE, [], EDGE[:1], [(k, "X" * (k % 5), "en") for k in range(65)], [(7, "Aa", f"l{k}") for k in range(9)] + [(7, "Aa", "l3")] * 8])
def test_edges(spark, tmp_path, rows):
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_interval_manifest(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force([r.asDict() for r in docs.collect()])


def test_other_fanout_and_kept_columns(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, [(k, str(k), "en" if k % 3 else None) for k in range(40)])
    entries = docs.withColumn("own", merkle.leaf_digest(*(F.col(c) for c in merkle.FIELDS)))
    got = merkle.manifest(entries, "lang", "doc_id", "own", fanout=3).withColumn("top", merkle.folded(F.col("own"), F.col("path"))).collect()
    want = {w[0]: w for w in brute_force([r.asDict() for r in docs.collect()], 3)}
    assert len(got) == 40
    for r in got:
        assert (r.own, r.subroot, r.root, r.top) == (*want[r.doc_id][1:4], r.root) and r.key == 3 and r.label == 8


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError, match="root"):
        merkle.manifest(spark.createDataFrame([], "k long, g string, leaf string, root string"), "g", "k", "leaf")
