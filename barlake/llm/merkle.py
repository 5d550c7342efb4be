"""Merkle manifest of a dataset whose nodes are labelled with nested intervals of leaf ranks.

Leaves have ranks within their group; a node is labelled with the interval of ranks below it. Interval labels make
the tree a table: node x lies below node y if x's interval lies in y's, and what a parent's children have besides
x is the parent's interval less x's own. A level's nodes cover `FANOUT`^level ranks each, so the bucket
lo div FANOUT^level is an equi-join key for the containment.

Up: the children of a bucket are folded to their parent, a level at a time; a group is done when one node covers
all its ranks. The groups' top nodes are the leaves of one more tree. Down: from the top, each node is joined to the
parent that contains it and gets the parent's path with its own siblings put in front. So the long paths are made for
an eighth of the rows at most and meet the leaves once, in the last join.

Ranks come from a range sort and the counts of its partitions, so a group of any size is spread over all tasks; no task
holds more than `FANOUT` nodes of a bucket at once. Each level is written once, an eighth of the level below it. The driver
learns one number, the largest group's size. All of it is done by DataFrame functions.

A null group is a group of its own, the first one; a null key is the least. Rows with equal group, key and leaf are leaves
of their own, next to each other. A leaf alone in its group is the group's top itself. An empty table
gives an empty result. Columns of the documents that are not leaf fields are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import table
from barlake.operators.ordering import with_position
from barlake.session import cut

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """A value with its length in bytes, so that no two lists of values give the same text."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Hex SHA-256 of a row's values."""
    return F.sha2(F.concat(*map(field_text, values)), 256)


def _height(largest: int | None, fanout: int) -> int:
    """Levels above the leaves until one node covers the largest group."""
    height, covered = 0, 1
    while covered < (largest or 0):
        height, covered = height + 1, covered * fanout
    return height


def build(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables of nodes (group, size, lo, hi, digest) by level; those above the leaves list their `kids`.

    leaves: one row per leaf; `size` is the number of leaves of its group and hi is lo + 1.
    """
    levels = [leaves]
    largest = leaves.agg(F.max("size")).first()[0]
    for level in range(1, _height(largest, fanout) + 1):
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        parents = (
            levels[-1]
            .filter(F.col("size") > fanout ** (level - 1))
            .groupBy("group", "size", F.expr(f"lo div {fanout**level}").alias("bucket"))
            .agg(kids.alias("kids"))
            .select("group", "size", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"), "kids")
        )
        levels.append(cut(parents))
    return levels


def paths(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves with their `path`: from each level up to the root, the digests before and after their own node.

    tops: group, path, and what else all leaves of the group are to have (subroot, root).
    """
    carried = [c for c in tops.columns if c not in ("group", "path")]
    above: DataFrame | None = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        is_top = F.col("size") <= fanout**level
        found = nodes.filter(is_top).join(tops, "group")
        if above is not None:
            size = fanout ** (level + 1)
            parent = above.select(
                F.col("group").alias("p_group"),
                F.expr(f"lo div {size}").alias("p_bucket"),
                F.col("lo").alias("p_lo"),
                F.col("hi").alias("p_hi"),
                F.col("kids").alias("p_kids"),
                F.col("path").alias("p_path"),
                *carried,
            )
            inside = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            bucket = F.expr(f"lo div {size}")
            before = F.filter("p_kids", lambda k: k["hi"] <= F.col("lo"))
            after = F.filter("p_kids", lambda k: k["lo"] >= F.col("hi"))
            step = F.struct(F.array_join(before["digest"], "").alias("before"), F.array_join(after["digest"], "").alias("after"))
            below = (
                nodes.filter(~is_top)
                .join(parent, (F.col("group") == F.col("p_group")) & (bucket == F.col("p_bucket")) & inside)
                .select(*nodes.columns, F.concat(F.array(step), "p_path").alias("path"), *carried)
            )
            found = found.select(*below.columns).unionByName(below)
        above = cut(found) if level else found
    return above


def proof_digests(path: Column) -> Column:
    """All sibling digests of a path, level by level and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["before"], own, s["after"]), 256))


def manifest(entries: DataFrame, group: str, key: str, leaf: str, fanout: int = FANOUT) -> DataFrame:
    """The entries with subroot and root of their group's tree and of the whole, and each leaf's `path` to the root.

    Raises ValueError if the entries have columns of these names.
    """
    if clash := {"subroot", "root", "path"} & set(entries.columns):
        raise ValueError(f"the entries have a column {min(clash)}")
    # equal rows are alike for the tree, their number only lets the sort deal them out
    row = F.struct(*entries.columns).alias("row")
    listed = entries.select(row, F.monotonically_increasing_id().alias("tie"))
    order = [F.col(f"row.{group}").asc_nulls_first(), F.col(f"row.{key}").asc_nulls_first(), F.col(f"row.{leaf}"), F.col("tie")]
    placed = with_position(listed, order, "at").select("row", "at", F.col(f"row.{group}").alias("value"))
    sizes = placed.groupBy("value").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    groups = cut(with_position(sizes, [F.col("value").asc_nulls_first()], "group").withColumn("group", F.col("group") - 1))
    lo = F.col("at") - F.col("first")
    leaves = cut(
        placed.join(groups.withColumnRenamed("value", "of"), F.col("value").eqNullSafe(F.col("of"))).select(
            "group", "size", lo.alias("lo"), (lo + 1).alias("hi"), F.col(f"row.{leaf}").alias("digest"), "row"
        )
    )
    trees = build(leaves, fanout)
    subroots = [t.filter((F.col("lo") == 0) & (F.col("hi") == F.col("size"))).select("group", "digest") for t in trees]
    tops = subroots[0]
    for t in subroots[1:]:
        tops = tops.unionByName(t)
    tops = cut(tops)
    n_groups = tops.agg(F.count(F.lit(1)).alias("n_groups"))
    one = tops.crossJoin(F.broadcast(n_groups)).select(F.lit(0).alias("group"), F.col("n_groups").alias("size"), F.col("group").alias("lo"), (F.col("group") + 1).alias("hi"), "digest")
    whole = build(one, fanout)
    no_path = F.array().cast("array<struct<before:string,after:string>>")
    root = whole[-1].select("group", no_path.alias("path"), F.col("digest").alias("root"))
    tops = cut(paths(whole, root, fanout).select(F.col("lo").alias("group"), "path", F.col("digest").alias("subroot"), "root"))
    return paths(trees, tops, fanout).select("row.*", "subroot", "root", "path")


def op11_interval_manifest(spark, sf_dir: str) -> DataFrame:
    """The contract's manifest of all documents, and what proofs say of the tampered third of them."""
    docs = table(spark, sf_dir, "documents")
    as_is = [F.col(c) for c in FIELDS]
    lowered = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    seen = F.when(hit, leaf_digest(*as_is[:-1], lowered)).otherwise(leaf_digest(*as_is))
    entries = docs.select("doc_id", "lang", leaf_digest(*as_is).alias("leaf"), seen.alias("seen"))
    folded_root = folded(F.col("seen"), F.col("path"))
    return (
        manifest(entries, "lang", "doc_id", "leaf")
        .select("doc_id", "leaf", "subroot", "root", F.sha2(proof_digests(F.col("path")), 256).alias("proof_sha256"), folded_root.alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


#: CRC-32 of a text's digits, four bits at a time; the remainders of 0 to 15 follow from the polynomial.
def _crc32_sql(text: str) -> str:
    def remainder(x: int) -> int:
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        return x

    steps = f"[{', '.join(str(remainder(x)) for x in range(16))}]"
    half = "xor({s}[(({a}) & 15)::INT + 1], ({a}) >> 4)"
    first = half.format(s=steps, a="xor(a, b)")
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {half.format(s=steps, a=first)}))"


_SQL_FIELDS = {c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS}
_SQL_LOWERED = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP11_SQL = f"""
WITH RECURSIVE read AS (
  SELECT doc_id, lang, sha256({' || '.join(_SQL_FIELDS.values())}) AS leaf,
    CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 3 = 0
      THEN sha256({' || '.join(_SQL_FIELDS[c] for c in FIELDS[:-1])} || coalesce(strlen({_SQL_LOWERED})::VARCHAR || ':' || {_SQL_LOWERED}, '-')) END AS lowered
  FROM documents
), leaves AS (
  SELECT doc_id, leaf, coalesce(lowered, leaf) AS seen, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
  FROM read
), nodes AS (
  SELECT tree, 0 AS level, rank AS idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS width FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx, digest, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, level, idx // {FANOUT} AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
    FROM nodes WHERE width > 1 GROUP BY tree, level, idx // {FANOUT})
), subroots AS (
  SELECT tree, digest FROM nodes WHERE width = 1
), upper_nodes AS (
  SELECT 0 AS level, tree AS idx, digest, count(*) OVER () AS width FROM subroots
  UNION ALL
  SELECT level + 1, idx, digest, count(*) OVER () FROM (
    SELECT level, idx // {FANOUT} AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
    FROM upper_nodes WHERE width > 1 GROUP BY level, idx // {FANOUT})
), lower_steps AS (
  SELECT l.tree, l.rank, n.level, string_agg(CASE WHEN n.idx = l.rank // ({FANOUT} ** n.level)::BIGINT THEN '*' ELSE n.digest END, '' ORDER BY n.idx) AS step
  FROM leaves l JOIN nodes n ON n.tree = l.tree AND n.width > 1 AND n.idx // {FANOUT} = l.rank // ({FANOUT} ** (n.level + 1))::BIGINT
  GROUP BY ALL
), upper_steps AS (
  SELECT s.tree, n.level, string_agg(CASE WHEN n.idx = s.tree // ({FANOUT} ** n.level)::BIGINT THEN '*' ELSE n.digest END, '' ORDER BY n.idx) AS step
  FROM subroots s JOIN upper_nodes n ON n.width > 1 AND n.idx // {FANOUT} = s.tree // ({FANOUT} ** (n.level + 1))::BIGINT
  GROUP BY ALL
), lower_paths AS (
  SELECT tree, rank, list(step ORDER BY level) AS steps FROM lower_steps GROUP BY ALL
), upper_paths AS (
  SELECT tree, list(step ORDER BY level) AS steps FROM upper_steps GROUP BY ALL
), proofs AS (
  SELECT l.doc_id, l.leaf, l.seen, s.digest AS subroot, (SELECT digest FROM upper_nodes WHERE width = 1) AS root,
    list_concat(coalesce(p.steps, []), coalesce(u.steps, [])) AS steps
  FROM leaves l JOIN subroots s USING (tree) LEFT JOIN lower_paths p USING (tree, rank) LEFT JOIN upper_paths u USING (tree)
), folds AS (
  SELECT *, sha256(replace(array_to_string(steps, ''), '*', '')) AS proof_sha256,
    list_reduce(list_prepend(seen, steps), lambda a, b: sha256(replace(b, '*', a))) AS folded_root
  FROM proofs
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""
