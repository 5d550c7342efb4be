"""Manifests, file inventories, copies and identities as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.numbers import variant_at, variant_text
from barlake.operators.gates import counted, gather, sampled
from barlake.schema import AUXILIARY_ASSETS, IDENTITY_FIELDS, MANIFEST_ASSET, SCHEMA_VERSION, SOURCE_NAME

DIGEST = r"\A[0-9a-f]{64}\z"
YEAR_KEY = r"\A[0-9]+\z"
PARTS_PER_NODE = 1000
ISO_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
ZONED_INSTANT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(?:Z|[+-][0-9]{2}:?[0-9]{2})\z"


def _is_year(key: Column) -> Column:
    return key.rlike(YEAR_KEY)


def expected_asset_name(key: Column) -> Column:
    rule = F.when(_is_year(key), F.concat(F.lit("prices-year-"), key, F.lit(".parquet")))
    for k, (name, _) in AUXILIARY_ASSETS.items():
        rule = rule.when(key == k, name)
    return rule


def expected_local_path(key: Column) -> Column:
    rule = F.when(_is_year(key), F.concat(F.lit("daily/year="), key, F.lit("/prices.parquet")))
    for k, (_, path) in AUXILIARY_ASSETS.items():
        rule = rule.when(key == k, path)
    return rule


def asset_key(local_path: Column) -> Column:
    """The manifest key a managed path belongs to, NULL for anything unmanaged."""
    year = F.nullif(F.regexp_extract(local_path, r"\Adaily/year=([0-9]+)/[^/]+\.parquet\z", 1), F.lit(""))
    rule = F.when(year.isNotNull(), year)
    for k, (_, path) in AUXILIARY_ASSETS.items():
        rule = rule.when(local_path == path, k)
    return rule


def part_tree(parts: DataFrame) -> DataFrame:
    """(key, size_bytes, sha256, n_parts) of years from parts(key, n, local_path, size_bytes, sha256), n counting from 0.

    The digest is that of a tree: lines of path, size and digest of some `PARTS_PER_NODE` parts are hashed to a node, the nodes in
    order to the year's digest. No row holds more than one node's lines or one year's nodes.
    """
    line = F.concat_ws(" ", "local_path", F.col("size_bytes").cast("string"), "sha256")
    own = F.struct("n", line.alias("line"))
    nodes = parts.groupBy("key", F.expr(f"n div {PARTS_PER_NODE}").alias("node")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(own))["line"], "\n"), 256).alias("digest"),
        F.sum("size_bytes").alias("size"),
        F.count(F.lit(1)).alias("parts"),
    )
    return nodes.groupBy("key").agg(
        F.sum("size").alias("size_bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("node", "digest")))["digest"], "\n"), 256).alias("sha256"),
        F.sum("parts").alias("n_parts"),
    )


def index_assets(inventory: DataFrame) -> DataFrame:
    """Asset rows of the managed files in an inventory(local_path, size_bytes, sha256).

    A year of one file is that file. A year of several is its folder with the tree digest of its parts, which are listed in
    `parts` in the order of their names. The window runs within one year over its file list, not over rows of data.
    """
    keyed = inventory.withColumn("key", asset_key(F.col("local_path"))).where("key IS NOT NULL")
    in_year = Window.partitionBy("key")
    numbered = keyed.withColumns({"n": F.row_number().over(in_year.orderBy("local_path")) - 1, "files": F.count(F.lit(1)).over(in_year)})
    name = expected_asset_name(F.col("key")).alias("asset_name")
    part = F.struct("local_path", "size_bytes", "sha256")
    single = numbered.where("files = 1").select("key", name, "local_path", "size_bytes", "sha256", F.lit(None).cast("array<struct<local_path:string,size_bytes:bigint,sha256:string>>").alias("parts"))
    several = numbered.where("files > 1")
    listed = several.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", part.alias("part"))))["part"].alias("parts"))
    trees = part_tree(several).join(listed, "key")
    return single.unionByName(trees.select("key", name, year_folder(F.col("key")).alias("local_path"), "size_bytes", "sha256", "parts"))


def year_folder(key: Column) -> Column:
    return F.concat(F.lit("daily/year="), key)


def asset_files(assets: DataFrame, parts: DataFrame) -> DataFrame:
    """The files to hold: assets that are files, and the parts of the years that have some."""
    name = F.concat(F.lit("prices-year-"), "key", F.lit("-"), F.lpad(F.col("n").cast("string"), 5, "0"), F.lit(".parquet"))
    columns = ["key", "asset_name", "local_path", "size_bytes", "sha256"]
    whole = assets.join(parts.select("key").distinct(), "key", "left_anti")
    return whole.select(*columns).unionByName(parts.withColumn("asset_name", name).select(*columns))


def part_violations(assets: DataFrame, parts: DataFrame) -> DataFrame:
    """Years stored in parts: the folder and its parts belong together, part names count from 0, and size and digest of the year follow from them."""
    rules = {
        "part_name": F.col("local_path") != F.concat(year_folder(F.col("key")), F.lit("/part-"), F.lpad(F.col("n").cast("string"), 5, "0"), F.lit(".parquet")),
        "part_digest_format": ~F.lower("sha256").rlike(DIGEST),
        "part_size": F.col("size_bytes") < 0,
    }
    tree = part_tree(parts).select("key", F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"), "n_parts")
    folders = assets.where(F.col("local_path") == year_folder(F.col("key"))).select("key", "size_bytes", "sha256", F.lit(True).alias("_folder"))
    both = folders.join(tree, "key", "full")
    differs = both.where(F.coalesce((F.col("size_bytes") != F.col("_size")) | (F.col("sha256") != F.col("_sha")) | (F.col("n_parts") < 2), F.lit(True)))
    return gather(counted(parts, rules), sampled(differs, "part_tree", F.col("key")))


def reconcile(assets: DataFrame, inventory: DataFrame, *, force: bool = False, years: list[int] | None = None, auxiliary: list[str] | None = None) -> DataFrame:
    """Per manifest asset: download when missing, different or forced, else unchanged."""
    chosen = assets
    if years is not None:
        chosen = chosen.where(
            F.when(_is_year(F.col("key")), F.col("key").try_cast("int").isin(list(years))).otherwise(
                F.col("key").isin(list(auxiliary or []))
            )
        )
    local = inventory.select(
        "local_path", F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha")
    )
    same = (F.col("size_bytes") == F.col("_size")) & (F.col("sha256") == F.col("_sha"))
    keep = F.coalesce(same, F.lit(False)) & F.lit(not force)
    return chosen.join(local, "local_path", "left").select(
        "key", "asset_name", "local_path", F.when(keep, "unchanged").otherwise("download").alias("action")
    )


def asset_actions(plan: DataFrame) -> DataFrame:
    """(key, action) per manifest asset: a year in parts is to be fetched if any of them is."""
    fetched = F.bool_or(F.col("action") == "download")
    return plan.groupBy("key").agg(F.when(fetched, "download").otherwise("unchanged").alias("action"))


def missing_and_obsolete(managed: DataFrame, present: DataFrame, name: str = "asset_name") -> DataFrame:
    """Names only on one side: missing (managed, absent) or obsolete (present, unmanaged)."""
    missing = managed.select(name).distinct().join(present.select(name), name, "left_anti")
    obsolete = present.select(name).distinct().join(managed.select(name), name, "left_anti")
    return missing.withColumn("state", F.lit("missing")).unionByName(obsolete.withColumn("state", F.lit("obsolete")))


def publication_order(assets: DataFrame) -> DataFrame:
    """Years ascending, auxiliaries in their fixed order, the manifest last.

    The window runs over one dataset's file list.
    """
    aux = F.create_map(*[F.lit(x) for i, k in enumerate(AUXILIARY_ASSETS) for x in (k, i)])
    listed = assets.select("key", "asset_name", "local_path").unionByName(
        assets.sparkSession.createDataFrame([("manifest", *MANIFEST_ASSET)], "key string, asset_name string, local_path string")
    )
    kind = F.when(_is_year(F.col("key")), 0).when(F.col("key") == "manifest", 2).otherwise(1)
    minor = F.coalesce(F.col("key").try_cast("int"), aux[F.col("key")])
    order = Window.orderBy("_kind", "_minor", "local_path")
    return (
        listed.withColumns({"_kind": kind, "_minor": minor})
        .withColumn("publish_order", F.row_number().over(order).cast("bigint"))
        .drop("_kind", "_minor")
    )


def identity_of(manifest: DataFrame, record: str = "manifest") -> DataFrame:
    """The four identity fields of a VARIANT manifest as text."""
    return manifest.select(
        *[F.try_variant_get(F.col(record), f"$.{f}", "string").alias(f) for f in IDENTITY_FIELDS]
    )


def identity_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Field by field: rows where the two one-row identities differ."""
    def tall(df: DataFrame, value: str) -> DataFrame:
        as_text = df.select(*[F.col(f).cast("string").alias(f) for f in IDENTITY_FIELDS])
        return as_text.unpivot([], IDENTITY_FIELDS, "field", value)

    return (
        tall(expected, "expected")
        .join(tall(actual, "actual"), "field")
        .where(~F.col("expected").eqNullSafe(F.col("actual")))
    )


def identity_violations(expected: DataFrame, actual: DataFrame) -> DataFrame:
    label = F.format_string("%s: %s<>%s", "field", "expected", "actual")
    return sampled(identity_differences(expected, actual), "identity", label)


def asset_violations(assets: DataFrame) -> DataFrame:
    """Key -> name -> path rule, digest and size of each asset; unique names and paths.

    `kind` is the JSON kind of size_bytes as written, so that true or 1.0 do not pass for 1.
    """
    key = F.col("key")
    rules = {
        "unsupported_key": expected_asset_name(key).isNull(),
        "asset_name_rule": F.col("asset_name") != expected_asset_name(key),
        "local_path_rule": (F.col("local_path") != expected_local_path(key)) & ~(_is_year(key) & (F.col("local_path") == year_folder(key))),
        "digest_format": ~F.lower("sha256").rlike(DIGEST),
        "size_negative": F.col("size_bytes") < 0,
    }
    if "kind" in assets.columns:
        rules["size_not_integer"] = F.col("kind") != "BIGINT"
    known = {n: F.when(expected_asset_name(key).isNull() & F.lit(n != "unsupported_key"), F.lit(False)).otherwise(r) for n, r in rules.items()}
    repeats = [
        sampled(assets.groupBy(c).count().where("count > 1"), f"duplicate_{c}", F.col(c))
        for c in ("asset_name", "local_path")
    ]
    return gather(counted(assets, known), *repeats)


def manifest_violations(manifest: DataFrame, assets: DataFrame, counts: DataFrame, record: str = "manifest") -> DataFrame:
    """The manifest as a whole: version, dates, totals, and years agreeing with the assets.

    manifest is one VARIANT row; assets and counts are sources.manifest.asset_rows and
    partition_counts of it.
    """
    m = F.col(record)

    def text(name: str) -> Column:
        return variant_text(m, f"$.{name}")

    def whole(name: str) -> Column:
        v = variant_at(m, f"$.{name}")
        return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))

    def day(name: str) -> Column:
        return F.when(text(name).rlike(ISO_DATE), text(name).try_cast("date"))

    completed = F.coalesce(F.when(F.schema_of_variant(variant_at(m, "$.completed")) == "BOOLEAN", F.try_variant_get(m, "$.completed", "boolean")), F.lit(False))
    facts = manifest.select(
        text("schema_version").alias("version"),
        text("source").alias("source"),
        completed.alias("completed"),
        text("universe_sha256").alias("digest"),
        whole("universe_ticker_count").alias("tickers"),
        day("requested_start").alias("start"),
        day("latest_session").alias("latest"),
        day("actual_min_date").alias("lo"),
        day("actual_max_date").alias("hi"),
        text("last_successful_update_utc").alias("updated"),
        whole("total_row_count").alias("total"),
    )
    years = counts.agg(
        F.count(F.lit(1)).alias("n_years"),
        F.sum("n").alias("rows"),
        F.min(F.col("year").try_cast("int")).alias("first_year"),
        F.count_if(~_is_year(F.col("year")) | F.col("n").isNull() | (F.col("n") < 0)).alias("bad_counts"),
    )
    both = facts.join(years, F.lit(True))
    year_sets = (
        assets.where(_is_year(F.col("key"))).select(F.col("key").alias("year"), F.lit(1).alias("a"), F.lit(0).alias("c"))
        .unionByName(counts.select("year", F.lit(0).alias("a"), F.lit(1).alias("c")))
        .groupBy("year").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
        .where("a = 0 OR c = 0")
    )
    has_coverage = assets.agg(F.count_if(F.col("key") == "ticker_coverage").alias("n"))
    return gather(
        counted(
            both,
            {
                "schema_version": F.col("version") != SCHEMA_VERSION,
                "not_completed": ~F.col("completed"),
                "source": F.col("source") != SOURCE_NAME,
                "universe_digest": ~F.lower("digest").rlike(DIGEST),
                "universe_ticker_count": F.col("tickers") <= 0,
                "requested_start": F.col("start").isNull(),
                "latest_session": F.col("latest").isNull(),
                "date_bounds": (F.col("lo") < F.col("start")) | (F.col("lo") > F.col("hi")) | (F.col("hi") != F.col("latest")),
                "last_update_instant": ~F.col("updated").rlike(ZONED_INSTANT),
                "total_row_count": F.col("total") < 0,
                "partition_counts": (F.col("n_years") == 0) | (F.col("bad_counts") > 0),
                "total_mismatch": F.col("rows") != F.col("total"),
                "year_before_start": F.col("first_year") < F.year("start"),
            },
        ),
        sampled(year_sets, "year_assets_mismatch", F.col("year")),
        counted(has_coverage, {"no_ticker_coverage": F.col("n") == 0}),
        asset_violations(assets),
    )


def update_report_violations(report: DataFrame, manifest: DataFrame, assets: DataFrame) -> DataFrame:
    """The last update's report against the manifest that manages it.

    report(success, run_id, target_session, years array<int>, changed array<string>) and
    manifest(run_id, latest_session, requested_start) are one-row tables.
    """
    m = manifest.select(
        F.col("run_id").alias("m_run"), F.col("latest_session").alias("m_latest"), F.col("requested_start").alias("m_start")
    )
    joined = report.join(m, F.lit(True))
    paths = F.concat(
        F.transform("years", lambda y: F.concat(F.lit("daily/year="), y.cast("string"), F.lit("/prices.parquet"))),
        F.array(*[F.lit(AUXILIARY_ASSETS[k][1]) for k in ("ticker_coverage", "update_missing_tickers", "update_report")], F.lit(MANIFEST_ASSET[1])),
    )
    listed = report.select(F.explode("years").alias("year")).select(F.col("year").cast("string").alias("key"))
    unmanaged = listed.join(assets.select("key"), "key", "left_anti")
    return gather(
        counted(
            joined,
            {
                "not_successful": ~F.col("success"),
                "run_id": (F.col("run_id") == "") | (F.col("run_id") != F.col("m_run")),
                "target_session": F.col("target_session") != F.col("m_latest"),
                "years_not_sorted_unique": (F.size("years") == 0) | (F.col("years") != F.array_sort(F.array_distinct("years"))),
                "year_before_start": F.array_min("years") < F.year("m_start"),
                "changed_list": F.col("changed") != paths,
            },
        ),
        sampled(unmanaged, "unmanaged_year", F.col("key")),
    )
