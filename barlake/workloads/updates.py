"""Updates of a committed store: deltas, replays, compaction, pruned upserts, writers side by side."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barlake.errors import CommitError, RefreshError
from barlake.operators import partials as T
from barlake.operators import presence as P
from barlake.operators.quality import stored_rules
from barlake.operators.reports import single
from barlake.plans.backfill import backfill
from barlake.plans.compact import compact
from barlake.plans.refresh import last_days, refresh
from barlake.plans.window import upsert_window
from barlake.schema import BAR_COLUMNS
from barlake.session import scratch
from barlake.sinks.bars import observed_violations
from barlake.sinks.layout import publish_years
from barlake.sinks.reports import write_csv
from barlake.sinks.snapshots import BarStore
from barlake.sources.files import qualified, stored_codecs
from barlake.sources.filestream import FileDigests
from barlake.sources.prices import staged_violations
from barlake.streaming.refresh_stream import apply_batch, bar_stream, refresh_stream
from barlake.workloads import coverage as WC
from barlake.workloads import inputs as I
from barlake.workloads.barops import BAR
from barlake.workloads.jobs import DATA_START, no_attempts, refreshed_store
from barlake.workloads.registry import query

FAR = dt.date(2100, 1, 1)


def based_store(spark, path, bars):
    """A store whose first version has the given bars, listed by file."""
    store = BarStore(spark, path)
    store.stage("base", bars)
    counts: dict[int, int] = {}
    for f in store.stage_files("base", []):
        counts[f.year] = counts.get(f.year, 0) + f.row_count
    store.commit("base", counts, deltas=dict.fromkeys(counts, 0))
    return store


def arriving(store):
    """Changed closes of a part of the store's bars of two years, and bars of tickers that it does not have."""
    recent = store.bars([2000, 2001]).where("volume > 40")
    changed = recent.withColumn("close", F.col("close") * 2)
    added = recent.where("volume > 45").withColumn("ticker", F.concat(F.lit("N"), "ticker"))
    return changed.unionByName(added).select(*BAR_COLUMNS)


#: What `arriving` makes of the bars.
ARRIVED = """SELECT date, ticker, CASE WHEN year(date) IN (2000, 2001) AND volume > 40 THEN close * 2 ELSE close END AS close, adj_close, volume FROM bars
       UNION ALL SELECT date, 'N' || ticker, close, adj_close, volume FROM bars WHERE year(date) IN (2000, 2001) AND volume > 45"""


def delta_store(spark, sf):
    """All bars, and the arriving ones streamed in by batches of one file."""

    def write(path):
        store = based_store(spark, f"{path}/store", I.bars(spark, sf))
        arriving(store).repartition(3, "ticker").write.parquet(f"{path}/arriving")
        source = bar_stream(spark, f"{path}/arriving", maxFilesPerTrigger="1")
        refresh_stream(source, store, f"{path}/checkpoint", refresh_start=dt.date(1990, 1, 1), end=FAR).awaitTermination()

    return BarStore(spark, I.once(spark, sf, "deltas", write) + "/store")


@query("t1_delta_stream", f"SELECT {BAR}, CAST(year(date) AS INTEGER) AS year FROM ({ARRIVED})")
def t1_delta(spark, sf):
    return delta_store(spark, sf).at(4).bars()


@query(
    "t1_delta_commits",
    f"""SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS row_count, CAST(CASE WHEN year(date) >= 2000 AND year(date) < 2002 THEN 3 ELSE 0 END AS BIGINT) AS deltas
       FROM ({ARRIVED}) GROUP BY year(date)""",
)
def t1_commits(spark, sf):
    """Row counts that the commits of the batches kept without reading the years."""
    return delta_store(spark, sf).at(4).current().where("year IS NOT NULL").select("year", "row_count", "deltas")


@query("t1_after_compaction", f"SELECT {BAR}, CAST(year(date) AS INTEGER) AS year, CAST(0 AS BIGINT) AS deltas FROM ({ARRIVED})")
def t1_compacted(spark, sf):
    store = delta_store(spark, sf)
    compact(store)
    left = store.current().where("year IS NOT NULL").select("year", "deltas")
    return store.bars().join(left, "year").select(*BAR_COLUMNS, "year", "deltas")


@query(
    "t3_replayed_batch",
    f"""SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS row_count, sum(close) > 0 AS priced, CAST(2 AS BIGINT) AS version, CAST(0 AS BIGINT) AS new_files
       FROM ({ARRIVED}) GROUP BY year(date)""",
)
def t3_replayed(spark, sf):
    """The same batch delivered twice: version and file list after the second are those after the first."""

    def write(path):
        store = based_store(spark, path, I.bars(spark, sf))
        batch = arriving(store)
        apply_batch(store, batch, 7, dt.date(1990, 1, 1), FAR)
        before = {(f.snapshot, f.year, f.name) for f in store.files()}
        apply_batch(store, batch.withColumn("close", -F.col("close")), 7, dt.date(1990, 1, 1), FAR)
        after = {(f.snapshot, f.year, f.name) for f in store.files()}
        spark.createDataFrame([(len(after ^ before),)], "new_files long").write.parquet(f"{path}/seen")

    store = BarStore(spark, I.once(spark, sf, "replayed", write))
    per_year = store.bars().groupBy("year").agg(F.count(F.lit(1)).alias("row_count"), (F.sum("close") > 0).alias("priced"))
    return per_year.withColumn("version", F.lit(store.version()).cast("bigint")).join(spark.read.parquet(f"{store.root}/seen"), F.lit(True))


@query("j4_pruned_upsert", f"SELECT {BAR}, CAST(year(date) AS INTEGER) AS year FROM ({ARRIVED})")
def j4_pruned(spark, sf):
    """The arriving bars merged into the files that their days touch."""

    def write(path):
        store = based_store(spark, path, I.bars(spark, sf))
        upsert_window(store, arriving(store))

    return BarStore(spark, I.once(spark, sf, "pruned", write)).bars()


def changed_year(spark, sf, year, factor):
    return I.bars(spark, sf).where(F.year("date") == year).withColumn("close", F.col("close") * factor)


@query(
    "k6_disjoint_writers",
    """SELECT date, ticker, CASE year(date) WHEN 1999 THEN close * 2 WHEN 2000 THEN close * 3 ELSE close END AS close, CAST(year(date) AS INTEGER) AS year FROM bars""",
)
def k6_disjoint(spark, sf):
    """Two writers begin from the same version and change different years; both commits hold."""

    def write(path):
        store = based_store(spark, path, I.bars(spark, sf))
        one, two = store.at(), store.at()
        for writer, name, year, factor in ((one, "one", 1999, 2), (two, "two", 2000, 3)):
            rows = writer.stage(name, changed_year(spark, sf, year, factor))
            writer.commit(name, {year: rows.count()})

    return BarStore(spark, I.once(spark, sf, "disjoint", write)).bars().select("date", "ticker", "close", "year")


@query(
    "k6_conflicting_writers",
    """SELECT date, ticker, CASE year(date) WHEN 2000 THEN close * 2 ELSE close END AS close, 'changed since version 1: year 2000' AS refused FROM bars""",
)
def k6_conflict(spark, sf):
    """Two writers begin from the same version and change the same year; the later one is refused."""

    def write(path):
        store = based_store(spark, path, I.bars(spark, sf))
        one, two = store.at(), store.at()
        said = ""
        for writer, name, factor in ((one, "one", 2), (two, "two", 3)):
            rows = writer.stage(name, changed_year(spark, sf, 2000, factor))
            try:
                writer.commit(name, {2000: rows.count()})
            except CommitError as exc:
                said = str(exc)
        spark.createDataFrame([(said,)], "refused string").write.parquet(f"{path}/said")

    store = BarStore(spark, I.once(spark, sf, "conflict", write))
    return store.bars().select("date", "ticker", "close").join(spark.read.parquet(f"{store.root}/said"), F.lit(True))


def presence_store(spark, sf):
    """Bitmaps of the old bars kept as a table, and merged with those of the new bars."""

    def write(path):
        store = BarStore(spark, path)
        store.stage_table("old", "presence", P.presence(I.old_bars(spark, sf)))
        store.commit("old", {}, ["presence"])
        store.stage_table("new", "presence", P.merged(store.table("presence"), P.presence(I.new_bars(spark, sf))))
        store.commit("new", {}, ["presence"])

    return BarStore(spark, I.once(spark, sf, "presence", write))


@query("j8_bitmap_active", "SELECT ticker FROM active")
def j8_bitmap(spark, sf):
    """Tickers seen on the last sessions, from the bitmaps that were kept before the refresh."""
    return P.active_on(presence_store(spark, sf).at(1).table("presence"), I.parts(spark, sf), last_days(I.sessions(spark, sf), I.TARGET))


@query(
    "a7_bitmap_coverage",
    """SELECT count(*) AS expected_count, count(p.ticker) AS present_count, round(count(p.ticker) / count(*), 6) AS coverage_ratio
       FROM active a LEFT JOIN present p ON p.ticker = a.ticker""",
)
def a7_bitmap(spark, sf):
    store = presence_store(spark, sf)
    ratio = P.share_on(store.at(2).table("presence"), j8_bitmap(spark, sf), I.TARGET)
    return ratio.withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query("a1_bitmap_day_counts", "SELECT ticker, count(*) AS row_count FROM (SELECT date, ticker FROM old_bars UNION SELECT date, ticker FROM new_bars) GROUP BY ticker")
def a1_bitmap(spark, sf):
    return P.day_counts(presence_store(spark, sf).at(2).table("presence"))


@query(
    "k3_observed_sink",
    """SELECT * FROM (SELECT unnest([{'rule': 'close_not_positive_finite', 'n': (SELECT count(*) FROM bars WHERE volume > 40)},
         {'rule': 'date_out_of_range', 'n': (SELECT count(*) FROM bars WHERE date < DATE '1995-07-01' OR date >= DATE '2001-07-01')}], recursive := true)) WHERE n > 0""",
)
def k3_observed(spark, sf):
    """What the write of spoilt bars counted; no second pass reads them."""
    spoilt = I.bars(spark, sf).withColumn("close", F.when(F.col("volume") > 40, -F.col("close")).otherwise(F.col("close")))
    store = BarStore(spark, scratch(spark, "k3-observed"))
    _, seen = store.stage_observed("s", spoilt, stored_rules(I.START, I.END))
    return observed_violations(spark, seen).select("rule", "n")


@query(
    "s8_batch_violations",
    """SELECT * FROM (
         SELECT 'batch=1' AS batch, 'close_not_positive_finite' AS rule, count(*) AS n FROM bars WHERE volume > 40
         UNION ALL SELECT 'batch=1', 'duplicate_key', count(*) FROM bars WHERE volume > 45
         UNION ALL SELECT 'batch=0', 'date_out_of_range', count(*) FROM bars WHERE date < DATE '1995-07-01' OR date >= DATE '2001-07-01'
         UNION ALL SELECT 'batch=1', 'date_out_of_range', count(*) FILTER (WHERE volume > 40) + count(*) FILTER (WHERE volume > 45) FROM bars WHERE date < DATE '1995-07-01' OR date >= DATE '2001-07-01'
         UNION ALL SELECT 'batch=1', 'unexpected_ticker', 0) WHERE n > 0""",
)
def s8_violations(spark, sf):
    """A sound batch and one with bad closes and repeats, each judged by itself."""

    def write(path):
        raw = I.bars(spark, sf).select(*BAR_COLUMNS)
        raw.write.parquet(f"{path}/batch=0")
        bad = raw.where("volume > 40").withColumn("close", -F.col("close"))
        bad.unionByName(raw.where("volume > 45").withColumn("close", F.lit(1.0))).write.parquet(f"{path}/batch=1")

    path = I.once(spark, sf, "staged-bad", write)
    known = I.bars(spark, sf).select("ticker").distinct()
    return staged_violations(spark, [f"{path}/batch=0", f"{path}/batch=1"], I.START, I.END, known)


@query(
    "k4_written_csv",
    """SELECT ticker, status, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, CAST(row_count AS VARCHAR) AS row_count,
         CAST(attempt_count AS VARCHAR) AS attempt_count, nullif(last_error, '') AS last_error FROM coverage""",
)
def k4_written(spark, sf):
    """The coverage report as its CSV file has it, cell by cell."""
    path = scratch(spark, "k4")
    write_csv(WC.coverage(spark, sf), path, ["ticker"])
    return spark.read.csv(path, header=True, escape='"')


@query(
    "k8_refused_refresh",
    """SELECT (SELECT count(*) FROM active) AS expected_count, (SELECT count(*) FROM active WHERE ticker IN (SELECT ticker FROM present)) AS present_count,
         (SELECT count(*) FROM active WHERE ticker NOT IN (SELECT ticker FROM present)) AS missing, CAST(1 AS BIGINT) AS version
       WHERE (SELECT count(*) FROM active WHERE ticker NOT IN (SELECT ticker FROM present)) > 0""",
)
def k8_refused(spark, sf):
    """A refresh whose coverage gate asks for all tickers: it refuses, says why, and leaves the store as it was."""

    def write(path):
        universe, store = I.parts(spark, sf), BarStore(spark, path)
        backfill(store, universe, I.old_bars(spark, sf), no_attempts(spark, universe), DATA_START, I.OLD_END, allow_no_data=True)
        try:
            refresh(store, universe, I.new_bars(spark, sf), no_attempts(spark, universe), I.sessions(spark, sf), I.TARGET, minimum_coverage=1.0)
        except RefreshError:
            return
        raise AssertionError("the coverage gate let a refresh with missing tickers pass")

    store = BarStore(spark, I.once(spark, sf, "refused-refresh", write))
    ratio = spark.read.parquet(f"{store.root}/diagnostics/*/coverage_ratio").select("expected_count", "present_count")
    missing = spark.read.parquet(f"{store.root}/diagnostics/*/update_missing").agg(F.count(F.lit(1)).alias("missing"))
    return single(ratio, missing).withColumn("version", F.lit(store.version()).cast("bigint"))


@query(
    "q6_coverage_states",
    """SELECT p.ticker, CASE WHEN p.ticker IN (SELECT ticker FROM old_bars UNION ALL SELECT ticker FROM new_bars) THEN 'success' ELSE 'no_data' END AS status,
         CAST(2 AS BIGINT) AS attempt_count, p.ticker IN (SELECT ticker FROM new_bars) AS last_run_succeeded FROM parts p""",
)
def q6_states(spark, sf):
    """Status, attempts and last error of the refreshed store's coverage."""
    found = refreshed_store(spark, sf).table("coverage")
    return found.select("ticker", "status", "attempt_count", (F.col("last_error") == "").alias("last_run_succeeded"))


def kept_partials(spark, sf):
    """Rows and bounds per ticker and year of the old bars, and the same after the new bars were merged."""

    def write(path):
        T.partials(I.old_bars(spark, sf)).write.parquet(f"{path}/old")
        replaced = I.old_bars(spark, sf).join(I.new_bars(spark, sf).select("date", "ticker"), ["date", "ticker"], "left_semi")
        T.updated(spark.read.parquet(f"{path}/old"), replaced, I.new_bars(spark, sf)).write.parquet(f"{path}/new")

    return spark.read.parquet(I.once(spark, sf, "partials", write) + "/new")


KEYS_AFTER = "SELECT date, ticker FROM old_bars UNION SELECT date, ticker FROM new_bars"


@query(
    "a19_from_partials",
    f"SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS row_count, min(date) AS min_date, max(date) AS max_date FROM ({KEYS_AFTER}) GROUP BY 1",
)
def a19_partials(spark, sf):
    return T.years_of(kept_partials(spark, sf))


@query(
    "j7_coverage_from_partials",
    f"SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS row_count FROM ({KEYS_AFTER}) GROUP BY ticker",
)
def j7_partials(spark, sf):
    return T.ranges_of(kept_partials(spark, sf))


@query(
    "s15_streamed_inventory",
    """SELECT CAST(c_nationkey AS VARCHAR) AS nation, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size_bytes,
         sha256(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha256 FROM customer GROUP BY c_nationkey""",
)
def s15_streamed(spark, sf):
    """The nations' files in ranges of 64 bytes, at most 1,000 bytes of files to a task."""

    def write(path):
        names = I.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value"))
        names.repartition("nation").sortWithinPartitions("nation", "value").write.partitionBy("nation").text(path)

    root = I.once(spark, sf, "names", write)
    spark.dataSource.register(FileDigests)
    found = spark.read.format(FileDigests.name()).option("rangeBytes", 64).option("partitionBytes", 1000).load(qualified(spark, root))
    return found.select(F.regexp_extract("local_path", r"nation=(\d+)", 1).alias("nation"), "size_bytes", "sha256")


@query("s16_published_codecs", "SELECT CAST(year(date) AS VARCHAR) AS year, 'ZSTD' AS codec, count(*) AS row_count FROM bars GROUP BY 1")
def s16_published(spark, sf):
    """Codecs of published years, whose names do not tell them."""
    path = I.once(spark, sf, "published", lambda p: publish_years(I.bars(spark, sf), p))
    per = stored_codecs(spark, f"{path}/daily").groupBy(F.regexp_extract("file", r"year=(\d+)", 1).alias("year"))
    return per.agg(F.max("codec").alias("codec"), F.sum("row_count").alias("row_count"))
