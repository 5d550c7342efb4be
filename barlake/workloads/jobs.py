"""The user-facing jobs and the stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barlake.errors import IncompleteError
from barlake.operators.inventory import asset_actions, asset_files, reconcile, update_report_violations
from barlake.operators.reports import single
from barlake.plans.accept import accept_dataset
from barlake.plans.backfill import backfill, export_dataset
from barlake.plans.clean import clean_bars, clean_wide
from barlake.plans.reconcile import reconcile_copies
from barlake.plans.refresh import refresh
from barlake.plans.universe import (
    build_from_files,
    build_universe,
    publish_universe,
    qualify_candidates,
    read_progressively,
    validate_universe,
)
from barlake.session import cut, scratch
from barlake.sinks.layout import publish_years
from barlake.sinks.snapshots import BarStore
from barlake.sources.directory import raw_record_count
from barlake.sources.manifest import asset_rows, part_rows, read_manifest
from barlake.streaming.refresh_stream import bar_stream, refresh_stream, split_late
from barlake.workloads import inputs as I
from barlake.workloads import securities as WSec
from barlake.workloads import storage as WS
from barlake.workloads.barops import BAR
from barlake.workloads.registry import query


@query("q1_clean_bars", "SELECT date, ticker, close, adj_close, volume FROM folded WHERE NOT conflict")
def q1(spark, sf):
    return clean_bars(I.parsed(I.dirty_text(spark, sf)), I.START, I.END).bars


@query(
    "q1_clean_outcomes",
    """SELECT p.ticker, CASE WHEN c > 0 THEN 'failed' WHEN n > 0 THEN 'success' WHEN bad > 0 THEN 'failed' ELSE 'no_data' END AS outcome,
         CASE WHEN c > 0 THEN 'DataConflictError' WHEN n > 0 THEN '' WHEN bad > 0 THEN 'InvalidData' ELSE 'NoData' END AS error_type,
         coalesce(n, 0) AS row_count, coalesce(bad, 0) AS invalid_rows
       FROM (SELECT ticker FROM parts UNION ALL SELECT ticker FROM users) p
       LEFT JOIN (SELECT ticker, count(*) FILTER (WHERE NOT conflict) AS n, count(*) FILTER (WHERE conflict) AS c FROM folded GROUP BY ticker) f ON f.ticker = p.ticker
       LEFT JOIN (SELECT ticker, count(*) AS bad FROM judged WHERE NOT ok GROUP BY ticker) j ON j.ticker = p.ticker""",
)
def q1_outcomes(spark, sf):
    requested = I.parts(spark, sf).select("ticker").unionByName(I.users(spark, sf).select("ticker"))
    return clean_bars(I.dirty(spark, sf), I.START, I.END, requested).outcomes


@query(
    "q1_clean_wide",
    """SELECT * FROM (SELECT l_returnflag AS ticker, 'success' AS outcome, '' AS error_type, count(DISTINCT l_shipdate) AS row_count,
         (SELECT count(DISTINCT l_shipdate) FROM lineitem) - count(DISTINCT l_shipdate) AS invalid_rows FROM lineitem GROUP BY l_returnflag
       UNION ALL SELECT 'Q', 'failed', 'MissingFields', 0, 0 UNION ALL SELECT 'ZZ', 'no_data', 'NoData', 0, 0)""",
)
def q1_wide(spark, sf):
    cleaned = clean_wide(WS.wide(spark, sf), ["A", "N", "R", "Q", "ZZ"], dt.date(1995, 1, 1), dt.date(2002, 1, 1))
    return cleaned.outcomes


@query("q2_qualify_candidates", "SELECT ord, ticker, company_name, security_name, market_cap, yahoo_exchange, listing_exchange, quote_type FROM candidates")
def q2(spark, sf):
    return qualify_candidates(I.feed(spark, sf), I.directory(spark, sf), I.manual(spark, sf)).candidates


#: A universe size that the smallest tables' feed can fill.
JOB_SIZE = 15


@query(
    "q3_build_universe",
    f"SELECT ticker, company_name, market_cap, market_cap_rank FROM selected WHERE market_cap_rank <= {JOB_SIZE}",
)
def q3(spark, sf):
    store = BarStore(spark, scratch(spark, "universe"))
    built = build_universe(
        I.feed(spark, sf), I.directory(spark, sf), raw_record_count(I.combined_directory(spark, sf)), I.manual(spark, sf), JOB_SIZE
    )
    publish_universe(store, "u1", built)
    return store.table("universe")


@query(
    "q3_build_from_files",
    f"SELECT ticker, company_name, market_cap, market_cap_rank FROM selected WHERE market_cap_rank <= {JOB_SIZE}",
)
def q3_files(spark, sf):
    """Both directories, full pages of the feed and the exclusion list as files; all pages count."""
    every = 2**30
    pages = WSec.full_pages(spark, sf)
    folder = I.once(spark, sf, "page-files", lambda path: pages.write.partitionBy("page").text(path))
    built = build_from_files(
        spark,
        I.once(spark, sf, "listing-a", lambda path: I.listed_a(spark, sf).write.option("sep", "|").option("header", "true").csv(path)),
        I.once(spark, sf, "listing-b", lambda path: I.listed_b(spark, sf).write.option("sep", "|").option("header", "true").csv(path)),
        folder,
        I.once(spark, sf, "exclusions", lambda path: I.manual(spark, sf).select(F.col("ticker").alias("value")).write.text(path)),
        size=JOB_SIZE,
        target=every,
        max_candidates=every,
    )
    return built.universe.select("ticker", "company_name", "market_cap", "market_cap_rank")


#: How many securities the paged read looks for; the smallest tables' feed has them before its last page.
READ_TARGET = 12


@query(
    "o6_progressive_pages",
    f"""SELECT * FROM (WITH placed AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS place FROM feed f),
       paged AS (SELECT place // 250 AS page, count(*) AS raw_count FROM placed GROUP BY 1),
       hits AS (SELECT page, count(*) AS found FROM (SELECT c.ticker, min(p.place // 250) AS page FROM cascade c JOIN placed p ON p.ord = c.ord
         WHERE c.exclusion_reason IS NULL GROUP BY c.ticker) GROUP BY page),
       stop AS (SELECT min(page) AS page FROM (SELECT p.page, raw_count, sum(coalesce(found, 0)) OVER (ORDER BY p.page) AS running
         FROM paged p LEFT JOIN hits h ON h.page = p.page) WHERE running >= {READ_TARGET} OR raw_count < 250)
       SELECT place // 250 AS page, place AS ord, (SELECT least(CAST(2 ** (floor(log2(page + 1)) + 1) AS BIGINT) - 1, (SELECT count(*) FROM paged)) FROM stop) AS opened
       FROM placed WHERE place // 250 <= (SELECT page FROM stop))""",
)
def o6_progressive(spark, sf):
    """The records of a paged read that stops early, and how many pages it opened."""
    folder = I.once(spark, sf, "page-files", lambda path: WSec.full_pages(spark, sf).write.partitionBy("page").text(path))
    read = read_progressively(spark, folder, cut(I.directory(spark, sf)), I.manual(spark, sf), target=READ_TARGET)
    return read.records.select("page", "ord", F.lit(read.opened).cast("bigint").alias("opened"))


@query(
    "v11_validate_universe",
    f"SELECT CAST({JOB_SIZE} AS BIGINT) AS rows, count(DISTINCT ticker) AS unique_tickers, min(market_cap_rank) AS rank_min, "
    f"max(market_cap_rank) AS rank_max, true AS audit_validated FROM selected WHERE market_cap_rank <= {JOB_SIZE}",
)
def v11(spark, sf):
    built = build_universe(
        I.feed(spark, sf), I.directory(spark, sf), raw_record_count(I.combined_directory(spark, sf)), I.manual(spark, sf), JOB_SIZE
    )
    summary = validate_universe(built.universe, built.audit, built.report, I.manual(spark, sf), JOB_SIZE)
    return summary.select("rows", "unique_tickers", "rank_min", "rank_max", "audit_validated")


@query("q4_resolve_status", "SELECT status, error_type, count(*) AS n, CAST(sum(attempt_count) AS BIGINT) AS attempts FROM state GROUP BY status, error_type")
def q4(spark, sf):
    from barlake.workloads.coverage import state

    return state(spark, sf).groupBy("status", "error_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("attempt_count").alias("attempts")
    )


def no_attempts(spark, universe):
    """An attempt log in which every ticker of the universe answered once without news."""
    return universe.select(
        "ticker", F.lit(1).cast("bigint").alias("attempt_no"), F.lit("no_data").alias("outcome"),
        F.lit("").alias("error_type"), F.lit("").alias("message"),
    )


DATA_START = dt.date(1995, 1, 1)


def filled_store(spark, sf, label):
    """A store backfilled with the old bars. Tickers without bars stay no_data."""

    def write(path):
        universe = I.parts(spark, sf)
        raw = I.old_bars(spark, sf)
        backfill(BarStore(spark, path), universe, raw, no_attempts(spark, universe), DATA_START, I.OLD_END, allow_no_data=True)

    return BarStore(spark, I.once(spark, sf, label, write))


@query("q5_backfill", f"SELECT {BAR}, CAST(year(date) AS INTEGER) AS year FROM old_bars")
def q5(spark, sf):
    return filled_store(spark, sf, "backfill").bars()


@query(
    "q5_backfill_coverage",
    """SELECT p.ticker, CASE WHEN n > 0 THEN 'success' ELSE 'no_data' END AS status, first_date, last_date, coalesce(n, 0) AS row_count
       FROM parts p LEFT JOIN (SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM old_bars GROUP BY ticker) b ON b.ticker = p.ticker""",
)
def q5_coverage(spark, sf):
    return filled_store(spark, sf, "backfill").table("coverage").select("ticker", "status", "first_date", "last_date", "row_count")


@query(
    "q5_backfill_invalid",
    """SELECT ticker, 'failed' AS status, CASE WHEN ticker IN (SELECT ticker FROM old_bars) THEN 'InvalidData' ELSE 'DownloadError' END AS error_type
       FROM parts WHERE ord % 10 = 0 OR ticker NOT IN (SELECT ticker FROM old_bars)""",
)
def q5_invalid(spark, sf):
    """Every attempt calls itself successful, but a tenth of the tickers has bad rows only and some have none:
    the backfill refuses, and its evidence names them."""

    def write(path):
        universe = I.parts(spark, sf)
        spoilt = F.substring("ticker", 2, 20).cast("bigint") % 10 == 0
        raw = I.old_bars(spark, sf).withColumn("close", F.when(spoilt, -F.col("close")).otherwise(F.col("close")))
        attempts = no_attempts(spark, universe).withColumn("outcome", F.lit("success"))
        try:
            backfill(BarStore(spark, path), universe, raw, attempts, DATA_START, I.OLD_END, allow_no_data=True)
        except IncompleteError:
            return
        raise AssertionError("the gate let tickers without a valid row pass")

    path = I.once(spark, sf, "refused", write)
    return spark.read.parquet(f"{path}/diagnostics/*/download_failures").select("ticker", "status", "error_type")


def refreshed_store(spark, sf):
    def write(path):
        universe = I.parts(spark, sf)
        store = BarStore(spark, path)
        backfill(store, universe, I.old_bars(spark, sf), no_attempts(spark, universe), DATA_START, I.OLD_END, allow_no_data=True)
        refresh(
            store, universe, I.new_bars(spark, sf), no_attempts(spark, universe), I.sessions(spark, sf), I.TARGET, minimum_coverage=0.0
        )

    return BarStore(spark, I.once(spark, sf, "refreshed", write))


@query(
    "q6_refresh",
    f"SELECT {BAR}, CAST(year(date) AS INTEGER) AS year FROM merged UNION ALL SELECT {BAR}, CAST(year(date) AS INTEGER) FROM old_bars WHERE date < DATE '1999-01-01'",
)
def q6(spark, sf):
    return refreshed_store(spark, sf).bars()


@query(
    "q6_refresh_coverage",
    """SELECT p.ticker, f.first_date, f.last_date, coalesce(f.n, 0) AS row_count
       FROM parts p LEFT JOIN (SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM (
         SELECT date, ticker FROM old_bars UNION SELECT date, ticker FROM new_bars) GROUP BY ticker) f ON f.ticker = p.ticker""",
)
def q6_coverage(spark, sf):
    return refreshed_store(spark, sf).table("coverage").select("ticker", "first_date", "last_date", "row_count")


@query(
    "v12_exported_update",
    """SELECT 'update' AS file, 0 AS violations, CAST((SELECT count(*) FROM active WHERE ticker NOT IN (SELECT ticker FROM present)) AS BIGINT) AS missing,
         '1999,2000,2001' AS years""",
)
def v12_exported(spark, sf):
    """The files of the refreshed store's export: the update's report against the manifest, and the missing tickers."""
    root = I.once(spark, sf, "exported-update", lambda path: export_dataset(refreshed_store(spark, sf), path))
    report = spark.read.json(f"{root}/update_report.json").select(
        "success", "run_id", "target_session", F.col("changed_partition_years").cast("array<int>").alias("years"), F.col("changed_files").alias("changed")
    )
    manifest = spark.read.json(f"{root}/manifest.json").select(F.col("last_update_run_id").alias("run_id"), "latest_session", F.col("requested_start").cast("date").alias("requested_start"))
    assets = asset_rows(read_manifest(spark, f"{root}/manifest.json"))
    found = update_report_violations(report, manifest, assets).agg(F.count(F.lit(1)).cast("int").alias("violations"))
    missing = spark.read.csv(f"{root}/update_missing_tickers.csv", header=True).agg(F.count(F.lit(1)).alias("missing"))
    return single(found, missing, report.select("years")).select(
        F.lit("update").alias("file"), "violations", "missing", F.array_join(F.col("years").cast("array<string>"), ",").alias("years")
    )


def exported(spark, sf):
    """A complete dataset in its plain-file layout: all bars, and the universe of their tickers."""

    def write(path):
        universe = I.bars(spark, sf).groupBy("ticker").agg(F.min(F.substring("ticker", 2, 20).cast("bigint")).alias("ord"))
        store = BarStore(spark, f"{path}-store")
        backfill(store, universe, I.bars(spark, sf), no_attempts(spark, universe), DATA_START, dt.date(2002, 1, 1))
        export_dataset(store, path)

    return I.once(spark, sf, "exported", write)


def all_tickers(spark, sf):
    return I.bars(spark, sf).select("ticker").distinct().withColumn("ord", F.substring("ticker", 2, 20).cast("bigint"))


@query(
    "q7_accept_dataset",
    """SELECT (SELECT count(*) FROM bars) AS total_row_count, (SELECT count(DISTINCT ticker) FROM bars) AS successful_ticker_count,
         CAST(0 AS BIGINT) AS failed_ticker_count, (SELECT count(*) FROM bars WHERE date = DATE '2000-06-14') AS target_session_ticker_count""",
)
def q7(spark, sf):
    summary = accept_dataset(spark, exported(spark, sf), all_tickers(spark, sf), dt.date(2000, 6, 14))
    return summary.select("total_row_count", "successful_ticker_count", "failed_ticker_count", "target_session_ticker_count")


@query(
    "q8_reconcile_copies",
    """SELECT CAST(year(date) AS VARCHAR) AS key, CASE WHEN year(date) >= 2000 THEN 'download' ELSE 'unchanged' END AS action FROM bars GROUP BY year(date)
       UNION ALL SELECT 'ticker_coverage', 'download' UNION ALL SELECT 'download_failures', 'download'""",
)
def q8(spark, sf):
    """The exported dataset against a copy that has stale files from 2000 on and no reports."""
    root = exported(spark, sf)

    def write(path):
        store = BarStore(spark, f"{root}-store")
        every = store.bars()
        publish_years(every.withColumn("close", F.when(F.col("year") >= 2000, F.col("close") * 2).otherwise(F.col("close"))), path)

    return asset_actions(reconcile_copies(spark, f"{root}/manifest.json", I.once(spark, sf, "copy", write)).plan)


def rows_in_quarter_years(spark, sf):
    """A file size that makes four files, or a few more, of every year."""
    most = I.bars(spark, sf).groupBy(F.year("date").alias("year")).count().agg(F.max("count")).first()[0]
    return max(1, -(-most // 4))


def exported_in_parts(spark, sf):
    def write(path):
        export_dataset(BarStore(spark, f"{exported(spark, sf)}-store"), path, rows_per_file=rows_in_quarter_years(spark, sf))

    return I.once(spark, sf, "exported-parts", write)


@query(
    "q7_accept_parts",
    """SELECT (SELECT count(*) FROM bars) AS total_row_count, (SELECT count(DISTINCT ticker) FROM bars) AS successful_ticker_count,
         (SELECT count(*) FROM bars WHERE date = DATE '2000-06-14') AS target_session_ticker_count, true AS in_parts""",
)
def q7_parts(spark, sf):
    """A dataset of several files a year is accepted: order within and across files, digests, counts."""
    root = exported_in_parts(spark, sf)
    summary = accept_dataset(spark, root, all_tickers(spark, sf), dt.date(2000, 6, 14))
    parts = part_rows(read_manifest(spark, f"{root}/manifest.json")).agg((F.count(F.lit(1)) >= 8).alias("in_parts"))
    return single(summary.select("total_row_count", "successful_ticker_count", "target_session_ticker_count"), parts)


@query(
    "q8_reconcile_parts",
    """SELECT CAST(year(date) AS VARCHAR) AS key, CASE WHEN year(date) = 2000 THEN 'download' ELSE 'unchanged' END AS action, CAST(0 AS BIGINT) AS obsolete
       FROM bars GROUP BY year(date)""",
)
def q8_parts(spark, sf):
    """A copy whose year 2000 is of other bars: only the parts of that year are to be fetched."""
    root, rows = exported_in_parts(spark, sf), rows_in_quarter_years(spark, sf)

    def write(path):
        every = BarStore(spark, f"{exported(spark, sf)}-store").bars()
        publish_years(every.withColumn("close", F.when(F.col("year") == 2000, F.col("close") * 2).otherwise(F.col("close"))), path, rows_per_file=rows)

    found = reconcile_copies(spark, f"{root}/manifest.json", I.once(spark, sf, "copy-parts", write))
    obsolete = found.names.agg(F.count_if(F.col("state") == "obsolete").alias("obsolete"))
    years = found.plan.where(F.col("key").rlike("^[0-9]+$"))
    return asset_actions(years).join(obsolete, F.lit(True))


@query(
    "j13_part_reconciliation",
    """SELECT CAST(year(date) AS VARCHAR) AS key, CASE WHEN year(date) = 1999 THEN 1 ELSE 0 END AS damaged FROM bars GROUP BY year(date)""",
)
def j13_parts(spark, sf):
    """One part of a year is damaged in a copy's inventory: that part alone is to be fetched."""
    manifest = read_manifest(spark, f"{exported_in_parts(spark, sf)}/manifest.json")
    files = asset_files(asset_rows(manifest), part_rows(manifest))
    hit = F.col("local_path") == "daily/year=1999/part-00001.parquet"
    copy = files.select("local_path", "size_bytes", F.when(hit, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    plan = reconcile(files, copy).where(F.col("key").rlike("^[0-9]+$"))
    return plan.groupBy("key").agg(F.count_if(F.col("action") == "download").cast("int").alias("damaged"))


def streamed(spark, sf):
    """The event users' events streamed into a store, twice, from the table's own files."""

    def write(path):
        store = BarStore(spark, f"{path}/store")
        schema = I.table(spark, sf, "events").schema
        for run in ("a", "b"):
            source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
            raw = source.select(
                F.to_date("ts").alias("date"),
                F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("ticker"),
                (F.col("value") + 1).alias("close"),
                (F.col("value") + 0.5).alias("adj_close"),
                F.lit(1.0).alias("volume"),
            )
            refresh_stream(raw, store, f"{path}/checkpoint-{run}", refresh_start=I.USERS_LATE, end=I.USERS_END).awaitTermination()

    return BarStore(spark, I.once(spark, sf, "streamed", write) + "/store")


@query(
    "t1_refresh_stream",
    """SELECT CAST(ts AS DATE) AS date, 'U' || user_id || '-' || event_id AS ticker, value + 1 AS close FROM events
       WHERE ts >= DATE '2024-01-06'""",
)
def t1(spark, sf):
    return streamed(spark, sf).bars().select("date", "ticker", "close")


@query("t2_late_bars", "SELECT CAST(ts AS DATE) AS date, 2 * count(*) AS n FROM events WHERE ts < DATE '2024-01-06' GROUP BY 1")
def t2(spark, sf):
    """Quarantined bars of all micro-batches of both runs."""
    late = spark.read.parquet(f"{streamed(spark, sf).root}/quarantine/late")
    return late.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t1_refresh_after_stream",
    """SELECT p.ticker, f.first_date, f.last_date, coalesce(f.n, 0) AS row_count
       FROM parts p LEFT JOIN (SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM (
         SELECT date, ticker FROM old_bars UNION SELECT date, ticker FROM new_bars) GROUP BY ticker) f ON f.ticker = p.ticker""",
)
def t1_after(spark, sf):
    """A filled store, the new bars but the last day's streamed in, then a refresh up to that day."""

    def write(path):
        universe, store = I.parts(spark, sf), BarStore(spark, f"{path}/store")
        backfill(store, universe, I.old_bars(spark, sf), no_attempts(spark, universe), DATA_START, I.OLD_END, allow_no_data=True)
        I.new_bars(spark, sf).where(F.col("date") < F.lit(I.TARGET)).write.parquet(f"{path}/arriving")
        source = bar_stream(spark, f"{path}/arriving")
        refresh_stream(source, store, f"{path}/checkpoint", refresh_start=I.WINDOW_START, end=I.TARGET).awaitTermination()
        refresh(store, universe, I.new_bars(spark, sf), no_attempts(spark, universe), I.sessions(spark, sf), I.TARGET, minimum_coverage=0.0)

    store = BarStore(spark, I.once(spark, sf, "refreshed-after-stream", write) + "/store")
    return store.table("coverage").select("ticker", "first_date", "last_date", "row_count")


@query("t2_late_split", "SELECT date, ticker, date < DATE '2024-01-06' AS late FROM user_bars")
def t2_split(spark, sf):
    on_time, late = split_late(I.user_bars(spark, sf), I.USERS_LATE)
    return on_time.select("date", "ticker", F.lit(False).alias("late")).unionByName(late.select("date", "ticker", F.lit(True).alias("late")))


@query("t3_replay_safety", "SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS row_count FROM events WHERE ts >= DATE '2024-01-06' GROUP BY 1")
def t3(spark, sf):
    """The whole source was streamed twice; the latest commit counts every bar once."""
    return streamed(spark, sf).current().where("year IS NOT NULL").select("year", "row_count")
