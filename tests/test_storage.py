import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barlake.errors import DataQualityError, IdentityError, IncompleteError, ManifestError, RefreshError
from barlake.operators import inventory as N
from barlake.operators import quality as Q
from barlake.plans.accept import accept_dataset
from barlake.plans.backfill import backfill, export_dataset
from barlake.plans.reconcile import reconcile_copies
from barlake.plans.refresh import refresh, window_start
from barlake.schema import ATTEMPT_SCHEMA, BAR_SCHEMA
from barlake.sinks.bars import rewrite_years, write_years
from barlake.sinks.snapshots import BarStore
from barlake.sources import files as SF
from barlake.sources import manifest as SM
from barlake.sources import prices as SP
from barlake.streaming.refresh_stream import apply_batch, bar_stream, refresh_stream


def d(text):
    return dt.date.fromisoformat(text)


def bar(spark, *rows):
    return spark.createDataFrame([(d(a), t, float(c), float(j), v) for a, t, c, j, v in rows], BAR_SCHEMA)


def raw(spark, *rows):
    return bar(spark, *rows).withColumn("volume", F.col("volume").cast("double"))


def log(spark, *tickers, outcome="success"):
    return spark.createDataFrame([(t, 1, outcome, "", "") for t in tickers], ATTEMPT_SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("date", "ticker", "close").collect())


START = [(day, t, 10, 9, 100) for day in ("2025-12-31", "2026-01-02") for t in ("AAA", "BBB")]


@pytest.fixture
def universe(spark):
    return spark.createDataFrame([(0, "AAA"), (1, "BBB")], "ord long, ticker string")


@pytest.fixture
def sessions(spark):
    days = [d("2025-12-29"), d("2025-12-30"), d("2025-12-31"), d("2026-01-02"), d("2026-01-05"), d("2026-01-06")]
    return spark.createDataFrame([(x, dt.datetime(x.year, x.month, x.day, 21)) for x in days], "session date, close_utc timestamp_ntz")


@pytest.fixture
def store(spark, folder, universe):
    s = BarStore(spark, f"{folder}/store")
    backfill(s, universe, raw(spark, *START), log(spark, "AAA", "BBB"), d("2016-01-01"), d("2026-01-03"))
    return s


def test_year_files(spark, folder):
    write_years(bar(spark, *START), f"{folder}/d")
    assert SP.read_years(spark, f"{folder}/d", [2026]).count() == 2
    plan = SP.read_window(spark, f"{folder}/d", d("2026-01-01"), d("2026-02-01"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(date)" in plan
    rewrite_years(bar(spark, ("2026-01-05", "AAA", 3, 3, 3)), f"{folder}/d", [2026])
    assert rows_of(SP.read_dataset(spark, f"{folder}/d")) == [
        (d("2025-12-31"), "AAA", 10.0), (d("2025-12-31"), "BBB", 10.0), (d("2026-01-05"), "AAA", 3.0)
    ]
    footers = SF.stored_codecs(spark, f"{folder}/d")
    assert {r.codec for r in footers.collect()} == {"ZSTD"}
    assert SP.stored_schema_matches(spark, f"{folder}/d")


def stored_rules(spark, root, start="2016-01-01", end="2030-01-01"):
    found = Q.stored_violations(SP.read_dataset(spark, root), SF.key_runs(spark, root), SF.stored_codecs(spark, root), d(start), d(end))
    return {r.rule: r.n for r in found.collect()}


def test_stored_gate(spark, folder):
    many = spark.range(30000).selectExpr(
        "date_add(date '2020-01-01', int(id / 100)) date", "concat('T', lpad(id % 100, 3, '0')) ticker", "1d close", "1d adj_close", "id volume"
    )
    write_years(many, f"{folder}/good")
    assert stored_rules(spark, f"{folder}/good") == {}
    shuffled = many.orderBy(F.xxhash64("volume")).coalesce(1)
    shuffled.write.option("compression", "gzip").parquet(f"{folder}/bad/year=2020")
    assert set(stored_rules(spark, f"{folder}/bad")) == {"file_not_sorted", "not_zstd"}
    write_years(bar(spark, ("2020-01-01", "A", 1, 1, 1)), f"{folder}/twice")
    write_years(bar(spark, ("2020-01-01", "A", 1, 1, 1)), f"{folder}/twice", mode="append")
    assert stored_rules(spark, f"{folder}/twice") == {"duplicate_key": 1}
    bar(spark, ("2021-01-01", "A", 1, 1, 1), ("2021-01-01", "A", 1, 1, 1)).coalesce(1).write.option("compression", "zstd").parquet(f"{folder}/year_off/year=2020")
    assert stored_rules(spark, f"{folder}/year_off") == {"wrong_year": 2, "file_repeats_key": 1}


def test_inventory_equals_the_files(spark, folder):
    import hashlib
    from pathlib import Path

    write_years(bar(spark, *START), f"{folder}/d")
    found = {r.local_path: (r.size_bytes, r.sha256) for r in SF.inventory(spark, f"{folder}/d").collect()}
    files = {str(p.relative_to(f"{folder}/d")): p.read_bytes() for p in Path(f"{folder}/d").rglob("part-*")}
    assert found == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()} and found


def test_backfill_gates(spark, folder, universe):
    s = BarStore(spark, f"{folder}/s")
    half = [r for r in START if r[1] == "AAA"]
    failing = log(spark, "AAA").unionByName(log(spark, "BBB", outcome="failed"))
    with pytest.raises(IncompleteError, match="1 failed"):
        backfill(s, universe, raw(spark, *half), failing, d("2016-01-01"), d("2026-01-03"))
    silent = log(spark, "AAA").unionByName(log(spark, "BBB", outcome="no_data"))
    with pytest.raises(IncompleteError, match="without data"):
        backfill(s, universe, raw(spark, *half), silent, d("2016-01-01"), d("2026-01-03"))
    clash = [*START, ("2026-01-02", "AAA", 11, 9, 100)]
    with pytest.raises(DataQualityError, match="2026-01-02 AAA"):
        backfill(s, universe, raw(spark, *clash), log(spark, "AAA", "BBB"), d("2016-01-01"), d("2026-01-03"))
    with pytest.raises(DataQualityError, match="unexpected_ticker"):
        backfill(s, universe, raw(spark, *START, ("2026-01-02", "ZZZ", 1, 1, 1)), log(spark, "AAA", "BBB"), d("2016-01-01"), d("2026-01-03"))
    assert s.version() == 0
    backfill(s, universe, raw(spark, *half), silent, d("2016-01-01"), d("2026-01-03"), allow_no_data=True)
    assert s.version() == 1 and s.bars().count() == 2


FEED = [("2026-01-05", t, 30, 29, 300) for t in ("AAA", "BBB")]


def test_refresh_end_to_end(spark, store, universe, sessions):
    done = refresh(store, universe, raw(spark, *FEED), log(spark, "AAA", "BBB"), sessions, d("2026-01-05"), window_days=10)
    assert (done.status, done.refresh_start, done.years, done.coverage_ratio) == ("updated", d("2025-12-26"), [2025, 2026], 1.0)
    assert store.bars().count() == 6
    for r in store.table("coverage").collect():
        assert (r.status, r.row_count, r.last_date, r.attempt_count, r.last_error) == ("success", 3, d("2026-01-05"), 2, "")
    m = store.table("manifest").first()
    assert (m.total_row_count, m.actual_min_date, m.actual_max_date, m.partition_row_counts) == (6, "2025-12-31", "2026-01-05", {"2025": 2, "2026": 4})
    again = refresh(store, universe, raw(spark, *FEED), log(spark, "AAA", "BBB"), sessions, d("2026-01-05"), window_days=10)
    assert again.status == "no_op" and store.version() == 2
    assert refresh(store, universe, raw(spark, *FEED), log(spark, "AAA", "BBB"), sessions, d("2026-01-06"), dry_run=True).status == "dry_run"
    with pytest.raises(IdentityError):
        refresh(store, universe.where("ord = 0"), raw(spark, *FEED), log(spark, "AAA"), sessions, d("2026-01-06"))


def test_refresh_carries_untouched_years(spark, store, universe, sessions):
    done = refresh(store, universe, raw(spark, *FEED), log(spark, "AAA", "BBB"), sessions, d("2026-01-05"), window_days=3)
    assert done.years == [2026]
    m = store.table("manifest").first()
    assert (m.total_row_count, m.actual_min_date, m.actual_max_date, m.partition_row_counts) == (6, "2025-12-31", "2026-01-05", {"2025": 2, "2026": 4})
    assert {r.year: r.data_snapshot == done.snapshot for r in store.current().where("year IS NOT NULL").collect()} == {2025: False, 2026: True}


def test_new_year_without_a_partition(spark, folder, universe, sessions):
    s = BarStore(spark, f"{folder}/s")
    backfill(s, universe, raw(spark, *START[:2]), log(spark, "AAA", "BBB"), d("2016-01-01"), d("2026-01-01"))
    refresh(s, universe, raw(spark, *[("2026-01-02", t, 1, 1, 1) for t in ("AAA", "BBB")]), log(spark, "AAA", "BBB"), sessions, d("2026-01-02"), window_days=3)
    assert s.years() == [2025, 2026]


def test_refused_refresh_changes_nothing(spark, store, universe, sessions):
    before = rows_of(store.bars())
    one = raw(spark, FEED[0])
    with pytest.raises(RefreshError, match="target_coverage"):
        refresh(store, universe, one, log(spark, "AAA").unionByName(log(spark, "BBB", outcome="no_data")), sessions, d("2026-01-05"), window_days=10)
    with pytest.raises(RefreshError, match="unresolved_failures.*BBB"):
        refresh(store, universe, one, log(spark, "AAA").unionByName(log(spark, "BBB", outcome="failed")), sessions, d("2026-01-05"), window_days=10)
    assert store.version() == 1 and rows_of(store.bars()) == before
    done = refresh(
        store, universe, one, log(spark, "AAA").unionByName(log(spark, "BBB", outcome="no_data")), sessions, d("2026-01-05"),
        window_days=10, allow_partial=True,
    )
    assert done.coverage_ratio == 0.5
    assert [tuple(r) for r in store.table("update_missing").collect()] == [("BBB", True, "no_data", "no attempt found usable rows")]
    bbb = store.table("coverage").where("ticker = 'BBB'").first()
    assert bbb.status == "success" and bbb.last_error != ""


def test_window_start():
    assert window_start(d("2016-01-01"), d("2026-01-05")) == d("2024-07-04")
    with pytest.raises(RefreshError):
        window_start(d("2026-01-06"), d("2026-01-05"))


def test_uncommitted_snapshot_is_invisible(spark, store):
    before = rows_of(store.bars())
    store.stage("torn", bar(spark, ("2026-01-02", "AAA", 99, 99, 9)))
    assert rows_of(store.bars()) == before


@pytest.fixture(scope="module")
def exported(spark, tmp_path_factory):
    """A published dataset that tests only read."""
    folder = tmp_path_factory.mktemp("published")
    s = BarStore(spark, f"{folder}/store")
    two = spark.createDataFrame([(0, "AAA"), (1, "BBB")], "ord long, ticker string")
    backfill(s, two, raw(spark, *START), log(spark, "AAA", "BBB"), d("2016-01-01"), d("2026-01-03"))
    export_dataset(s, f"{folder}/data")
    return f"{folder}/data"


def test_acceptance(spark, exported, universe, folder):
    import shutil

    exported = shutil.copytree(exported, f"{folder}/data")
    summary = accept_dataset(spark, exported, universe, d("2026-01-02"), 0.97).first()
    assert (summary.total_row_count, summary.successful_ticker_count, summary.target_session_coverage_ratio) == (4, 2, 1.0)
    with pytest.raises(DataQualityError, match="target_coverage"):
        accept_dataset(spark, exported, universe, d("2026-01-05"), 0.97)
    with pytest.raises(DataQualityError, match="universe_digest"):
        accept_dataset(spark, exported, universe.withColumn("ord", -F.col("ord")))
    with pytest.raises(ValueError):
        accept_dataset(spark, exported, universe, None, 0.5)
    with open(f"{exported}/ticker_coverage.csv", encoding="utf-8") as handle:
        text = handle.read()
    with open(f"{exported}/ticker_coverage.csv", "w", encoding="utf-8") as handle:
        handle.write(text.replace("AAA,success", "AAA,no_data"))
    drop_crc(exported)
    with pytest.raises(DataQualityError, match="file_changed.*status_not_success"):
        accept_dataset(spark, exported, universe)


def drop_crc(root):
    """Hadoop's local checksum files would reject the edit before our own digest does."""
    from pathlib import Path

    for crc in Path(root).rglob(".*.crc"):
        crc.unlink()


def test_manifest_of_the_export_is_sound(spark, exported):
    m = SM.read_manifest(spark, f"{exported}/manifest.json")
    assert N.manifest_violations(m, SM.asset_rows(m), SM.partition_counts(m)).count() == 0
    order = [r.key for r in N.publication_order(SM.asset_rows(m)).orderBy("publish_order").collect()]
    assert order == ["2025", "2026", "ticker_coverage", "download_failures", "manifest"]


BREAKS = [
    ("schema_version", lambda m: m.update(schema_version="v0")), ("not_completed", lambda m: m.update(completed="true")),
    ("source", lambda m: m.update(source="x")), ("universe_digest", lambda m: m.update(universe_sha256="zz")),
    ("universe_ticker_count", lambda m: m.update(universe_ticker_count=True)), ("requested_start", lambda m: m.update(requested_start="2016-1-1")),
    ("date_bounds", lambda m: m.update(latest_session="2026-01-05")), ("last_update_instant", lambda m: m.update(last_successful_update_utc="2026-01-05T00:00:00")),
    ("total_row_count", lambda m: m.update(total_row_count=-1)), ("total_mismatch", lambda m: m["partition_row_counts"].update({"2025": 9})),
    ("partition_counts", lambda m: m["partition_row_counts"].update({"2025": "2"})), ("year_assets_mismatch", lambda m: m["partition_row_counts"].update({"2024": 0})),
    ("year_before_start", lambda m: m.update(requested_start="2026-01-01")), ("no_ticker_coverage", lambda m: m["assets"].pop("ticker_coverage")),
    ("unsupported_key", lambda m: m["assets"].update(other=m["assets"]["2025"])), ("duplicate_asset_name", lambda m: m["assets"].update(other=m["assets"]["2025"])),
    ("local_path_rule", lambda m: m["assets"]["2025"].update(local_path="../x")), ("digest_format", lambda m: m["assets"]["2025"].update(sha256="q")),
    ("size_negative", lambda m: m["assets"]["2025"].update(size_bytes=-1)), ("size_not_integer", lambda m: m["assets"]["2025"].update(size_bytes="1")),
]


def test_manifest_rules(spark, exported):
    with open(f"{exported}/manifest.json", encoding="utf-8") as handle:
        sound = handle.read()
    for rule, spoil in BREAKS:
        payload = json.loads(sound)
        spoil(payload)
        m = SM.parse_manifest(spark.createDataFrame([(json.dumps(payload),)], "value string"))
        assert rule in {r.rule for r in N.manifest_violations(m, SM.asset_rows(m), SM.partition_counts(m)).collect()}, rule


def test_reconcile(spark, exported, folder):
    import shutil

    copy = f"{folder}/copy"
    shutil.copytree(exported, copy)
    manifest = f"{exported}/manifest.json"

    def plan(**options):
        return {r.key: r.action for r in reconcile_copies(spark, manifest, copy, **options).plan.collect()}

    assert set(plan().values()) == {"unchanged"}
    assert set(plan(force=True).values()) == {"download"}
    with open(f"{copy}/daily/year=2025/prices.parquet", "r+b") as handle:
        byte = handle.read(1)
        handle.seek(0)
        handle.write(bytes([byte[0] ^ 1]))
    import os

    os.remove(f"{copy}/ticker_coverage.csv")
    shutil.copy(f"{copy}/daily/year=2026/prices.parquet", f"{copy}/daily/year=2026/extra.parquet")
    drop_crc(copy)
    assert plan() == {"2025": "download", "2026": "unchanged", "ticker_coverage": "download", "download_failures": "unchanged"}
    assert plan(years=[2026]) == {"2026": "unchanged"}
    assert plan(years=[2010]) == {}
    assert set(plan(years=[2025], auxiliary=["ticker_coverage"])) == {"2025", "ticker_coverage"}
    names = {(r.local_path, r.state) for r in reconcile_copies(spark, manifest, copy).names.collect()}
    assert names == {("ticker_coverage.csv", "missing"), ("daily/year=2026/extra.parquet", "obsolete")}
    other = N.identity_of(SM.read_manifest(spark, manifest)).withColumn("requested_start", F.lit("2017-01-01"))
    with pytest.raises(IdentityError, match="requested_start"):
        reconcile_copies(spark, manifest, copy, expected_identity=other)


def test_unreadable_manifest(spark, folder):
    with open(f"{folder}/m.json", "w", encoding="utf-8") as handle:
        handle.write("[1]")
    with pytest.raises(ManifestError):
        SM.read_manifest(spark, f"{folder}/m.json")


def test_update_report(spark):
    assets = spark.createDataFrame([("2025",), ("2026",)], "key string")
    manifest = spark.createDataFrame([("r", "2026-01-05", d("2016-01-01"))], "run_id string, latest_session string, requested_start date")
    changed = ["daily/year=2026/prices.parquet", "ticker_coverage.csv", "update_missing_tickers.csv", "update_report.json", "manifest.json"]

    def rules(**change):
        base = {"success": True, "run_id": "r", "target_session": "2026-01-05", "years": [2026], "changed": changed, **change}
        report = spark.createDataFrame([tuple(base.values())], "success boolean, run_id string, target_session string, years array<int>, changed array<string>")
        return {r.rule for r in N.update_report_violations(report, manifest, assets).collect()}

    assert rules() == set()
    assert rules(success=False) == {"not_successful"}
    assert rules(run_id="x") == {"run_id"}
    assert rules(target_session="2026-01-06") == {"target_session"}
    assert rules(years=[2026, 2025]) == {"years_not_sorted_unique", "changed_list"}
    assert rules(years=[2027]) == {"unmanaged_year", "changed_list"}
    assert rules(years=[2015, 2026]) == {"year_before_start", "unmanaged_year", "changed_list"}
    assert rules(changed=changed[:-1]) == {"changed_list"}


def test_stream_merges_arriving_files(spark, folder, store):
    arriving = f"{folder}/in"
    raw(spark, ("2026-01-02", "AAA", 12, 11, 5), ("2026-01-05", "AAA", 13, 12, 6), ("2025-11-01", "AAA", 1, 1, 1)).coalesce(1).write.parquet(arriving)
    schema = spark.read.parquet(arriving).schema

    def run(checkpoint):
        source = bar_stream(spark, arriving, schema)
        refresh_stream(source, store, f"{folder}/{checkpoint}", refresh_start=d("2025-12-20"), end=d("2026-01-10")).awaitTermination()

    run("c1")
    want = [
        (d("2025-12-31"), "AAA", 10.0), (d("2025-12-31"), "BBB", 10.0), (d("2026-01-02"), "AAA", 12.0), (d("2026-01-02"), "BBB", 10.0),
        (d("2026-01-05"), "AAA", 13.0),
    ]
    assert rows_of(store.bars()) == want
    assert spark.read.parquet(f"{store.root}/quarantine/late").count() == 1
    run("c1")
    raw(spark, ("2026-01-06", "BBB", 7, 7, 7), ("2026-01-06", "AAA", -1, 7, 7)).write.mode("append").parquet(arriving)
    run("c1")
    assert rows_of(store.bars()) == [*want, (d("2026-01-06"), "BBB", 7.0)]
    refused = spark.read.parquet(f"{store.root}/quarantine/refused").collect()
    assert [(r.ticker, r.invalid) for r in refused] == [("AAA", 1)]
    run("c2")
    assert rows_of(store.bars()) == [*want, (d("2026-01-06"), "BBB", 7.0)]


def test_replayed_batch_gives_the_same_table(spark, store):
    batch = raw(spark, ("2026-01-05", "AAA", 13, 12, 6))
    apply_batch(store, batch, 7, d("2025-12-20"), d("2026-01-10"))
    first = rows_of(store.bars())
    apply_batch(store, batch, 7, d("2025-12-20"), d("2026-01-10"))
    assert rows_of(store.bars()) == first and store.version() == 2
