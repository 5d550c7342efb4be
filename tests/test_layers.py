import datetime as dt
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from barlake.errors import CommitError
from barlake.operators.layers import FILE_SCHEMA, closed, last_layer, touched
from barlake.operators.quality import codec_violations
from barlake.plans.compact import compact
from barlake.plans.window import upsert_window
from barlake.schema import BAR_SCHEMA
from barlake.sinks.bars import write_years
from barlake.sinks.snapshots import BarStore
from barlake.sources import files as SF
from barlake.sources.filestream import FileDigestReader, planned
from barlake.streaming.refresh_stream import apply_batch

FIRST, FAR = dt.date(1990, 1, 1), dt.date(2100, 1, 1)


def d(text):
    return dt.date.fromisoformat(text)


def bars(spark, *rows):
    return spark.createDataFrame([(d(a), t, float(c), float(c), 1) for a, t, c in rows], BAR_SCHEMA)


def many(spark, days=120, tickers=40):
    """A year's bars over several files of disjoint days."""
    return spark.range(days * tickers).selectExpr(
        f"date_add(date '2024-01-01', int(id / {tickers})) date", f"concat('T', lpad(id % {tickers}, 3, '0')) ticker",
        "double(id % 97 + 1) close", "double(id % 89 + 1) adj_close", "id volume",
    )


@pytest.fixture
def store(spark, folder):
    s = BarStore(spark, f"{folder}/s")
    keys = ["date", "ticker"]
    rows = many(spark).withColumn("year", F.year("date")).repartitionByRange(6, *keys).sortWithinPartitions(*keys)
    rows.write.option("compression", "zstd").partitionBy("year").parquet(f"{s.root}/bars/snapshot=base")
    s.stage_files("base", [])
    s.commit("base", {2024: 4800}, deltas={2024: 0})
    return s


def names(store):
    return {(f.snapshot, f"{f.year}/{f.name}") for f in store.files()}


def content(df):
    return sorted(map(tuple, df.select("date", "ticker", "close").collect()))


def file(layer, name, lo, hi, tickers=("A", "Z"), year=2024, nulls=0):
    return Row(*FILE_SCHEMA.names)(year, "s", name, layer, 1, nulls, lo and d(lo), hi and d(hi), *tickers)


def test_zone_maps_choose_files():
    a, b, c = file(0, "a", "2024-01-01", "2024-01-31"), file(0, "b", "2024-02-01", "2024-02-29"), file(0, "c", "2024-03-01", "2024-03-31")
    delta = file(1, "x", "2024-02-10", "2024-03-05")
    assert [f.name for f in touched([a, b, c], d("2024-02-01"), d("2024-02-03")).hit] == ["b"]
    # the delta over b draws c in as well, which it also lies over
    assert [f.name for f in touched([a, b, c, delta], d("2024-02-01"), d("2024-02-03")).hit] == ["b", "c", "x"]
    assert [f.name for f in closed([delta], [a, b, c, delta]).kept] == ["a"]
    assert [f.name for f in closed([file(1, "y", "2024-02-10", "2024-03-05", ("ZZ", "ZZZ"))], [a, b, c]).kept] == ["a", "b", "c"]
    # unknown bounds and NULL keys may be anywhere, other years are never
    odd = [file(0, "n", None, None), file(0, "m", "2024-01-01", "2024-01-02", nulls=1), file(0, "o", "2024-02-10", "2024-02-11", year=2023)]
    assert [f.name for f in closed([delta], [*odd, delta]).hit] == ["n", "m", "x"]


def test_last_layer_is_one_hash_aggregate(spark):
    rows = bars(spark, ("2024-01-01", "A", 1)).withColumn("n", F.lit(0)).unionByName(bars(spark, ("2024-01-01", "A", 2)).withColumn("n", F.lit(3)))
    merged = last_layer(rows, "n")
    assert content(merged) == [(d("2024-01-01"), "A", 2.0)]
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def size_of(root, snapshot):
    return sum(p.stat().st_size for p in Path(root).rglob("*.parquet") if f"snapshot={snapshot}" in str(p) and "/bars/" in str(p))


def test_a_batch_writes_in_proportion_to_itself(spark, store):
    before = names(store)
    batch = bars(spark, ("2024-03-01", "T001", 999), ("2024-03-01", "NEW", 5), ("2025-01-02", "T001", 7))
    assert apply_batch(store, batch, 0, FIRST, FAR)
    written = {s for s, _ in names(store) - before}
    assert len(written) == 1 and before < names(store)
    assert size_of(store.root, *written) < size_of(store.root, "base") / 5
    want = {(r.date, r.ticker): r.close for r in many(spark).collect()} | {(d("2024-03-01"), "T001"): 999.0, (d("2024-03-01"), "NEW"): 5.0, (d("2025-01-02"), "T001"): 7.0}
    assert content(store.bars()) == sorted((a, b, c) for (a, b), c in want.items())
    assert {r.year: (r.row_count, r.deltas) for r in store.current().where("year IS NOT NULL").collect()} == {2024: (4801, 1), 2025: (1, 1)}
    # the second version of a key wins, and readers of an older version see the older one
    old = store.at()
    assert apply_batch(store, bars(spark, ("2024-03-01", "T001", 1000)), 1, FIRST, FAR)
    assert store.bars().where("ticker = 'T001' AND date = '2024-03-01'").first().close == 1000.0
    assert old.bars().where("ticker = 'T001' AND date = '2024-03-01'").first().close == 999.0


def test_a_replayed_batch_is_refused_before_it_writes(spark, store):
    batch = bars(spark, ("2024-03-01", "T001", 999))
    assert apply_batch(store, batch, 4, FIRST, FAR, "feed")
    before = sorted(str(p) for p in Path(store.root).rglob("*"))
    assert not apply_batch(store, batch, 4, FIRST, FAR, "feed") and not apply_batch(store, batch, 3, FIRST, FAR, "feed")
    assert sorted(str(p) for p in Path(store.root).rglob("*")) == before and store.version() == 2
    assert apply_batch(store, batch, 4, FIRST, FAR, "other") and (store.applied("feed"), store.applied("other"), store.applied("x")) == (4, 4, None)


def test_compaction_keeps_files_without_deltas(spark, store):
    apply_batch(store, bars(spark, ("2024-03-01", "T001", 999)), 0, FIRST, FAR)
    apply_batch(store, bars(spark, ("2024-03-01", "T002", 998)), 1, FIRST, FAR)
    seen, before = content(store.bars()), names(store)
    assert compact(store, least_deltas=3).snapshot is None
    done = compact(store)
    assert done.years == [2024] and content(store.bars()) == seen
    assert all(f.layer == 0 for f in store.files()) and len(names(store) & before) == 5
    plan = store.bars()._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and compact(store).snapshot is None
    assert store.applied("batches") == 1


def test_upsert_opens_and_rewrites_only_what_its_days_touch(spark, store):
    before = names(store)
    snapshot = upsert_window(store, bars(spark, ("2024-04-28", "T001", 999), ("2024-04-29", "NEW", 1)))
    kept = names(store) & before
    assert len(kept) == 5 and {s for s, _ in names(store) - before} == {snapshot}
    split = store.at(1).window(d("2024-04-28"), d("2024-04-29"), [2024])
    opened = store.bars_in(split.hit).inputFiles()
    assert len(opened) == 1
    assert store.bars().count() == 4801 and upsert_window(store, bars(spark)) is None
    assert {r.row_count for r in store.current().where("year IS NOT NULL").collect()} == {4801}


def test_writers_side_by_side(spark, store):
    one, two, three = store.at(), store.at(), store.at()
    one.stage("one", bars(spark, ("2023-01-02", "A", 1)))
    assert one.commit("one", {2023: 1}) == 2
    two.stage("two", bars(spark, ("2025-01-02", "A", 1)))
    assert two.commit("two", {2025: 1}, stream=("s", 1)) == 3
    assert store.years() == [2023, 2024, 2025]
    with pytest.raises(CommitError, match="year 2025"):
        three.commit("three", {2025: 1})
    with pytest.raises(CommitError, match="stream s"):
        three.commit("three", {2022: 1}, stream=("s", 1))
    assert store.version() == 3 and store.applied("s") == 1


def test_a_race_for_a_version_is_run_again(spark, store, monkeypatch):
    pinned = store.at()
    real, calls = BarStore._versions, []

    def late(self):
        """The first look at the log misses a commit that lands right afterwards."""
        found = real(self)
        calls.append(1)
        if len(calls) == 1:
            BarStore(spark, store.root).commit("other", {2020: 1})
        return found

    monkeypatch.setattr(BarStore, "_versions", late)
    assert pinned.commit("mine", {2021: 1}) == 3
    monkeypatch.undo()
    assert store.years() == [2020, 2021, 2024]


def test_files_of_any_size_are_streamed(spark, folder):
    Path(f"{folder}/d/_hidden").mkdir(parents=True)
    Path(f"{folder}/d/sub dir").mkdir()
    files = {"big.bin": bytes(range(256)) * 5000, "sub dir/small.txt": b"x", "empty": b""}
    for name, data in files.items():
        Path(f"{folder}/d/{name}").write_bytes(data)
    Path(f"{folder}/d/_hidden/no").write_bytes(b"no")
    Path(f"{folder}/d/.crc").write_bytes(b"no")
    want = {n: (len(v), hashlib.sha256(v).hexdigest()) for n, v in files.items()}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        assert {r.local_path: (r.size_bytes, r.sha256) for r in SF.inventory(spark, f"{folder}/d").collect()} == want
        with pytest.raises(Exception, match="exceeds"):
            SF.inventory_rows(spark, f"{folder}/d").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    reader = FileDigestReader({"path": f"file:{folder}/d", "rangeBytes": "1000", "partitionBytes": "10"})
    parts = reader.partitions()
    assert sorted(len(p.files) for p in parts) == [1, 2]
    assert {r[1]: r[2:] for p in parts for r in reader.read(p)} == want
    Path(f"{folder}/none").mkdir()
    assert SF.inventory(spark, f"{folder}/none").collect() == [] and planned([], 5) == []


def test_codec_of_a_published_name_comes_from_its_footer(spark, folder):
    one = bars(spark, ("2024-01-01", "A", 1)).coalesce(1)
    for year, codec in ((1, "zstd"), (2, "gzip")):
        one.write.option("compression", codec).parquet(f"{folder}/w-{codec}")
        target = Path(f"{folder}/d/year={year}/prices.parquet")
        target.parent.mkdir(parents=True)
        next(Path(f"{folder}/w-{codec}").glob("part-*.parquet")).rename(target)
    one.write.option("compression", "zstd").parquet(f"{folder}/d/year=3")
    found = SF.stored_codecs(spark, f"{folder}/d")
    assert sorted((r.file.split("/")[-2], r.codec, r.row_count) for r in found.collect()) == [("year=1", "ZSTD", 1), ("year=2", "GZIP", 1), ("year=3", "ZSTD", 1)]
    assert [(r.rule, r.n) for r in codec_violations(found).collect()] == [("not_zstd", 1)]
    unknown = spark.createDataFrame([("f", None, 1)], "file string, codec string, row_count long")
    assert [(r.rule, r.n) for r in codec_violations(unknown).collect()] == [("not_zstd", 1)]


def test_blocks_meet_in_order_and_need_no_python(spark, folder, monkeypatch):
    from barlake.operators.quality import order_violations

    monkeypatch.setattr(SF, "ROWS_PER_BLOCK", 7)
    write_years(many(spark, 10, 10), f"{folder}/good")
    runs = SF.key_runs(spark, f"{folder}/good")
    assert "Python" not in runs._jdf.queryExecution().executedPlan().toString() and "Arrow" not in runs._jdf.queryExecution().executedPlan().toString()
    assert runs.count() >= 15 and order_violations(runs).collect() == []
    zones = SF.zone_maps(runs).agg(F.sum("row_count"), F.min("min_date"), F.max("max_date"), F.min("min_ticker"), F.max("max_ticker"), F.sum("null_count")).first()
    assert tuple(zones) == (100, d("2024-01-01"), d("2024-01-10"), "T000", "T009", 0)
    rows = [("2024-01-01", f"T{k:02d}", 1) for k in range(14)]
    for label, spoilt, rule in (
        ("edge", [*rows[:7], rows[3], *rows[7:]], {"file_not_sorted"}),
        ("twice", [*rows[:7], rows[6], *rows[7:]], {"file_repeats_key"}),
    ):
        bars(spark, *spoilt).coalesce(1).write.parquet(f"{folder}/{label}/year=2024")
        assert {r.rule for r in order_violations(SF.key_runs(spark, f"{folder}/{label}")).collect()} == rule


def test_equal_years_are_published_as_equal_files(spark, tmp_path, monkeypatch):
    from barlake.operators import inventory as N
    from barlake.sinks import bars as SB
    from barlake.sinks.layout import publish_years

    monkeypatch.setattr(SB, "ROWS_PER_TASK", 4_000)
    days = spark.range(40_000).select(
        F.date_add(F.lit(d("2023-01-01")), (F.col("id") % 600).cast("int")).alias("date"), F.format_string("T%05d", "id").alias("ticker"),
        *[F.col("id").cast("double").alias(c) for c in ("close", "adj_close")], F.col("id").alias("volume"),
    )
    days.write.parquet(f"{tmp_path}/stored")
    days = spark.read.parquet(f"{tmp_path}/stored")
    changed = days.withColumn("close", F.when(F.year("date") == 2024, F.sin("close")).otherwise(F.col("close"))).repartition(7)
    for name, rows in (("a", days), ("b", changed)):
        publish_years(rows, f"{tmp_path}/{name}")
    a, b = ({p.relative_to(tmp_path / n).as_posix(): p.read_bytes() for p in (tmp_path / n).rglob("*.parquet")} for n in "ab")
    assert a.keys() == b.keys() and sum("2023" in p for p in a) >= 4
    assert {p for p in a if a[p] != b[p]} == {p for p in a if "2024" in p}
    keys = [spark.read.parquet(f"{tmp_path}/a/{p}").agg(F.min(F.struct("date", "ticker")), F.max(F.struct("date", "ticker")), F.count("*")).first() for p in sorted(a)]
    assert all(x[1] < y[0] for x, y in zip(keys, keys[1:])) and sum(k[2] for k in keys) == 40_000
    plan = spark.createDataFrame([("2023", "unchanged"), ("2023", "download"), ("2024", "unchanged"), ("2024", "unchanged")], "key string, action string")
    assert {tuple(r) for r in N.asset_actions(plan).collect()} == {("2023", "download"), ("2024", "unchanged")}


def test_published_columns_have_one_encoding(spark, tmp_path):
    """A footer's list of several encodings is ordered by hashes of the JVM that wrote it, so equal files would differ between executors."""
    from pyarrow import parquet

    from barlake.sinks.layout import publish_years

    rows = many(spark).select("date", F.when(F.col("volume") % 7 > 0, F.col("ticker")).alias("ticker"), "close", "adj_close", "volume")
    publish_years(rows, f"{tmp_path}/p")
    facts = parquet.read_metadata(next((tmp_path / "p").rglob("*.parquet")))
    assert {len(facts.row_group(0).column(c).encodings) for c in range(facts.num_columns)} == {1}
    assert {facts.row_group(0).column(c).compression for c in range(facts.num_columns)} == {"ZSTD"}
    assert spark.read.parquet(f"{tmp_path}/p/daily").drop("year").exceptAll(rows).isEmpty() and facts.num_rows == 4800


def test_years_of_several_files_are_published_and_checked(spark, tmp_path):
    import json
    import shutil

    from barlake.errors import ManifestError
    from barlake.operators import inventory as N
    from barlake.plans.accept import accept_dataset
    from barlake.plans.backfill import backfill, export_dataset
    from barlake.plans.reconcile import reconcile_copies
    from barlake.schema import ATTEMPT_SCHEMA
    from barlake.sources import manifest as SM

    rows = many(spark, 40, 10).unionByName(bars(spark, ("2025-01-02", "T001", 3)))
    universe = rows.groupBy("ticker").agg(F.min(F.substring("ticker", 2, 9).cast("bigint")).alias("ord"))
    log = spark.createDataFrame([], ATTEMPT_SCHEMA)
    store = BarStore(spark, f"{tmp_path}/s")
    backfill(store, universe, rows.withColumn("volume", F.col("volume").cast("double")), log, dt.date(2024, 1, 1), dt.date(2025, 2, 1))
    root = f"{tmp_path}/data"
    export_dataset(store, root, rows_per_file=100)
    names = sorted(p.name for p in Path(f"{root}/daily/year=2024").glob("*.parquet"))
    assert names == [f"part-{k:05d}.parquet" for k in range(len(names))] and len(names) >= 4
    assert [p.name for p in Path(f"{root}/daily/year=2025").glob("*.parquet")] == ["prices.parquet"]
    lows = [spark.read.parquet(f"{root}/daily/year=2024/{n}").agg(F.min("date"), F.max("date")).first() for n in names]
    assert all(a[1] <= b[0] for a, b in zip(lows, lows[1:]))
    assert accept_dataset(spark, root, universe).first().total_row_count == 401

    manifest = SM.read_manifest(spark, f"{root}/manifest.json")
    parts = {r.local_path: r for r in SM.part_rows(manifest).collect()}
    lines = [f"{p} {parts[p].size_bytes} {parts[p].sha256}" for p in sorted(parts)]
    digest = hashlib.sha256(hashlib.sha256("\n".join(lines).encode()).hexdigest().encode()).hexdigest()
    year = SM.asset_rows(manifest).where("key = '2024'").first()
    assert (year.local_path, year.sha256, year.size_bytes) == ("daily/year=2024", digest, sum(r.size_bytes for r in parts.values()))

    copy = shutil.copytree(root, f"{tmp_path}/copy")
    target = Path(f"{copy}/daily/year=2024/part-00001.parquet")
    target.write_bytes(target.read_bytes()[:-1] + b"x")
    shutil.copy(target, f"{copy}/daily/year=2024/part-00099.parquet")
    found = reconcile_copies(spark, f"{root}/manifest.json", copy)
    assert [r.local_path for r in found.plan.where("action = 'download'").collect()] == ["daily/year=2024/part-00001.parquet"]
    assert [(r.local_path, r.state) for r in found.names.collect()] == [("daily/year=2024/part-00099.parquet", "obsolete")]

    sound = json.loads(Path(f"{root}/manifest.json").read_text())
    for spoil, rule in (
        (lambda m: m["partition_files"]["2024"].reverse(), "part_name"),
        (lambda m: m["partition_files"]["2024"][0].update(size_bytes=1), "part_tree"),
        (lambda m: m["partition_files"].pop("2024"), "part_tree"),
        (lambda m: m["partition_files"]["2024"][0].update(sha256="q"), "part_digest_format"),
    ):
        text = json.loads(json.dumps(sound))
        spoil(text)
        m = SM.parse_manifest(spark.createDataFrame([(json.dumps(text),)], "value string"))
        assert rule in {r.rule for r in N.part_violations(SM.asset_rows(m), SM.part_rows(m)).collect()}
    Path(f"{copy}/manifest.json").write_text(json.dumps(text))
    for crc in Path(copy).rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(ManifestError, match="part_"):
        accept_dataset(spark, copy, universe)


def test_blocks_are_dealt_over_tasks_of_bounded_size(spark, folder, monkeypatch):
    monkeypatch.setattr(SF, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(SF, "ROWS_PER_TASK", 30, raising=False)
    bars(spark, *[("2024-01-01", f"T{k:03d}", 1) for k in range(100)]).coalesce(1).write.parquet(f"{folder}/year=2024")
    runs = SF.key_runs(spark, folder)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    # lists of keys are kept for 128 blocks of a task, and all further rows of the task are sorted with their file's name
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and ", 4), REPARTITION_BY_NUM" in plan
    assert sorted((r.block, r.rows, r.first_key.ticker, r.last_key.ticker) for r in runs.collect())[-1] == (14, 2, "T098", "T099")
