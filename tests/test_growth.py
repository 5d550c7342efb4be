"""Steps of queries whose work has to grow no faster than the tables."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barlake.operators import bars as B
from barlake.plans.clean import clean_bars
from barlake.sinks import bars as SB
from barlake.workloads import inputs as I
from barlake.workloads import storage as WS
from barlake.workloads import updates as WU

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not mounted")


@pytest.fixture(autouse=True)
def anew():
    I.forget()
    yield
    I.forget()


def test_a_year_of_unsorted_bars_is_written_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {r.rule: r.n for r in WS.w6_unsorted(spark, SF).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    years = [f.split("/")[-2] for f in spark.read.parquet(I.once(spark, SF, "unsorted", None)).inputFiles()]
    assert len(years) > len(set(years))
    assert found == {"file_not_sorted": len([y for y in set(years) if int(y[-1]) % 2 == 0]), "file_repeats_key": len(set(years))}


def test_arriving_bars_come_from_the_store(spark, folder):
    store = WU.based_store(spark, folder, I.bars(spark, SF))
    assert {r.year: r.row_count for r in store.current().where("year IS NOT NULL").collect()} == {r.year: r["count"] for r in store.bars().groupBy("year").count().collect()}
    assert all("/year=200" in f for f in WU.arriving(store).inputFiles())


def test_a_published_row_is_compared_with_the_bounds_of_its_day(spark):
    first = dt.date(2000, 1, 1)
    keys = [(first + dt.timedelta(days=k % 500), None if k == 17 else f"T{k % 37:02d}") for k in range(6_000)]
    rows = spark.createDataFrame([(*k, 1.0, 1.0, 1) for k in keys], "date date, ticker string, close double, adj_close double, volume long")

    def ordered(key):
        return key[0], key[1] is not None, key[1] or ""

    few, many = SB._fixed_out(rows, 3_000), SB._fixed_out(rows, 100)
    assert many.rdd.getNumPartitions() > 20
    # the bounds are no part of the rows' expression
    plans = [df._jdf.queryExecution().analyzed().toString() for df in (few, many)]
    assert abs(len(plans[0]) - len(plans[1])) < 100
    bounds = SB._bounds(rows.withColumn("year", F.year("date")), 100)
    before, place = 0, {}
    for year, cuts in bounds:
        for k in keys:
            if k[0].year == year:
                place[k] = before + sum(ordered(b) <= ordered(k) for b in cuts)
        before += len(cuts) + 1
    found = {(r.date, r.ticker): r.p for r in many.select("date", "ticker", F.spark_partition_id().alias("p")).collect()}
    assert found == place and many.rdd.getNumPartitions() == before


def test_outcomes_and_counts_are_made_of_tallies(spark):
    cleaned = clean_bars(I.dirty(spark, SF), I.START, I.END, I.parts(spark, SF), materialize=True)
    assert not set(cleaned.folded.inputFiles()) & {*cleaned.outcomes.inputFiles(), *cleaned.tallies.inputFiles(), *cleaned.partials().inputFiles()}
    assert sorted(cleaned.outcomes.collect()) == sorted(B.ticker_outcomes(cleaned.folded, I.parts(spark, SF)).collect())
    invalid = cleaned.folded.agg(F.sum("invalid")).first()[0]
    assert invalid > 0 and cleaned.counts() == (invalid, B.duplicates_removed(cleaned.folded).first()[0])


def test_bars_are_folded_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(I, "ROWS_PER_TASK", 100, raising=False)
    rows = I.raw_bars(spark, SF).count()
    assert I.bars(spark, SF).rdd.getNumPartitions() == -(-rows // 100) > 8
