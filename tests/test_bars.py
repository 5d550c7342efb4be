import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barlake.errors import ConflictError, DataQualityError, RefreshError, SourceError
from barlake.operators import bars as B
from barlake.operators import coverage as V
from barlake.operators import quality as Q
from barlake.operators.gates import enforce
from barlake.operators.ordering import first_occurrence, in_batches, with_position
from barlake.operators.upsert import keep_last_by_source, upsert, upsert_small, upsert_violations
from barlake.plans.clean import clean_bars, clean_wide
from barlake.schema import BAR_SCHEMA

RAW = "date date, ticker string, close double, adj_close double, volume double"
START, END = dt.date(2016, 1, 1), dt.date(2021, 1, 1)
NAN, INF = float("nan"), float("inf")


def d(text):
    return dt.date.fromisoformat(text)


def raw(spark, rows):
    return spark.createDataFrame([(d(a) if a else None, t, c, j, v) for a, t, c, j, v in rows], RAW)


def bar(spark, rows):
    return spark.createDataFrame([(d(a), t, float(c), float(j), v) for a, t, c, j, v in rows], BAR_SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


CLEANING = [
    ("2009-12-31", "A", 10.0, 9.0, 100.0), ("2020-01-02", "A", 0.0, 9.0, 100.0), ("2020-01-03", "A", 10.0, -1.0, 100.0),
    ("2020-01-04", "A", 10.0, 9.0, -1.0), ("2020-01-05", "A", 10.0, 9.0, 1.5), ("2020-01-06", "A", 10.0, 9.0, 0.0),
]


def test_cleaning_counts(spark):
    c = clean_bars(raw(spark, CLEANING), START, END)
    assert rows_of(c.bars) == [(d("2020-01-06"), "A", 10.0, 9.0, 0)]
    assert c.counts() == (5, 0)
    assert B.count_invalid(raw(spark, CLEANING), START, END).first()[0] == 5


@pytest.mark.parametrize("column", [2, 3, 4])
@pytest.mark.parametrize("value", [NAN, INF, -INF, None])
def test_non_finite_values_are_invalid(spark, column, value):
    row = ["2020-01-06", "A", 10.0, 9.0, 5.0]
    row[column] = value
    assert B.valid_rows(raw(spark, [tuple(row)]), START, END).count() == 0


@pytest.mark.parametrize(("volume", "kept"), [(2.5, None), (2.0 + 5e-10, 2), (-1e-10, None), (1e15, 10**15)])
def test_volume_tolerance(spark, volume, kept):
    found = B.valid_rows(raw(spark, [("2020-01-06", "A", 1.0, 1.0, volume)]), START, END).collect()
    assert [r.volume for r in found] == ([] if kept is None else [kept])


def test_equal_copies_collapse_and_conflicts_refuse(spark):
    same = ("2020-01-02", "A", 10.0, 9.0, 100.0)
    c = clean_bars(raw(spark, [same, same]), START, END)
    assert c.bars.count() == 1 and c.counts() == (0, 1)
    c.enforce()
    clash = clean_bars(raw(spark, [same, ("2020-01-02", "A", 11.0, 9.0, 100.0), ("2020-01-03", "B", 1.0, 1.0, 1.0)]), START, END)
    assert rows_of(clash.conflicts) == [(d("2020-01-02"), "A", 2)]
    assert [r.ticker for r in clash.bars.collect()] == ["B"]
    with pytest.raises(ConflictError, match="2020-01-02 A"):
        clash.enforce()


def test_outcomes(spark):
    requested = spark.createDataFrame([("A",), ("B",), ("Z",)], "ticker string")
    feed = raw(spark, [("2020-01-02", "A", 1.0, 1.0, 1.0), ("2020-01-02", "B", -1.0, 1.0, 1.0)])
    found = {r.ticker: (r.outcome, r.error_type) for r in clean_bars(feed, START, END, requested).outcomes.collect()}
    assert found == {"A": ("success", ""), "B": ("failed", "InvalidData"), "Z": ("no_data", "NoData")}


@pytest.mark.parametrize("order", ["ticker first", "field first"])
def test_wide_layouts(spark, order):
    def label(t, f):
        return f"{t}|{f}" if order == "ticker first" else f"{f}|{t}"

    names = ["date"] + [label(t, f) for t in ("AAA", "BBB") for f in ("Close", "Adj Close", "Volume", "Open")]
    wide = spark.createDataFrame([(dt.datetime(2020, 1, 2), 10.0, 9.0, 100.0, 1.0, "20.0", "18.0", "200", "x")], names)
    found = clean_wide(wide, ["AAA", "BBB"], START, END)
    assert rows_of(found.bars) == [(d("2020-01-02"), "AAA", 10.0, 9.0, 100), (d("2020-01-02"), "BBB", 20.0, 18.0, 200)]


def test_wide_refusals(spark):
    flat = spark.createDataFrame([("2020-01-02T00:00:00-05:00", 10.0, 9.0, 100)], ["date", "Close", "adj_close", "Volume"])
    assert clean_wide(flat, ["AAA"], START, END).bars.count() == 1
    with pytest.raises(SourceError):
        clean_wide(flat, ["AAA", "BBB"], START, END)
    twice = spark.createDataFrame([("2020-01-02", 1.0, 2.0)], ["date", "A|Close", "close|A"])
    with pytest.raises(SourceError, match="duplicate"):
        clean_wide(twice, ["A"], START, END)
    partial = spark.createDataFrame([("2020-01-02", 1.0, 2)], ["date", "A|Close", "A|Volume"])
    found = {r.ticker: (r.outcome, r.error_type) for r in clean_wide(partial, ["A", "B"], START, END).outcomes.collect()}
    assert found == {"A": ("failed", "MissingFields"), "B": ("no_data", "NoData")}


OLD = [("2025-12-31", "AAA", 10, 9, 100), ("2026-01-02", "AAA", 11, 10, 101), ("2026-01-02", "BBB", 20, 19, 200)]
NEW = [("2026-01-02", "AAA", 12, 11.5, 111), ("2026-01-05", "AAA", 13, 12, 112)]


@pytest.mark.parametrize("how", [upsert, upsert_small])
def test_upsert_keeps_omitted_keys_and_is_idempotent(spark, how):
    old, new = bar(spark, OLD), bar(spark, NEW)
    once = how(old, new)
    found = {(r.date.isoformat(), r.ticker): r.adj_close for r in once.collect()}
    assert found == {("2025-12-31", "AAA"): 9, ("2026-01-02", "AAA"): 11.5, ("2026-01-02", "BBB"): 19, ("2026-01-05", "AAA"): 12}
    assert rows_of(how(once, new)) == rows_of(once)
    both = old.withColumn("s", F.lit(0)).unionByName(new.withColumn("s", F.lit(1)))
    assert rows_of(keep_last_by_source(both, "s")) == rows_of(once)


def test_upsert_preconditions(spark):
    allowed = spark.createDataFrame([("AAA",), ("BBB",)], "ticker string")
    old, new = bar(spark, OLD), bar(spark, NEW)
    assert upsert_violations(old, new, d("2025-12-20"), d("2026-01-05"), allowed).count() == 0
    late = bar(spark, [*OLD, ("2026-01-06", "BBB", 1, 1, 1)])
    rules = {r.rule for r in upsert_violations(late, new, d("2026-01-03"), d("2026-01-05"), allowed.where("ticker = 'BBB'")).collect()}
    assert rules == {"old_rows_after_target", "date_out_of_range", "unexpected_ticker"}


def test_bar_gate(spark):
    rows = [("2020-01-02", "A", 1, 1, 1), ("2020-01-02", "A", 1, 1, 1), ("2020-01-03", "", 1, 1, -1), ("2030-01-03", "X", NAN, INF, 1)]
    allowed = spark.createDataFrame([("A",), ("",)], "ticker string")
    found = {r.rule: (r.n, r["sample"]) for r in Q.bar_violations(bar(spark, rows), START, END, allowed).collect()}
    assert found == {
        "duplicate_key": (1, "2020-01-02 A"), "empty_ticker": (1, ""), "negative_volume": (1, ""), "date_out_of_range": (1, ""),
        "close_not_positive_finite": (1, ""), "adj_close_not_positive_finite": (1, ""), "unexpected_ticker": (1, "X"),
    }
    nulls = spark.createDataFrame([(None, "A", 1.0, None, 1)], BAR_SCHEMA)
    assert {r.rule: r.n for r in Q.bar_violations(nulls, START, END).collect()} == {"null_value": 1}
    wrong = spark.createDataFrame([("A", 1)], "ticker string, volume long").selectExpr(
        "date '2020-01-01' date", "ticker", "1f close", "1d adj_close", "volume"
    )
    assert "schema" in {r.rule for r in Q.bar_violations(wrong, START, END).collect()}
    with pytest.raises(DataQualityError, match="duplicate_key: 1"):
        enforce(Q.bar_violations(bar(spark, rows), START, END))


def test_positions_and_batches(spark):
    rng = random.Random(4)
    names = [f"T{i:04d}" for i in range(1203)]
    rng.shuffle(names)
    df = spark.createDataFrame([(n,) for n in names], "ticker string").repartition(7)
    placed = {r.ticker: r.position for r in with_position(df, [F.col("ticker")]).collect()}
    assert placed == {n: i for i, n in enumerate(sorted(names), start=1)}
    sizes = in_batches(df, [F.desc("ticker")], 250, 250).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [250, 250, 250, 250, 203]
    with pytest.raises(ValueError):
        in_batches(df, [F.col("ticker")], 251, 250)
    firsts = spark.createDataFrame([(5, "A"), (2, "B"), (1, "A")], "ord long, ticker string")
    assert rows_of(first_occurrence(firsts, "ticker", "ord")) == [("A", 1), ("B", 2)]


def random_bars(rng, days, tickers, scale):
    return [(day, t, scale, scale, rng.randrange(9)) for day in days for t in tickers if rng.random() < 0.6]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_incremental_coverage_equals_recomputation(spark, seed):
    rng = random.Random(seed)
    tickers = [f"T{i}" for i in range(6)]
    days = [f"2025-{m:02d}-15" for m in range(1, 13)] + [f"2026-{m:02d}-15" for m in range(1, 4)]
    old = bar(spark, random_bars(rng, days[:13], tickers[:5], 1.0))
    new = bar(spark, random_bars(rng, days[8:], tickers, 2.0))
    universe = spark.createDataFrame([(t,) for t in [*tickers, "NONE"]], "ticker string")
    state = universe.selectExpr("ticker", "'no_data' status", "1L attempt_count", "'m' error_message", "'NoData' error_type")
    prior = V.build_coverage(universe, old, state)
    window = old.where("year(date) = 2026 OR month(date) > 6")
    merged = upsert(window, new)
    after = V.refresh_coverage(universe, prior, window, merged, state)
    want = {r.ticker: (r.first_date, r.last_date, r.row_count) for r in V.ticker_ranges(upsert(old, new)).collect()}
    for r in after.collect():
        assert (r.first_date, r.last_date, r.row_count) == want.get(r.ticker, (None, None, 0))
        assert r.status == ("success" if r.ticker in want else "no_data")
        assert r.attempt_count == 2 and r.last_error == "m"


def test_hot_ticker_with_copies(spark):
    """A third of the rows on one ticker, many as copies: the fold must stay exact."""
    cold = spark.range(4000).selectExpr("date_add(date '2018-01-01', int(id % 20)) date", "concat('T', id) ticker", "1d close", "1d adj_close", "1d volume")
    hot = spark.range(2000).selectExpr("date_add(date '2018-01-01', int(id % 500)) date", "'HOT' ticker", "2d close", "2d adj_close", "3d volume")
    c = clean_bars(cold.unionByName(hot), START, END)
    assert c.counts() == (0, 1500)
    hot_range = V.ticker_ranges(c.bars).where("ticker = 'HOT'").first()
    assert hot_range.row_count == 500


def test_empty_year_is_refused(spark, folder):
    from barlake.sinks.bars import rewrite_years

    with pytest.raises(RefreshError, match="2027"):
        rewrite_years(bar(spark, OLD), f"{folder}/x", [2025, 2026, 2027])
