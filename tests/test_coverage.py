import datetime as dt

import pytest

from barlake.errors import DataQualityError, RefreshError
from barlake.operators import calendar as C
from barlake.operators import coverage as V
from barlake.operators import quality as Q
from barlake.operators.gates import enforce
from barlake.schema import ATTEMPT_SCHEMA, BAR_SCHEMA


def d(text):
    return dt.date.fromisoformat(text)


def names(spark, *tickers):
    return spark.createDataFrame([(t,) for t in tickers], "ticker string")


def test_status_fold(spark):
    log = [
        ("BBB", 1, "no_data", "", ""), ("BBB", 2, "no_data", "", ""), ("BBB", 3, "success", "", ""),
        *[("AAA", i, "no_data", "", "") for i in range(1, 5)],
        *[("ERR", i, "failed", "TimeoutError", f"try {i}") for i in range(1, 4)],
        ("MIX", 1, "failed", "KeyError", "k"), ("MIX", 2, "no_data", "", ""),
    ]
    universe = names(spark, "AAA", "BBB", "ERR", "MIX", "NEVER", "ROWS")
    bars = spark.createDataFrame([(d("2020-01-02"), "ROWS", 1.0, 1.0, 1)], BAR_SCHEMA)
    found = {r.ticker: tuple(r)[1:] for r in V.resolve_status(spark.createDataFrame(log, ATTEMPT_SCHEMA), universe, bars).collect()}
    assert found["BBB"] == ("no_data", 3, "NoData", V.NO_DATA_FINAL_MESSAGE)
    assert found["AAA"] == ("no_data", 4, "NoData", V.NO_DATA_FINAL_MESSAGE)
    assert found["ERR"] == ("failed", 3, "TimeoutError", "try 3")
    assert found["MIX"] == ("failed", 2, "NoData", V.NO_DATA_MESSAGE)
    assert found["NEVER"] == ("failed", 0, "DownloadError", V.UNDETERMINED_MESSAGE)
    assert found["ROWS"][0] == "success"


def weekday_sessions(spark, first, last, holidays=(), early=()):
    """Sessions that close at 16:00 New York, or 13:00 on early days, as UTC wall clocks."""
    from zoneinfo import ZoneInfo

    rows, day = [], d(first)
    while day <= d(last):
        if day.weekday() < 5 and day.isoformat() not in holidays:
            hour = 13 if day.isoformat() in early else 16
            local = dt.datetime(day.year, day.month, day.day, hour, tzinfo=ZoneInfo("America/New_York"))
            rows.append((day, local.astimezone(dt.UTC).replace(tzinfo=None)))
        day += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "session date, close_utc timestamp_ntz")


@pytest.fixture(scope="module")
def xnys(spark):
    return weekday_sessions(spark, "2024-12-02", "2026-12-31", holidays=("2025-11-27", "2025-12-25", "2026-01-01", "2026-07-03"), early=("2025-11-28",))


CASES = [
    ("2026-08-04 22:00", "2026-08-04"), ("2026-08-04 20:30", "2026-08-03"), ("2026-08-08 16:00", "2026-08-07"), ("2026-07-04 16:00", "2026-07-02"),
    ("2025-03-10 21:45", "2025-03-10"), ("2025-11-28 19:00", "2025-11-26"), ("2025-11-28 20:00", "2025-11-28"), ("2025-11-28 19:30", "2025-11-28"),
    ("2030-01-01 00:00", "2026-12-31"), ("2020-01-01 00:00", None),
]


def test_settled_sessions(spark, xnys):
    asked = spark.createDataFrame([(i, dt.datetime.fromisoformat(n)) for i, (n, _) in enumerate(CASES)], "i int, now_utc timestamp_ntz")
    found = {r.i: r.resolved for r in C.latest_settled(asked, xnys).collect()}
    assert [found[i] and found[i].isoformat() for i in range(len(CASES))] == [want for _, want in CASES]


def test_long_delay_reaches_back_several_sessions(spark, xnys):
    asked = spark.createDataFrame([(dt.datetime(2026, 8, 7, 12),)], "now_utc timestamp_ntz")
    assert C.latest_settled(asked, xnys, delay_minutes=3 * 24 * 60).first().resolved == d("2026-08-03")


def test_explicit_targets(xnys):
    at = dt.datetime(2025, 11, 28, 19)
    with pytest.raises(RefreshError, match="not_a_session"):
        C.target_session(xnys, at, target=d("2025-11-29"))
    with pytest.raises(RefreshError, match="not_settled"):
        C.target_session(xnys, at, target=d("2025-11-28"))
    assert C.target_session(xnys, at, target=d("2025-11-28"), allow_partial=True) == d("2025-11-28")
    assert C.target_session(xnys, at, allow_partial=True) == d("2025-11-28")
    assert C.target_session(xnys, at) == d("2025-11-26")


def test_expected_active_and_ratio(spark, xnys):
    bars = spark.createDataFrame(
        [(d("2026-01-02"), "AAA", 1.0, 1.0, 1), (d("2025-12-31"), "BBB", 1.0, 1.0, 1), (d("2025-01-02"), "OLD", 1.0, 1.0, 1), (d("2026-01-02"), "XXX", 1.0, 1.0, 1)],
        BAR_SCHEMA,
    )
    target = d("2026-01-05")
    expected = V.expected_active(bars, names(spark, "AAA", "BBB", "OLD"), xnys, target)
    assert sorted(r.ticker for r in expected.collect()) == ["AAA", "BBB"]
    merged = bars.unionByName(spark.createDataFrame([(target, "AAA", 1.0, 1.0, 1)], BAR_SCHEMA))
    ratio = V.target_coverage(expected, merged, target)
    assert ratio.first().coverage_ratio == 0.5
    assert [r.ticker for r in V.missing_at_target(expected, merged, target).collect()] == ["BBB"]
    with pytest.raises(DataQualityError, match="target_coverage"):
        enforce(Q.coverage_gate(ratio))
    enforce(Q.coverage_gate(ratio, allow_partial=True))
    enforce(Q.coverage_gate(ratio, 0.5))
    nobody = expected.where("ticker = ''")
    assert V.target_coverage(nobody, merged, target).first().coverage_ratio == 1.0


def test_universe_wide_ratio(spark):
    bars = spark.createDataFrame([(d("2020-01-02"), "AAA", 1.0, 1.0, 1), (d("2020-01-01"), "BBB", 1.0, 1.0, 1)], BAR_SCHEMA)
    assert V.universe_coverage(bars, names(spark, "AAA", "BBB"), d("2020-01-02")).first().coverage_ratio == 0.5


def test_coverage_and_reports(spark):
    universe = names(spark, "AAA", "BBB", "CCC")
    bars = spark.createDataFrame([(d("2020-01-02"), "AAA", 1.0, 1.0, 1), (d("2020-01-03"), "AAA", 1.0, 1.0, 1)], BAR_SCHEMA)
    log = spark.createDataFrame([("AAA", 1, "success", "", ""), ("BBB", 1, "failed", "TimeoutError", "slow")], ATTEMPT_SCHEMA)
    state = V.resolve_status(log, universe, bars)
    coverage = V.build_coverage(universe, bars, state)
    assert [tuple(r) for r in coverage.orderBy("ticker").collect()] == [
        ("AAA", "success", d("2020-01-02"), d("2020-01-03"), 2, 1, ""),
        ("BBB", "failed", None, None, 0, 1, "slow"),
        ("CCC", "failed", None, None, 0, 0, V.UNDETERMINED_MESSAGE),
    ]
    assert [tuple(r) for r in V.failure_report(coverage, state).orderBy("ticker").collect()] == [
        ("BBB", "failed", 1, "TimeoutError", "slow"), ("CCC", "failed", 0, "DownloadError", V.UNDETERMINED_MESSAGE),
    ]
    assert tuple(V.status_counts(coverage).first()) == (1, 0, 2)
    missing = V.missing_report(names(spark, "BBB", "ZZZ"), state)
    assert [tuple(r) for r in missing.orderBy("ticker").collect()] == [("BBB", True, "failed", "slow"), ("ZZZ", True, "unknown", "")]
    rules = {r.rule for r in Q.coverage_row_violations(coverage, names(spark, "AAA", "BBB")).collect()}
    assert {"coverage_not_universe", "status_not_success", "no_rows", "leftover_error"} <= rules
