"""Paged reads in rounds, presence bitmaps, rules counted during a write, batches and files judged one by one."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barlake.errors import DataQualityError, SourceError
from barlake.operators import presence as P
from barlake.operators.universe import best_per_ticker
from barlake.plans.universe import read_progressively
from barlake.schema import BAR_SCHEMA
from barlake.sinks.bars import observed_violations, write_staged, write_years
from barlake.sources.prices import resolve_columns, staged_violations
from barlake.sources.reports import read_failures
from barlake.sources.universe import page_files


def d(text):
    return dt.date.fromisoformat(text)


def bars(spark, *rows):
    return spark.createDataFrame([(d(a), t, float(c), float(c), 1) for a, t, c in rows], BAR_SCHEMA)


def quote(k, exchange="NMS"):
    return {"symbol": f"T{k:04d}", "exchange": exchange, "marketCap": 1000 + k, "longName": f"Company {k}", "quoteType": "EQUITY"}


@pytest.fixture
def listed(spark):
    return spark.range(5000).selectExpr(
        "concat('T', lpad(id, 4, '0')) AS ticker", "'Common Stock' AS security_name", "'NASDAQ' AS listing_exchange",
        "false AS etf", "false AS test_issue", "'Q' AS market_category", "'N' AS financial_status",
    )


def write_pages(folder, pages):
    Path(folder).mkdir(parents=True, exist_ok=True)
    for k, quotes in enumerate(pages):
        text = quotes if isinstance(quotes, str) else json.dumps({"quotes": quotes})
        Path(f"{folder}/page-{k}.json").write_text(text)
    return str(folder)


def kept(read):
    return sorted((r.page, r.ord) for r in read.records.select("page", "ord").collect())


def test_pages_behind_the_stop_are_never_opened(spark, tmp_path, listed):
    pages = [[quote(4 * p + i) for i in range(4)] for p in range(6)]
    folder = write_pages(tmp_path / "p", [*pages, "no page at all"])
    assert [n for n, _ in page_files(spark, folder)] == list(range(7))
    read = read_progressively(spark, folder, listed, target=10, page_size=4)
    assert (read.opened, read.listed) == (3, 7) and kept(read) == [(p, 4 * p + i) for p in range(3) for i in range(4)]
    # the target is met in the third round, whose last pages are opened and not kept, not even the broken one
    read = read_progressively(spark, folder, listed.where("ticker >= 'T0009'"), target=4, page_size=4)
    assert (read.opened, kept(read)[-1]) == (7, (3, 15))
    with pytest.raises(SourceError, match="invalid_page"):
        read_progressively(spark, folder, listed, target=1000, page_size=4)


def test_paged_read_stops_where_a_read_page_by_page_does(spark, tmp_path, listed):
    short = write_pages(tmp_path / "short", [[quote(i) for i in range(4)], [quote(4)], [quote(5 + i) for i in range(4)]])
    assert kept(read_progressively(spark, short, listed, target=50, page_size=4)) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 4)]
    again = [quote(i) for i in range(4)]
    stale = write_pages(tmp_path / "stale", [again, again, [quote(9 + i) for i in range(4)]])
    assert kept(read_progressively(spark, stale, listed, target=50, page_size=4)) == [(0, 0), (0, 1), (0, 2), (0, 3)]
    many = write_pages(tmp_path / "many", [[quote(4 * p + i) for i in range(4)] for p in range(5)])
    capped = read_progressively(spark, many, listed, target=50, page_size=4, max_candidates=6)
    assert kept(capped) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (1, 5)]
    # a ticker of two records counts once, on its first page
    twice = [quote(0), {**quote(0), "marketCap": 5}, quote(1), quote(2)]
    read = read_progressively(spark, write_pages(tmp_path / "twice", [twice, [quote(7 + i) for i in range(4)], again]), listed, target=4, page_size=4)
    assert {p for p, _ in kept(read)} == {0, 1}
    with pytest.raises(SourceError, match="no pages"):
        read_progressively(spark, write_pages(tmp_path / "none", []), listed, target=4)


def test_presence_bits(spark):
    days = ["1970-01-01", "2024-02-29", "2024-03-01", "2059-09-18", "2059-09-19", "2070-01-01"]
    one = P.presence(bars(spark, *[(x, "A", 1) for x in days[:3]], ("2024-02-29", "B", 1)))
    two = P.presence(bars(spark, *[(x, "A", 1) for x in days[2:]]))
    both = P.merged(one, two)
    assert {r.ticker: r.row_count for r in P.day_counts(both).collect()} == {"A": 6, "B": 1}
    for x in days:
        assert both.where(P.has_day(d(x))).where("ticker = 'A'").count() == 1
    assert both.where(P.has_day(d("2024-02-28"))).count() == 0
    universe = spark.createDataFrame([("B",), ("C",)], "ticker string")
    assert [r.ticker for r in P.active_on(both, universe, [d("2024-02-28"), d("2024-02-29")]).collect()] == ["B"]
    assert P.active_on(both, universe, []).count() == 0
    assert tuple(P.share_on(both, universe, d("2024-02-29")).first()) == (2, 1, 0.5)
    assert P.share_on(both, universe.limit(0), d("2024-02-29")).first().coverage_ratio == 1.0
    assert P.presence(bars(spark)).collect() == []
    early = P.presence(bars(spark, ("1969-12-31", "A", 1), ("1969-10-01", "A", 1)))
    assert early.where(P.has_day(d("1969-12-31"))).count() == early.where(P.has_day(d("1969-10-01"))).count() == 1
    # a ticker's row is as wide as a number, whatever its days
    assert dict(both.dtypes)["days"] == "bigint"


def test_rules_are_counted_once_during_the_write(spark, tmp_path):
    rows = spark.range(5000).selectExpr("date_add(date '2024-01-01', int(id % 100)) date", "concat('T', id) ticker", "double(id - 10) close", "1d adj_close", "id volume")
    seen = write_years(rows, f"{tmp_path}/w", rules={"bad": F.col("close") <= 0, "unknown": F.col("close") > F.lit(None)})
    assert {r.rule: r.n for r in observed_violations(spark, seen).collect()} == {"bad": 11, "unknown": 5000}
    with pytest.raises(DataQualityError, match="close_not_positive_finite: 11"):
        write_staged(rows, f"{tmp_path}/s", d("2024-01-01"), d("2025-01-01"))
    good = rows.withColumn("close", F.lit(1.0))
    assert write_staged(good, f"{tmp_path}/g", d("2024-01-01"), d("2025-01-01"), good.select("ticker")).count() == 5000
    with pytest.raises(DataQualityError, match="duplicate_key: 5000.*unexpected_ticker"):
        write_staged(good.unionByName(good), f"{tmp_path}/t", d("2024-01-01"), d("2025-01-01"), good.where("volume > 5").select("ticker"))


def test_each_staged_batch_is_judged(spark, tmp_path):
    bars(spark, ("2024-01-01", "A", 1)).write.parquet(f"{tmp_path}/b=0")
    bars(spark, ("2024-01-01", "A", -1), ("2024-01-01", "A", 2), ("2020-01-01", "Z", 1)).write.parquet(f"{tmp_path}/b=1")
    bars(spark, ("2024-01-01", "A", 1)).drop("volume").write.parquet(f"{tmp_path}/b=2")

    def found(*names):
        got = staged_violations(spark, [f"{tmp_path}/{n}" for n in names], d("2024-01-01"), d("2025-01-01"), bars(spark, ("2024-01-01", "A", 1)))
        return {(r.batch, r.rule): r.n for r in got.collect()}

    assert found("b=0") == {}
    assert found("b=0", "b=1", "b=2") == {
        ("b=1", "close_not_positive_finite"): 1, ("b=1", "adj_close_not_positive_finite"): 1, ("b=1", "duplicate_key"): 1, ("b=1", "date_out_of_range"): 1, ("b=1", "unexpected_ticker"): 1, ("b=2", "null_value"): 1,
    }
    bars(spark, ("2024-01-01", "A", 1)).withColumn("more", F.lit(1)).write.parquet(f"{tmp_path}/b=3")
    assert ("", "schema") in found("b=0", "b=3")
    bars(spark, ("2024-01-01", "A", 1)).withColumn("close", F.lit("x")).write.parquet(f"{tmp_path}/b=4")
    with pytest.raises(Exception, match="CANNOT_MERGE_SCHEMAS|FAILED_READ_FILE|merg"):
        found("b=0", "b=4")


def test_every_report_file_has_the_exact_header(spark, tmp_path):
    header = "ticker,status,attempt_count,error_type,error_message"
    folder = tmp_path / "r"
    folder.mkdir()
    (folder / "a.csv").write_text(f"{header}\nA,failed,1,x,y\n")
    assert [r.ticker for r in read_failures(spark, str(folder)).collect()] == ["A"]
    (folder / "b.csv").write_text(f"{header.replace('status', 'state')}\nB,failed,1,x,y\n")
    with pytest.raises(Exception, match="status|state|unexpected columns"):
        read_failures(spark, str(folder)).collect()


def test_best_record_is_one_hash_aggregate(spark):
    rows = [(5, "A", 10), (3, "A", 10), (9, "A", 2**62), (2**40, "B", 1), (7, "A", 2**62), (0, "C", 3), (1, "C", 3)]
    kept_rows = spark.createDataFrame(rows, "ord long, ticker string, market_cap long").selectExpr(
        "*", "'c' company_name", "'s' security_name", "'n' yahoo_exchange", "'l' listing_exchange", "'q' quote_type"
    )
    best = best_per_ticker(kept_rows)
    assert sorted((r.ticker, r.ord, r.market_cap) for r in best.collect()) == [("A", 7, 2**62), ("B", 2**40, 1), ("C", 0, 3)]
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()


def test_wide_labels_of_many_tickers():
    tickers = [f"T{k}" for k in range(4000)]
    found = resolve_columns([f"{t}|Close" for t in tickers], tickers)
    assert len(found) == 4000 and found["T7"] == {"close": "T7|Close"}


def test_names_of_batches_take_no_pattern_per_row(spark, tmp_path):
    bars(spark, ("2024-01-01", "A", -1)).write.parquet(f"{tmp_path}/b=1")
    found = staged_violations(spark, f"{tmp_path}/b=1", d("2024-01-01"), d("2025-01-01"))
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.batch, r.rule): r.n for r in found.collect() if r.rule == "close_not_positive_finite"} == {("b=1", "close_not_positive_finite"): 1}
