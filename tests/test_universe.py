import json

import pytest
from pyspark.sql import functions as F

from barlake.errors import SourceError, UniverseError
from barlake.operators import quality as Q
from barlake.operators import universe as U
from barlake.operators.gates import enforce
from barlake.plans.universe import build_universe, publish_universe, qualify_candidates, validate_universe
from barlake.schema import UNIVERSE_SCHEMA
from barlake.sinks.snapshots import BarStore
from barlake.sources import directory as D
from barlake.sources import universe as SU

A_HEAD = "Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares"
B_HEAD = "ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol"
FOOT = "File Creation Time: 0804202621:31|||||||"


def write(folder, name, *lines):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as handle:
        handle.write("\n".join(lines) + "\n")
    return path


def read_a(spark, folder, *lines, head=A_HEAD):
    return D.parse_listed_a(D.read_pipe(spark, write(folder, "a.txt", head, *lines, FOOT), D.LISTED_A_COLUMNS))


def read_b(spark, folder, *lines):
    return D.parse_listed_b(D.read_pipe(spark, write(folder, "b.txt", B_HEAD, *lines, FOOT), D.LISTED_B_COLUMNS))


def test_first_layout(spark, folder):
    row = read_a(spark, folder, "zub.k|Zubex Mills Common Stock, Class K|s|N|N|40|y|N", "|||||||").first()
    assert (row.raw_symbol, row.ticker, row.market_category, row.listing_exchange, row.etf, row.problem) == ("zub.k", "ZUB-K", "S", "NASDAQ", True, None)


def test_second_layout(spark, folder):
    rows = {r.ticker: r for r in read_b(
        spark, folder, "TOLV|Tolva Mining Common Stock|A|TOLV|Y|10|N|TOLV", "OST.R|Ostrava Works Rights|N|OST.R|N|10|N|OST^",
    ).collect()}
    assert rows["TOLV"].listing_exchange == "NYSE American" and rows["TOLV"].financial_status is None and rows["TOLV"].etf
    assert rows["OST-R"].raw_symbol == "OST.R" and rows["OST-R"].listing_exchange == "NYSE"


def test_directory_refusals(spark, folder):
    bad = D.combine(read_a(spark, folder, "ABC|Example Common Stock|Q|N|N|100||N", "XYZ||Q|N|N|100|N|N"))
    assert {r.problem for r in bad.collect()} == {"invalid_etf_flag", "invalid_critical_field"}
    assert {r.rule: r.n for r in D.directory_violations(bad).collect()} == {"invalid_record": 2}
    with pytest.raises(SourceError, match="Financial Status"):
        read_a(spark, folder, "A|b", head="Symbol|Security Name|Market Category|Test Issue|ETF")
    empty = D.combine(read_a(spark, folder))
    assert {r.rule for r in D.directory_violations(empty).collect()} == {"no_records"}


def test_directory_union(spark, folder):
    a = read_a(spark, folder, "ABC|Example Common Stock|Q|N|N|100|N|N", "ABC|Example Common Stock|Q|N|N|100|N|N")
    b = read_b(spark, folder, "ABC|Other Common Stock|N|ABC|N|100|N|ABC")
    assert D.raw_record_count(D.combine(a)).first()[0] == 2
    assert D.directory(D.combine(a)).count() == 1
    assert {r.rule: r["sample"] for r in D.directory_violations(D.combine(a, b)).collect()} == {"conflicting_records": "ABC"}


def test_universe_and_exclusion_files(spark, folder):
    path = write(folder, "u.csv", "﻿ticker,company_name", " aapl ,x", "MSFT,x", "AAPL,x", " ,x", "brk.b,x")
    assert [r.ticker for r in SU.load_universe(spark, path).orderBy("ord").collect()] == ["AAPL", "MSFT", "BRK-B"]
    with pytest.raises(SourceError, match="BAD/F"):
        SU.load_universe(spark, write(folder, "v.csv", "ticker", "BAD/F"))
    with pytest.raises(SourceError, match="no_tickers"):
        SU.load_universe(spark, write(folder, "w.csv", "ticker", " "))
    with pytest.raises(SourceError, match="ticker"):
        SU.load_universe(spark, write(folder, "x.csv", "symbol", "A"))
    listed = SU.manual_exclusions(spark, write(folder, "e.txt", "# comment", "", "brk.b", " AAPL "))
    assert sorted(r.ticker for r in listed.collect()) == ["AAPL", "BRK-B"]
    assert SU.manual_exclusions(spark, f"{folder}/absent.txt").count() == 0
    with pytest.raises(SourceError, match="A B"):
        SU.manual_exclusions(spark, write(folder, "f.txt", "A B"))
    with pytest.raises(UniverseError, match="unexpected columns"):
        SU.read_universe(spark, write(folder, "y.csv", "ticker,market_cap", "A,1"))


def test_pages(spark, folder):
    write(folder, "p1.json", json.dumps({"quotes": [{"symbol": "A"}, "junk"]}))
    write(folder, "p2.json", json.dumps({"quotes": []}))
    write(folder, "p3.json", json.dumps({"other": 1}))
    write(folder, "p14.json", "not json")
    parsed = SU.read_pages(spark, [f"{folder}/p{i}.json" for i in (1, 2, 3, 14)])
    rows = [(r.page, r.pos, r.problem) for r in parsed.orderBy("page", "pos").collect()]
    assert rows == [(1, 0, None), (1, 1, None), (3, None, "no_quotes_list"), (14, None, "no_quotes_list")]
    assert SU.page_violations(parsed).first()["n"] == 2


def test_unranked_files_keep_their_order(spark, folder):
    def tickers(name, *lines):
        return [r.ticker for r in SU.load_universe(spark, write(folder, name, "ticker,market_cap_rank", *lines)).orderBy("ord").collect()]

    assert tickers("ranked.csv", "TOLV,3", "ZUB,2", "OST,1") == ["OST", "ZUB", "TOLV"]
    assert tickers("unranked.csv", "TOLV,3", "ZUB,", "OST,1") == ["TOLV", "ZUB", "OST"]


def records(spark, *items):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(items)], "ord long, value string").select(
        "ord", F.parse_json("value").alias("record")
    )


def quote(symbol, cap=100, exchange="NMS", **more):
    return {"symbol": symbol, "marketCap": cap, "exchange": exchange, "quoteType": "EQUITY", "longName": f"{symbol} Inc", **more}


def listing(spark, **changes):
    base = {"raw_symbol": "", "ticker": "", "security_name": "Zubex Mills Common Stock", "listing_exchange": "NASDAQ", "etf": False,
            "test_issue": False, "market_category": "Q", "financial_status": "N"}
    rows = [tuple({**base, "raw_symbol": t, "ticker": t, **c}.values()) for t, c in changes.items()]
    from barlake.schema import DIRECTORY_SCHEMA

    return spark.createDataFrame(rows, DIRECTORY_SCHEMA)


REASONS = [
    ("not_in_symbol_directory", quote("GONE"), {}),
    ("exchange_not_allowed", quote("AAA", exchange="PNK"), {}),
    ("exchange_not_allowed", quote("AAA", exchange="PCX"), {"listing_exchange": "NYSE Arca"}),
    ("exchange_not_allowed", quote("AAA"), {"market_category": "S"}),
    ("exchange_not_allowed", quote("AAA", exchange="NYQ"), {}),
    ("invalid_ticker", quote("BAD/F"), {}),
    ("invalid_market_cap", quote("AAA", cap=None), {}),
    ("invalid_market_cap", quote("AAA", cap=1.5), {}),
    ("foreign_otc_suffix", quote("QUXZF"), {}),
    ("etf", quote("AAA"), {"etf": True}),
    ("test_issue", quote("AAA"), {"test_issue": True}),
    ("ambiguous_security_type", quote("AAA"), {"financial_status": "D"}),
    ("ambiguous_security_type", quote("AAA"), {"security_name": "Ostrava Works"}),
    ("non_common_security", quote("AAA", quoteType="etf"), {}),
    ("non_common_security", quote("AAA", quoteType="CRYPTOCURRENCY"), {}),
    ("non_common_security", quote("AAA"), {"security_name": "Tolva Mining warrant"}),
    ("manual_exclusion", quote("MAN"), {}),
    ("adr_or_ads", quote("AAA"), {"security_name": "Zubex American Depositary Shares"}),
    (None, quote("aaa ", quoteType=None), {}),
]


def test_cascade(spark):
    manual = spark.createDataFrame([("MAN",)], "ticker string")
    for reason, record, change in REASONS:
        tickers = {"AAA": change, "MAN": change, "QUXZF": change}
        row = qualify_candidates(records(spark, record), listing(spark, **tickers), manual).evaluated.first()
        assert row.exclusion_reason == reason, record
        early = reason in ("invalid_ticker", "invalid_market_cap", "foreign_otc_suffix", "not_in_symbol_directory") or record["exchange"] == "PNK" or record["exchange"] == "PCX"
        assert (row.security_name == "") == early


def test_records_that_are_no_objects(spark):
    q = qualify_candidates(records(spark, 5, [1], "x", None), listing(spark, AAA={}))
    assert [(r.ticker, r.exclusion_reason) for r in q.evaluated.collect()] == [("", "invalid_ticker")] * 4
    assert U.observed_tickers(q.evaluated).first()[0] == 0


def test_ties_and_duplicates(spark):
    feed = records(spark, quote("zzz", 100), quote("aaa", 100), quote("BRK.B", 80), quote("AAA", 90), quote("aaa", 100, longName="late"))
    directory = listing(spark, ZZZ={}, AAA={}, **{"BRK-B": {}})
    q = qualify_candidates(feed, directory)
    assert [(r.ticker, r.market_cap, r.ord) for r in U.candidate_sort(q.candidates).collect()] == [("AAA", 100, 1), ("ZZZ", 100, 0), ("BRK-B", 80, 2)]
    assert sorted((r.market_cap, r.exclusion_reason) for r in q.excluded.collect()) == [(90, "duplicate"), (100, "duplicate")]


def test_hot_ticker_in_the_feed(spark):
    hot = spark.range(3000).selectExpr("id AS ord", """concat('{"symbol":"HOT","marketCap":', id % 1000 + 1, ',"exchange":"NMS"}') AS value""")
    cold = spark.range(6000).selectExpr("id + 3000 AS ord", """concat('{"symbol":"T', id, '","marketCap":5,"exchange":"NMS"}') AS value""")
    feed = hot.unionByName(cold).select("ord", F.parse_json("value").alias("record"))
    directory = spark.range(6000).selectExpr("concat('T', id) AS ticker").unionByName(spark.range(1).selectExpr("'HOT' AS ticker")).selectExpr(
        "ticker AS raw_symbol", "ticker", "'Common Stock' AS security_name", "'NASDAQ' AS listing_exchange", "false AS etf", "false AS test_issue",
        "'Q' AS market_category", "'N' AS financial_status",
    )
    q = qualify_candidates(feed, directory)
    assert q.candidates.count() == 6001
    top = U.select_top(q.candidates, 1).first()
    assert (top.ticker, top.market_cap, top.ord, top.company_name) == ("HOT", 1000, 999, "Common Stock")
    assert U.reason_counts(q.excluded).collect()[0].n == 2999


def six(spark):
    feed = records(
        spark, quote("AAA", 30), quote("BBB", 40, exchange="NYQ"), quote("FUND", 10), quote("ADR", 9), quote("GONE", 8), quote("CAP", 0)
    )
    directory = listing(
        spark, AAA={}, BBB={"listing_exchange": "NYSE", "market_category": None, "financial_status": None}, FUND={"etf": True},
        ADR={"security_name": "Some ADR"}, CAP={},
    )
    return feed, directory, spark.createDataFrame([(5,)], "raw_record_count long")


def test_build_report_publish_and_archive(spark, folder):
    feed, directory, count = six(spark)
    built = build_universe(feed, directory, count, None, 2)
    assert [tuple(r) for r in built.universe.orderBy("market_cap_rank").collect()] == [("BBB", "BBB Inc", 40, 1), ("AAA", "AAA Inc", 30, 2)]
    report = built.report.first()
    assert (report.raw_yfinance_candidate_count, report.symbol_directory_record_count, report.validated_candidate_count, report.final_count) == (6, 5, 2, 2)
    assert (report.excluded_etf_count, report.excluded_adr_count, report.excluded_not_in_symbol_directory_count, report.invalid_market_cap_count) == (1, 1, 1, 1)
    assert report.exchange_counts == {"NASDAQ": 1, "NYSE": 1} and report.validation_passed
    store = BarStore(spark, f"{folder}/store")
    publish_universe(store, "u1", built)
    publish_universe(store, "u2", build_universe(feed, directory, count, None, 1))
    assert store.table("universe").count() == 1
    assert spark.read.parquet(f"{folder}/store/tables/universe/snapshot=u1").count() == 2
    assert validate_universe(store.table("universe"), store.table("audit"), store.table("report"), None, 1).first().audit_validated
    with pytest.raises(UniverseError, match="report_count"):
        validate_universe(built.universe, built.audit, store.table("report"), None, 2)
    banned = spark.createDataFrame([("AAA",)], "ticker string")
    with pytest.raises(UniverseError, match="manually_excluded"):
        validate_universe(built.universe, built.audit, None, banned, 2)


def test_too_few_candidates(spark):
    feed, directory, count = six(spark)
    with pytest.raises(UniverseError, match="needed 3 validated securities, found 2.*'adr_or_ads': 1"):
        build_universe(feed, directory, count, None, 3)


def test_scale_case(spark):
    feed = spark.range(2000).selectExpr("id AS ord", """concat('{"symbol":"T', lpad(id, 4, '0'), '","marketCap":', 10000000 - id, ',"exchange":"NMS"}') AS value""")
    directory = spark.range(2000).selectExpr(
        "concat('T', lpad(id, 4, '0')) AS raw_symbol", "raw_symbol AS ticker", "'Common Stock' AS security_name", "'NASDAQ' AS listing_exchange",
        "false AS etf", "false AS test_issue", "'Q' AS market_category", "'N' AS financial_status",
    )
    built = build_universe(feed.select("ord", F.parse_json("value").alias("record")), directory, spark.createDataFrame([(2000,)], "raw_record_count long"))
    assert built.universe.where("ticker <> concat('T', lpad(market_cap_rank - 1, 4, '0'))").count() == 0


@pytest.mark.parametrize(
    ("rows", "rule"),
    [
        ([("A", "x", 2, 1)], "row_count"), ([("a", "x", 2, 1), ("B", "x", 1, 2)], "ticker_not_normalised"),
        ([("ASMLF", "x", 2, 1), ("B", "x", 1, 2)], "foreign_otc_suffix"), ([("A", " ", 2, 1), ("B", "x", 1, 2)], "missing_company_name"),
        ([("A", "x", 2, 1), ("B", "x", 0, 2)], "market_cap_not_positive"), ([("A", "x", 2, 1), ("B", "x", 1, 3)], "rank_out_of_range"),
        ([("A", "x", 2, 1), ("B", "x", 1, 1)], "rank_not_continuous"), ([("A", "x", 2, 1), ("A", "x", 1, 2)], "duplicate_ticker"),
        ([("A", "x", 1, 1), ("B", "x", 2, 2)], "rank_order"), ([("B", "x", 2, 1), ("A", "x", 2, 2)], "rank_order"),
    ],
)
def test_universe_gate(spark, rows, rule):
    universe = spark.createDataFrame(rows, UNIVERSE_SCHEMA)
    assert rule in {r.rule for r in Q.universe_violations(universe, 2).collect()}


def test_sound_universe_passes(spark):
    enforce(Q.universe_violations(spark.createDataFrame([("A", "x", 2, 1), ("B", "x", 2, 2)], UNIVERSE_SCHEMA), 2))


def page_rows(spark, *rows):
    return spark.createDataFrame(rows, "page long, ord long, raw_count long, is_new boolean")


def kept_ords(pages, qualifies, **options):
    return sorted(r.ord for r in U.cap_input(pages, qualifies, page_size=2, **options).collect())


def test_input_cap(spark):
    pages = page_rows(spark, *[(i // 2, i, 2, True) for i in range(8)])
    good = spark.createDataFrame([(0, "A"), (2, "A"), (3, "B"), (6, "C")], "ord long, ticker string")
    assert kept_ords(pages, good, target=2) == [0, 1, 2, 3]
    assert kept_ords(pages, good, target=3) == list(range(8))
    assert kept_ords(pages, good, target=3, max_candidates=5) == [0, 1, 2, 3, 4]
    short = page_rows(spark, (0, 0, 2, True), (0, 1, 2, True), (1, 2, 1, True), (2, 4, 2, True))
    assert kept_ords(short, good, target=9) == [0, 1, 2]
    stale = page_rows(spark, (0, 0, 2, True), (0, 1, 2, False), (1, 2, 2, False), (1, 3, 2, False), (2, 4, 2, True))
    assert kept_ords(stale, good, target=9) == [0]
