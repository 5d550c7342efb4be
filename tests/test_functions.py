import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from barlake.functions import dates, fingerprint, numbers, text


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        (" aapl ", "AAPL"), ("brk.b", "BRK-B"), ("BRK-B", "BRK-B"), ("\tmsft\n", "MSFT"), (" x1 ", "X1"),
        ("BAD/F", None), ("^GSPC", None), ("AAC=", None), ("A--B", None), ("-A", None), ("A.", None), ("", None), ("A\nB", None),
        ("A B", None), (None, None),
    ],
)
def test_normalize_ticker(one, raw, expected):
    assert one(text.normalize_ticker(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    ("ticker", "foreign"),
    [("QUXZF", True), ("WOMBY", True), ("ZZZZF", True), ("FFFFF", True), ("KF", False), ("KY", False), ("WXYF", False),
     ("FLYER", False), ("GHJK-F", False), ("SIXESF", False), ("FIRMX", False)],
)
def test_foreign_suffix(one, ticker, foreign):
    assert one(text.is_foreign_otc(F.lit(ticker))) is foreign


@pytest.mark.parametrize(
    ("name", "hit"),
    [
        ("Zubex AMERICAN DEPOSITARY Shares each for two", True), ("Zubex american\tdepository receipts", True), ("ADR of Zubex", True),
        ("Zubex, ADS, sponsored", True), ("Zubex [GDR]", True), ("one Depositary  Receipt of Zubex", True),
        ("Quadrille Mills Ordinary Shares", False), ("Madras Looms Ordinary Shares", False), ("Grads Club Ordinary Shares", False),
        ("ADRé Ordinary Shares", False),
    ],
)
def test_depositary(one, name, hit):
    assert one(text.depositary_reason(F.lit(name))) == ("adr_or_ads" if hit else None)


@pytest.mark.parametrize(
    ("name", "reason"),
    [
        ("Tolva Mining 7% PREFERRED", "non_common_security"), ("Tolva Mining warrant, 2031", "non_common_security"), ("Unit of Tolva Mining", "non_common_security"),
        ("Tolva Mining Senior Notes due 2040", "non_common_security"), ("Right of Tolva Mining", "non_common_security"), ("Tolva Gold ETN", "non_common_security"),
        ("Tolva Mining PFD", "non_common_security"), ("Ostrava Land REIT", None), ("Ostrava Land Shares of Beneficial Interest", None),
        ("Ostrava Works Common Stock, Class C", None), ("Ostrava Pipelines Limited Partnership Interests", None),
        ("Ostrava Works", "ambiguous_security_type"),
    ],
)
def test_non_common(one, name, reason):
    assert one(text.non_common_reason(F.lit(name))) == reason


def test_flags(one):
    assert one(text.flag(F.lit(" y "))) is True
    assert one(text.flag(F.lit("N"))) is False
    assert one(text.flag(F.lit("maybe"))) is None
    with pytest.raises(Exception, match="ETF"):
        one(text.strict_flag(F.lit("x"), "ETF"))


def test_exchanges(one):
    assert one(text.exchange_name(F.lit("a"))) == "NYSE American"
    assert one(text.exchange_name(F.lit("Q"))) is None
    assert one(text.expected_feed_exchange(F.lit("NASDAQ"), F.lit("S"))) == "NCM"
    assert one(text.expected_feed_exchange(F.lit("NYSE"), F.lit(None).cast("string"))) == "NYQ"
    assert one(text.expected_feed_exchange(F.lit("NYSE Arca"), F.lit(None).cast("string"))) is None


def test_field_name(one):
    assert one(text.field_name(F.lit("  Adj__Close \t"))) == "adj close"


def test_safe_message(one):
    raw = "GET  http://x/?crumb=abc&n=1\n&TOKEN=q/r"
    assert one(text.safe_message(F.lit(raw))) == "GET http://x/?crumb=<redacted>&n=1 &TOKEN=<redacted>"
    assert one(text.safe_message(F.lit(" \n"))) == "unspecified error"
    assert len(one(text.safe_message(F.lit("z" * 900)))) == 500


@pytest.mark.parametrize(
    ("literal", "cap"),
    [
        ("100", 100), ("100.0", 100), ("1e3", 1000), ('"100"', 100), ('"100.00"', 100), ('" 7 "', 7), ("5309727768576", 5309727768576),
        ("null", None), ("0", None), ("-1", None), ("1.5", None), ('"bad"', None), ('"1e3"', None), ("true", None), ('"-5"', None),
        ("[1]", None), ('{"a":1}', None), ("123456789012345678901234", None), ('"123456789012345678901234"', None),
    ],
)
def test_market_cap_kinds(one, literal, cap):
    record = F.parse_json(F.lit('{"marketCap": ' + literal + "}"))
    assert one(numbers.market_cap(record)) == cap


def test_market_cap_places(one):
    assert one(numbers.market_cap(F.parse_json(F.lit('{"marketCap": null, "lastclosemarketcap.lasttwelvemonths": 5}')))) == 5
    assert one(numbers.market_cap(F.parse_json(F.lit('{"lastclosemarketcap": {"lasttwelvemonths": "6.0"}}')))) == 6
    assert one(numbers.market_cap(F.parse_json(F.lit('{"marketCap": 1, "lastclosemarketcap": {"lasttwelvemonths": 6}}')))) == 1


def test_company_name(one):
    assert one(numbers.company_name(F.parse_json(F.lit('{"longName": " ", "shortName": 3, "displayName": " D "}')))) == "D"
    assert one(numbers.company_name(F.parse_json(F.lit("{}")))) == ""


@pytest.mark.parametrize(
    ("raw", "day"),
    [
        ("2020-01-02", dt.date(2020, 1, 2)), ("2020-01-02T23:30:00-05:00", dt.date(2020, 1, 2)), ("2020-01-02 00:10:00+09:00", dt.date(2020, 1, 2)),
        ("2020-01-02T05:00:00.123456Z", dt.date(2020, 1, 2)), ("2020-13-02", None), ("2020-02-30", None), ("2020-01-02T25:00", None), ("x", None), ("", None),
    ],
)
def test_calendar_date(one, raw, day):
    assert one(dates.calendar_date(F.lit(raw))) == day


@pytest.mark.parametrize(
    ("raw", "value"),
    [("1.5", 1.5), (" 2 ", 2.0), ("1e3", 1000.0), (".5", 0.5), ("12d", None), ("0x1p3", None), ("n/a", None), ("", None), ("NaN", None), ("-inf", float("-inf"))],
)
def test_to_number(one, raw, value):
    found = one(numbers.to_number(F.lit(raw)))
    assert (found != found) if value is None else found == value


def test_exclusive_end_is_the_new_york_date(one):
    assert one(dates.exclusive_end(F.lit(dt.datetime(2026, 2, 1, 4, 30)).cast("timestamp_ntz"))) == dt.date(2026, 2, 1)


def test_refresh_window(one):
    target = F.lit(dt.date(2026, 1, 5))
    assert one(dates.refresh_start(F.lit(dt.date(2016, 1, 1)), target)) == dt.date(2024, 7, 4)
    assert one(dates.refresh_start(F.lit(dt.date(2025, 1, 1)), target)) == dt.date(2025, 1, 1)
    assert one(dates.refresh_start(F.lit(dt.date(2026, 1, 6)), target)) is None
    assert one(dates.affected_years(F.lit(dt.date(2024, 7, 4)), target)) == [2024, 2025, 2026]
    with pytest.raises(ValueError):
        dates.refresh_start(target, target, -1)


def test_fingerprints_match_hashlib(spark):
    df = spark.createDataFrame([(3, "C"), (1, "B-A"), (2, "A")], "ord long, ticker string")
    row = df.agg(
        fingerprint.ordered_fingerprint(F.col("ord"), F.col("ticker")).alias("sha"),
        fingerprint.run_key(F.col("ord"), F.col("ticker"), dt.date(2016, 1, 1), dt.date(2026, 1, 1)).alias("run"),
    ).first()
    assert row.sha == hashlib.sha256(b"B-A\nA\nC\n").hexdigest()
    payload = {"schema_version": "daily_prices_v1", "tickers": ["B-A", "A", "C"], "start": "2016-01-01", "end_exclusive": "2026-01-01"}
    assert row.run == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_safe_message_rewrites_only_what_shows(one):
    import time

    head = " \u2003 GET\x1c\thttp://x/?KEY=" + "s" * 100_000 + "\u2003&token=" + "t" * 100_000 + " &key=&n= "
    short = "GET http://x/?KEY=<redacted> &token=<redacted> &key=&n= "
    assert one(text.safe_message(F.lit(head + "y" * 2_000))) == (short + "y" * 2_000)[:500]
    assert one(text.safe_message(F.lit(head))) == short.rstrip()
    assert one(text.safe_message(F.lit("a  " * 400))) == ("a " * 400)[:500]
    assert one(text.safe_message(F.lit("\U0001f600" * 600))) == "\U0001f600" * 500
    assert one(text.safe_message(F.lit(None).cast("string"))) == "unspecified error"
    began = time.monotonic()
    # the whole of it would be rewritten blank by blank
    assert one(text.safe_message(F.repeat(F.lit("z \n"), F.lit(20_000_000)))) == ("z " * 250)
    assert time.monotonic() - began < 5


def test_layers_of_identity_have_a_digest_per_run(spark):
    df = spark.range(10).selectExpr("id AS ord", "concat('T', id) AS ticker")

    def sha(lines):
        return hashlib.sha256("".join(f"{x}\n" for x in lines).encode()).hexdigest()

    first = [sha([f"T{i}" for i in range(a, min(a + 2, 10))]) for a in range(0, 10, 2)]
    found = fingerprint.identity_layer(df, 2, 2).orderBy("number").collect()
    assert [tuple(r) for r in found] == [(1, sha(first[:2]), 10), (2, sha(first[2:4]), 10), (3, sha(first[4:]), 10)]


def test_universe_identity_of_odd_rows(spark):
    df = spark.createDataFrame([(2, "B"), (None, "Z"), (1, None), (2, "A")], "ord long, ticker string")
    assert tuple(fingerprint.universe_identity(df).first()) == (hashlib.sha256(b"A\nB\nZ\n").hexdigest(), 4)
    assert tuple(fingerprint.universe_identity(df.where("ord > 9")).first()) == (hashlib.sha256(b"").hexdigest(), 0)
    assert "collect_list" not in fingerprint.universe_identity(df)._jdf.queryExecution().toString()


def test_identity_of_a_large_universe(spark):
    df = spark.range(10).selectExpr("id AS ord", "concat('T', id) AS ticker")
    whole = fingerprint.universe_identity(df).first()
    assert whole.sha == hashlib.sha256("".join(f"T{i}\n" for i in range(10)).encode()).hexdigest()
    assert whole.n == 10

    def layered(lines, run):
        while True:
            lines = [hashlib.sha256("".join(f"{x}\n" for x in lines[a : a + run]).encode()).hexdigest() for a in range(0, len(lines), run)]
            if len(lines) == 1:
                return lines[0]

    for run in (3, 4, 10, 1000):
        row = fingerprint.layered_identity(df, run).first()
        assert (row.layered_sha256, row.n) == (layered([f"T{i}" for i in range(10)], run), 10)


def test_repeated_records_ignore_key_order(spark):
    rows = [(0, '{"a":1,"b":[1,2]}'), (1, '{"b": [1, 2], "a": 1}'), (2, '{"a":1,"b":[2,1]}')]
    df = spark.createDataFrame(rows, "ord long, value string").select("ord", F.parse_json("value").alias("record"))
    assert sorted(r.ord for r in fingerprint.drop_repeated_records(df, "record", "ord").collect()) == [0, 2]
    shas = [r[0] for r in df.orderBy("ord").select(fingerprint.record_fingerprint(F.col("record"))).collect()]
    assert shas[0] == shas[1] != shas[2]
