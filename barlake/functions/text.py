"""Ticker, security-name and message expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: symbol and security-name rules ---------------------------------------
TICKER_TEXT = r"[A-Z0-9]+(?:[-.][A-Z0-9]+)*"  # the dot becomes a hyphen
FOREIGN_SUFFIXES = ["F", "Y"]
ADR_PHRASES = [
    r"AMERICAN\s+DEPOSIT(?:ARY|ORY)",
    r"DEPOSIT(?:ARY|ORY)\s+RECEIPTS?",
    r"DEPOSIT(?:ARY|ORY)\s+SHARES?",
    "ADR",
    "ADS",
    "GDR",
]
NON_COMMON_WORDS = [
    "ETF",
    "ETN",
    "FUND",
    "WARRANTS?",
    "RIGHTS?",
    "UNITS?",
    "PREFERRED",
    "PREFERENCE",
    "PFD",
    "DEBENTURES?",
    "BONDS?",
    "NOTES?",
    "NEXTSHARES",
]
COMMON_PHRASES = [
    r"COMMON\s+STOCK",
    r"COMMON\s+SHARES?",
    r"ORDINARY\s+SHARES?",
    r"CAPITAL\s+STOCK",
    r"SHARES?\s+OF\s+BENEFICIAL\s+INTEREST",
    r"VOTING\s+SHARES?",
    r"SUBORDINATE\s+VOTING\s+SHARES?",
    r"LIMITED\s+PARTNERSHIP\s+INTERESTS?",
    "REIT",
]
EXCHANGE_NAMES = {
    "A": "NYSE American",
    "M": "NYSE Texas",
    "N": "NYSE",
    "P": "NYSE Arca",
    "Z": "Cboe BZX",
    "V": "IEX",
}
NASDAQ_FEED_CODES = {"Q": "NMS", "G": "NGM", "S": "NCM"}
LISTING_FEED_CODES = {"NYSE": "NYQ", "NYSE American": "ASE"}
ALLOWED_FEED_EXCHANGES = ["NMS", "NGM", "NCM", "NYQ", "ASE"]
ALLOWED_LISTING_EXCHANGES = ["NASDAQ", "NYSE", "NYSE American"]
SECRET_PARAMETERS = ["crumb", "cookie", "token", "key"]
REDACTED = "<redacted>"
MESSAGE_LIMIT = 500
DEFAULT_MESSAGE = "unspecified error"
# ----------------------------------------------------------------------------------------

SPACE = r"[\s\x1c-\x1f]"


def _words(patterns: list[str]) -> str:
    """Any of the patterns as whole words. The look-ahead skips most positions before the
    costlier Unicode word-boundary test."""
    first = "".join(sorted({p[0] for p in patterns}))
    return rf"(?iU)(?=[{first}])\b(?:" + "|".join(patterns) + r")\b"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normalize_ticker(c: Column) -> Column:
    """Upper-case, dot to hyphen; NULL unless the whole trimmed value is a plain symbol."""
    found = F.regexp_extract(F.upper(c), rf"(?U)\A{SPACE}*({TICKER_TEXT}){SPACE}*\z", 1)
    return F.nullif(F.translate(found, ".", "-"), F.lit(""))


def is_foreign_otc(ticker: Column) -> Column:
    return (F.length(ticker) == 5) & F.right(ticker, F.lit(1)).isin(FOREIGN_SUFFIXES)


def is_depositary(security_name: Column) -> Column:
    return security_name.rlike(_words(ADR_PHRASES))


def depositary_reason(security_name: Column) -> Column:
    return F.when(is_depositary(security_name), F.lit("adr_or_ads"))


def non_common_reason(security_name: Column) -> Column:
    return F.when(
        security_name.rlike(_words(NON_COMMON_WORDS)), F.lit("non_common_security")
    ).when(~security_name.rlike(_words(COMMON_PHRASES)), F.lit("ambiguous_security_type"))


def flag(c: Column) -> Column:
    """Y/N as boolean, NULL for anything else; gates count the NULLs."""
    letter = F.upper(strip(c))
    return F.when(letter == "Y", F.lit(True)).when(letter == "N", F.lit(False))


def strict_flag(c: Column, field: str) -> Column:
    """Y/N as boolean; any other value fails the job and names the field."""
    problem = F.concat(F.lit(f"invalid {field} flag: "), F.coalesce(c, F.lit("NULL")))
    return F.coalesce(flag(c), F.raise_error(problem).cast("boolean"))


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def exchange_name(code: Column) -> Column:
    return _lookup(F.upper(strip(code)), EXCHANGE_NAMES)


def expected_feed_exchange(listing_exchange: Column, market_category: Column) -> Column:
    """The one feed exchange that agrees with the official listing, or NULL."""
    return F.when(
        listing_exchange == "NASDAQ", _lookup(market_category, NASDAQ_FEED_CODES)
    ).otherwise(_lookup(listing_exchange, LISTING_FEED_CODES))


def field_name(c: Column) -> Column:
    """Comparable form of a feed's column label."""
    return F.lower(strip(F.regexp_replace(F.translate(c, "_", " "), rf"(?U){SPACE}+", " ")))


#: As much of a message as can show: each alternative leaves one character of the result at least.
SHOWN = (
    rf"(?s)\A(?U:{SPACE})*+(?:(?i:[?&](?:{'|'.join(SECRET_PARAMETERS)})=)(?U:[^&\s\x1c-\x1f])++|(?U:{SPACE})++|.){{0,{MESSAGE_LIMIT + 1}}}+"
)

#: From this length on it pays to look for that part.
LONG_MESSAGE = 4 * MESSAGE_LIMIT


def safe_message(c: Column) -> Column:
    """One-line message without secrets, bounded in length. Of a long one only the part that shows is rewritten."""
    shown = F.when(F.length(c) > LONG_MESSAGE, F.regexp_extract(c, SHOWN, 0)).otherwise(c)
    one_line = strip(F.regexp_replace(shown, rf"(?U){SPACE}+", " "))
    clean = F.regexp_replace(
        one_line, rf"(?i)([?&](?:{'|'.join(SECRET_PARAMETERS)})=)[^&\s]+", rf"$1{REDACTED}"
    )
    return F.coalesce(F.nullif(F.substring(clean, 1, MESSAGE_LIMIT), F.lit("")), F.lit(DEFAULT_MESSAGE))
