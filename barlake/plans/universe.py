"""qualify_candidates and build_universe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.errors import SourceError, UniverseError
from barlake.functions.fingerprint import drop_repeated_records
from barlake.operators.gates import counted, enforce, gather
from barlake.operators.quality import audit_violations, universe_violations
from barlake.operators.reports import single
from barlake.operators.universe import (
    audit_rows,
    build_report,
    cap_input,
    evaluate,
    page_stop,
    reason_counts,
    screener_fields,
    select_top,
    split_candidates,
    suffix_counts,
    universe_rows,
)
from barlake.schema import MAX_CANDIDATES, PAGE_SIZE, UNIVERSE_SIZE
from barlake.session import cut
from barlake.sinks.snapshots import BarStore
from barlake.sources.directory import (
    LISTED_A_COLUMNS,
    LISTED_B_COLUMNS,
    combine,
    directory,
    directory_violations,
    parse_listed_a,
    parse_listed_b,
    raw_record_count,
    read_pipe,
)
from barlake.sources.universe import manual_exclusions, page_files, page_violations, read_pages


@dataclass(frozen=True)
class Qualified:
    evaluated: DataFrame
    candidates: DataFrame
    excluded: DataFrame


def qualify_candidates(
    records: DataFrame, directory: DataFrame, manual: DataFrame | None = None, *, materialize: bool = False
) -> Qualified:
    """records(ord, record VARIANT) against the directory: candidates and explained exclusions."""
    evaluated = evaluate(screener_fields(records), directory, manual)
    if materialize:
        evaluated = cut(evaluated)
    candidates, excluded = split_candidates(evaluated)
    return Qualified(evaluated, candidates, excluded)


@dataclass(frozen=True)
class BuiltUniverse:
    universe: DataFrame
    audit: DataFrame
    excluded: DataFrame
    report: DataFrame


def build_universe(
    records: DataFrame,
    directory: DataFrame,
    directory_count: DataFrame,
    manual: DataFrame | None = None,
    size: int = UNIVERSE_SIZE,
) -> BuiltUniverse:
    """Exactly `size` ranked rows with their evidence, or an error with the reason counts."""
    q = qualify_candidates(records, directory, manual, materialize=True)
    selected = cut(select_top(q.candidates, size))
    found = selected.count()
    if found < size:
        # one row per reason, and the reasons are a fixed set
        reasons = {r.exclusion_reason: r.n for r in reason_counts(q.excluded).orderBy("exclusion_reason").collect()}
        raise UniverseError(f"needed {size} validated securities, found {found}; exclusions={reasons}")
    universe, audit = universe_rows(selected), audit_rows(selected)
    enforce(gather(universe_violations(universe, size), audit_violations(universe, audit, manual)), UniverseError)
    report = build_report(records, directory_count, q.candidates, q.excluded, universe, audit, size)
    return BuiltUniverse(universe, audit, q.excluded, report)


@dataclass(frozen=True)
class PagedRead:
    """records(page, ord, record): what a paged read keeps; opened: the pages that were read, of `listed` ones."""

    records: DataFrame
    opened: int
    listed: int


def read_progressively(
    spark: SparkSession,
    pages: str,
    directory: DataFrame,
    manual: DataFrame | None = None,
    *,
    target: int,
    max_candidates: int = MAX_CANDIDATES,
    page_size: int = PAGE_SIZE,
) -> PagedRead:
    """Read page files in rounds until the stop of `operators.universe.page_stop` is met.

    The first round has as many pages as the target needs at least, each further one twice as many, so pages far behind the stop
    are never opened and the number of rounds grows with the logarithm of the pages. A round parses its own pages,
    drops records that it or an earlier round has had, and qualifies only the rest: each record once. A page without quotes
    is an error if the read has not ended before it.
    """
    files = page_files(spark, pages)
    block = max(1, -(-target // page_size))
    at = 0
    seen: DataFrame | None = None
    listed: DataFrame | None = None
    kept: DataFrame | None = None
    while at < len(files):
        paths = [path for _, path in files[at : at + block]]
        at, block = at + len(paths), 2 * block
        quotes = cut(read_pages(spark, paths))
        broken = quotes.where("problem IS NOT NULL").agg(F.min("page").alias("page")).first().page
        sound = quotes if broken is None else quotes.where(F.col("page") < broken)
        numbered = sound.withColumn("ord", F.col("page") * page_size + F.col("pos"))
        fresh = drop_repeated_records(numbered, "record", "ord").withColumn("text", F.to_json("record"))
        if seen is not None:
            fresh = fresh.join(seen.select("text"), "text", "left_anti")
        fresh = cut(fresh.select("ord", "record", "text"))
        passed = evaluate(screener_fields(fresh), directory, manual).where("exclusion_reason IS NULL").select("ord", "ticker")
        is_new = numbered.select("page", "ord", "raw_count").join(fresh.select("ord", F.lit(True).alias("is_new")), "ord", "left")
        marked = cut(is_new.withColumn("is_new", F.coalesce("is_new", F.lit(False))))
        passed = cut(passed)
        seen = fresh if seen is None else seen.unionByName(fresh)
        listed = marked if listed is None else listed.unionByName(marked)
        kept = passed if kept is None else kept.unionByName(passed)
        state = page_stop(listed, kept, target=target, max_candidates=max_candidates, page_size=page_size).first()
        if state.stop is not None or state.new_records >= max_candidates:
            break
        if broken is not None:
            enforce(page_violations(quotes), SourceError)
    if seen is None:
        raise SourceError(f"no pages below {pages}")
    within = cap_input(listed, kept, target=target, max_candidates=max_candidates, page_size=page_size)
    return PagedRead(within.join(seen.select("ord", "record"), "ord"), at, len(files))


def build_from_files(
    spark: SparkSession,
    first_listing: str | list[str],
    second_listing: str | list[str],
    pages: str,
    exclusions: str | None = None,
    *,
    size: int = UNIVERSE_SIZE,
    target: int | None = None,
    max_candidates: int = MAX_CANDIDATES,
) -> BuiltUniverse:
    """A universe from the files of both directories, the screener's pages and the exclusion list.

    Pages are read up to the one on which `target` securities qualify, by default `size`, see `read_progressively`.

    A directory with an invalid flag, an unknown exchange or conflicting records stops the job before anything is
    qualified, a page without quotes when it is read.
    """
    combined = cut(
        combine(
            parse_listed_a(read_pipe(spark, first_listing, LISTED_A_COLUMNS)),
            parse_listed_b(read_pipe(spark, second_listing, LISTED_B_COLUMNS)),
        )
    )
    enforce(directory_violations(combined), SourceError)
    listed = cut(directory(combined))
    manual = None if exclusions is None else cut(manual_exclusions(spark, exclusions))
    read = read_progressively(spark, pages, listed, manual, target=size if target is None else target, max_candidates=max_candidates)
    return build_universe(read.records.select("ord", "record"), listed, raw_record_count(combined), manual, size)


def publish_universe(store: BarStore, snapshot: str, built: BuiltUniverse) -> int:
    """Store the four tables and commit; the previous universe stays under its own snapshot."""
    tables = {"universe": built.universe, "audit": built.audit, "excluded": built.excluded, "report": built.report}
    for name, table in tables.items():
        store.stage_table(snapshot, name, table)
    return store.commit(snapshot, {}, list(tables))


def validate_universe(
    universe: DataFrame, audit: DataFrame | None, report: DataFrame | None, manual: DataFrame | None = None, size: int = UNIVERSE_SIZE
) -> DataFrame:
    """Check stored universe tables against each other; returns the summary row."""
    found = [universe_violations(universe, size)]
    if audit is not None:
        found.append(audit_violations(universe, audit, manual))
    if report is not None:
        confirmed = {"report_not_passed": ~F.col("validation_passed"), "report_count": F.col("final_count") != size}
        found.append(counted(report, confirmed))
    enforce(gather(*found), UniverseError)
    summary = universe.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("ticker").alias("unique_tickers"),
        F.min("market_cap_rank").alias("rank_min"),
        F.max("market_cap_rank").alias("rank_max"),
    ).withColumn("audit_validated", F.lit(audit is not None))
    return single(summary, suffix_counts(universe))
