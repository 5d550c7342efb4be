"""Trading sessions: settled session as of an instant, previous sessions.

A calendar is a table sessions(session DATE, close_utc TIMESTAMP_NTZ) with one row per trading day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.errors import RefreshError
from barlake.functions.dates import market_date
from barlake.schema import ACTIVE_SESSIONS, MARKET_TIMEZONE, SETTLEMENT_MINUTES


def previous_sessions(sessions: DataFrame, target, count: int = ACTIVE_SESSIONS) -> DataFrame:
    if count <= 0:
        raise ValueError("session count must be positive")
    before = sessions.where(F.col("session") < F.lit(target)).select("session").distinct()
    return before.orderBy(F.desc("session")).limit(count)


def _day_index(sessions: DataFrame, day: Column) -> DataFrame:
    """One row per civil day: the session of that day and the latest one before it.

    Dense from the first day to one past the last. The window runs over the calendar itself, a
    few hundred rows per year however many requests are resolved.
    """
    keyed = sessions.select(
        day.alias("day"), F.col("session").alias("here"), F.col("close_utc").alias("here_close")
    )
    span = keyed.agg(F.min("day").alias("lo"), F.date_add(F.max("day"), 1).alias("hi"))
    days = span.where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    up_to_yesterday = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.join(keyed, "day", "left").select(
        "day", "here", "here_close", F.last("here", ignorenulls=True).over(up_to_yesterday).alias("before")
    )


def _as_of(requests: DataFrame, index: DataFrame, day: Column, usable: Column) -> DataFrame:
    """Equi join on the day instead of a range join: the answer is that day's session or the one before."""
    last = index.agg(F.max("day")).scalar()
    return (
        requests.withColumn("day", F.least(day, last))
        .join(index, "day", "left")
        .withColumn("resolved", F.when(usable, F.col("here")).otherwise(F.col("before")))
        .drop("day", "here", "here_close", "before")
    )


def latest_settled(
    requests: DataFrame,
    sessions: DataFrame,
    *,
    delay_minutes: int = SETTLEMENT_MINUTES,
) -> DataFrame:
    """Add `resolved`: the latest session with close + delay <= now_utc, NULL before the first.

    A session closes on its own market day, so a settled one is never after the market date.
    """
    if delay_minutes < 0:
        raise ValueError("settlement delay cannot be negative")
    instant = F.col("now_utc") - F.make_dt_interval(mins=F.lit(delay_minutes))
    index = _day_index(sessions, F.to_date("close_utc"))
    marked = requests.withColumn("_instant", instant)
    usable = F.col("here").isNotNull() & (F.col("here_close") <= F.col("_instant"))
    return _as_of(marked, index, F.to_date("_instant"), usable).drop("_instant")


def latest_started(requests: DataFrame, sessions: DataFrame, timezone: str = MARKET_TIMEZONE) -> DataFrame:
    """Add `resolved`: the latest session on or before the market date, settled or not."""
    index = _day_index(sessions, F.col("session"))
    return _as_of(requests, index, market_date(F.col("now_utc"), timezone), F.col("here").isNotNull())


def check_targets(
    requests: DataFrame, sessions: DataFrame, *, delay_minutes: int = SETTLEMENT_MINUTES, allow_partial: bool = False
) -> DataFrame:
    """For requests(now_utc, target): `problem` is NULL, not_a_session or not_settled."""
    known = sessions.select(F.col("session").alias("target"), F.col("close_utc").alias("_close"))
    settled = F.col("_close") + F.make_dt_interval(mins=F.lit(delay_minutes)) <= F.col("now_utc")
    problem = F.when(F.col("_close").isNull(), "not_a_session")
    if not allow_partial:
        problem = problem.when(~settled, "not_settled")
    return requests.join(known, "target", "left").withColumn("problem", problem).drop("_close")


def target_session(
    sessions: DataFrame,
    now_utc: dt.datetime,
    *,
    target: dt.date | None = None,
    delay_minutes: int = SETTLEMENT_MINUTES,
    allow_partial: bool = False,
    timezone: str = MARKET_TIMEZONE,
) -> dt.date:
    """The session a refresh run should reach. now_utc is naive UTC."""
    one = sessions.sparkSession.range(1).select(
        F.lit(now_utc).cast("timestamp_ntz").alias("now_utc"), F.lit(target).cast("date").alias("target")
    )
    if target is not None:
        problem = check_targets(one, sessions, delay_minutes=delay_minutes, allow_partial=allow_partial).first().problem
        if problem:
            raise RefreshError(f"requested target {target}: {problem}")
        return target
    found = latest_started(one, sessions, timezone) if allow_partial else latest_settled(one, sessions, delay_minutes=delay_minutes)
    resolved = found.first().resolved
    if resolved is None:
        raise RefreshError("no settled session is available")
    return resolved
