"""Sessions in batch: by inactivity, and by change of campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessionize(events: DataFrame, gap: str = "30 minutes", campaign: str | None = None) -> DataFrame:
    """Adds session_seq, from 0 in each passport.

    A session ends after `gap` without an event.  With a campaign column it also ends where an event
    names another campaign than the one with which the session began, or names one when it began with none;
    an event that names none, or the empty one, changes nothing.
    """
    by = W.partitionBy("passport_id").orderBy("ts", "id")
    quiet = F.coalesce(F.col("ts") - F.lag("ts").over(by) >= F.expr(f"INTERVAL {gap}"), F.lit(False))
    marked = events.withColumn("_new", quiet.cast("long"))
    if campaign:
        visit = W.partitionBy("passport_id", "_visit").orderBy("ts", "id")
        named = F.nullif(F.col(campaign), F.lit(""))
        open_ = F.coalesce(F.last(named, ignorenulls=True).over(visit.rowsBetween(W.unboundedPreceding, -1)), F.lit(""))
        other = (F.row_number().over(visit) > 1) & F.coalesce(named != open_, F.lit(False))
        marked = marked.withColumn("_visit", F.sum("_new").over(by)).withColumn("_new", F.greatest("_new", other.cast("long"))).drop("_visit")
    return marked.withColumn("session_seq", F.sum("_new").over(by)).drop("_new")


def sessions(events: DataFrame, gap: str = "30 minutes", campaign: str | None = None) -> DataFrame:
    """One row for each session: started_at, last_activity_at, events."""
    return sessionize(events, gap, campaign).groupBy("passport_id", "session_seq").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_activity_at"), F.count(F.lit(1)).alias("events"))


CAMPAIGN = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "referrer")


def session_rows(visits: DataFrame) -> DataFrame:
    """One row for each session of sessionized events with session_id: its person, ends, events, and the campaign that it began with."""
    known = [c for c in CAMPAIGN if c in visits.columns]
    first = [F.min_by(c, F.struct("ts", "id")).alias(c) for c in known]
    return visits.groupBy("session_id").agg(F.first("passport_id").alias("passport_id"), F.min("ts").alias("started_at"), F.max("ts").alias("last_activity_at"), F.count(F.lit(1)).alias("events"), *first)


def timeline(events: DataFrame, held: DataFrame, passport_id: int | None = None, since: str | None = None, until: str | None = None, channels: list[str] | None = None, directions: list[str] | None = None) -> DataFrame:
    """Events (with session_id) of a person, or of everybody, with the campaign of the session that each belongs to, if it does to one.

    For pages of it, newest first, see ranks.page().
    """
    for test in (
        None if passport_id is None else F.col("passport_id") == passport_id, None if since is None else F.col("ts") >= F.lit(since).cast("timestamp"), None if until is None else F.col("ts") <= F.lit(until).cast("timestamp"),
        F.col("channel").isin(channels) if channels else None, F.col("direction").isin(directions) if directions else None,
    ):
        events = events if test is None else events.filter(test)
    known = [c for c in CAMPAIGN if c in held.columns]
    return events.drop(*known).join(held.select("session_id", *known), "session_id", "left")
