"""Structured Streaming: sessions, duplicates, windowed series, current values, enrolments."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .ordered import Ordered, ordered


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by inactivity: one row for each once the watermark has passed its end."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "passport_id").agg(F.count(F.lit(1)).alias("events")).select("passport_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")


class Sessions(Ordered):
    """A person's open session as JSON: start, last activity, events and campaign."""

    def __init__(self, gap_us: int) -> None:
        self.gap = gap_us

    def event(self, who, held, us, said, out):
        at = json.loads(held) if held else None
        if at is not None and said and said != at["campaign"]:
            self._close(who, at, "campaign", out)
            at = None
        at = at or {"from": us, "events": 0, "campaign": said or None}
        at |= {"to": us, "events": at["events"] + 1}
        return json.dumps(at), us + self.gap

    def deadline(self, who, held, due, out):
        self._close(who, json.loads(held), "inactivity", out)
        return None, None

    @staticmethod
    def _close(who, at: dict, reason: str, out: list) -> None:
        out.append(Row(passport_id=who, from_us=at["from"], to_us=at["to"], events=at["events"], reason=reason))


def campaign_sessions(events: DataFrame, gap_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Sessions that end by inactivity or where an event names another campaign (columns passport_id, ts, campaign and, if there is one, id).

    The rules are those of sessions in batch, on events in order of time however they come in.  A session is known by its person and
    start, so nothing is kept of a person whose last session has ended.
    """
    said = F.col("campaign")
    made = ordered(events, Sessions(gap_minutes * 60_000_000), said, "passport_id long, from_us long, to_us long, events long, reason string", late)
    return made.select("passport_id", F.timestamp_micros("from_us").alias("started_at"), F.timestamp_micros("to_us").alias("last_activity_at"), "events", "reason")


def once_each(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """The first event of each key, for as long as duplicates can come late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def clamped(events: DataFrame, now, minutes: int = 5) -> DataFrame:
    """A clock that runs more than so many minutes ahead is set to now."""
    return events.withColumn("ts", F.when(F.col("ts") > now + F.make_dt_interval(mins=F.lit(minutes)), now).otherwise(F.col("ts")))


def windowed(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "channel").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), "channel", "n")


def current_values(batch: DataFrame, held: DataFrame | None) -> DataFrame:
    """Current values after a micro-batch: late facts never replace a newer one."""
    rows = batch.select("passport_id", "key", "value", "observed_at", "id")
    rows = rows if held is None else rows.unionByName(held.select(*rows.columns))
    newest = F.max_by(F.struct("value", "observed_at", "id"), F.struct("observed_at", "id"))
    return rows.groupBy("passport_id", "key").agg(newest.alias("f")).select("passport_id", "key", "f.*")
