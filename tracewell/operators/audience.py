"""Audiences: set algebra over cohorts, suppression, attribution and enrolment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import identity


def combine(mode: str, positive: list[DataFrame], negative: list[DataFrame]) -> DataFrame:
    """any: in one of the positives; all: in each; never in a negative.  No positives, nobody."""
    if mode not in ("any", "all"):
        raise ValueError(f"audience: mode is any or all, not {mode!r}")
    ids = [p.select("passport_id").distinct() for p in positive]
    if not ids:
        return negative[0].select("passport_id").limit(0)
    out = ids[0]
    for p in ids[1:]:
        out = out.unionByName(p).distinct() if mode == "any" else out.join(p, "passport_id", "left_semi")
    for n in negative:
        out = out.join(n.select("passport_id"), "passport_id", "left_anti")
    return out


def suppress(audience: DataFrame, suppressed: DataFrame) -> DataFrame:
    """One row: members, those suppressed, those left."""
    marked = audience.select("passport_id").distinct().join(suppressed.select("passport_id").distinct().withColumn("_s", F.lit(1)), "passport_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("members"), F.count("_s").alias("suppressed"), F.count_if(F.col("_s").isNull()).alias("sendable"))


#: Lengths of slots in seconds, short holds first: a hold lies in slots of the first length of which it meets at most MOST_SLOTS.
SLOTS = (3600, 86_400, 30 * 86_400, 3650 * 86_400)
MOST_SLOTS = 26


def attributed(calls: DataFrame, holds: DataFrame) -> DataFrame:
    """Each call (number, ts) with the visitor that held its number then; of several, the latest to take it.

    Both sides meet by number and slot of time, so that a call meets the holds of its slots and not all of its number.  Long holds
    lie in longer slots, and a call asks for its slot of each length.
    """
    keys = [c for c in calls.columns]
    slot = lambda t, width: F.floor(F.unix_timestamp(t) / width)
    meets = lambda width: slot("held_to", width) - slot("held_from", width) < MOST_SLOTS
    width = F.coalesce(*[F.when(meets(w), F.lit(w)) for w in SLOTS[:-1]], F.lit(SLOTS[-1]))
    sized = holds.filter("held_to > held_from").withColumn("_wide", width)
    spread = sized.select(F.col("number").alias("_number"), "visitor", "held_from", "held_to", "_wide", F.explode(F.sequence(slot("held_from", F.col("_wide")), slot("held_to", F.col("_wide")))).alias("_at"))
    asked = calls.withColumn("_width", F.explode(F.array(*map(F.lit, SLOTS))))
    same = (F.col("number") == F.col("_number")) & (F.col("_width") == F.col("_wide")) & (F.col("_slot") == F.col("_at")) & (F.col("ts") >= F.col("held_from")) & (F.col("ts") < F.col("held_to"))
    joined = asked.withColumn("_slot", slot("ts", F.col("_width"))).join(spread, same, "left")
    return joined.groupBy(*keys).agg(F.max_by("visitor", "held_from").alias("visitor"))


def add_to_list(members: DataFrame, added: DataFrame) -> DataFrame:
    """A static list (list, passport_id) with further members; adding one twice changes nothing."""
    return members.select("list", "passport_id").unionByName(added.select("list", "passport_id")).distinct()


def membership(passports: DataFrame, members: DataFrame) -> DataFrame:
    """(passport_id, lists): the lists of each of these people, in order; none is an empty array."""
    held = members.groupBy("passport_id").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    return passports.join(held, "passport_id", "left").select("passport_id", F.coalesce("lists", F.array().cast("array<string>")).alias("lists"))


def sendable(batch: DataFrame, suppressed: DataFrame, invalid: DataFrame) -> DataFrame:
    """Adds verdict to contacts (contact): suppressed before invalid before ok; contacts are compared trimmed and in lower case."""
    plain = F.lower(F.trim("contact"))
    marks = suppressed.select(plain.alias("_c"), F.lit(2).alias("_m")).unionByName(invalid.select(plain.alias("_c"), F.lit(1).alias("_m"))).groupBy("_c").agg(F.max("_m").alias("_m"))
    joined = batch.withColumn("_c", plain).join(marks, "_c", "left")
    return joined.withColumn("verdict", F.when(F.col("_m") == 2, "suppressed").when(F.col("_m") == 1, "invalid").otherwise("ok")).drop("_c", "_m")


def converted_within(enrolments: DataFrame, log: DataFrame, days: int | None = None, closure: DataFrame | None = None) -> DataFrame:
    """Enrolments with an event of the log in [enrolled_at, + days], or at any time from then on.

    With a closure of merges (absorbed, survivor) what an absorbed passport did counts for its survivor.
    """
    if closure is not None:
        log = identity.resolve(log, closure)
    theirs = (F.col("passport_id") == F.col("_p")) & (F.col("occurred_at") >= F.col("enrolled_at"))
    if days is not None:
        theirs = theirs & (F.col("occurred_at") <= F.col("enrolled_at") + F.make_dt_interval(days=F.lit(days)))
    return enrolments.join(log.select(F.col("passport_id").alias("_p"), "occurred_at"), theirs, "left_semi")


def watched_segments(segments: DataFrame, watched: DataFrame) -> DataFrame:
    """Segments (content, start, end) that overlap one of the ranges (array of from, to) that were watched."""
    return segments.join(watched, "content").filter(F.exists("ranges", lambda r: (F.col("end") >= r["from"]) & (F.col("start") <= r["to"]))).select("content", "start", "end")


def recipients(audiences: list[DataFrame], excluded: list[DataFrame], contacts: DataFrame, suppressed: DataFrame, invalid: DataFrame) -> DataFrame:
    """(passport_id, contact) to whom a campaign goes: anybody of its audiences with a contact that may be written to, each contact once."""
    people = combine("any", audiences, excluded)
    known = sendable(contacts.join(people, "passport_id", "left_semi"), suppressed, invalid).filter("verdict = 'ok'")
    return known.groupBy(F.lower(F.trim("contact")).alias("contact")).agg(F.min("passport_id").alias("passport_id")).select("passport_id", "contact")
