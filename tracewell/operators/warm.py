"""Audiences kept warm: only people with something new are tested again, and who entered or left is written down.

Membership is a fact of its person in a fact store, `true` from when they entered and `false` from when they left, so it has a history, current
members are read from its own folders, and a batch that comes again changes nothing.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import durations
from . import cohort

#: Operators whose answer changes while nothing happens.
CLOCKED = ("last", "next", "before", "recency_days", "held", "changed", "increased", "decreased", "transition")


def hangs_on_clock(node) -> bool:
    """Whether a selector's answer for somebody can change without a new event or fact of theirs."""
    if isinstance(node, dict):
        return any(k in CLOCKED or hangs_on_clock(v) for k, v in node.items())
    return isinstance(node, list) and any(map(hangs_on_clock, node))


def among(world: cohort.World, people: DataFrame) -> cohort.World:
    """The world of these people only."""
    theirs = people.select("passport_id").distinct()
    of = lambda df, c="passport_id": None if df is None else df.join(theirs.withColumnRenamed("passport_id", c), c, "left_semi")
    return replace(world, passports=of(world.passports, "id"), events=of(world.events), facts=of(world.facts), visits=of(world.visits), exposures=of(world.exposures), held=of(world.held))


def _key(name: str) -> str:
    return f"audience:{name}"


def members(store, name: str) -> DataFrame:
    """(passport_id) of those in an audience now."""
    return store.current(_key(name)).filter("value = 'true'").select("passport_id")


def changes(store, name: str) -> DataFrame:
    """(passport_id, change, at): everyone who entered or left, and when that was found."""
    return store.log(_key(name)).select("passport_id", F.when(F.col("value") == "true", "entered").otherwise("left").alias("change"), F.col("observed_at").alias("at"))


def _settle(store, name: str, found: DataFrame, tested: DataFrame | None, at: str, batch: int | None) -> bool:
    there = members(store, name)
    if tested is not None:
        there = there.join(tested.select("passport_id").distinct(), "passport_id", "left_semi")
    found = found.select("passport_id").distinct()
    entered, left = found.join(there, "passport_id", "left_anti"), there.join(found, "passport_id", "left_anti")
    rows = entered.withColumn("value", F.lit("true")).unionByName(left.withColumn("value", F.lit("false")))
    rows = rows.withColumns({"key": F.lit(_key(name)), "observed_at": durations.instant(at, "at"), "source": F.lit("audiences")})
    return store.record(rows, batch=batch, stream=_key(name))


def sweep(store, name: str, world: cohort.World, node: dict, batch: int | None = None) -> bool:
    """Test everybody, at the world's clock; false if the batch was done before."""
    return _settle(store, name, cohort.evaluate(world, node), None, world.now, batch)


def refresh(store, name: str, world: cohort.World, node: dict, touched: DataFrame, batch: int | None = None) -> bool:
    """Test those with new events or facts (passport_id) at the world's clock; the others stay as they are.

    An audience whose answer hangs on the clock cannot be kept by what is new alone, and is swept.
    """
    if hangs_on_clock(node):
        return sweep(store, name, world, node, batch)
    return _settle(store, name, cohort.evaluate(among(world, touched), node), touched, world.now, batch)


def entered_at(store, names: list[str], mode: str = "any") -> DataFrame:
    """(passport_id, at) of members of any or all of some audiences, from when they were: what triggers a journey."""
    if mode not in ("any", "all"):
        raise durations.SpecError(f"audience: mode is any or all, not {mode!r}")
    rows = None
    for name in dict.fromkeys(names):
        more = store.current(_key(name)).filter("value = 'true'").select("passport_id", F.col("observed_at").alias("at"))
        rows = more if rows is None else rows.unionByName(more)
    if rows is None:
        return store.current().limit(0).select("passport_id", F.col("observed_at").alias("at"))
    held = rows.groupBy("passport_id").agg(F.count(F.lit(1)).alias("n"), (F.min if mode == "any" else F.max)("at").alias("at"))
    return held.filter(F.col("n") >= (1 if mode == "any" else len(set(names)))).select("passport_id", "at")
