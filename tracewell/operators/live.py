"""Monitoring: event catalog, facets, zero-filled series, counters, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dotted types of the registry and the catalog's prefixes.
TYPES = {"purchase": "conversion.purchase", "view": "awareness.recorded", "click": "mail.clicked", "error": "mail.failed", "signup": "session.started"}
CATALOG = [("conversion.", "conversion", "conversion", "info"), ("awareness.", "exposure", "web", "info"), ("mail.", "exposure", "mail", "info"), ("mail.clicked", "expression", "mail", "info"), ("mail.failed", "observation", "mail", "error"), ("session.", "observation", "web", "info")]
STEPS = (1, 5, 10, 15, 30, 60, 300, 600, 900, 1800, 3600, 10800, 21600, 43200, 86400)


def registry(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return events.select("id", kind[F.col("attr_event")].alias("type"), "passport_id", F.col("ts").alias("occurred_at"), "meta")


def classify(rows: DataFrame, spark: SparkSession, catalog: list[tuple] = CATALOG) -> DataFrame:
    """Adds direction, channel, severity of the catalog's longest prefix of each type."""
    entries = spark.createDataFrame(catalog, "prefix string, direction string, channel string, severity string")
    kinds = rows.select("type").distinct()
    matched = kinds.join(F.broadcast(entries), F.startswith(F.col("type"), F.col("prefix")))  # the catalog is code
    best = matched.groupBy("type").agg(F.max_by(F.struct("direction", "channel", "severity"), F.length("prefix")).alias("s")).select("type", "s.*")
    return rows.join(F.broadcast(best), "type", "left")  # one row for each type


def axis(column: str, spec: str) -> Column:
    """`a,b,-c`: any of the named ones, all if none is named; a minus excludes, and wins."""
    names = [x.strip() for x in spec.split(",") if x.strip()]
    wanted, barred = [n for n in names if n[0] != "-"], [n[1:] for n in names if n[0] == "-"]
    out = F.col(column).isin(wanted) if wanted else F.lit(True)
    return out & ~F.col(column).isin(barred) if barred else out


def facets(rows: DataFrame, channels: str = "", directions: str = "") -> DataFrame:
    """(facet, name, n): each axis is counted under the other's filter."""
    by_channel = rows.filter(axis("direction", directions)).groupBy(F.lit("channel").alias("facet"), F.col("channel").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_direction = rows.filter(axis("channel", channels)).groupBy(F.lit("direction").alias("facet"), F.col("direction").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return by_channel.unionByName(by_direction)


def step_for(seconds: int, most: int = 120) -> int:
    return next((s for s in STEPS if seconds / s <= most), STEPS[-1])


def series(rows: DataFrame, start: str, end: str, step: int) -> DataFrame:
    """(bucket, n) of every step from start to end, empty ones 0; bucket is in seconds since the epoch."""
    spark = rows.sparkSession
    first, last = (F.unix_timestamp(F.lit(t).cast("timestamp")) for t in (start, end))
    seconds = F.unix_timestamp("occurred_at")
    counts = rows.filter((seconds >= first) & (seconds < last)).groupBy((F.floor(seconds / step) * step).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(1).select(F.explode(F.sequence(F.floor(first / step) * step, last - 1, F.lit(step).cast("long"))).alias("bucket"))
    return grid.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def counters(rows: DataFrame, column: str, states: list[str]) -> DataFrame:
    """One row: how many rows there are, and how many in each state."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == s).alias(f"n_{s}") for s in states])


def delivery(outbox: DataFrame, milestones: list[str], terminal: dict[str, str]) -> DataFrame:
    """One row: rows, how many reached each milestone, and how many ended in each terminal state."""
    return outbox.agg(F.count(F.lit(1)).alias("total"), *[F.count(m).alias(f"n_{m}") for m in milestones], *[F.count_if(F.col("status") == v).alias(f"n_{k}") for k, v in terminal.items()])


def payload_values(rows: DataFrame, key: str, limit: int) -> DataFrame:
    value = F.get_json_object("meta", f"$['{key}']")
    return rows.groupBy(value.alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("name IS NOT NULL").orderBy(F.desc("n"), "name").limit(limit)


def activity(rows: DataFrame, prefix: str = "") -> DataFrame:
    """(type, n, passports, last_at) of the registry's types with a prefix."""
    return rows.filter(F.startswith("type", F.lit(prefix))).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("passport_id").alias("passports"), F.max("occurred_at").alias("last_at"))


def rate(rows: DataFrame, now: Column, minutes: int) -> DataFrame:
    """One row: events of the last minutes, and how many a minute."""
    recent = (F.col("occurred_at") > now - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("occurred_at") <= now)
    return rows.agg(F.count_if(recent).alias("n")).withColumn("per_minute", F.round(F.col("n") / minutes, 2))


def base_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("channel", "direction").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("passport_id").alias("people"))


def retained(rows: DataFrame, now: str, days: int = 90) -> DataFrame:
    return rows.filter(F.col("occurred_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


# The kinds of content that people consume.
CONTENT_KINDS = ("video", "text", "image", "section", "link")


def content_kinds(events: DataFrame, limit: int = 10) -> DataFrame:
    """(kind, n) of what was consumed, the most frequent first; sources that are no kind of content do not count."""
    kinds = events.filter(F.lower("source").isin(*CONTENT_KINDS)).groupBy(F.col("source").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.orderBy(F.desc("n"), "kind").limit(limit)


def totals(events: DataFrame, people: DataFrame) -> DataFrame:
    """One row: people, people with an event, and events."""
    seen = events.agg(F.count_distinct("passport_id").alias("active"), F.count(F.lit(1)).alias("events"))
    return people.agg(F.count(F.lit(1)).alias("people")).join(F.broadcast(seen))  # one row each


def recent(rows: DataFrame, limit: int = 50, kind: str | None = None, prefix: str | None = None, passport_id: int | None = None) -> DataFrame:
    """The newest registry rows, of a type, of types that begin so, or of one person."""
    if kind:
        rows = rows.filter(F.col("type") == kind)
    if prefix:
        rows = rows.filter(F.startswith(F.col("type"), F.lit(prefix)))
    if passport_id is not None:
        rows = rows.filter(F.col("passport_id") == passport_id)
    return rows.orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit)


def counts_by_type(rows: DataFrame, since: str | None = None, passport_id: int | None = None) -> DataFrame:
    """(type, recorded_direction, recorded_channel, n): the two facets as events recorded them under data in their JSON; many record none."""
    if since is not None:
        rows = rows.filter(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    if passport_id is not None:
        rows = rows.filter(F.col("passport_id") == passport_id)
    facets = [F.get_json_object("meta", f"$.data.{c}").alias(f"recorded_{c}") for c in ("direction", "channel")]
    return rows.groupBy("type", *facets).agg(F.count(F.lit(1)).alias("n"))
