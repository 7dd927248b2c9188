"""Exact percentiles of many groups, and pages by key, without a group or an order in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.durations import SpecError

SLICES = 4096
ROUNDS = 2


def _same(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on names whose nulls are equal; columns of b other than these must have other names than a's."""
    other = b.withColumnsRenamed({n: f"_b_{n}" for n in names})
    return a.join(other, reduce(and_, [F.col(n).eqNullSafe(F.col(f"_b_{n}")) for n in names]), how).drop(*[f"_b_{n}" for n in names])


def _narrowed(counts: DataFrame, wanted: DataFrame, names: list[str], slices: int) -> DataFrame:
    """For each rank wanted the values (low to high) of the slice that holds it, and how many rows are below."""
    inside = _same(counts, wanted, names).filter(F.col("v").between(F.col("low"), F.col("high")))
    share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor(share * slices), F.lit(slices - 1))).otherwise(0)
    cells = inside.groupBy(*names, "rank", "at", "below", place.alias("slice")).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    upto = F.sum("n").over(W.partitionBy(*names, "rank").orderBy("slice")) + F.col("below")  # as many rows as slices at most
    held = cells.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    return held.select(*names, "rank", "at", (F.col("upto") - F.col("n")).alias("below"), F.col("least").alias("low"), F.col("most").alias("high"))


def _values(counts: DataFrame, wanted: DataFrame, names: list[str], slices: int) -> DataFrame:
    """names, rank, at and v: the value at each rank wanted (names, rank, at, low, high), from different values v and their counts n."""
    wanted = wanted.select(*names, "rank", "at", "low", "high", F.lit(0).cast("long").alias("below"))
    for _ in range(ROUNDS):
        wanted = _narrowed(counts, wanted, names, slices)
    left = _same(counts, wanted, names).filter(F.col("v").between(F.col("low"), F.col("high")))
    upto = F.sum("n").over(W.partitionBy(*names, "rank").orderBy("v")) + F.col("below")
    return left.withColumn("upto", upto).filter(F.col("upto") > F.col("rank")).groupBy(*names, "rank", "at").agg(F.min("v").alias("v"))


def percentiles(rows: DataFrame, names: list[str], value: Column, p: float, slices: int = SLICES) -> DataFrame:
    """names and value: the exact p-quantile of each group's numbers, between its two nearest ranks; null without a number.

    Different values are counted once for all.  A group's range is cut into slices, their counts are summed from below, and
    only the slice with the wanted rank is cut again; what is left of it is put in order.  So the task of a group sees some
    thousand sums, and in the end the different values of one slice of a slice.  Nulls and NaN are no numbers.
    """
    if not 0 <= p <= 1:
        raise SpecError(f"group: a percentile lies between 0 and 1, not {p!r}")
    number = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    counts = rows.select(*names, number.alias("v")).groupBy(*names, "v").agg(F.count(F.lit(1)).alias("n"))
    known = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
    ends = counts.groupBy(*names).agg(known.alias("rows"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("at", F.lit(float(p)) * (F.col("rows") - 1))
    both = F.array_distinct(F.array(F.floor("at"), F.ceil("at")))
    hit = _values(counts, ends.filter("rows > 0").withColumn("rank", F.explode(both)), names, slices)
    share = F.col("at") - F.floor("at")
    two = hit.groupBy(*names, "at").agg(F.min_by("v", "rank").alias("one"), F.max_by("v", "rank").alias("two"))
    found = two.select(*names, F.round(F.col("one") + (F.col("two") - F.col("one")) * share, 4).alias("value"))
    return found.unionByName(ends.filter("rows = 0").select(*names, F.lit(None).cast("double").alias("value")))


def at_share(counts: DataFrame, ends: DataFrame, share: float, slices: int = SLICES) -> DataFrame:
    """One row v: the smallest value that so large a share of all rows does not exceed.

    counts are the different values v and how many rows n have each, ends their one row of rows, low and high.
    """
    wanted = ends.select(F.lit(0).alias("_all"), (F.ceil(F.lit(float(share)) * F.col("rows")) - 1).alias("rank"), F.lit(0.0).alias("at"), "low", "high")
    return _values(counts.select(F.lit(0).alias("_all"), "v", "n"), wanted, ["_all"], slices).select("v")


def page(rows: DataFrame, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The next rows in descending order of the keys after a row's keys, with `more`: whether others follow.

    One row over the size tells.  The last row's keys begin the next page, and the filter on them reaches the scan, so a late page
    costs no more than the first.  Keys must tell rows apart; rows with a null key are on no page.
    """
    if not size > 0:
        raise SpecError("page: a size over 0")
    if after is not None:
        if len(after) != len(keys):
            raise SpecError(f"page: after needs values for {'/'.join(keys)}")
        first, bound = F.col(keys[0]), F.lit(after[0])
        older, equal = F.lit(False), F.lit(True)
        for k, v in zip(keys, after, strict=True):
            older = older | (equal & (F.col(k) < F.lit(v)))
            equal = equal & (F.col(k) == F.lit(v))
        rows = rows.filter((first <= bound) & older)
    some = rows.filter(reduce(and_, [F.col(k).isNotNull() for k in keys])).orderBy(*[F.desc(k) for k in keys]).limit(size + 1)
    place = F.row_number().over(W.orderBy(*[F.desc(k) for k in keys]))  # of size + 1 rows
    return some.withColumn("_place", place).withColumn("more", F.max("_place").over(W.partitionBy(F.lit(0))) > size).filter(F.col("_place") <= size).drop("_place")


def page_begins(rows: DataFrame, keys: list[str], size: int, number: int, bins: int = 4096) -> tuple | None:
    """The keys after which page `number` (from 0) begins, None for the first, for page(); rows are not put in order for it.

    Counts by ranges of the first key, a time or number, are summed from the newest; only the range in which the page begins is
    looked into.  Past the last row there is nothing after the last row's keys.
    """
    skip = number * size
    if skip <= 0:
        return None
    first = F.col(keys[0])
    number_of = F.unix_micros(first) if dict(rows.dtypes)[keys[0]] == "timestamp" else first
    known = rows.filter(reduce(and_, [F.col(k).isNotNull() for k in keys])).withColumn("_k", number_of.cast("double"))
    low, high = known.agg(F.min("_k"), F.max("_k")).first()
    if low is None:
        return None
    above = 0
    while True:
        width = (high - low) / bins
        place = F.when(F.lit(width > 0), F.least(F.floor((F.col("_k") - low) / F.lit(width or 1.0)), F.lit(bins - 1))).otherwise(0)
        cells = known.filter(F.col("_k").between(low, high)).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("least"), F.max("_k").alias("most")).orderBy(F.desc("b")).collect()
        cell = cells[-1]
        for c in cells:
            cell = c
            if above + c["n"] >= skip:
                break
            above += c["n"]
        low, high = cell["least"], cell["most"]
        if cell["n"] <= max(size, bins) or low == high:
            break
    inside = known.filter(F.col("_k").between(low, high)).orderBy(*[F.desc(k) for k in keys]).select(*keys)
    last = inside.limit(max(1, skip - above)).orderBy(*keys).first()
    return tuple(last)
