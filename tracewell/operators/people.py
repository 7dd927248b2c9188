"""Finding people: by identities, fact values and ids, with an index of three-letter grams, and pages by key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
GRAM_BUCKETS = 64


def _bucket(gram):
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS))


def grams_of(rows: DataFrame) -> DataFrame:
    """(gram, value, bucket): the grams of each different value, in lower case.

    Written with partitionBy("bucket"), a search reads the buckets of its own grams only.
    """
    values = rows.select("value").filter("value IS NOT NULL").distinct()
    low = F.lower("value")
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    each = values.withColumn("gram", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr(low, i, F.lit(GRAM))))))
    return each.select("gram", "value", _bucket(F.col("gram")).cast("int").alias("bucket"))


def holding(grams: DataFrame, text: str) -> DataFrame:
    """The values with the text in them, whatever its case; a text shorter than a gram is looked for in all values."""
    low = text.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return grams.filter(F.contains(F.lower("value"), F.lit(low))).select("value").distinct()
    spark = grams.sparkSession
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    rows = grams.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    full = rows.groupBy("value").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted))
    return full.filter(F.contains(F.lower("value"), F.lit(low))).select("value")


SEARCHED = ("identities", "facts", "id")


def search(passports: DataFrame, facts: DataFrame, identities: DataFrame, text: str = "", fields: tuple[str, ...] | str | None = None, merges: DataFrame | None = None, anonymous: bool = False, grams: DataFrame | None = None) -> DataFrame:
    """(id, last_seen_at) of the people whose identity or fact holds the text, whatever its case, or whose id begins with it.

    Only an id of hexadecimal digits is looked for as an id.  fields narrows the search to some of SEARCHED; none, or only
    unknown ones, means all.  Without a text everybody with an identity is found, with `anonymous` those without one too.
    Passports that merges (absorbed, survivor) have absorbed are never found.  With the grams of all values, only values that
    hold every gram of the text are looked at.
    """
    term = text.strip()
    asked = [f.strip() for f in (fields.split(",") if isinstance(fields, str) else fields or ())]
    scope = [f for f in asked if f in SEARCHED] or list(SEARCHED)
    people = passports if merges is None else passports.join(merges.select(F.col("absorbed").alias("id")).distinct(), "id", "left_anti")
    has = lambda rows: rows.join(found_values, "value", "left_semi") if found_values is not None else rows.filter(F.contains(F.lower("value"), F.lit(term.lower())))
    if not term:
        found = people if anonymous else people.join(identities.select(F.col("passport_id").alias("id")).distinct(), "id", "left_semi")
        return found.select("id", "last_seen_at")
    found_values = None if grams is None else holding(grams, term)
    hits = [has({"identities": identities, "facts": facts}[f]).select(F.col("passport_id").alias("id")) for f in scope if f != "id"]
    if "id" in scope and re.fullmatch(r"[0-9a-fA-F-]*[0-9a-fA-F][0-9a-fA-F-]*", term):
        hits.append(people.filter(F.startswith(F.lower(F.col("id").cast("string")), F.lit(term.lower()))).select("id"))
    if not hits:
        return people.limit(0).select("id", "last_seen_at")
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    return people.join(every.distinct(), "id", "left_semi").select("id", "last_seen_at")
