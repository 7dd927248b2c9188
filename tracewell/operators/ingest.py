"""What is done to records on their way in: conversions, engagement, customer records, links."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The kinds of engagement events.
ENGAGEMENT = ("section", "text", "video", "image", "link")


def conversions(rows: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """One row for each event_id, the first received; clocks more than so many minutes ahead are set to now."""
    ahead = F.col("ts") > now + F.make_dt_interval(mins=F.lit(minutes))
    valid = rows.filter("event_id IS NOT NULL AND name IS NOT NULL")
    first = valid.groupBy("event_id").agg(F.min_by(F.struct("name", "passport_id", "ts", "value"), "received").alias("r")).select("event_id", "r.*")
    return first.withColumn("ts", F.when(ahead, now).otherwise(F.col("ts")))


def engagement(rows: DataFrame) -> DataFrame:
    """Exposures of known kinds of engagement: what was met, for how long, and how much of it (0 to 1)."""
    share = F.when(F.col("kind") == "video", F.col("watched_s") / F.col("length_s")).when(F.col("kind") == "text", read_depth(F.col("length_chars"), F.col("partial"))).otherwise(F.lit(1.0))
    return rows.filter(F.col("kind").isin(*ENGAGEMENT)).select("id", "passport_id", "ts", F.col("kind").alias("source"), "dwell_ms", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0)))).alias("engagement"))


# Characters of a word, words of a full read, and the least that counts.
CHARS_A_WORD, FULL_READ_WORDS, LEAST_READ = 5, 80, 0.02


def words_of(length_chars: Column) -> Column:
    return F.greatest(F.lit(1.0), F.round(F.coalesce(length_chars, F.lit(0)) / CHARS_A_WORD))


def read_depth(length_chars: Column, partial: Column) -> Column:
    """How much was read, of a full read: the words of the text, half of them if it was not read to its end."""
    read = words_of(length_chars) * F.when(F.coalesce(partial, F.lit(False)), 0.5).otherwise(1.0)
    return F.floor(F.greatest(F.lit(LEAST_READ), F.least(F.lit(1.0), read / FULL_READ_WORDS)) * 100 + 0.5) / 100


def records_to_facts(records: DataFrame, id_col: str, observed: str, columns: list[str]) -> DataFrame:
    """One fact for each scalar field that has a value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    return records.select(F.col(id_col).alias("passport_id"), F.col(observed).alias("observed_at"), F.explode(pairs).alias("f")).select("passport_id", "observed_at", "f.key", "f.value").filter("value IS NOT NULL")


def unnested(rows: DataFrame, column: str) -> DataFrame:
    """(key, value) of every entry of a JSON object."""
    return rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def claimed(clicks: DataFrame, claims: DataFrame, minutes: int) -> DataFrame:
    """Each click with the first claim of its token within so many minutes; a token is claimed once."""
    first = claims.groupBy("token").agg(F.min(F.struct("claimed_at", "passport_id")).alias("c"))
    until = F.col("clicked_at") + F.make_dt_interval(mins=F.lit(minutes))
    return clicks.join(first, "token").filter((F.col("c.claimed_at") >= F.col("clicked_at")) & (F.col("c.claimed_at") <= until)).select("token", "visitor", "c.passport_id")


def enrolments(triggers: DataFrame, cooldown_days: int) -> DataFrame:
    """(passport_id, enrolled_at) of triggers that enrol: of each passport the first, and those at least the cooldown after the last that did.

    A passport's different seconds with a trigger are in one task, 8 bytes each; from one enrolment the next is found by bisection.
    """
    import numpy as np
    import pyarrow as pa

    gap = cooldown_days * 86400
    times = triggers.select("passport_id", F.unix_timestamp("ts").alias("enrolled_at")).filter("enrolled_at IS NOT NULL").distinct()
    kind = times.schema["passport_id"].dataType.simpleString()

    def chosen(group: pa.Table) -> pa.Table:
        at = np.sort(group["enrolled_at"].to_numpy())
        kept, k = [], 0
        while k < len(at):
            kept.append(int(at[k]))
            k = max(k + 1, int(at.searchsorted(at[k] + gap)))
        return pa.table({"passport_id": group["passport_id"].slice(0, 1).take(pa.array([0] * len(kept), pa.int64())), "enrolled_at": pa.array(kept, pa.int64())})

    return times.groupBy("passport_id").applyInArrow(chosen, f"passport_id {kind}, enrolled_at long")


# Calls that a content gets, and the pause after the first that failed; each further pause is twice as long.
ATTEMPTS, FIRST_PAUSE_S = 5, 5
TRIES = "content_hash string, attempts int, next_at timestamp, failed string"


def to_embed(chunks: DataFrame, embedded: DataFrame, tries: DataFrame | None = None, now: Column | None = None, most: int = ATTEMPTS) -> DataFrame:
    """(content_hash, chunk_text) to be embedded: each new content once, however many rows have it; blank texts never.

    With tries (TRIES), not what has had so many calls, nor what pauses beyond now.
    """
    new = chunks.filter(F.col("chunk_text").rlike(r"\S")).join(embedded.select("content_hash"), "content_hash", "left_anti")
    if tries is not None:
        barred = F.col("attempts") >= most
        barred = barred if now is None else barred | (F.col("next_at") > now)
        new = new.join(tries.filter(barred).select("content_hash"), "content_hash", "left_anti")
    return new.groupBy("content_hash").agg(F.min("chunk_text").alias("chunk_text"))


def embed(due: DataFrame, embedder: Callable[[list[str]], list], lot: int = 64) -> DataFrame:
    """(content_hash, embedding, failed) of every content due: the caller's embedder gets lots of texts.

    Where a lot raises, or gives another number of vectors, its texts are tried one by one, so that one bad text fails alone; failed then
    says why and the embedding is null.  Write the result before you use it twice: each reading calls the embedder anew.
    """

    def called(texts: list[str]) -> list:
        vectors = list(embedder(texts))
        if len(vectors) != len(texts):
            raise ValueError(f"{len(texts)} texts, {len(vectors)} vectors")
        return [([float(x) for x in v], None) for v in vectors]

    def each(texts: list[str]) -> list:
        try:
            return called(texts)
        except Exception as fault:  # noqa: BLE001 - what failed is a row of the result
            return [(None, f"{type(fault).__name__}: {fault}")] if len(texts) == 1 else [x for t in texts for x in each([t])]

    def run(frames):
        for frame in frames:
            texts = frame["chunk_text"].tolist()
            found = [x for at in range(0, len(texts), lot) for x in each(texts[at : at + lot])]
            yield pd.DataFrame({"content_hash": frame["content_hash"], "embedding": [x[0] for x in found], "failed": pd.Series([x[1] for x in found], dtype="object")})

    return due.mapInPandas(run, "content_hash string, embedding array<double>, failed string")


def tries_after(tries: DataFrame, results: DataFrame, now: Column, most: int = ATTEMPTS, first_pause_s: int = FIRST_PAUSE_S) -> DataFrame:
    """TRIES after some results (content_hash, failed): a success ends its row, a failure counts one more and pauses twice as long as the last.

    Given-up contents stay, without a next time, so that they can be looked at.
    """
    before = tries.select("content_hash", F.col("attempts").alias("_a"), F.col("next_at").alias("_t"), F.col("failed").alias("_f"))
    seen = results.groupBy("content_hash").agg(F.bool_and(F.col("failed").isNotNull()).alias("_bad"), F.min("failed").alias("failed"))
    both = before.join(seen, "content_hash", "full_outer").filter("_bad IS NULL OR _bad")
    n = F.coalesce("_a", F.lit(0)) + F.when(F.col("_bad"), 1).otherwise(0)
    pause = F.timestamp_seconds(F.unix_timestamp(now) + F.lit(first_pause_s) * F.pow(F.lit(2.0), n - 1))
    next_at = F.when(F.col("_bad").isNull(), F.col("_t")).when(n < most, pause)
    return both.select("content_hash", n.cast("int").alias("attempts"), next_at.alias("next_at"), F.coalesce("failed", "_f").alias("failed"))


def rechecks(events: DataFrame, quiet: str) -> DataFrame:
    """(passport_id, recheck_at, n): one recheck after each burst of events, once it has been quiet for so long.

    For batches and, with a watermark on ts, for streams in append mode; a burst's state is its two ends and a count.
    """
    bursts = events.groupBy("passport_id", F.session_window("ts", quiet).alias("burst")).agg(F.count(F.lit(1)).alias("n"))
    return bursts.select("passport_id", F.col("burst.end").alias("recheck_at"), "n")


def attribute_keys(events: DataFrame) -> DataFrame:
    """(key, n_rows, n_values, sources, channels) of every key of the open map `meta` but `event`: who wrote it, and how often."""
    pairs = events.select("source", "channel", F.explode(F.from_json("meta", "map<string,string>")).alias("key", "value")).filter("key <> 'event'")
    names = [F.array_join(F.sort_array(F.collect_set(c)), ",").alias(f"{c}s") for c in ("source", "channel")]
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("value").alias("n_values"), *names)


def latest_step(enrolled: DataFrame, runs: DataFrame) -> DataFrame:
    """Each enrolment with its latest step run, if it has one."""
    last = runs.groupBy("enrolment_id").agg(F.max_by("step", F.struct("started_at", "run_id", "step")).alias("step"))
    return enrolled.join(last, "enrolment_id", "left")


def utm_breakdown(visits: DataFrame) -> DataFrame:
    """Sessions of each campaign source; those without one are direct."""
    return visits.groupBy(F.coalesce("utm_source", F.lit("direct")).alias("source")).agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("passport_id").alias("people"))


def latest_of_each_key(facts: DataFrame, passport_id: int) -> DataFrame:
    rows = facts.filter(F.col("passport_id") == passport_id)
    return rows.groupBy("key").agg(F.max_by("value", F.struct("observed_at", "id")).alias("value"))


def touches_before(events: DataFrame, kind: str, n: int) -> DataFrame:
    """For each event of a kind its person's last n channels before it, newest first."""
    by = W.partitionBy("passport_id").orderBy("ts", "id").rowsBetween(-n, -1)
    return events.withColumn("path", F.reverse(F.collect_list("channel").over(by))).filter(F.col("attr_event") == kind).select("id", F.array_join("path", ">").alias("path"))
