"""Importance resampling towards a target distribution.

Features of a text are its runs of consecutive words, hashed into buckets.  A bucket's gain is the logarithm of its share
of the target's features over its share of all documents', in thousandths; a document's weight is the mean gain of its
features, and its score the weight plus Gumbel noise drawn from its id, so that the highest scores are a sample without
replacement.

Counts of both sides are one row for each bucket, and the gains one array, by which each text is scored in a single step.
Scores are whole numbers in a narrow range: counts by score, summed from the top, give each score's first rank and the
cutoff score.  Only documents at or above it are numbered, by doc_id within their score.  A score that many documents
share is numbered in stretches of doc_id, each with its own first rank, so no task numbers more than about
MOST_OF_A_SCORE rows, however many rows one score has; equal rows of one doc_id are numbered as one row.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import checkpoint
from .textvec import text_of

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
MOST_OF_A_SCORE = 1 << 20
MAX_FEATURES = 500_000
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FULL = 2.0**32


class Features:
    """Buckets of a text's features, with a bounded table of those met before."""

    def __init__(self, buckets: int, most_words: int) -> None:
        self.buckets, self.most_words, self.table = buckets, most_words, {}

    def of(self, text: str) -> tuple[int, list[int]]:
        """The number of words, and the bucket of each run of 1 to most_words words."""
        words = text.encode().translate(_WORD_BYTES).split()
        runs = words
        for k in range(2, self.most_words + 1):
            runs = runs + [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        table = self.table
        if len(table) > MAX_FEATURES:
            table.clear()
        for run in set(runs).difference(table):
            table[run] = zlib.crc32(run) % self.buckets
        return len(words), [table[x] for x in runs]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most_words: int = 1) -> np.ndarray:
    """How many features of all texts are in each bucket; at most one row for each bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, most_words), np.zeros(buckets, np.int64)
        for batch in batches:
            held: list[int] = []
            for text in text_of(batch.column(0)):
                held += features.of(text.as_py())[1]
                if len(held) > 1 << 18:
                    total += np.bincount(held, minlength=buckets)
                    held = []
            total += np.bincount(np.array(held, np.int64), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    counts = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths, rounded down."""
    all_source, all_target, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, rounded down, from a digest of the seed and the id (none: the empty text)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / _FULL)))


def scored(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most_words: int = 1, seed: int = SEED) -> DataFrame:
    """The columns of SCORED, one row per row of docs; a text without features has weight 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gains), most_words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n_words, n_features, sums = [], [], []
                held: list[int] = []
                for text in text_of(part.column(1)):
                    words, of = features.of(text.as_py())
                    n_words.append(words)
                    n_features.append(len(of))
                    held += of
                    if len(held) > 1 << 20 or len(n_words) == part.num_rows:
                        total = np.concatenate(([0], np.cumsum(gains[np.array(held, np.int64)])))
                        edge = np.concatenate(([0], np.cumsum(n_features[len(sums) :])))
                        sums += np.diff(total[edge]).tolist()
                        held = []
                weight = np.array(sums, np.int64) // np.maximum(np.array(n_features, np.int64), 1)
                score = weight + np.array([noise(x, seed) for x in part.column(0).to_pylist()], np.int64)
                columns = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score)]
                yield pa.record_batch([part.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)


def _first_ranks(counts: dict, draw: int) -> list[tuple]:
    """(key, rows before it) in the order of the keys, as far as the draw reaches."""
    out, before = [], 0
    for key in sorted(counts):
        if before >= draw:
            break
        out.append((*key, before))
        before += counts[key]
    return out


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, most_of_a_score: int = MOST_OF_A_SCORE) -> DataFrame:
    """The rows of scores (columns SCORED, read several times) with their rank, null where they are not drawn.

    Of the rows with at least least_words words, percent in a hundred (rounded down) are drawn: the highest scores, ties to the smaller
    doc_id, a null one first; rows alike in these by n_features and weight.
    """
    spark = scores.sparkSession
    stands = F.col("n_words") >= least_words
    # One row for each score: scores lie within some 40,000 of each other (a logarithm of a count each in weight and noise).
    by_score = scores.filter(stands).groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).collect()
    draw = sum(r["n"] for r in by_score) * percent // 100
    reached = [(r[0], r[-1]) for r in _first_ranks({(-r["score"],): r["n"] for r in by_score}, draw)]
    if not reached:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    cutoff = -reached[-1][0]
    # Stretches of doc_id within a frequent score, some n / most_of_a_score of them.
    cuts = {}
    for r in by_score:
        if r["n"] > most_of_a_score and r["score"] >= cutoff:
            least, most = float(r["least"] or 0), float(r["most"] or 0)
            cuts[-r["score"]] = least, (most - least + 1) / -(-r["n"] // most_of_a_score)
    layout = spark.createDataFrame([(-key, *cuts.get(key, (0.0, 0.0))) for key, _ in reached], "score long, _least double, _span double")
    within = F.floor((F.col("doc_id").cast("double") - F.col("_least")) / F.col("_span"))
    stretch = F.when(F.col("_span") == 0, F.lit(0)).when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(within).cast("long")
    above = scores.filter(stands & (F.col("score") >= cutoff)).join(F.broadcast(layout), "score").withColumn("_stretch", stretch).drop("_least", "_span")
    if cuts:
        by_stretch = above.groupBy("score", "_stretch").count().collect()
        firsts = _first_ranks({(-r["score"], r["_stretch"]): r["count"] for r in by_stretch}, draw)
    else:
        firsts = [(key, 0, before) for key, before in reached]
    offsets = spark.createDataFrame([(-key, part, before) for key, part, before in firsts], "score long, _stretch long, _before long")
    same = above.groupBy("score", "_stretch", "doc_id", "n_features", "weight", "n_words").agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy("score", "_stretch").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight", "n_words")
    last = same.withColumn("_last", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    placed = last.join(F.broadcast(offsets), ["score", "_stretch"], "left").withColumn("_first", F.col("_before") + F.col("_last") - F.col("_n") + 1)
    each = placed.withColumn("rank", F.explode(F.coalesce(F.expr("sequence(_first, _first + _n - 1)"), F.expr("array_repeat(cast(null as bigint), cast(_n as int))"))))
    drawn = each.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    columns = [*scores.columns, "rank"]
    rest = scores.filter(~(stands & (F.col("score") >= cutoff))).withColumn("rank", F.lit(None).cast("long"))
    return rest.select(columns).unionByName(drawn.select(columns))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, most_words: int = 1, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, most_of_a_score: int = MOST_OF_A_SCORE) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank, one row per row of docs.

    Null and empty texts have no features, weight 0 and are not drawn unless least_words is 0; without a target text all gains
    come from the documents alone.  A null id draws the noise of the empty text and counts as the smallest.  Repeated rows are
    drawn one by one.  An empty table gives no rows.  Further columns are left out, whatever their names.
    """
    gains = gains_of(bucket_counts(docs, text_col, buckets, most_words), bucket_counts(target, target_col, buckets, most_words))
    return ranked(checkpoint(scored(docs, gains, id_col, text_col, most_words, seed)), percent, least_words, most_of_a_score)
