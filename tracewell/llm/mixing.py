"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is a number of equal-token blocks.  Sources get blocks by highest quotient target / (2k + 1);
the method is monotone in the number of blocks, so shard after shard takes the next blocks of one
ranking, and every shard gets integer quotas.  A source's documents stand on a line in a seeded order
and its blocks are cut from that line, begun again where it ends; each shard takes the blocks that follow
those of the shard before, so a document's tokens go to the shards whose stretches of the line it lies on.

Only tables with one row for each source, or each (source, slice of the hash range), are ever in one
task.  Documents are summed within slices, so a source with most of the rows is not in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The finest block, so that a source of a few words comes as near its target as a large one; blocks are counted, never rows of their own.
BLOCK_TOKENS = 1
SHARDS = 8
SLICES = 256
SHARE = 1.5
CAP = 2.0
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds weight and target to rows (source, source_size).

    Sources by code point, null last, take the weights in turn.  A target is weight times one level,
    but cap times the source's size at most; the level is where the targets make up the share.
    """
    everyone = W.orderBy(F.col("source").asc_nulls_last())
    all_rows = W.partitionBy()
    ranked = sources.withColumn("_turn", F.row_number().over(everyone) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_turn") % len(weights) + 1).cast("int")))
    ceiling = F.col("source_size") * F.lit(cap)
    by_ceiling = W.orderBy((ceiling / F.col("weight")), "_turn")
    filled = ranked.withColumns(
        {
            "_whole": F.least(F.lit(share), F.lit(cap)) * F.sum("source_size").over(all_rows),
            "_full": F.coalesce(F.sum(ceiling).over(by_ceiling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "_open": F.sum("weight").over(by_ceiling.rowsBetween(W.currentRow, W.unboundedFollowing)),
        }
    ).withColumn("_level", (F.col("_whole") - F.col("_full")) / F.col("_open"))
    level = F.max(F.when(F.col("_level") * F.col("weight") <= ceiling, F.col("_level"))).over(all_rows)
    return filled.withColumn("_line", level).select("source", "source_size", "weight", F.least(ceiling, F.coalesce(F.col("_line") * F.col("weight"), ceiling)).alias("target"))


def quotas(targets: DataFrame, block_tokens: int = BLOCK_TOKENS, n_shards: int = SHARDS, cap: float = CAP) -> DataFrame:
    """Blocks of each source for each shard: rows (shard, source, source_size, target, blocks, blocks_before).

    With n sources the shares rounded at the divisor sum / (seats + n / 2) are too many together, those at sum / (seats - n / 2)
    too few.  Only the seats between these two are contested, some 2n of all sources together, and are ranked by quotient.
    The last block that a source can give, at cap times its size, may be a part of one.
    """
    all_rows = W.partitionBy()
    seats = targets.withColumns({"_n": F.count(F.lit(1)).over(all_rows), "_sum": F.sum("target").over(all_rows)})
    seats = seats.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    seats = seats.withColumn("_seats", F.round(F.col("_sum") / block_tokens * (F.col("shard") + 1) / n_shards).cast("long"))
    rounded = lambda seats: F.floor(F.when(F.col("_sum") > 0, F.col("target") * F.greatest(F.lit(0.0), seats) / F.col("_sum")).otherwise(0.0) + 0.5)
    seats = seats.withColumns({"_base": F.greatest(F.lit(0), rounded(F.col("_seats") - F.col("_n") / 2) - 1), "_top": rounded(F.col("_seats") + F.col("_n") / 2)})
    by_shard = W.partitionBy("shard")
    left = seats.withColumn("_left", F.col("_seats") - F.sum("_base").over(by_shard))
    ranked = left.withColumn("_seat", F.explode(F.sequence(F.col("_base"), F.col("_top")))).withColumn("_place", F.row_number().over(by_shard.orderBy((F.col("target") / (2 * F.col("_seat") + 1)).desc(), F.col("source").asc_nulls_last())))
    won = ranked.groupBy("shard", "source", "source_size", "target", "_base").agg(F.count_if((F.col("_place") <= F.col("_left")) & (F.col("target") > 0)).alias("_won"))
    most = F.ceil(F.col("source_size") * F.lit(cap) / block_tokens)
    so_far = won.withColumn("_total", F.least(F.col("_base") + F.col("_won"), most).cast("long"))
    before = F.coalesce(F.lag("_total").over(W.partitionBy("source").orderBy("shard")), F.lit(0)).cast("long")
    return so_far.select("shard", "source", "source_size", "target", (F.col("_total") - before).alias("blocks"), before.alias("blocks_before"))


def mix_sources(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, n_shards: int = SHARDS, seed: int = 29, slices: int = SLICES) -> DataFrame:
    """The rows with size, source_size, target, taken (tokens the mix takes, repeats counted), line_start, source_blocks and
    shard_taken (the tokens that each shard takes, in the order of the shards; taken is their sum).

    A row is taken whole as often as the quota goes around its source's line, and once more as far as
    the rest of the quota reaches; so one row of each source at most is taken in part.  Null sources
    are one source, the last.  Sources without tokens take nothing.  Repeated rows stand on the line
    one after the other.  An empty input gives no rows.  Input columns with the added names are replaced.
    """
    added = ("size", "source_size", "target", "taken", "line_start", "source_blocks", "shard_taken")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*keep).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"))  # so that no name clashes
    key = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = rows.withColumns({"order": F.xxhash64(F.lit(seed), "id"), "key": key})
    rows = rows.withColumn("slice", F.shiftrightunsigned("order", 64 - int(math.log2(slices))).cast("int"))
    by_slice = rows.groupBy("key", "slice").agg(F.sum("size").alias("tokens"), F.first("source").alias("source"))
    starts = by_slice.select("key", "slice", (F.sum("tokens").over(W.partitionBy("key").orderBy("slice")) - F.col("tokens")).alias("from"))
    sources = by_slice.groupBy("key").agg(F.first("source").alias("source"), F.sum("tokens").alias("source_size"))
    filled = water_fill(sources.select("source", "source_size"))
    most = F.floor(F.col("source_size") * F.lit(CAP)).cast("long")
    reach = lambda blocks: F.least(most, blocks * F.lit(block_tokens))  # noqa: E731 - tokens of so many blocks
    stretch = F.struct("shard", reach(F.col("blocks_before")).alias("from"), reach(F.col("blocks_before") + F.col("blocks")).alias("to"))
    dealt = quotas(filled, block_tokens, n_shards).groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("blocks").alias("source_blocks"), F.array_sort(F.collect_list(stretch)).alias("stretches"))
    offsets = starts.join(dealt.select(key.alias("key"), "source_size", "target", "source_blocks", "stretches"), "key")
    line = W.partitionBy("key", "slice").orderBy("order", "id", "size", F.xxhash64("row"))
    placed = rows.join(offsets, ["key", "slice"]).withColumn("line_start", F.col("from") + F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))

    def taken_by(shard: Column) -> Column:
        """What of the row, in each time around the line, lies on the shard's stretch."""
        begins = [F.col("line_start") + around * F.col("source_size") for around in range(math.ceil(CAP))]
        parts = [F.greatest(F.lit(0).cast("long"), F.least(shard["to"], at + F.col("size")) - F.greatest(shard["from"], at)) for at in begins]
        return sum(parts[1:], parts[0])

    shared = placed.withColumn("shard_taken", F.transform("stretches", taken_by))
    return shared.withColumn("taken", F.aggregate("shard_taken", F.lit(0).cast("long"), lambda total, x: total + x)).select("row.*", *added)


def copies(mixed: DataFrame, columns: list[str], seed: int = 29) -> DataFrame:
    """Each row of mix_sources() as often as it is taken whole; the part of a row counts if it is half or more."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    rows = mixed.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), times.alias("times")).filter("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def mixture(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows as often as the mix takes them, as they are: columns named like those that mix_sources() adds keep their values."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("whole"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("words"))
    return copies(mix_sources(packed, F.col("words")), ["whole"]).select("whole.*")
