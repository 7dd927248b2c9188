"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are first dealt to source partitions by a hash of the whole row.  How many rows each partition owes
each shard is drawn exactly: row by row of the matrix from the multivariate hypergeometric law, so
the matrix is distributed as under a uniform permutation of all rows.  Each partition then orders its
rows by a seeded hash and deals them by its row of the matrix; each shard orders what it received by
a second hash, which gives the slots.  Slots are numbered within (shard, slice of the hash range), with the
sizes of the slices before it added, so no task sorts a whole shard.

There are as many partitions and slices as keep each at some ROWS_A_TASK rows, and never fewer than
PARTITIONS and SLICES; the matrix has a count for each partition and shard.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTITIONS = 256
SLICES = 16
ROWS_A_TASK = 1 << 22


def hypergeometric(rng: random.Random, good: int, bad: int, take: int) -> int:
    """How many of `take` drawn without replacement are good; inversion outwards from the mode."""
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    mode = min(high, max(low, (take + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(log_choose(good, mode) + log_choose(bad, take - mode) - log_choose(good + bad, take))
    left = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (take - up) / ((up + 1) * (bad - take + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - take + down) / ((good - down + 1) * (take - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up < 1e-18 and p_down < 1e-18:
            break
    return mode


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows for each partition to each shard; shard sizes differ by one at most."""
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = []
    for p, count in enumerate(counts):
        rng = random.Random(f"{seed}:{p}")
        open_, need, row = sum(room), count, []
        for s in range(n_shards):
            open_ -= room[s]
            got = hypergeometric(rng, room[s], open_, need)
            row.append(got)
            need -= got
            room[s] -= got
        out.append(row)
    return out


def uniform_shards(rows: DataFrame, n_shards: int, id_col: str = "doc_id", seed: int = 17, partitions: int = PARTITIONS, slices: int = SLICES, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """The rows with all their columns, and shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Rows are hashed by all columns, so that those with a null or repeated id are spread like others; only rows that are
    alike in every column stay together, and are interchangeable.  Where a column is a map, which has no hash, the id alone
    is hashed.  An empty input gives no rows.  Input columns named shard or slot are replaced.
    """
    spark = rows.sparkSession
    n = rows.count()
    partitions = max(partitions, -(-n // rows_a_task))
    slices = 1 << max(1, math.ceil(math.log2(slices)), math.ceil(math.log2(max(1, n / n_shards / rows_a_task))))
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]
    packed = rows.select(F.col(f"`{id_col}`").alias("id"), F.struct(*keep).alias("row"))  # so that no name clashes
    ties = ["id"] if "map<" in packed.schema["row"].dataType.simpleString() else ["id", "row"]
    order = lambda k: F.xxhash64(F.lit(seed + k), *ties, F.lit("order"))
    dealt = packed.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), *ties), F.lit(partitions)).cast("int"))
    by_part = dict(dealt.groupBy("part").count().collect())  # at most `partitions` rows
    parts = sorted(by_part)
    matrix = communication_matrix([by_part[p] for p in parts], n_shards, seed)
    bounds = [(p, list(accumulate(row))) for p, row in zip(parts, matrix, strict=True)]
    bounds_df = spark.createDataFrame(bounds, "part int, bounds array<long>")  # a row of shards counts for each partition
    local = W.partitionBy("part").orderBy(order(1), *ties)
    placed = (
        dealt.withColumn("rank", F.row_number().over(local).cast("long"))
        .join(F.broadcast(bounds_df), "part")
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("rank"))))
        .withColumn("order", order(2))
        .withColumn("slice", F.shiftrightunsigned("order", 64 - int(math.log2(slices))).cast("int"))
        .select("id", "row", "shard", "order", "slice")
    )
    sizes = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("shard", "slice").orderBy("order", *ties)
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "slice"])  # a row for each shard and slice
        .select("row.*", "shard", (F.col("before") + F.col("at")).alias("slot"))
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32 of every document; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
