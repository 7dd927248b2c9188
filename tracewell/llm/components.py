"""Connected components of an edge table, by folding edges in tasks and contracting nodes in rounds.

A task folds the edges it has to stars: each node points to the least node it is tied to there.  A round
ties each node to its least neighbour, itself included, and puts that node in its place; what is left is
an edge table of fewer nodes, folded again.  The first round takes nodes in their own order, in which
stars vanish at once, later ones in an order by a hash, in which no chain of nodes can be a slow one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Tables

MOST_ROUNDS = 100
EDGES_A_TASK = 100_000  # at most 2 MB
HELD = 250_000
EDGES = "a long, b long"


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: every node but the least of each component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    one, two = at[: len(a)], at[len(a) :]
    while len(one):
        low = np.minimum(label[one], label[two])
        np.minimum.at(label, label[one], low)
        np.minimum.at(label, label[two], low)
        while True:
            next_label = label[label]
            if np.array_equal(next_label, label):
                break
            label = next_label
        open_ = label[one] != label[two]
        one, two = one[open_], two[open_]
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task (a, b) as stars; what is held is bounded, edges beyond that leave as they are by then."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x[0]) for x in held) > HELD:
            held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if len(held[0][0]) > HELD // 2:
                yield rows(*held.pop())
    if held:
        yield rows(*stars(*(np.concatenate(x) for x in zip(*held, strict=True))))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a task's edges and the least node of its component."""
    table = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    a, b = stars(table.column(0).to_numpy(), table.column(1).to_numpy())
    heads = np.unique(b)
    yield pa.record_batch([pa.array(np.concatenate([a, heads])), pa.array(np.concatenate([b, heads]))], names=["node", "component"])


def folded(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").filter("a <> b").mapInArrow(fold, EDGES)


def contract(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b long) that another one is tied to; the component is one of its nodes.

    Loops and repeated edges change nothing; an empty table has no components.  Nodes with very many edges are first
    folded to a minimum, and met in joins that Spark can split.  Each round's tables are written to the checkpoint
    folder, so that the planner has their sizes, and removed when they are done with.  Rounds go on until what is left
    fits a task of EDGES_A_TASK, whose stars are the last ones.
    """
    tables = Tables(edges.sparkSession)
    edges = tables.write(folded(edges))
    found = None
    for k in range(MOST_ROUNDS):
        tasks = 1 + edges.count() // EDGES_A_TASK
        if tasks == 1:
            least = edges.coalesce(1).mapInArrow(settle, "node long, component long")
        else:
            order = lambda c, salt=k: F.struct((F.xxhash64(F.lit(salt // 2), c) if salt else F.lit(0)).alias("order"), F.col(c).alias("node"))
            around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(2 * tasks)
            least = around.groupBy("a").agg(F.min(order("b")).alias("_low")).withColumn("_low", F.least("_low", order("a")))
            least = least.select(F.col("a").alias("node"), F.col("_low.node").alias("component")).coalesce(tasks)
        least = tables.write(least)
        if found is None:
            now = least
        else:
            moved = least.select(F.col("node").alias("component"), F.col("component").alias("_to"))
            now = tables.write(found.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component")))
            tables.drop(found)
        if tasks > 1:
            to = lambda c, name, least=least: least.select(F.col("node").alias(c), F.col("component").alias(name))
            moved = edges.join(to("a", "_a"), "a").join(to("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            left = tables.write(folded(moved.coalesce(tasks)))
        tables.drop(edges)
        if found is not None:
            tables.drop(least)
        found = now
        if tasks == 1:
            return found
        edges = left
    raise RuntimeError("components did not settle")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b long); the component is its least node, loops alone are none."""
    found = contract(edges)
    least = found.groupBy("component").agg(F.min("node").alias("_least"))
    return found.join(least, "component").select("node", F.col("_least").alias("component"))
