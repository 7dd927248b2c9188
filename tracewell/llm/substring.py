"""Substring deduplication by seed and extend on winnowed anchors.

A window is WINDOW consecutive words.  Winnowing picks, among the runs of ANCHOR words inside each
window, the one with the least hash; equal windows pick equal anchors at equal places, so every
repeated window is found from a seed, a pair of places with the same anchor.  A seed can extend as
far as a window reaches on either side; that surrounding is the anchor's context.

Places are never paired.  Those with one anchor and one context are a class; the extension of a
place to the first document of its class is the whole context.  Only the places in that first
document can owe words to another class, and they are compared with all other classes at once,
window by window.  Both give maximal repeats: runs of words, at least a window long, that an earlier
document holds too.  Work and rows grow with the places, whatever the size of a group of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpoint
from .textvec import U64, Slice, run_hash, run_prefix, signed, slices, text_of

WINDOW = 50
ANCHOR = 25
PLACE_BITS = 28
NO_ID = 2**63 - 1

PLACES = "anchor long, context long, doc_order long, row_key long, place long, left_words short, right_words short"
RUNS = "window_a long, window_b long, doc_order long, row_key long, first_word long"
RESULT = "doc_id long, n_words long, n_removed long, text string, kept_sha256 string"


class Anchors:
    """The words of a slice with, for each window, the word where its anchor starts."""

    def __init__(self, s: Slice, window: int, anchor: int) -> None:
        s.find_words()
        self.reach = window - anchor
        self.prefix = run_prefix(s.hash_words())
        n = len(s.start)
        self.end = s.first[1:][s.doc] if n else np.zeros(0, np.int64)
        self.begin = s.first[:-1][s.doc] if n else np.zeros(0, np.int64)
        at = np.arange(n)
        self.windows = at[at + window <= self.end]
        self.chosen = np.zeros(n, np.int64)
        if len(self.windows):
            low = U64((1 << PLACE_BITS) - 1)
            key = run_hash(self.prefix, at, np.minimum(at + anchor, n)) & ~low | at.astype(U64)
            width, best = self.reach + 1, key
            span = 1
            while 2 * span <= width:
                best = np.minimum(best[: len(best) - span], best[span:])
                span *= 2
            if span < width:
                best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
            self.chosen[self.windows] = (best[self.windows] & low).astype(np.int64)


def find_places(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for s in slices(text_of(batch.column(2))):
                a = Anchors(s, window, anchor)
                if not len(a.windows):
                    continue
                p = np.unique(a.chosen[a.windows])
                left = np.minimum(a.reach, p - a.begin[p])
                right = np.minimum(a.reach, a.end[p] - p - anchor)
                context = run_hash(a.prefix, p - left, p + anchor + right) + left.astype(U64) * U64(0x9E3779B97F4A7C15)
                doc = s.lo + s.doc[p]
                yield pa.record_batch(
                    [pa.array(signed(run_hash(a.prefix, p, p + anchor))), pa.array(signed(context)), pa.array(order[doc]), pa.array(keys[doc]), pa.array(p - a.begin[p]), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))],
                    names=["anchor", "context", "doc_order", "row_key", "place", "left_words", "right_words"],
                )

    return run


def find_windows(window: int, anchor: int):
    """The windows of each row whose anchor is at one of its listed places, under two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            places = batch.column(4)
            for s in slices(text_of(batch.column(3))):
                a = Anchors(s, window, anchor)
                if not len(a.windows):
                    continue
                of = places.slice(s.lo, s.rows)
                at = of.flatten().to_numpy() + np.repeat(s.first[:-1], of.value_lengths().to_numpy())
                wanted = np.zeros(len(s.start), bool)
                wanted[at] = True
                w = a.windows[wanted[a.chosen[a.windows]]]
                half = w + window // 2
                yield pa.record_batch(
                    [
                        pa.array(signed(run_hash(a.prefix, w, w + window))),
                        pa.array(signed(run_hash(a.prefix, w, half) ^ (run_hash(a.prefix, half, w + window) * U64(0xD6E8FEB86659FD93)))),
                        pa.array(order[s.lo + s.doc[w]]),
                        pa.array(keys[s.lo + s.doc[w]]),
                        pa.array(w - a.begin[w]),
                    ],
                    names=["window_a", "window_b", "doc_order", "row_key", "first_word"],
                )

    return run


def remove_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the words in the listed runs (from, to) of each row."""
    for batch in batches:
        texts = text_of(batch.column(1)).cast(pa.binary())
        out: list[list] = [[], [], [], [], []]
        size = 0
        for doc_id, text, runs in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
            words = text.as_py().split()
            n = len(words)
            if runs:
                gone = np.zeros(n + 1, np.int64)
                ends = np.array([(r["from"], r["to"]) for r in runs])
                np.add.at(gone, ends[:, 0], 1)
                np.add.at(gone, ends[:, 1], -1)
                stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                words = [words[i] for i in stay.tolist()]
            kept = b" ".join(words)
            size += len(kept)
            for column, value in zip(out, (doc_id, n, n - len(words), kept.decode(), hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
            if size > 1 << 23:
                yield _rows(out)
                out, size = [[], [], [], [], []], 0
        if out[0]:
            yield _rows(out)


def _rows(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "text", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by one space), kept_sha256 of every row.

    A word goes if a window over it starts, word for word, in a row with a smaller id as well.  Rows
    with one id don't take words from each other, and a null id counts as larger than any.  Null texts
    have no words.  Repeated rows (same id and text) share one result, which each of them returns.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_order"), F.xxhash64("doc_id", "text").alias("row_key"), "text")
    places = rows.select("doc_order", "row_key", "text").mapInArrow(find_places(window, anchor), PLACES)
    # Tables of distinct keys are checkpointed before they meet the places, so that both sides of such a
    # join are plain exchanges and Spark splits the places of a frequent anchor over many tasks.
    found = places.groupBy("anchor").agg(F.min("doc_order").alias("_low"), F.max("doc_order").alias("_high"), (F.min("context") != F.max("context")).alias("several"))
    repeated = checkpoint(found.filter("_low < _high").select("anchor", "several"))
    seeds = checkpoint(places.join(repeated, "anchor"))
    classes = checkpoint(seeds.groupBy("anchor", "context").agg(F.min("doc_order").alias("first_doc")))
    later = F.col("doc_order") > F.col("first_doc")
    enough = F.col("left_words") + F.col("right_words") + anchor >= window
    seeds = checkpoint(seeds.join(classes, ["anchor", "context"]).filter((later & enough) | (~later & F.col("several"))).withColumn("later", later))
    whole = seeds.filter("later").select(
        "row_key", "doc_order", (F.col("place") - F.col("left_words")).alias("from"), (F.col("place") + anchor + F.col("right_words")).alias("to")
    )
    open_places = seeds.filter("NOT later").groupBy("row_key", "doc_order").agg(F.collect_set("place").alias("places"))
    windows = rows.join(open_places, ["row_key", "doc_order"]).select(*rows.columns, "places").mapInArrow(find_windows(window, anchor), RUNS)
    first = windows.groupBy("window_a", "window_b").agg(F.min("doc_order").alias("_low"), F.max("doc_order").alias("_high")).filter("_low < _high")
    parts = windows.join(first, ["window_a", "window_b"]).filter("doc_order > _low").select("row_key", "doc_order", F.col("first_word").alias("from"), (F.col("first_word") + window).alias("to"))
    runs = whole.unionByName(parts).groupBy("row_key", "doc_order").agg(F.collect_set(F.struct("from", "to")).alias("runs"))  # as many as the row has words at most
    return rows.join(runs, ["row_key", "doc_order"], "left").select("doc_id", "text", "runs").mapInArrow(remove_runs, RESULT)
