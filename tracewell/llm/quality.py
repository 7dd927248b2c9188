"""Quality rules from suffix arrays over the words of each document.

The suffixes of all documents of a slice are sorted together by prefix doubling, with the document
in the first key, so one suffix array holds one run for each document.  A boundary that appears
when prefixes of length k become prefixes of 2k fixes the longest common prefix there at once.  At
each suffix the larger of its two neighbouring values is the longest string that starts there and
occurs again in its document; the union of those strings' spans is that of all maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import U64, Slice, mix, run_hash, slices, text_of

MIN_REPEAT = 10
MAX_COVERED = 0.3
MAX_LONGEST = 100
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_IN_WORD[0x80:0xC0] = False

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")
RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS)


def longest_repeats(words: np.ndarray, doc: np.ndarray, doc_end: np.ndarray) -> np.ndarray:
    """For each word the length of the longest run from it that starts elsewhere in its document too."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(words ^ mix(doc.astype(U64) + U64(1)), kind="stable")
    keys = (words ^ mix(doc.astype(U64) + U64(1)))[order]
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    lcp = np.zeros(n + 1, np.int64)
    size = np.diff(np.append(np.flatnonzero(new), n))
    alive = order[np.repeat(size, size) > 1]
    levels, k = [rank.copy()], 1
    end = doc_end[doc]

    def rank_at(level: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        inside = at < end[of]
        return np.where(inside, level[np.minimum(at, n - 1)], -1)

    while len(alive):
        base, ahead = rank[alive], rank_at(rank, alive + k, alive) + 1
        by = np.lexsort((ahead, base)) if n >= 1 << 31 else np.argsort(base << 32 | ahead, kind="stable")
        alive, base, ahead = alive[by], base[by], ahead[by]
        m = len(alive)
        old = np.ones(m, bool)
        old[1:] = base[1:] != base[:-1]
        new = old.copy()
        new[1:] |= ahead[1:] != ahead[:-1]
        at = np.arange(m)
        old_at, new_at = np.maximum.accumulate(np.where(old, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        fresh = np.flatnonzero(new & ~old)
        a, b = alive[fresh - 1], alive[fresh]
        common = np.full(len(fresh), k, np.int64)
        for j in range(len(levels) - 1, -1, -1):
            x, y = rank_at(levels[j], a + common, a), rank_at(levels[j], b + common, b)
            common += np.where((x == y) & (x >= 0), 1 << j, 0)
        rank[alive] = base + (new_at - old_at)
        lcp[rank[b]] = common
        size = np.diff(np.append(np.flatnonzero(new), m))
        alive = alive[np.repeat(size, size) > 1]
        levels.append(rank.copy())
        k *= 2
    return np.maximum(lcp[rank], lcp[rank + 1])


def _per_row(s: Slice, flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[s.offsets])


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


def measure(s: Slice) -> list[np.ndarray]:
    """The columns COLUMNS of each row of a slice."""
    s.find_words()
    prefix = s.byte_prefix()
    n = len(s.start)
    repeat = longest_repeats(run_hash(prefix, s.start, s.end), s.doc, s.first[1:])
    by_doc = lambda flags: np.bincount(s.doc[flags], minlength=s.rows)
    triple = np.flatnonzero(repeat >= 3)
    repeated = _covered(triple, np.full(len(triple), 3), n)
    long = np.flatnonzero(repeat >= MIN_REPEAT)
    covered = _covered(long, repeat[long], n)
    longest = np.zeros(s.rows, np.int64)
    np.maximum.at(longest, s.doc, repeat)

    breaks = np.union1d(np.flatnonzero(s.data == 10), [])
    line_from = np.union1d(s.offsets[:-1][np.diff(s.offsets) > 0], breaks + 1).astype(np.int64)
    line_from = line_from[line_from < len(s.data)]
    row = np.searchsorted(s.offsets, line_from, side="right") - 1
    stop = np.append(line_from[1:], len(s.data))
    stop = np.minimum(stop, s.offsets[row + 1])
    stop -= s.data[np.maximum(stop - 1, 0)] == 10
    has_word = np.searchsorted(s.start, stop) > np.searchsorted(s.start, line_from)
    line_from, stop, row = line_from[has_word], stop[has_word], row[has_word]
    keys = run_hash(prefix, line_from, stop) ^ mix(row.astype(U64) + U64(1))
    _, first = np.unique(keys, return_index=True)
    again = np.bincount(row, minlength=s.rows) - np.bincount(row[first], minlength=s.rows)
    return [s.n_words, _per_row(s, _IN_WORD[s.data]), _per_row(s, _IS_SYMBOL[s.data]), again, by_doc(repeated), by_doc(covered), longest]


def measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(text_of(batch.column(1))):
            yield pa.record_batch([batch.column(0).slice(s.lo, s.rows), *(pa.array(x.astype(np.int64)) for x in measure(s))], names=["doc_id", *COLUMNS])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, the measures, base_failed and kept, one row per input row.

    Null text counts as empty; texts of fewer than 50 words fail the base rule.  A text that passes it
    is kept if at most max_covered of its words lie in repeats of ten words or more, and no repeat is
    longer than max_longest words.  Rows are judged alone: repeated rows, null ids and further columns
    change nothing.
    """
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(measure_batches, RESULT)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    passes = (F.col("n_covered_words") <= F.col("n_words") * F.lit(max_covered)) & (F.col("longest_repeat") <= max_longest)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & passes)
