"""Periodic runs of words, by a vectorised scan of all lags.

A run is a stretch of words with smallest period q, at least as long as max(6, 4 * q), that no neighbour extends.  The
array of word ids is compared with itself shifted by every lag q up to n / 4, and the true stretches of the comparison
are measured: one of at least max(6, 4 * q) - q is a run.  A block of lags is compared together, first at every s-th
word only: each stretch of the length asked for holds at least eight of those places in a row, so only where eight in
a row agree is the comparison carried out word by word.  Nothing is lost by that, and a text of n words costs some
n * log n comparisons instead of n * n / 8.

Of equal stretches the smallest lag is the period.  Longer lags that are multiples of it meet the same stretch again;
inside a run found already they are passed over.

Texts are scanned where they are read.  A long one is laid out as rows of (document, lag range) with its word ids, which
Spark deals to all tasks, and its runs are put together again by document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import shuffle_width
from .textvec import text_of

MIN_LENGTH = 6
MIN_EXPONENT = 4
IN_A_ROW = 8
LARGE = 4096
LONG_CHARS = 4 << 20
LAG_RANGES = 8
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_PART = "uid long, doc_id long, part int, lo long, hi long, ids binary, text string"
_FOUND = "uid long, doc_id long, part int, runs binary, text string"


def words_of(text: str, doc_id: int | None, rewrite: bool = True) -> list[bytes]:
    """The words of a text in UTF-8; every tenth document by crc32 of its id ends in a period of its own making.

    Without a doc_id nothing is rewritten.
    """
    words = text.encode().split()
    n = len(words)
    if rewrite and n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words[a:] = (words[a : a + p] * ((n - a) // p + 1))[: n - a]
    return words


def ids_of(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, count()), np.int32, len(words))


def lag_blocks(n: int) -> list[tuple[int, int]]:
    """Lags 1 to n / MIN_EXPONENT in blocks [lo, hi) whose width grows with the lag."""
    most = n // MIN_EXPONENT if n >= MIN_LENGTH else 0
    out, lo = [], 1
    while lo <= most:
        hi = min(max(6, 2 * lo), most + 1)
        out.append((lo, hi))
        lo = hi
    return out


def _needed(lag: int) -> int:
    return max(MIN_LENGTH, MIN_EXPONENT * lag) - lag


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _rows_of_true(flags: np.ndarray, k: int) -> np.ndarray:
    """True where k true values follow each other, from there on, in each column."""
    out, have = flags, 1
    while have < k:
        step = min(have, k - have)
        out = out[:-step] & out[step:]
        have += step
    return out


def scan(ids: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """Rows of (start, length, lag) of the runs that lags of these blocks see, smallest lags of equal stretches only."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    large: list[tuple[int, int, int]] = []
    for lo, hi in blocks:
        least = _needed(lo)
        s = max(1, least // IN_A_ROW)
        k = least // s
        at = np.arange(0, n - lo, s)
        if len(at) < k:
            continue
        padded = np.concatenate((ids, np.full(hi - lo, -1, np.int32)))
        same = np.lib.stride_tricks.sliding_window_view(padded, hi - lo)[at + lo] == ids[at][:, None]
        hits = _rows_of_true(same, k).any(axis=0)
        for column in np.flatnonzero(hits).tolist():
            q = lo + column
            first, past = _stretches(np.ascontiguousarray(same[:, column]))
            long = past - first >= k
            for a, b in zip(first[long].tolist(), past[long].tolist(), strict=True):
                left, right = max(0, (a - 1) * s + 1), min(n - q, b * s)
                if right - left > LARGE and any(q % p == 0 and x <= a * s and (b - 1) * s + q < y for x, y, p in large):
                    continue  # a multiple of the period inside its run
                starts, ends = _stretches(ids[left:right] == ids[left + q : right + q])
                for x, y in zip((starts + left).tolist(), (ends + left).tolist(), strict=True):
                    if y - x >= _needed(q) and (x, y + q) not in found:
                        found[x, y + q] = q
                        if y - x > LARGE:
                            large.append((x, y + q, q))
    return np.array([(x, y - x, q) for (x, y), q in found.items()], np.int64).reshape(-1, 3)


def merged(runs: np.ndarray) -> np.ndarray:
    """Runs by start, then period; of equal stretches only the smallest lag."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def report(words: list[bytes], runs: np.ndarray) -> tuple:
    """The columns of RESULT after doc_id."""
    runs = merged(runs)
    lines = "".join([f"{x},{y},{q}\n" for x, y, q in runs.tolist()])
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    drop = np.cumsum(step[:-1]) > 0
    kept = words if not len(runs) else [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]
    best = [None] * 4
    if len(runs):
        x, y, q = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        best = [x, y, q, 1000 * y // q]
    return len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_L, _I, _B, _S = pa.int64(), pa.int32(), pa.binary(), pa.string()
_RESULT = pa.schema([("doc_id", _L), ("n_runs", _L), ("start", _L), ("length", _L), ("period", _L), ("exponent_milli", _L), ("runs_sha256", _S), ("collapsed_sha256", _S)])
_PARTS = pa.schema([("uid", _L), ("doc_id", _L), ("part", _I), ("lo", _L), ("hi", _L), ("ids", _B), ("text", _S)])
_RUNS = pa.schema([("uid", _L), ("doc_id", _L), ("part", _I), ("runs", _B), ("text", _S)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = True, long_chars: int = LONG_CHARS, lag_ranges: int = LAG_RANGES) -> DataFrame:
    """The columns of RESULT, one row per row of docs.

    n_runs counts the runs; the next four columns are those of the longest one (ties: smallest start, then period), null
    without runs.  runs_sha256 is over all runs, collapsed_sha256 over the words that stay when every run keeps its first
    period only.  A null or empty text has no words.  Rows stand on their own: repeated rows, null ids and further columns
    change nothing.  rewrite=False leaves every text as it is.  Texts over long_chars are scanned in lag_ranges rows.
    """

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_of(batch.column(1)), strict=True):
                words = words_of(text.as_py(), doc_id, rewrite)
                rows.append((doc_id, *report(words, scan(ids_of(words), lag_blocks(len(words))))))
            yield _table(rows, _RESULT)

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, uid, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py(), doc_id, rewrite)
                ids = ids_of(words).tobytes()
                edges = np.unique(np.geomspace(1, len(words) // MIN_EXPONENT + 1, lag_ranges + 1).astype(np.int64)).tolist()
                pairs = list(zip(edges, edges[1:], strict=False)) or [(1, 1)]
                for part, (lo, hi) in enumerate(pairs):
                    yield _table([(uid, doc_id, part, lo, hi, ids, None if part else text.as_py())], _PARTS)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int32)
                blocks = [(max(lo, row["lo"]), min(hi, row["hi"])) for lo, hi in lag_blocks(len(ids)) if lo < row["hi"] and hi > row["lo"]]
                yield _table([(row["uid"], row["doc_id"], row["part"], scan(ids, blocks).tobytes(), row["text"])], _RUNS)

    def together(group: pa.Table) -> pa.Table:
        runs = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group["runs"]]).reshape(-1, 3)
        text = next(x.as_py() for x in group["text"] if x.is_valid)
        doc_id = group["doc_id"][0].as_py()
        return pa.Table.from_batches([_table([(doc_id, *report(words_of(text, doc_id, rewrite), runs))], _RESULT)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    width = shuffle_width(docs.sparkSession)
    parts = rows.filter(is_long).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(laid_out, _PART)
    found = parts.repartition(width, "uid", "part").mapInArrow(ranges, _FOUND)
    return rows.filter(~is_long).mapInArrow(short, RESULT).unionByName(found.groupBy("uid").applyInArrow(together, RESULT))
