"""Exact deduplication by Grace hashing.

Texts are equal when their bytes are, after lower-casing A-Z.  Each map task first folds the copies
in a batch into one record (text, ids), so a group that holds a third of all rows crosses the
shuffle as one text a batch.  Spark's exchange is the first level of partitioning.  A reduce task
feeds an open-addressing table that compares complete content; when the table is over its memory
the records go to spill files by further hash bits, and each file is treated alike, down to the
depth that the hash allows.  The ids of a group are never held together: they go to a file as they
come and are read back once the group's survivor and size are known.

Null counts as the empty text.  Rows without an id are rows of their own and rank below every id.
Repeated rows are copies of one another.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import shuffle_width
from .textvec import text_of

NO_ID = -(2**63)
TABLE_BYTES = 96 << 20
FAN_OUT = 16
MAX_DEPTH = 8

FOLDED = "bucket long, digest binary, body binary, ids array<long>"
RESULT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"


def fold_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each distinct text of a batch, with the ids of its copies."""
    for batch in batches:
        groups: dict[bytes, list[int]] = {}
        texts = text_of(batch.column(1)).cast(pa.binary())
        for doc_id, body in zip(batch.column(0).to_pylist(), texts, strict=True):
            groups.setdefault(body.as_py().lower(), []).append(NO_ID if doc_id is None else doc_id)
        bodies = list(groups)
        digests = [hashlib.sha256(b).digest() for b in bodies]
        bucket = np.frombuffer(b"".join(d[:8] for d in digests), "<i8")
        for at in range(0, len(bodies), 1000):
            to = at + 1000
            yield pa.record_batch(
                [pa.array(bucket[at:to]), pa.array(digests[at:to], pa.binary()), pa.array(bodies[at:to], pa.binary()), pa.array([groups[b] for b in bodies[at:to]], pa.list_(pa.int64()))],
                names=["bucket", "digest", "body", "ids"],
            )


class OpenTable:
    """Linear probing over slots of record numbers; equality is that of the complete content."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hashes: list[int] = []
        self.bodies: list[bytes] = []
        self.digests: list[bytes] = []
        self.count: list[int] = []
        self.keep: list[int] = []
        self.row: list = []
        self.bytes = 0

    def _slot(self, h: int, body: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (i := self.slots[at]) >= 0 and not (self.hashes[i] == h and self.bodies[i] == body):
            at = (at + 1) & mask
        return at

    def add(self, h: int, digest: bytes, body: bytes, ids: list[int], row=None) -> int:
        at = self._slot(h, body)
        i = int(self.slots[at])
        if i < 0:
            i = self.slots[at] = len(self.bodies)
            self.hashes.append(h)
            self.bodies.append(body)
            self.digests.append(digest)
            self.count.append(0)
            self.keep.append(NO_ID)
            self.row.append(row)
            self.bytes += len(body) * (1 if row is None else 2) + 250
            if 2 * len(self.bodies) > len(self.slots):
                self._grow()
        self.count[i] += len(ids)
        if max(ids) > self.keep[i]:
            self.keep[i], self.row[i] = max(ids), row
        return int(i)

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        for i, h in enumerate(self.hashes):
            mask = len(self.slots) - 1
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _stored(file) -> Iterator:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def grace(records: Iterator[tuple], limit: int, depth: int = 0) -> Iterator[tuple[OpenTable, list[tuple[int, list[int]]]]]:
    """(table, some (group, ids)) over records (hash, digest, body, ids, row of the largest id or None).

    A table is complete when it is first given out.  A bucket too large for it is spilled and split.
    """
    table = OpenTable()
    with tempfile.TemporaryFile() as members:
        spilled = None
        for h, digest, body, ids, row in records:
            if spilled is None and table.bytes > limit and depth < MAX_DEPTH:
                spilled = [tempfile.TemporaryFile() for _ in range(FAN_OUT)]
            if spilled is not None:
                at = table._slot(h, body)
                if table.slots[at] < 0:  # texts that the table holds stay in it
                    pickle.dump((h, digest, body, ids, row), spilled[(h >> (60 - 4 * depth)) & (FAN_OUT - 1)])
                    continue
            pickle.dump((table.add(h, digest, body, ids, row), ids), members)
        for member in _stored(members):
            yield table, [member]
    del table
    for file in spilled or ():
        with file:
            yield from grace(_stored(file), limit, depth + 1)


def survivors(batches: Iterator[pa.RecordBatch], limit: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    def records():
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                yield row[0] & (2**63 - 1), *row[1:], None

    out: list[tuple] = []

    def flush():
        ids, keeps, sizes, kept, shas = zip(*out, strict=True)
        out.clear()
        none = lambda xs: pa.array([None if x == NO_ID else x for x in xs], pa.int64())
        return pa.record_batch([none(ids), none(keeps), pa.array(sizes, pa.int64()), pa.array(kept), pa.array(shas)], names=["doc_id", "keep_id", "group_size", "kept", "text_sha256"])

    taken: set[int] = set()
    last = None
    for table, members in grace(records(), limit):
        if table is not last:
            taken, last = set(), table
        for i, ids in members:
            keep, size, sha = table.keep[i], table.count[i], table.digests[i].hex()
            for x in ids:
                stays = x == keep and i not in taken
                if stays:
                    taken.add(i)
                out.append((x, keep, size, stays, sha))
        if len(out) >= 5000:
            yield flush()
    if out:
        yield flush()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; of repeated rows with that id, one.
    """
    width = shuffle_width(docs.sparkSession)
    folded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(fold_batch, FOLDED)
    return folded.repartition(width, "bucket").mapInArrow(survivors, RESULT)


def bucket_name(names: list[str]) -> str:
    """A name that no column has."""
    return "_" * (1 + max((len(n) for n in names), default=0)) + "bucket"


def first_rows(names: list[str], id_col: str, text_col: str):
    """Whole rows for survivors(): of the copies in a batch only the one with the largest id goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[bytes, tuple[int, int]] = {}
            ids = batch.column(names.index(id_col)).cast(pa.int64()).to_pylist()
            for i, body in enumerate(text_of(batch.column(names.index(text_col))).cast(pa.binary())):
                body, order = body.as_py().lower(), NO_ID if ids[i] is None else ids[i]
                if body not in best or order > best[body][0]:
                    best[body] = order, i
            bucket = np.frombuffer(b"".join(hashlib.sha256(b).digest()[:8] for b in best), "<i8")
            rows = batch.take(pa.array([i for _, i in best.values()], pa.int64()))
            yield pa.record_batch([pa.array(bucket), *rows.columns], names=[bucket_name(names), *names])

    return run


def surviving_rows(names: list[str], id_col: str, text_col: str, limit: int = TABLE_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def records():
            for batch in batches:
                kinds[:] = [c.type for c in batch.columns[1:]]
                for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    body = (row[names.index(text_col)] or "").encode().lower()
                    order = row[names.index(id_col)]
                    yield bucket & (2**63 - 1), b"", body, [NO_ID if order is None else order], row

        last = None
        for table, _ in grace(records(), limit):
            if table is not last:
                last = table
                for at in range(0, len(table.row), 1000):
                    columns = zip(*table.row[at : at + 1000], strict=True)
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest id.

    Of rows that tie on the largest id, or have none, one stays.
    """
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    first = docs.mapInArrow(first_rows(names, id_col, text_col), f"`{bucket_name(names)}` long, {fields}")
    return first.repartition(shuffle_width(docs.sparkSession), F.col(f"`{bucket_name(names)}`")).mapInArrow(surviving_rows(names, id_col, text_col), fields)
