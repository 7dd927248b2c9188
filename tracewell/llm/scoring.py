"""Scoring texts by a causal self-attention model over subword numbers, beside a unigram base.

Documents are dealt into groups by a hash, once, and each group is encoded once: its distinct words with
their subword ids and their training counts, and the row of its words.  What follows reads these, not the texts.
Groups send their words in buckets, by hash; sums over all groups go back to the groups that have the word, so no
task and no broadcast holds the corpus's words.  A group is then scored with its words' counts at hand: the base
from the counts, the model from the words' subword ids.

The model (attention.py) is trained before that in one pass over every training document: in each round every group
learns from its part of them, the weights are averaged piece by piece in tasks, and the next round begins with these.
Weights and subword counts have a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention, bpe
from .session import checkpoint, shuffle_width
from .textvec import Slice, signed, slices, text_of

PIECE = 1 << 14
LOT = 200_000  # tokens whose windows are mixed before they are learned from
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
GROUP_BYTES = 16 << 20  # of text in a group, about
BUCKET_BYTES = 128 << 20  # of text whose words are in a bucket, about
AT_ONCE = 1 << 19  # tokens of documents that are scored together
RATES = (1.5e-2, 1e-2, 5e-3, 2e-3)
LOG10 = math.log(10)
#: Documents in order: id, whether it is null, held out, key, number of words; the words' places in the list of words.
#: Words: hash, training count, ids with their starts.
BLOBS = {"doc_id": "<i8", "no_id": "?", "held_out": "?", "key": "<i8", "n_words": "<i8", "which": "<u4", "word": "<i8", "count": "<i8", "ids": "<u4", "start": "<u4"}
ENCODED = "grp int, " + ", ".join(f"{k} binary" for k in BLOBS)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by ten; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _words(s: Slice) -> np.ndarray:
    s.find_words()
    return signed(s.hash_words(lower=True))


def _blobs(**arrays: np.ndarray) -> dict[str, pa.Array]:
    """Each array's length in bytes, and the array compressed, its entries' first bytes before all second ones."""
    raw = {k: np.ascontiguousarray(x.astype(BLOBS[k])).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for k, x in arrays.items()}
    return {k: pa.array([len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)], pa.binary()) for k, x in raw.items()}


def _array(blob: bytes, kind: str) -> np.ndarray:
    raw = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _row(batch: pa.RecordBatch | pa.Table, at: int) -> dict[str, np.ndarray]:
    """The arrays of a group's row, as far as they are there."""
    names = batch.schema.names
    return {k: _array(batch.column(names.index(k))[at].as_py(), BLOBS[k]) for k in names if k in BLOBS}


def _encoded(table: pa.Table, vocabulary: str) -> dict[str, pa.Array]:
    """A group's documents (doc_id, held_out, key, text) as the columns of ENCODED."""
    hashes, n_words, starts, ends, bodies, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    for s in slices(text_of(table.column("text"))):
        hashes.append(_words(s))
        n_words.append(s.n_words)
        starts.append(s.start + size)
        ends.append(s.end + size)
        bodies.append(s.data.tobytes())
        size += len(bodies[-1])
    hashes, n_words, starts, ends = (np.concatenate(x) for x in (hashes, n_words, starts, ends))
    word, first, which, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")  # frequent words have small places, which take less room
    word, first = word[order], first[order]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    which = place[which]
    body = b"".join(bodies)
    spelled = [body[lo:hi].lower().decode() for lo, hi in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    ids, start = bpe.coder(vocabulary).encode_words(spelled)
    held = table.column("held_out").to_numpy().astype(bool)
    count = np.bincount(which[~np.repeat(held, n_words)], minlength=len(word))
    doc_id = table.column("doc_id").combine_chunks()
    return _blobs(
        doc_id=doc_id.fill_null(0).to_numpy(), no_id=doc_id.is_null().to_numpy(zero_copy_only=False), held_out=held, key=table.column("key").to_numpy(), n_words=n_words,
        which=which, word=word, count=count, ids=ids, start=start,
    )


def encode_groups(vocabulary: str):
    """Each run of rows of a group becomes one row of ENCODED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((int(batch.column(0)[lo].as_py()), batch.slice(lo, hi - lo)) for batch in batches for lo, hi in _runs(batch.column(0).to_numpy()))
        for grp, own in groupby(parts, key=lambda x: x[0]):
            columns = _encoded(pa.Table.from_batches([x for _, x in own]), vocabulary)
            yield pa.record_batch([pa.array([grp], pa.int32()), *(columns[k] for k in BLOBS)], names=["grp", *BLOBS])

    return run


def _numbers(row: dict[str, np.ndarray], number_of: np.ndarray, end: int, docs: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some documents of a group, each closed by the end, and where each starts."""
    n_words, which = row["n_words"], row["which"]
    if isinstance(docs, slice):
        edge = np.append(0, np.cumsum(n_words))
        lo, hi, _ = docs.indices(len(n_words))
        n_words, which = n_words[lo:hi], which[edge[lo] : edge[hi]]
    else:
        n_words, which = n_words[docs], which[np.repeat(docs, n_words)]
    flat, start = number_of[row["ids"]], row["start"].astype(np.int64)
    n = np.diff(start).take(which)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    first = np.zeros(len(n_words) + 1, np.int64)
    np.cumsum(np.bincount(doc, weights=n, minlength=len(n_words)).astype(np.int64) + 1, out=first[1:])
    out = np.full(first[-1], end, np.int64)
    before = np.cumsum(n) - n
    within = np.arange(n.sum())
    out[within + np.repeat(doc, n)] = flat.take(within + np.repeat(start.take(which) - before, n))
    return out, first


def _end_id(vocabulary: str) -> int:
    coder = bpe.coder(vocabulary)
    return coder.tokenizer.token_to_id(coder.special[0]) if coder.special else 0


def count_subwords(vocabulary: str):
    """(id, n): how often training documents have each id, their ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(bpe.coder(vocabulary).pieces)
        for batch in batches:
            count = np.zeros(size, np.int64)
            for row in (_row(batch, at) for at in range(batch.num_rows)):
                count[_end_id(vocabulary)] += (~row["held_out"]).sum()
                count += np.bincount(row["ids"], weights=np.repeat(row["count"], np.diff(row["start"].astype(np.int64))), minlength=size).astype(np.int64)
            some = np.flatnonzero(count)
            yield pa.record_batch([pa.array(some), pa.array(count[some])], names=["id", "n"])

    return run


class Model:
    """Weights, and the model's number of each subword id: by frequency, the escape's tail after the first."""

    def __init__(self, counts: dict[int, int], vocabulary: str) -> None:
        size = len(bpe.coder(vocabulary).pieces)
        end = _end_id(vocabulary)
        count = np.zeros(size)
        count[list(counts)] = list(counts.values())
        ranked = np.lexsort((np.arange(size), -count, np.arange(size) != end))  # the end first
        place = np.arange(size)
        self.number_of = np.empty(size, np.int64)
        self.number_of[ranked] = np.where(place < attention.ESCAPE, place, place - attention.ESCAPE + attention.TAIL)
        self.end = 0
        self.tail = max(0, size - attention.ESCAPE)
        table = np.zeros(attention.NUMBERS + self.tail)
        table[np.where(place < attention.ESCAPE, place, place + 1)] = count[ranked]
        self.weights = attention.flatten(attention.initial(table))
        self.seen = 0  # tokens learned from


def _lots(parts: Iterator[tuple[np.ndarray, np.ndarray]], tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents (numbers, first) in lots that end with the document that fills them, however they come in."""
    held, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for numbers, first in parts:
        held, sizes = np.concatenate([held, numbers]), np.concatenate([sizes, np.diff(first)])
        ends = np.append(0, np.cumsum(sizes))
        lo = 0
        while ends[-1] - ends[lo] >= tokens:
            hi = int(np.searchsorted(ends, ends[lo] + tokens))
            yield held[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
            lo = hi
        held, sizes = held[ends[lo] :], sizes[lo:]
    if len(sizes):
        yield held, np.append(0, np.cumsum(sizes))


def train_part(model: Model, k: int):
    """(piece, seen, high, low): what a group's documents of round k add to the weights, times their tokens, in whole 2**-24ths.

    A group's documents are learned from in the order of its row.
    """

    def change(row: dict[str, np.ndarray]) -> pa.RecordBatch:
        trainer = attention.Trainer(attention.unflatten(model.weights, model.tail), RATES[k], k)
        part = ~row["held_out"] & (row["key"] % len(RATES) == k)
        for numbers, first in _lots(iter([_numbers(row, model.number_of, model.end, part)]), LOT):
            trainer.learn(numbers, first)
        added = np.rint((attention.flatten(trainer.w) - model.weights).astype(np.float64) * UNIT).astype(np.int64) * trainer.seen
        pieces = [added[at : at + PIECE] for at in range(0, len(added), PIECE)]
        return _pieces({k: (trainer.seen, x >> UNIT_BITS, x & (UNIT - 1)) for k, x in enumerate(pieces)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield change(_row(batch, at))

    return run


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts, cuts[1:], strict=False)) if len(values) else []


def _pieces(sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), *(pa.array([x[k].tobytes() for x in sums.values()], pa.binary()) for k in (1, 2))]
    return pa.record_batch(columns, names=["piece", "seen", "high", "low"])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each piece, in whole numbers and so the same in any order; a task holds its pieces once, however many trainers there were."""
    sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for piece, n, *parts in zip(*(batch.column(c).to_pylist() for c in ("piece", "seen", "high", "low")), strict=True):
            high, low = (np.frombuffer(x, np.int64) for x in parts)
            old = sums.get(piece, (0, 0, 0))
            sums[piece] = old[0] + n, old[1] + high, old[2] + low
    if sums:
        yield _pieces(sums)


def fit(groups: DataFrame, vocabulary: str) -> Model:
    """Train on the training documents of groups (ENCODED): each is learned from once, in the round of its key.

    Groups and the order of their documents follow from the rows alone, and sums are of whole numbers, so that lost tasks and
    other partitions give the same weights.
    """
    counts = groups.select("held_out", "count", "ids", "start").mapInArrow(count_subwords(vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    model = Model({r["id"]: r["n"] for r in counts.collect()}, vocabulary)  # as many rows as the vocabulary has ids
    pieces, width = "piece int, seen long, high binary, low binary", min(8, shuffle_width(groups.sparkSession))
    learned = groups.select("held_out", "key", "n_words", "which", "ids", "start")
    for k in range(len(RATES)):
        sums = learned.mapInArrow(train_part(model, k), pieces).repartition(width, "piece").mapInArrow(add_up, pieces)
        got = sorted((r["piece"], r["seen"], bytes(r["high"]), bytes(r["low"])) for r in sums.collect())  # the size of the weights
        if got and got[0][1]:
            high, low = (np.concatenate([np.frombuffer(x[at], np.int64) for x in got]).astype(np.float64) for at in (2, 3))
            model.weights = (model.weights + (high + low / UNIT) / got[0][1]).astype(np.float32)
            model.seen += got[0][1]
    return model


def _buckets(word: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' order by bucket, and where each bucket's begin."""
    bucket = word.view(np.uint64) % np.uint64(buckets)
    return np.argsort(bucket, kind="stable"), np.append(0, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets)))


def deal_words(buckets: int):
    """(bucket, grp, word, count): each group's words with their counts, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = _row(batch, at)
                order, edge = _buckets(row["word"], buckets)
                word, count = row["word"][order], row["count"][order].astype("<i4")  # in a group of bounded size
                some = np.flatnonzero(np.diff(edge)).tolist()
                blobs = ([x[edge[b] : edge[b + 1]].tobytes() for b in some] for x in (word, count))
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([batch.column(0)[at].as_py()] * len(some), pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "grp", "word", "count"])

    return run


def add_counts(table: pa.Table) -> pa.Table:
    """A bucket's words summed over all groups: (grp, bucket, total) for each group, and the bucket's tokens and types in the first row."""
    word = [np.frombuffer(x, np.int64) for x in table.column("word").to_pylist()]
    count = np.concatenate([np.frombuffer(x, "<i4") for x in table.column("count").to_pylist()])
    _, which = np.unique(np.concatenate(word), return_inverse=True)
    total = np.bincount(which, weights=count).astype(np.int64)  # exact below 2**53
    ends = np.cumsum([len(x) for x in word])
    totals = [x.tobytes() for x in np.split(total[which], ends[:-1])]
    once = [np.zeros(len(word), np.int64) for _ in range(2)]
    once[0][0], once[1][0] = total.sum(), (total > 0).sum()
    return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "total": pa.array(totals, pa.binary()), "tokens": once[0], "types": once[1]})


def score_group(shared, buckets: int, tokens: int, types: int, ends: int):
    def run(group: pa.Table, totals: pa.Table) -> pa.Table:
        model: Model = shared.value
        weights = attention.unflatten(model.weights, model.tail)
        scale = math.log10(tokens + 0.1 * (types + 1))
        row = _row(group, 0)
        order, edge = _buckets(row["word"], buckets)
        total = np.zeros(len(row["word"]), np.int64)
        for b, x in zip(totals.column("bucket").to_pylist(), totals.column("total").to_pylist(), strict=True):
            total[order[edge[b] : edge[b + 1]]] = np.frombuffer(x, np.int64)
        n_words, which = row["n_words"], row["which"]
        doc = np.repeat(np.arange(len(n_words)), n_words)
        logs = [np.zeros(0)]
        size = np.cumsum(np.bincount(doc, weights=np.diff(row["start"].astype(np.int64)).take(which), minlength=len(n_words)) + 1)
        cuts = np.unique(np.append(np.searchsorted(size, np.arange(0, size[-1], AT_ONCE)), len(size)))
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            logs.append(attention.log_probabilities(weights, *_numbers(row, model.number_of, model.end, slice(lo, hi))))
        base = np.bincount(doc, weights=(np.log10(total + 0.1) - scale).take(which), minlength=len(n_words)) + math.log10(ends + 0.1) - scale
        known = np.bincount(doc, weights=(total > 0).take(which), minlength=len(n_words)).astype(np.int64) + (ends > 0)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_id"], mask=row["no_id"]), "held_out": row["held_out"], "n_tokens": n_words + 1, "n_known": known,
                "train_tokens": np.full(len(n_words), tokens), "base_score": base, "score": np.round(np.concatenate(logs) / LOG10, 4),
            }
        )

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the model's probability) of every row.

    A null text is the empty one, whose only token is the end.  Null ids are training rows.  Repeated rows
    are scored, and counted, each.  An empty table gives no rows.  Scores are rounded to 4 places, beyond which they hang on
    how texts were batched.
    """
    vocabulary = vocabulary or bpe.default_vocabulary()
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text.alias("text"))
    ends, size = rows.agg(F.count_if(~F.col("held_out")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_groups, buckets = 1 + size // GROUP_BYTES, 1 + size // BUCKET_BYTES
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    dealt = rows.withColumn("key", key).withColumn("grp", F.pmod(F.floor(F.col("key") / len(RATES)), F.lit(n_groups)).cast("int"))
    dealt = dealt.repartitionById(n_groups, "grp").sortWithinPartitions("grp", "key", "text", "doc_id")
    groups = checkpoint(dealt.select("grp", "doc_id", "held_out", "key", "text").mapInArrow(encode_groups(vocabulary), ENCODED))
    model = fit(groups, vocabulary)
    words = groups.select("grp", "word", "count").mapInArrow(deal_words(buckets), "bucket int, grp int, word binary, count binary")
    totals = checkpoint(words.groupBy("bucket").applyInArrow(add_counts, "grp int, bucket int, total binary, tokens long, types long"))
    tokens, types = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(model)  # weights and one number for each vocabulary id: fixed size
    score = score_group(shared, buckets, tokens + ends, types + (ends > 0), ends)
    return groups.drop("key", "count").groupBy("grp").cogroup(totals.select("grp", "bucket", "total").groupBy("grp")).applyInArrow(score, RESULT)
