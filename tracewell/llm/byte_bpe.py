"""Byte-level BPE by ranks, with overlapping chunks.

A text is cut into chunks that overlap.  Each chunk is split into pre-tokens by itself, as if it were a text of its own,
and its pre-tokens are encoded.  Where a chunk begins in the middle of something its first boundaries may be wrong, and
at its end its last ones may be; but the splitting looks ahead only, so from the first boundary that two neighbours
have in common, both go on alike.  There the chunks are stitched: the earlier one's ids up to it, the later one's after
it.  Neighbours without a common boundary (a pre-token longer than the overlap) are split again from the last sound
boundary before them.

Which characters are letters, numbers and white space is asked of the ranks' library itself, since versions of Unicode
differ.  Texts are chunked where they are read; the chunks of a long one go to all tasks and meet again by document.
Decoding puts the bytes of the ids' tokens in a row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import shuffle_width
from .textvec import text_of

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256
LONG_CHARS = 4 << 20
LONG_CHUNK_CHARS = 1 << 20
#: So many characters before the end of a chunk the boundaries are sound: a contraction looks two ahead.
LOOK_AHEAD = 4
MAX_WORDS = 400_000
#: Fixed value: the pattern that splits texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENCODED = "doc_id long, ids binary"
ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_coders: dict[str, RankCoder] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@dataclass
class Chunk:
    """A stretch of a text from character `at` on: where its pre-tokens end in the text, and the ids of each."""

    at: int
    text: str
    ends: np.ndarray
    ids: list[bytes]


def starts_of(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of PATTERN begin, as flags over the characters.

    Runs of one kind are pre-tokens; a space before a run goes with it, other white space does not, and white space
    before those stands by itself.  A contraction is one where its apostrophe begins a pre-token.
    """
    n = len(codes)
    start = np.ones(n, bool)
    if not n:
        return start
    space = kinds == _SPACE
    start[1:] = kinds[1:] != kinds[:-1]
    start[1:] &= space[1:] | (codes[:-1] != 32)
    start[:-1] |= space[:-1] & ~space[1:]
    mark = np.flatnonzero((codes == 39) & start)
    for letters in ("s", "t", "m", "d", "re", "ve", "ll"):
        hit = mark[mark + len(letters) < n]
        for k, x in enumerate(letters, 1):
            hit = hit[codes[hit + k] == ord(x)]
        start[hit + 1] = False
        after = hit + len(letters) + 1
        start[after[after < n]] = True
    return start


class RankCoder:
    """Encoder and decoder with a bounded table of the pre-tokens that it has met."""

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.kinds = np.zeros(0x110000, np.uint8)
        single = {bytes([i]): i for i in range(256)}
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, of in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            found = tiktoken.Encoding("kind", pat_str=of, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
            self.kinds[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
        self.words: dict[str, bytes] = {}

    def ends(self, text: str) -> np.ndarray:
        """Where the pre-tokens of a text end."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.append(np.flatnonzero(starts_of(codes, self.kinds[codes]))[1:], len(codes)) if len(codes) else np.zeros(0, np.int64)

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit integers."""
        table = self.words
        if len(table) > MAX_WORDS:
            table.clear()
        for word in set(words).difference(table):
            table[word] = np.array(self.encoding.encode_ordinary(word), "<u4").tobytes()
        return [table[w] for w in words]

    def chunk(self, text: str, at: int = 0) -> Chunk:
        ends = self.ends(text)
        edges = [0, *ends.tolist()]
        return Chunk(at, text, ends + at, self.ids([text[a:b] for a, b in zip(edges, edges[1:], strict=False)]))

    def encode(self, text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> bytes:
        return self.stitch([self.chunk(text[a:b], a) for a, b in places(len(text), size, overlap)])

    def stitch(self, chunks: list[Chunk]) -> bytes:
        """The ids of a whole text from its chunks in order, each overlapping the next one."""
        out: list[bytes] = []
        held, since = chunks[0], 0
        waiting: list[Chunk] = []
        for k, following in enumerate(chunks[1:], 2):
            sound = held.ends[: np.searchsorted(held.ends, held.at + len(held.text) - LOOK_AHEAD, side="right")]
            theirs = following.ends if k == len(chunks) else following.ends[following.ends <= following.at + len(following.text) - LOOK_AHEAD]
            common = np.intersect1d(sound[np.searchsorted(sound, following.at) :], theirs, assume_unique=True) if not waiting else theirs[:0]
            common = common[common >= (held.ends[since - 1] if since else held.at)]
            if len(common):
                stop = int(np.searchsorted(held.ends, common[0])) + 1
                out += held.ids[since:stop]
                held, since = following, int(np.searchsorted(following.ends, common[0])) + 1
                continue
            waiting.append(following)
            if len(theirs) or k == len(chunks):
                stop = max(len(sound), since)
                out += held.ids[since:stop]
                begin = int(held.ends[stop - 1]) if stop else held.at
                text, reach = held.text[begin - held.at :], held.at + len(held.text)
                for x in waiting:
                    text += x.text[max(0, reach - x.at) :]
                    reach = max(reach, x.at + len(x.text))
                held, since, waiting = self.chunk(text, begin), 0, []
        return b"".join(out + held.ids[since:])

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def places(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of a text of n characters: each begins size after the one before and reaches overlap into the next."""
    return [(a, min(n, a + size + overlap)) for a in range(0, max(1, n - overlap), size)]


def coder(path: str) -> RankCoder:
    if path not in _coders:
        _coders[path] = RankCoder(path)
    return _coders[path]


_CHUNK = "uid long, doc_id long, k int, at long, text string"
_DONE = _CHUNK + ", ends binary, sizes binary, ids binary"


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, long_chars: int, chunk_chars: int, finish, result: str, fields: pa.Schema) -> DataFrame:
    """Encode every text and make a row of doc_id and its ids by finish(); long texts chunk by chunk on all tasks."""

    def row_of(doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        columns = list(zip(*[(d, *finish(coder(path), x)) for d, x in zip(doc_ids, ids, strict=True)], strict=True)) or [[]] * len(fields)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield row_of(part.column(0).to_pylist(), [coder(path).encode(x.as_py()) for x in text_of(part.column(1))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, value, uid in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = value.as_py()
                for k, (a, b) in enumerate(places(len(text), chunk_chars, OVERLAP_CHARS)):
                    yield pa.record_batch([pa.array([uid.as_py()], pa.int64()), pa.array([doc_id.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([a], pa.int64()), pa.array([text[a:b]])], names=["uid", "doc_id", "k", "at", "text"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(batch.num_rows):
                row = batch.slice(lo, 1)
                done = coder(path).chunk(row.column(4)[0].as_py(), row.column(3)[0].as_py())
                made = [done.ends.astype("<i8").tobytes(), np.array([len(x) for x in done.ids], "<i4").tobytes(), b"".join(done.ids)]
                yield pa.record_batch([*row.columns, *(pa.array([x], pa.binary()) for x in made)], names=["uid", "doc_id", "k", "at", "text", "ends", "sizes", "ids"])

    def together(group: pa.Table) -> pa.Table:
        chunks = []
        for row in sorted(group.select(["k", "at", "text", "ends", "sizes", "ids"]).to_pylist(), key=lambda x: x["k"]):
            edges = [0, *np.cumsum(np.frombuffer(row["sizes"], "<i4"), dtype=np.int64).tolist()]
            ids = [row["ids"][a:b] for a, b in zip(edges, edges[1:], strict=False)]
            chunks.append(Chunk(row["at"], row["text"], np.frombuffer(row["ends"], "<i8"), ids))
        return pa.Table.from_batches([row_of([group["doc_id"][0].as_py()], [coder(path).stitch(chunks)])])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    width = shuffle_width(docs.sparkSession)
    chunks = rows.filter(is_long).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(cut, _CHUNK).repartition(width, "uid", "k")
    return rows.filter(~is_long).mapInArrow(short, result).unionByName(chunks.mapInArrow(split, _DONE).groupBy("uid").applyInArrow(together, result))


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS, chunk_chars: int = LONG_CHUNK_CHARS) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text, by the ranks in the file at path.

    A null text is the empty one and has no ids.  Strings of special tokens are ordinary text.  Every row is encoded on
    its own account, repeated rows and null doc_ids included; further columns are left out.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    return _encoded(docs, path or default_ranks(), id_col, text_col, long_chars, chunk_chars, lambda _, ids: (ids,), ENCODED, fields)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and bytes of every row (doc_id, ids); null ids decode to no bytes."""
    path = path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                made = pa.array([coder(path).decode(x.as_py() or b"") for x in part.column(1)], pa.binary())
                yield pa.record_batch([part.column(0), part.column(1), made], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def round_trips(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS, chunk_chars: int = LONG_CHUNK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encode_documents() and decode_documents() in one pass."""

    def digests(c: RankCoder, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _encoded(docs, path or default_ranks(), id_col, text_col, long_chars, chunk_chars, digests, ROUND_TRIP, fields)
