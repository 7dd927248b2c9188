"""Byte-level BPE by reuse of content-defined chunks.

A rolling hash over the last bytes cuts a text where its low bits are zero, so equal passages are cut
alike wherever they stand.  The core of a chunk lies between its first and last safe boundary: a
place between a character that is not white space and one space before another such character, where
the vocabulary's word pattern always splits and no merge reaches across.  Cores are encoded once and
looked up by content afterwards.  A join, the text between two cores, is encoded anew; it starts and
ends at safe boundaries, so the ids on both sides agree with those of the whole text.  A chunk
without two safe boundaries, or with no core, is part of the join, which grows until it meets one.

What a core or join is made of is looked up word by word in the same way before the tokenizer sees
it.  The tables live in the Python worker, are bounded, and are shared by its tasks: sharing them
between executors would move every chunk and its ids through a shuffle, more than the texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import text_of

CHUNK_BITS = 9
MAX_WORDS = 300_000
MAX_CHUNK_BYTES = 16 << 20
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fixed value: the word pattern of byte-level vocabularies.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
_GAP = re.compile(r"\s\s")
_coders: dict[str, Coder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Coder:
    """Encoder and decoder with tables of the words and chunks that it has met."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        alphabet = _byte_alphabet()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.lengths = np.array([len(x) for x in self.pieces], np.int64)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(vocabulary)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.chunk_bytes = 0

    def _ranked(self, vocabulary: str):
        """The same merges for plain words, from a faster library; only where each merge's rank is its id's."""
        model = json.loads(Path(vocabulary).read_text())["model"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        by_id = sorted(model["vocab"].items(), key=lambda x: x[1])
        if model.get("ignore_merges") or [t for t, _ in by_id[256:]] != merges or any(len(self.pieces[i]) != 1 for _, i in by_id[:256]):
            return None
        import tiktoken

        return tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks={self.pieces[i]: i for _, i in by_id}, special_tokens={})

    def _tokenized(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode words that start with one space in a row; the ids' lengths tell where each word ends."""
        for at in range(0, len(new), 500):
            words = new[at : at + 500]
            ids = np.array(self._row(" " + " ".join(words)), "<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) + 1 for w in words])) + 1
            raw, lo = ids.tobytes(), 0
            for w, hi in zip(words, (4 * ends).tolist(), strict=True):
                self.words[w] = raw[lo:hi]
                lo = hi

    def _row(self, text: str) -> list[int]:
        if self.ranked is not None:
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of texts that start and end at safe boundaries, as little-endian 32-bit integers."""
        words = self.words
        if len(words) > MAX_WORDS:
            words.clear()
        plain = [p[1:].split(" ") if p[:1] == " " and p[-1] != " " and not _GAP.search(p) and not any(x in p for x in self.special) else None for p in parts]
        self._learn(list({w for ws in plain if ws is not None for w in ws if w not in words}))
        odd = [_BOUNDARY.split(p) for p, ws in zip(parts, plain, strict=True) if ws is None]
        others = dict.fromkeys(w for ws in odd for w in ws)
        others.update(zip(others, self._tokenized(list(others)), strict=True))
        rest = iter(odd)
        return [b"".join([words[w] for w in ws] if ws is not None else [others[w] for w in next(rest)]) for ws in plain]

    def encode_words(self, words: list[str], most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each after one space, in a row, and where each word's start; none of the words has a space."""
        flat, counts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for at in range(0, len(words), most):
            some = words[at : at + most]
            text = " " + " ".join(some)
            if _GAP.search(text) or any(x in text for x in self.special):
                raw = self.encode_parts([" " + w for w in some])
                flat.append(np.frombuffer(b"".join(raw), "<u4").astype(np.int64))
                counts.append(np.array([len(x) // 4 for x in raw]))
            else:
                flat.append(np.array(self._row(text), np.int64))
                sizes = np.fromiter((len(w.encode()) + 1 for w in some), np.int64, len(some))
                counts.append(np.diff(np.searchsorted(np.cumsum(self.lengths[flat[-1]]), np.cumsum(sizes)) + 1, prepend=0))
        return np.concatenate(flat), np.cumsum(np.concatenate(counts))

    def encode(self, texts: list[bytes], cuts: list[np.ndarray]) -> list[bytes]:
        """Ids of whole texts in UTF-8, each cut at the given places."""
        if self.chunk_bytes > MAX_CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        plans: list[list[tuple[bool, bytes]]] = []
        for body, at in zip(texts, cuts, strict=True):
            plan, held = [], b""
            edges = [0, *at.tolist(), len(body)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                chunk = body[lo:hi]
                core = _core(chunk)
                if core is None:
                    held += chunk
                    continue
                first, last = core
                held += chunk[:first]
                if held:
                    plan.append((False, held))
                plan.append((True, chunk[first:last]))
                held = chunk[last:]
            if held:
                plan.append((False, held))
            plans.append(plan)
        new = list({c for plan in plans for is_core, c in plan if is_core and c not in self.chunks})
        for c, ids in zip(new, self.encode_parts([c.decode() for c in new]), strict=True):
            self.chunks[c] = ids
            self.chunk_bytes += len(c) + len(ids) + 150
        joins = [j for plan in plans for is_core, j in plan if not is_core]
        repaired = iter(self.encode_parts([j.decode() for j in joins]))
        return [b"".join([self.chunks[c] if is_core else next(repaired) for is_core, c in plan]) for plan in plans]

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_FIRST = re.compile(rb"[!-~](?= [!-~])")


def _core(chunk: bytes) -> tuple[int, int] | None:
    """From the first to the last place between an ASCII letter or sign and a space before another."""
    first = _FIRST.search(chunk)
    if first is None:
        return None
    at = len(chunk)
    while (at := chunk.rfind(b" ", 0, at)) > first.end():
        if 32 < chunk[at - 1] < 127 and at + 1 < len(chunk) and 32 < chunk[at + 1] < 127:
            return first.end(), at
    return None


def cut_places(texts: list[bytes], bits: int = CHUNK_BITS) -> list[np.ndarray]:
    """Where a rolling hash of the last bytes has low bits of zero, moved off the middle of a character."""
    out = []
    for body in texts:
        data = np.frombuffer(body, np.uint8)
        if len(data) < 64:
            out.append(np.zeros(0, np.int64))
            continue
        wide = np.frombuffer(body[: len(body) // 8 * 8 + 8 if len(body) % 8 == 0 else len(body) - len(body) % 8], np.uint8).astype(np.uint32)
        h = wide[7:] + 0
        for back, factor in zip(range(1, 8), (31, 131, 1313, 13131, 131071, 524287, 6700417), strict=True):
            h += wide[7 - back : len(wide) - back] * np.uint32(factor)
        h = (h * np.uint32(2654435761)) >> np.uint32(32 - bits)
        at = np.flatnonzero(h == 0) + 8
        at = at[at < len(data)]
        out.append(at[(data[at] & 0xC0) != 0x80])
    return out


def coder(vocabulary: str) -> Coder:
    if vocabulary not in _coders:
        _coders[vocabulary] = Coder(vocabulary)
    return _coders[vocabulary]


def encode_texts(texts: list[bytes], vocabulary: str) -> list[bytes]:
    return coder(vocabulary).encode(texts, cut_places(texts))


def _batches(column: pa.Array, most: int = 1 << 20) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in column.cast(pa.binary()):
        held.append(x.as_py())
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text.

    A null text is the empty one and has no ids.  The vocabulary's special strings in a text take their
    own ids.  Every row is encoded on its own account, repeated rows and null doc_ids included.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _batches(text_of(batch.column(1))):
                ids = encode_texts(texts, vocabulary)
                yield pa.record_batch([batch.column(0).slice(at, len(ids)), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
                at += len(ids)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text of every row (doc_id, ids); null ids decode to the empty text."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [coder(vocabulary).decode(x.as_py() or b"") for x in part.column(1)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trips(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, and decoded again, in one pass.

    The same as encode_documents() and decode_documents() one after the other, with one Python worker for
    each task in place of two, and without the ids on the way between them.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _batches(text_of(batch.column(1))):
                ids = encode_texts(texts, vocabulary)
                decoded = [hashlib.sha256(coder(vocabulary).decode(x).encode()).hexdigest() for x in ids]
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded)]
                yield pa.record_batch([batch.column(0).slice(at, len(ids)), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(ids)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, ENCODED)
