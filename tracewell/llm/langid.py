"""Language identification by the nearest of several centroids for each language.

A text is a vector of hashed byte pairs and triples of its lower-cased letters, weighted by
log-tf times idf and scaled to length one.  Each language has a few centroids, found by spherical
k-means over labelled texts; a prediction is the language of the centroid with the largest cosine.
A text is rejected if it is farther from every centroid than all but FALSE_REJECTIONS of the labelled texts
of its length are that the centroids were not fitted on; these are also cut to lengths that few texts have.

The classifier is fitted on a bounded sample: at most about `rows` labelled texts of each language, drawn
by a hash of the id.  Everything else reads every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textvec import slices, text_of

ROWS_PER_LANGUAGE = 400
CENTROIDS = 3
FALSE_REJECTIONS = 0.01
OUTSIDE = 5  # one labelled text in so many is outside the fit
EDGES = np.array([8, 32, 128, 512])
DIMENSIONS = 4096
BITS = 12
SLICE = 1 << 18
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
RESULT = "doc_id long, lang_pred string, score double, rejected boolean"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-tf of the hashed pairs and triples of each row, and the number of them."""
    rows = len(offsets) - 1
    out = np.zeros((rows, DIMENSIONS), np.float32)
    n = np.diff(offsets)
    if len(data):
        folded = _FOLD[data]
        inside = folded != 32
        row = np.repeat(np.arange(rows, dtype=np.int64), n)
        count = np.zeros(rows * DIMENSIONS, np.int64)
        for k, factor in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
            if len(data) < k:
                continue
            h = folded[: 1 - k] * np.uint32(1)
            use = (row[: 1 - k] == row[k - 1 :]) & (inside[: 1 - k] | inside[k - 1 :])
            for step in range(1, k):
                h = h * np.uint32(257) + folded[step : len(folded) - k + 1 + step]
            h = (h * np.uint32(factor)) >> np.uint32(32 - BITS)
            count += np.bincount(row[: 1 - k][use] * DIMENSIONS + h[use], minlength=rows * DIMENSIONS)
        n = np.bincount(row[inside], minlength=rows)
        out = np.log1p(count.reshape(rows, DIMENSIONS).astype(np.float32))
    return out, n


@dataclass
class Classifier:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    edges: np.ndarray
    floor: np.ndarray

    def cosines(self, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return (x @ self.centroids.T) / np.maximum(norm, 1e-12)[:, None]

    def predict(self, tf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, scores from 0 to 1, and whether each text is too far from all centroids."""
        if not self.languages:
            return np.zeros(len(tf), np.int64), np.zeros(len(tf)), np.ones(len(tf), bool)
        cos = self.cosines(tf)
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(cos)), best], 0, 1)
        return self.owner[best], score, score < self.floor[np.searchsorted(self.edges, n, side="right")]


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _pieces(texts: list[str], rng: np.random.Generator) -> list[str]:
    """The texts, and a run of whole words of each for every length between EDGES that it exceeds."""
    out = list(texts)
    for text in texts:
        words = text.split()
        size = np.array([len(x.encode()) for x in words], np.int64)
        for lo, hi in zip([1, *EDGES[:-1].tolist()], EDGES.tolist(), strict=True):
            if size.sum() > hi:
                first, want = int(rng.integers(len(words))), int(rng.integers(lo, hi))
                n = max(1, int(np.searchsorted(np.cumsum(size[first:]), want, side="right")))
                out.append(" ".join(words[first : first + n]))
    return out


def floors(model: Classifier, texts: list[str], rng: np.random.Generator, rate: float = FALSE_REJECTIONS) -> np.ndarray:
    """For each length the cosine that a new text like these stays below with the rate at most.

    A length with too few texts for the rate takes in the next longer one's, the longest those before it.  If all
    are too few, the floor is 0.4 of the lowest, or 0 below 20 texts.
    """
    parts = [vectors(s.data, s.offsets) for s in slices(pa.array(_pieces(texts, rng), pa.string()), SLICE)]
    n = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int64)
    best = np.concatenate([model.cosines(tf).max(axis=1) for tf, _ in parts]) if parts else np.zeros(0)
    level = np.where(n > 0, np.searchsorted(EDGES, n, side="right"), -1)
    out, bands = np.zeros(len(EDGES) + 1), len(EDGES) + 1
    for b in range(bands):
        lo, hi = b, b + 1
        while (np.count_nonzero((level >= lo) & (level < hi)) + 1) * rate < 1 and hi - lo < bands:
            lo, hi = (lo, hi + 1) if hi < bands else (lo - 1, hi)
        of = np.sort(best[(level >= lo) & (level < hi)])
        k = int((len(of) + 1) * rate)
        out[b] = of[k - 1] if k else 0.4 * of[0] if len(of) >= 20 else 0.0
    return out


def fit(texts: list[str], labels: list[str], per_language: int = CENTROIDS, seed: int = 5) -> Classifier:
    """Spherical k-means within each language; floors are set on one text in OUTSIDE of each, which is not fitted on.

    Where no language has that many texts there is none, and all are used for both.
    """
    languages = sorted(set(labels))
    aside = np.zeros(len(texts), bool)
    for lang in languages:
        aside[np.flatnonzero(np.array(labels) == lang)[OUTSIDE - 1 :: OUTSIDE]] = True
    outside = [t for t, out in zip(texts, aside, strict=True) if out] or texts
    texts, labels = ([x for x, out in zip(xs, aside, strict=True) if not out] for xs in (texts, labels))
    parts = [vectors(s.data, s.offsets) for s in slices(pa.array(texts, pa.string()), SLICE)]
    n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    if not n.any():  # no labelled text has a letter: no language is known
        empty = np.zeros(0, np.int64)
        return Classifier([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), empty, empty, np.zeros(1))
    tf = np.concatenate([p[0] for p in parts])
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = _normal(tf * idf)
    own = np.array([languages.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    found, owner = [], []
    for k in range(len(languages)):
        of = x[(own == k) & (n > 0)]
        if not len(of):
            continue
        centre = of[rng.permutation(len(of))[:per_language]]
        for _ in range(8):
            near = (of @ centre.T).argmax(axis=1)
            centre = _normal(np.array([of[near == c].mean(axis=0) if (near == c).any() else centre[c] for c in range(len(centre))]))
        found.append(centre)
        owner += [k] * len(centre)
    model = Classifier(languages, idf, np.concatenate(found), np.array(owner), EDGES, np.zeros(len(EDGES) + 1))
    model.floor = floors(model, outside, rng)
    return model


def training_rows(docs: DataFrame, held_out: Column, id_col: str, text_col: str, lang_col: str, rows: int) -> tuple[list[str], list[str]]:
    """About `rows` labelled texts of each language at most, chosen by a hash of the id."""
    usable = docs.filter(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = dict(usable.groupBy(lang_col).count().collect())  # one row for each language
    place = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col(lang_col) == lang) & (place < int(min(1.0, rows / n) * (1 << 30))))
    got = sorted((tuple(r) for r in usable.filter(chosen).select(id_col, lang_col, text_col).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) if counts else []
    return [r[2] for r in got], [r[1] for r in got]


def predict_documents(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row.

    Null texts and texts without a letter are `und` with score 0 and are rejected.  Other texts get a learned
    language whether rejected or not.  Null and repeated ids change nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few megabytes, whatever the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            column = text_of(batch.column(1))
            for s in slices(column, SLICE):
                lang, score, rejected = m.predict(*vectors(s.data, s.offsets))
                blank = np.array([not has_letter(x.as_py()) for x in column.slice(s.lo, s.rows)], bool)
                lang = np.where(blank | (not m.languages), len(m.languages), lang)
                yield pa.record_batch([batch.column(0).slice(s.lo, s.rows), pa.array(names[lang].tolist(), pa.string()), pa.array(np.where(blank, 0.0, score).astype(np.float64)), pa.array(rejected | blank)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, RESULT)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the labelled rows that are not held out and predict every row: adds held_out."""
    model = fit(*training_rows(docs, held_out(id_col), id_col, text_col, lang_col, rows * OUTSIDE // (OUTSIDE - 1)))
    return predict_documents(docs, model, id_col, text_col).withColumn("held_out", held_out("doc_id"))


def keep_identified(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the classifier does not reject, with all their columns.

    It is fitted on labelled rows of the table itself, held-out ones excluded.
    """
    model = fit(*training_rows(docs, held_out(id_col), id_col, text_col, lang_col, rows * OUTSIDE // (OUTSIDE - 1)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few megabytes, whatever the rows
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_of(batch.column(at))
            for s in slices(column, SLICE):
                _, _, rejected = shared.value.predict(*vectors(s.data, s.offsets))
                letters = np.array([has_letter(x.as_py()) for x in column.slice(s.lo, s.rows)], bool)
                yield batch.slice(s.lo, s.rows).filter(pa.array(letters & ~rejected))

    return docs.mapInArrow(run, docs.schema)
