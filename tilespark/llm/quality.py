"""Quality scores by nearest-neighbour voting in a latent semantic space.

A text's terms are its byte-class pairs (case, digits, punctuation and frequent letters kept apart), its word lengths and
a few whole-text measures (repetition, word variety, share of capitals, marks and bars) as binned terms; nothing else of a
row is looked at. The space is a truncated SVD of the TF-IDF rows of labelled texts. The labelled vectors are broadcast
(their number is a documented parameter, so the broadcast has a fixed bound) and every document's exact cosine to all of
them is computed in blocks; the ``neighbours`` closest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Byte classes: 0 blank, 1 line end, 2-27 letters a-z, 28 capitals, 29 digits, 30 full stop and comma, 31 bars, 32 marks that end or ask, 33 other ASCII marks, 34 bytes beyond ASCII.
_CLASSES = 35
_CLASS = np.full(256, 33, np.int16)
_CLASS[[32, 9]] = 0
_CLASS[[10, 13, 11, 12]] = 1
_CLASS[97:123] = np.arange(2, 28)
_CLASS[65:91] = 28
_CLASS[48:58] = 29
_CLASS[[44, 46]] = 30
_CLASS[124] = 31
_CLASS[[33, 63]] = 32
_CLASS[128:] = 34
_LENGTHS, _MEASURES, _BINS = 24, 9, 12
N_TERMS = _CLASSES * _CLASSES + _LENGTHS + _MEASURES * _BINS
_CHUNK = 1 << 22


def terms(text: str | None) -> np.ndarray:
    """Sublinear term frequencies of a whole text; an empty text has its measures only."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(N_TERMS, np.float32)
    pairs, singles = np.zeros(_CLASSES * _CLASSES, np.int64), np.zeros(_CLASSES, np.int64)
    for at in range(0, len(data), _CHUNK):
        c = _CLASS[data[max(0, at - 1) : at + _CHUNK]]
        pairs += np.bincount(c[:-1] * np.int16(_CLASSES) + c[1:], minlength=len(pairs))
        singles += np.bincount(c[1 if at else 0 :], minlength=_CLASSES)
    words = (text or "").split()
    n, chars = len(words), max(1, len(data) - singles[0] - singles[1])
    lengths = np.bincount(np.minimum(np.fromiter(map(len, words), np.int64, n), _LENGTHS - 1), minlength=_LENGTHS)
    repeats = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
    ends = sum(1 for w in words if not w[-1].isalnum()) / max(1, n)
    measures = [
        repeats, len(set(words)) / max(1, n), singles[28] / chars, singles[31] / chars, singles[32] / chars, singles[33] / chars,
        singles[30] / chars, ends, min(1.0, np.log1p(n) / 12),
    ]
    out[: len(pairs)] = np.log1p(pairs)
    out[len(pairs) : len(pairs) + _LENGTHS] = np.log1p(lengths)
    total = np.linalg.norm(out) or 1.0
    at = len(pairs) + _LENGTHS
    for value in measures:
        place = np.sqrt(value) * (_BINS - 1)
        low = int(place)
        out[at + low] += (1 - (place - low)) * total * 0.5
        if low + 1 < _BINS:
            out[at + low + 1] += (place - low) * total * 0.5
        at += _BINS
    return out


class NeighbourModel:
    """Labelled vectors in the latent space. ``score`` gives the weighted share of label 1 among the nearest."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int):
        self.idf, self.basis, self.vectors, self.labels, self.neighbours = idf, basis, vectors, labels, neighbours

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows * self.idf) @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray, block: int = 128) -> np.ndarray:
        out = np.empty(len(rows))
        k = min(self.neighbours, len(self.labels))
        if not k:
            return np.full(len(rows), 0.5)
        for at in range(0, len(rows), block):
            cosine = self.project(rows[at : at + block]) @ self.vectors.T
            best = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, best, axis=1), 1e-6).astype(np.float64) ** 8
            out[at : at + block] = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, dims: int = 32, neighbours: int = 15, max_labelled: int = 4000) -> NeighbourModel:
    """Learn from ``docs(doc_id, text)`` with ``labels(doc_id, quality)``; held-out rows must have been removed by the caller.

    ``max_labelled`` bounds the fitted sample for each label value (the rows with the smallest hash of doc_id), and with it
    the driver's share and the broadcast: 2 x ``max_labelled`` x ``dims`` floats. Rows without a label of 0 or 1 do not count;
    of contradicting labels of one doc_id the smallest counts. Without labelled rows every score is 0.5.
    """
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    bounded = known.where("quality = 0").orderBy("h", "doc_id").limit(max_labelled).unionByName(known.where("quality = 1").orderBy("h", "doc_id").limit(max_labelled))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [terms(t if isinstance(t, str) else None).astype(np.float16).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"].astype("int32"), "terms": found})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = texts.join(F.broadcast(bounded.select("doc_id", "quality")), "doc_id").mapInPandas(rows, "doc_id long, quality int, terms binary")
    got = sample.toPandas().sort_values(["doc_id", "terms"]).drop_duplicates("doc_id")
    y = got["quality"].to_numpy(np.float64)
    if not len(y):
        return NeighbourModel(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, neighbours)
    x = np.stack([np.frombuffer(b, np.float16) for b in got["terms"]]).astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    values, vectors = np.linalg.eigh((x * idf).T.astype(np.float64) @ (x * idf).astype(np.float64))
    basis = vectors[:, ::-1][:, :dims].astype(np.float32)
    model = NeighbourModel(idf, basis, np.zeros((0, dims), np.float32), y, neighbours)
    model.vectors = model.project(x)
    return model


def score(docs: DataFrame, model: NeighbourModel, threshold: float = 0.3, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs(doc_id, text, ...)`` -> its columns with ``score`` and ``predicted`` added; null texts count as empty.

    Columns of ``docs`` that have the names of the two new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in (score_col, predicted_col)]

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = np.empty(len(texts))
            for at in range(0, len(texts), 128):
                piece = texts.iloc[at : at + 128]
                out[at : at + 128] = shared.value.score(np.stack([terms(t if isinstance(t, str) else None) for t in piece]))
            yield pd.Series(out)

    added = docs.select(*names, scored(F.col("text").cast("string")).alias(score_col))
    return added.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))


def held_out(doc_id="doc_id"):
    """True where crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
