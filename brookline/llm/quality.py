"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of hashed counts: byte trigrams, and how its words repeat. The fit takes a
bounded sample of labelled documents (`per_class` of each class, chosen by a hash of the id),
weighs features by their inverse document frequency in it and projects onto its leading
singular vectors. The labelled vectors, at most 2 * per_class of `rank` floats, are broadcast.
Every document is compared with all of them, as exact cosine products in blocks; the
`neighbours` nearest vote with weights that rise with similarity.

Defined results: a row for every input row, an empty table for an empty one; very long texts are read
whole. A null or empty text, or one that shares nothing
with the sample, gets the share of label 1 among all labels as its score, and so does every
text if no row is labelled (then 0.5). Ties between neighbours go by the order of the sample,
which is by id. Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.llm import text as T
from brookline.llm.shared import labelled

BUCKETS, EXTRA = 2048, 16
PER_CLASS, RANK, NEIGHBOURS, BLOCK, POWER = 1500, 64, 15, 256, 4
#: Rows of a chunk: a dense row of features is 8 KB, however short its text.
ROWS = 512


def features(chunk: T.Chunk) -> np.ndarray:
    """Rows by buckets: log counts of hashed byte trigrams, then shares of repeated words and of letter case, in steps."""
    rows, data = chunk.rows, chunk.data
    out = np.zeros((rows, BUCKETS + EXTRA), np.float32)
    if len(data) == 0:
        return out
    size = np.diff(chunk.offsets)
    row = np.repeat(np.arange(rows, dtype=np.int64), size)
    b = data.astype(np.uint32)
    if len(b) >= 3:
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        cell = row[:-2] * BUCKETS + (h >> np.uint32(21)).astype(np.int64)
        cell = cell[row[:-2] == row[2:]]
        out[:, :BUCKETS] = np.log1p(np.bincount(cell, minlength=rows * BUCKETS).reshape(rows, BUCKETS)).astype(np.float32)
    w = T.words(chunk, lower=True)
    n = np.diff(w.first)
    word_row = w.rows
    near = np.zeros(len(w.hash), bool)
    near[1:] = (w.hash[1:] == w.hash[:-1]) & (word_row[1:] == word_row[:-1])
    g = T.grams(w, 3)
    order = np.lexsort((g.hash, g.row))
    again = np.zeros(len(order), bool)
    again[1:] = (g.hash[order][1:] == g.hash[order][:-1]) & (g.row[order][1:] == g.row[order][:-1])
    upper = np.bincount(row, weights=(data >= 65) & (data <= 90), minlength=rows)
    letter = np.bincount(row, weights=((data | 32) >= 97) & ((data | 32) <= 122), minlength=rows)
    shares = [np.bincount(word_row, weights=near, minlength=rows) / np.maximum(n, 1), np.bincount(g.row[order], weights=again, minlength=rows) / np.maximum(n - 2, 1), upper / np.maximum(letter, 1), 1 - letter / np.maximum(size, 1)]
    norm = np.sqrt(np.square(out).sum(1))
    for k, x in enumerate(shares):
        for j, edge in enumerate((0.03, 0.1, 0.25, 0.5)):
            out[:, BUCKETS + 4 * k + j] = (x > edge) * norm * 0.25
    return out


class Voters:
    """The fitted space and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int, neighbours: int):
        self.y, self.neighbours = y.astype(np.float32), neighbours
        self.prior = float(y.mean()) if len(y) else 0.5
        self.weight = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        scaled = self._scale(x)
        if len(x):
            values, vectors = np.linalg.eigh((scaled.T @ scaled).astype(np.float64))
            keep = np.argsort(values)[::-1][: min(rank, len(x))]
            self.axes = vectors[:, keep[values[keep] > 1e-9]].astype(np.float32)
        else:
            self.axes = np.zeros((BUCKETS + EXTRA, 1), np.float32)
        self.vectors = self._unit(scaled @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt(np.square(x).sum(1, keepdims=True)), 1e-12)

    def _scale(self, x: np.ndarray) -> np.ndarray:
        return self._unit(x * self.weight)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        k = min(self.neighbours, len(self.y))
        if not k:
            return out
        for at in range(0, len(x), BLOCK):
            v = self._unit(self._scale(x[at : at + BLOCK]) @ self.axes)
            known = np.square(v).sum(1) > 0.5
            cos = v @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.clip(np.take_along_axis(cos, near, 1), 0, 1).astype(np.float64) ** POWER
            total = w.sum(1)
            known &= total > 1e-12
            vote = (w * self.y[near]).sum(1) / np.maximum(total, 1e-12)
            out[at : at + BLOCK][known] = vote[known]
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int = PER_CLASS, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Voters:
    """Features of the sample are made on the workers; the driver gets at most 2 * per_class rows of half floats."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in T.pieces(batch, "text", ROWS):
                x = features(chunk).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    got = labelled(docs, labels, label, allowed, per_class).select("doc_id", "text", "label").mapInArrow(T.task(extract), "doc_id long, label int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, BUCKETS + EXTRA).astype(np.float32)
    return Voters(x, got["label"].to_numpy(), rank, neighbours)


def score_quality(docs: DataFrame, model: Voters, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row; the model's broadcast is bounded by the fit's parameters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk in T.pieces(batch, "text", ROWS):
                s = sent.value.score(features(chunk))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

        T.release()

    return docs.select("doc_id", "text").mapInArrow(T.task(scan), "doc_id long, score double, predicted int")
