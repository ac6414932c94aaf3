"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed words and their beginnings (inflected forms share those), word pairs, and
pairs with one word between them, each present or not. Every coordinate has its own learning rate, and the L1 term leaves most weights at zero:
what remains goes to the tasks as one small array.

Learning takes at most ``SAMPLE_ROWS`` labelled documents; scoring reads every whole text.
Null texts count as empty and get the bias's score; a label of several rows of one id is
their maximum; null labels and ids do not teach; without labels every score is 0.5; an empty
table gives no rows; repeated rows score alike; other columns are ignored. Labelled ids of equal keyed hash are taken in
their own order. A text of any length is scored whole: its features are a few numbers a word, one text at a time.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import bounded_ids, map_texts

DIMENSIONS = 1 << 18
SAMPLE_ROWS = 10_000
STEMS = (4, 5, 6, 7)


class Featurer:
    """Hashed features of a text, whole; a word's hash is kept while the table has room."""

    words_of = re.compile(r"\w+").findall

    def __init__(self, dimensions: int = DIMENSIONS):
        self.mask = np.uint64(dimensions - 1)
        self.known: dict[str, tuple[int, ...]] = {}

    def hashed(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = tuple(zlib.crc32(p.encode("utf-8", "replace")) for p in (w, *(w[:n] for n in STEMS)))
        return np.array(list(map(known.__getitem__, words)), np.uint64).reshape(-1, 1 + len(STEMS))

    def __call__(self, text: str | None) -> np.ndarray:
        """Feature numbers with repeats. A word shorter than a stem is its own stem."""
        both = self.hashed(self.words_of((text or "").lower()))
        h = both[:, 0]
        pair = lambda a, b, kind: (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind)) >> np.uint64(29)
        return (np.concatenate([pair(both, both, 1).ravel(), pair(h[:-1], h[1:], 2), pair(h[:-2], h[2:], 3)]) & self.mask).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, int]], dimensions: int, alpha: float, beta: float, l1: float, l2: float,
         epochs: int) -> np.ndarray:
    """Weights after ``epochs`` passes over (features, label); the last one is the bias."""
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)
    free = np.full(dimensions + 1, l1)
    free[-1] = 0  # the bias is not held to zero

    def weights(i):
        return np.where(np.abs(z[i]) <= free[i], 0.0,
                        -(z[i] - np.sign(z[i]) * free[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))
    for _ in range(epochs):
        for features, label in rows:
            i = np.append(features, dimensions)
            w = weights(i)
            g = sigmoid(w.sum()) - label
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(slice(None))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE_ROWS, id_col: str = "doc_id",
          text_col: str = "text", alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0,
          epochs: int = 6) -> np.ndarray:
    """Weights and bias from at most ``bound`` labelled ids, in the order of a keyed hash."""
    known = labels.where(F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    chosen = known.join(bounded_ids(known, id_col, bound, "toxicity"), id_col, "left_semi")

    def features(batches):
        make = Featurer()
        for batch in batches:
            rows = [np.unique(make(t)).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(rows, pa.list_(pa.int32()))],
                ["id", "label", "features"])

    def fit(batches):
        rows = [(f, y) for b in batches for f, y in
                zip((np.array(x, np.int64) for x in b.column(1).to_numpy(zero_copy_only=False)), b.column(0).to_pylist())]
        w = ftrl(rows, DIMENSIONS, alpha, beta, l1, l2, epochs) if rows else np.zeros(DIMENSIONS + 1)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w[at])], ["i", "w"])

    rows = map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                     .join(F.broadcast(chosen.select(F.col(id_col).alias("id"), "label")), "id"),
                     ["id", "label", "text"], features, "id long, label int, features array<int>")
    # One task, but of a bounded sample.
    order = [F.xxhash64(F.lit("order"), "id"), F.xxhash64("features")]
    found = (rows.withColumn("o", F.struct(*order)).repartition(1).sortWithinPartitions("o").select("label", "features")
             .mapInArrow(fit, "i long, w double").collect())
    weights = np.zeros(DIMENSIONS + 1)
    for r in found:
        weights[r["i"]] = r["w"]
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score)."""
    table, bias = weights[:-1].astype(np.float32), float(weights[-1])

    def make(batches):
        features = Featurer()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                f = features(text)
                f = np.unique(f[table[f] != 0])
                out.append(float(sigmoid(bias + float(table[f].sum()))))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.float64())],
                                             ["doc_id", "score"])
    return map_texts(docs, [id_col, text_col], make, "doc_id long, score double")
