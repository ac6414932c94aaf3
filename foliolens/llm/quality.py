"""Quality by ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds cut the
latent value: P(grade <= k) = sigmoid(threshold_k - value). Selection uses the expected
grade or the probability of at least some grade. Features are relative frequencies of
hashed words, of word shapes (case, digits, punctuation), pairs of shapes, and of words that
repeat the one before or two before them.

Learning takes at most ``SAMPLE_ROWS`` rated documents; scoring reads every whole text. Null
texts count as empty; several ratings of one id count as their maximum; null ratings and ids
do not teach; with fewer than two grades every document is kept with the one grade known; an
empty table gives no rows; repeated rows score alike; other columns are ignored by ``rate``
and kept by ``select_documents``. A very long text is one vector of hashed
features; a tail of exactly the limit keeps the document.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import bounded_ids, map_texts

DIMENSIONS = 1 << 14
SAMPLE_ROWS = 12_000


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray


class Featurer:
    def __init__(self, dimensions: int = DIMENSIONS):
        self.half = dimensions // 2
        self.known: dict[str, tuple[int, int]] = {}

    # Lower case first, so that the names of the classes stay.
    runs = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "9"))

    def word(self, w: str) -> tuple[int, int]:
        """(hash of the word, hash of its shape): runs of a class of characters count once."""
        shape = w
        for run, name in self.runs:
            shape = run.sub(name, shape)
        return zlib.crc32(w.lower().encode("utf-8", "replace")), zlib.crc32(shape.encode("utf-8", "replace"))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, values): each family has a half or less of the norm."""
        words = (text or "").split()
        known = self.known
        if len(known) > 150_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        if not words:
            return np.array([2 * self.half - 1]), np.array([1.0])
        both = np.array(list(map(known.__getitem__, words)), np.uint64)
        h, s = both[:, 0], both[:, 1]
        half = np.uint64(self.half - 8)
        mixed = lambda a, b: ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(31))
        shapes = np.concatenate([mixed(s, s) % half, mixed(s[:-1], s[1:]) % half])
        again = [np.full(int((h[j:] == h[:-j]).sum()), self.half - 8 + j, np.uint64) for j in (1, 2)]
        out_i, out_v = [], []
        for base, numbers, share in ((0, np.concatenate([shapes, *again]), 1.0), (self.half, mixed(h, h) % half, 0.25)):
            i, n = np.unique(numbers, return_counts=True)
            v = np.sqrt(n)
            out_i.append(i.astype(np.int64) + base)
            out_v.append(share * v / np.linalg.norm(v))
        return np.concatenate(out_i), np.concatenate(out_v)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def cumulative_link(index, value, owner, grade: np.ndarray, n_grades: int, dimensions: int, l2: float, steps: int,
                    rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the whole sample. ``index``, ``value`` and ``owner``
    list the features of all documents; ``grade`` is 0 .. n_grades-1 per document."""
    docs = len(grade)
    share = np.cumsum(np.bincount(grade, minlength=n_grades) + 0.5)[:-1] / (docs + 0.5 * n_grades)
    # The first threshold and the logarithms of the gaps keep the order.
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(dimensions), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    m, s = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:dimensions], np.exp(p[dimensions + 1:])
        cut = p[dimensions] + np.concatenate([[0.0], np.cumsum(gaps)])
        latent = np.bincount(owner, weights=w[index] * value, minlength=docs)
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        high, low = sigmoid(edge[grade + 1] - latent), sigmoid(edge[grade] - latent)
        likelihood = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / likelihood, low * (1 - low) / likelihood
        g_latent = (d_high - d_low) / docs
        g_cut = np.zeros(n_grades + 1)
        np.add.at(g_cut, grade + 1, -d_high / docs)
        np.add.at(g_cut, grade, d_low / docs)
        g_cut = g_cut[1:-1]
        later = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(index, weights=value * g_latent[owner], minlength=dimensions) + l2 * w,
                            later[:1], later[1:] * gaps])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return p[:dimensions], p[dimensions] + np.concatenate([[0.0], np.cumsum(np.exp(p[dimensions + 1:]))])


def learn(docs: DataFrame, ratings: DataFrame, rating: str = "quality", bound: int = SAMPLE_ROWS, id_col: str = "doc_id",
          text_col: str = "text", l2: float = 3e-5, steps: int = 150) -> Model:
    known = ratings.where(F.col(rating).isNotNull()).groupBy(id_col).agg(F.max(rating).cast("int").alias("grade"))
    chosen = known.join(bounded_ids(known, id_col, bound, "quality"), id_col, "left_semi")

    def features(batches):
        make = Featurer()
        for batch in batches:
            rows = [make(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([i for i, _ in rows], pa.list_(pa.int64())),
                 pa.array([v for _, v in rows], pa.list_(pa.float64()))], ["id", "grade", "i", "v"])

    def fit(batches):
        rows = [(g, i, v) for b in batches for g, i, v in
                zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))]
        grades = sorted({g for g, _, _ in rows})
        weights, cut = np.zeros(DIMENSIONS), np.zeros(max(0, len(grades) - 1))
        if len(grades) > 1:
            owner = np.repeat(np.arange(len(rows)), [len(i) for _, i, _ in rows])
            weights, cut = cumulative_link(np.concatenate([i for _, i, _ in rows]), np.concatenate([v for _, _, v in rows]), owner,
                                           np.array([grades.index(g) for g, _, _ in rows]), len(grades), DIMENSIONS, l2, steps)
        for kind, numbers in (("grade", grades), ("weight", weights), ("threshold", cut)):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(numbers), pa.string()), pa.array(range(len(numbers)), pa.int32()),
                                              pa.array(numbers, pa.float64())], ["kind", "i", "v"])

    rows = map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                     .join(F.broadcast(chosen.select(F.col(id_col).alias("id"), "grade")), "id"),
                     ["id", "grade", "text"], features, "id long, grade int, i array<long>, v array<double>")
    # One task, but of a bounded sample.
    order = F.struct(F.xxhash64(F.lit("order"), "id"), F.xxhash64("i"))
    found = (rows.withColumn("o", order).repartition(1).sortWithinPartitions("o").select("grade", "i", "v")
             .mapInArrow(fit, "kind string, i int, v double").collect())
    of = lambda kind: np.array([r["v"] for r in sorted((r for r in found if r["kind"] == kind), key=lambda r: r["i"])])
    weights = of("weight")
    return Model([int(g) for g in of("grade")], weights if len(weights) else np.zeros(DIMENSIONS), of("threshold"))


def rate(docs: DataFrame, model: Model, least: int | None = None, tail: float = 0.5, id_col: str = "doc_id",
         text_col: str = "text", names: tuple[str, str, str] = ("expected_grade", "tail_probability", "keep")) -> DataFrame:
    """(row columns of ``docs``, expected_grade, tail_probability, keep): the tail is P(grade >= ``least``),
    by default the highest grade; a document is kept at ``tail`` or more. ``names`` are those of the last
    three; columns of ``docs`` that have them give way."""
    grades = model.grades
    least = grades[-1] if least is None and grades else least
    above = np.searchsorted(grades, least) if grades else 0
    columns = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]

    def make(batches):
        features = Featurer()
        for batch in batches:
            latent = []
            for text in batch.column(text_col).to_pylist():
                i, v = features(text)
                latent.append(float(model.weights[i] @ v))
            latent = np.array(latent)
            upto = np.stack([*(sigmoid(t - latent) for t in model.thresholds), np.ones(len(latent))], axis=1)
            share = np.diff(upto, axis=1, prepend=0)
            expected = share @ np.array(grades, float) if grades else np.zeros(len(latent))
            over = 1 - upto[:, above - 1] if above else np.ones(len(latent))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(over), pa.array(over >= tail)],
                                             [*columns, *names])
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in columns] + [
        T.StructField(n, kind) for n, kind in zip(names, (T.DoubleType(), T.DoubleType(), T.BooleanType()))])
    return map_texts(docs, columns, make, schema)


def select_documents(docs: DataFrame, model: Model, least: int | None = None, tail: float = 0.5, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, with all their columns, whatever their names."""
    taken = {c.lower() for c in docs.columns}
    names = tuple(next(n for n in (f"{name}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken)
                  for name in ("expected_grade", "tail_probability", "keep"))
    return rate(docs, model, least, tail, id_col, text_col, names).where(F.col(names[2])).select(*docs.columns)
