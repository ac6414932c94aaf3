"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Every passage of every document is a query. An item's score is its BM25 score over the score
it gives itself, so one threshold suits all items. Postings are kept in blocks of items with
each block's highest impact; a passage whose sum of block maxima stays below the threshold
skips the block, as in WAND's pivot test, and only what is left is scored item by item. All
items above the threshold are then checked: at least ``OVERLAP`` of the five-word shingles of
the question and of the answer must be in the document.

Items are indexed in parts of bounded size; each part makes one pass over the documents.
Items without separate columns are cut before their last sentence: question, then answer; an
item of one sentence is both. Such an item also counts where ``OVERLAP`` of the shingles of its
whole text are in the document. Long items are indexed in segments as long as half a passage.

Null texts of documents and items match nothing, nor do items without words; repeated item
rows count once; repeated documents match alike; empty tables give no matches; other columns
are ignored by ``matches`` and kept by ``clean``. Items of equal score are all
reported; a very long text is cut into passages that overlap, so an item in it is met wherever it stands.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import map_texts

K1, B = 1.2, 0.75
SHINGLE, OVERLAP, THRESHOLD, CHUNK = 5, 0.8, 0.5, 64
#: Characters of item text in one index, which goes to every task.
INDEX_CHARS = 1_000_000
BLOCKS = 64

words_of = re.compile(r"\w+").findall


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) <= SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence or line of more than one."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if words_of(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


@dataclass
class Index:
    """``maxima[t, b]`` is the highest impact of term t in block b; the postings of (t, b) are
    ``segment`` and ``impact`` from ``start[t * blocks + b]`` on."""

    terms: dict[str, int]
    maxima: np.ndarray
    start: np.ndarray
    segment: np.ndarray
    impact: np.ndarray
    entry_of: list[int]
    entries: list[tuple[int, set, set, set | None]]


def build(items: list[tuple[int, str, str]], frequency: dict[str, int], n_items: int, mean_length: float, whole: bool = False) -> Index:
    segments, owners, entries = [], [], []
    for item, question, answer in items:
        words = words_of(question.lower()) + (words_of(answer.lower()) if answer != question else [])
        if not words:
            continue
        entries.append((item, shingles(words_of(question.lower())), shingles(words_of(answer.lower())), shingles(words) if whole else None))
        for at in range(0, max(1, len(words) - CHUNK // 4), CHUNK):
            segments.append(Counter(words[at:at + CHUNK]))
            owners.append(len(entries) - 1)
    blocks = max(1, min(BLOCKS, len(segments)))
    # Segments of like length share a block, so that the maxima are tight.
    order = sorted(range(len(segments)), key=lambda s: (sum(segments[s].values()), s))
    block_of = {s: i * blocks // max(1, len(order)) for i, s in enumerate(order)}
    terms: dict[str, int] = {}
    rows = []
    for s, counts in enumerate(segments):
        length = sum(counts.values())
        weight = {t: math.log(1 + (n_items - min(n_items, frequency[t]) + 0.5) / (frequency[t] + 0.5))
                  * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean_length)) for t, n in counts.items()}
        own = sum(weight.values())
        rows += [(terms.setdefault(t, len(terms)), block_of[s], s, w / own) for t, w in weight.items()]
    rows.sort()
    maxima = np.zeros((len(terms) + 1, blocks), np.float32)
    for t, b, _, w in rows:
        maxima[t, b] = max(maxima[t, b], w)
    slot = np.array([t * blocks + b for t, b, _, _ in rows], np.int64)
    start = np.searchsorted(slot, np.arange(len(terms) * blocks + 1))
    return Index(terms, maxima, start, np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows]), owners, entries)


def candidates(index: Index, words: list[str], threshold: float) -> dict[int, float]:
    """Entries that some passage (two neighbouring chunks) scores at ``threshold`` or above, with
    the highest score."""
    if not index.entry_of or not words:
        return {}
    unknown = len(index.terms)
    get = index.terms.get
    ids = np.fromiter((get(w, unknown) for w in words), np.int64, len(words))
    at = np.flatnonzero(ids != unknown)
    if not len(at):
        return {}
    # Each term once a chunk; a passage adds up its two chunks, so a bound never falls short.
    pairs = np.unique(at // CHUNK * unknown + ids[at])
    chunk, term = pairs // unknown, pairs % unknown
    first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    sums = np.zeros((int(chunk[-1]) + 2, index.maxima.shape[1]), np.float32)
    sums[chunk[first]] = np.add.reduceat(index.maxima[term], first, axis=0)
    over = np.argwhere(sums[:-1] + sums[1:] >= threshold - 1e-6)
    best: dict[int, float] = {}
    blocks = index.maxima.shape[1]
    last, query = -1, []
    for c, b in over.tolist():
        if c != last:
            last = c
            low, high = np.searchsorted(chunk, [c, c + 2])
            query = np.unique(term[low:high])
        # Terms with no posting in the block are skipped; the rest add up.
        live = query[index.maxima[query, b] > 0]
        lows, highs = index.start[live * blocks + b], index.start[live * blocks + b + 1]
        take = np.concatenate([np.arange(x, y) for x, y in zip(lows, highs)]) if len(live) else np.zeros(0, np.int64)
        found, inverse = np.unique(index.segment[take], return_inverse=True)
        for s, score in zip(found.tolist(), np.bincount(inverse, weights=index.impact[take]).tolist()):
            if score >= threshold:
                entry = index.entry_of[s]
                best[entry] = max(best.get(entry, 0.0), score)
    return best


def verified(index: Index, words: list[str], threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
    """(item, score, share of the question, share of the answer) of the items that a text holds."""
    best = candidates(index, words, threshold)
    if not best:
        return []
    own = shingles(words)
    text = None
    out = []
    for entry, score in sorted(best.items()):
        item, *parts, whole = index.entries[entry]
        shares = []
        for part in [*parts, whole] if whole else parts:
            if part and len(next(iter(part))) < SHINGLE:
                # A part of fewer words than a shingle must stand in the text as a whole.
                text = text or f" {' '.join(words)} "
                shares.append(float(f" {' '.join(next(iter(part)))} " in text))
            else:
                shares.append(len(part & own) / len(part) if part else 1.0)
        if min(shares[:2]) >= overlap or max(shares[2:], default=0.0) >= overlap:
            out.append((item, score, *shares[:2]))
    return out


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", question_col: str | None = None,
            answer_col: str | None = None):
    """Indexes of parts of the items, one at a time. Document frequencies and the mean length
    are those of all items; the driver holds the items and frequencies of one part."""
    question, answer = (question_col or text_col), (answer_col or question_col or text_col)
    items = (benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(question), F.lit("")).alias("q"),
                              F.coalesce(F.col(answer), F.lit("")).alias("a")).where("item is not null").distinct())

    def words(batches):
        for batch in batches:
            rows = [words_of(" ".join(dict.fromkeys(pair)).lower()) for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(r)) for r in rows], pa.list_(pa.string())),
                                              pa.array([len(r) for r in rows], pa.int64())], ["w", "n"])
    lists = map_texts(items, ["q", "a"], words, "w array<string>, n long")
    size = lists.where("n > 0").agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    chars = items.agg(F.sum(F.length("q") + F.length("a"))).first()[0] or 0
    frequency = lists.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    parts = max(1, math.ceil(chars / INDEX_CHARS))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item", "q", "a").collect()
        texts = [(r["item"], *((r["q"], r["a"]) if question_col else split_item(r["q"]))) for r in rows]
        own = sorted({w for r in rows for w in words_of(f"{r['q']} {r['a']}".lower())})
        if own:
            known = frequency.join(F.broadcast(items.sparkSession.createDataFrame([(w,) for w in own], "w string")), "w")
            yield build(texts, {r["w"]: r["n"] for r in known.collect()}, size["n"], size["mean"], not question_col)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
            id_col: str = "doc_id", text_col: str = "text", **item_columns) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every item that a document holds."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def finder(index):
        def make(batches):
            for batch in batches:
                rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                        for m in verified(index, words_of((text or "").lower()), threshold, overlap)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                                 ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
        return make
    out = None
    for index in indexes(benchmark, **item_columns):
        found = map_texts(docs, [id_col, text_col], finder(index), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
          text_col: str = "text", **item_columns) -> DataFrame:
    """The rows of ``docs`` that hold no item, in one pass for each index and without a join."""
    def keeper(index):
        def make(batches):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                keep = [not verified(index, words_of((t or "").lower()), threshold, overlap) for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))
        return make
    for index in indexes(benchmark, **item_columns):
        docs = map_texts(docs, docs.columns, keeper(index), docs.schema)
    return docs
