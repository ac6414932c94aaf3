"""Packing of tokenised documents into sequences of fixed length.

Shortest-pack-first over the histogram of piece lengths. A document's ids (and the closing
id) are cut every ``size`` ids; whole pieces fill a sequence alone and the rests are packed.
The driver sees one count per length, at most ``size`` of them: it places the lengths from
the longest down, each on the pattern with the most room, and splits a pattern's count where
only a part of it gets the new length. Patterns go back to the pieces by rank: the r-th piece
of a length takes the r-th slot that patterns have for it.

Null texts count as empty (the closing id alone), repeated rows are packed once each, an empty
table gives no rows. Other columns are ignored. Documents that tie in length are ranked by id and place; a very
long one is as many pieces as it needs, from one pass over its ids.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import map_texts, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class Encoder:
    """Ids of ``byte_bpe_50k.json``.

    Latin text goes through the rank form of the same vocabulary, which gives the same ids
    about four times faster. Other scripts and very long runs of white space, where
    the two libraries' character tables could differ, and texts with an added token of the
    vocabulary go through ``tokenizers``.
    """

    other = re.compile(r"[^\0-ɏ‐-…€]|\s{200}").search

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        #: Strings that are one token of their own, which only ``tokenizers`` knows of.
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or self.other(text) or any(a in text for a in self.added):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None,
           size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``size`` ids, in one pass over the texts."""
    def make(batches):
        encode = Encoder(json_path, ranks_path, pattern)
        for batch in batches:
            rows = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = array("I", encode(text or ""))
                ids.append(end_id)
                raw = np.frombuffer(ids, dtype=np.uint32).astype("<u4").tobytes()
                for start in range(0, len(ids), size):
                    part = raw[4 * start:4 * (start + size)]
                    for column, value in zip(rows, (doc, start, len(part) // 4, zlib.crc32(part), len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return map_texts(docs, [id_col, text_col], make, PIECES)


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths of a pattern, how many sequences have it), from the count of each length."""
    done: list[tuple[list[int], int]] = []
    open_packs: list[tuple[int, int, list[int], int]] = []  # room as a negative number first: most room on top
    serial = 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[length]
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, lengths, n = heapq.heappop(open_packs)
                took = min(n, left)
                if n > took:
                    heapq.heappush(open_packs, (room, (serial := serial + 1), lengths, n - took))
                lengths, n, room = [*lengths, length], took, -room - length
            else:
                # A new pack is the emptiest, so it takes this length until it is full.
                fits = min(size // length, left)
                lengths, n, room, took = [length] * fits, left // fits, size - fits * length, left // fits * fits
            left -= took
            if room:
                heapq.heappush(open_packs, (-room, (serial := serial + 1), lengths, n))
            else:
                done.append((lengths, n))
    return done + [(lengths, n) for _, _, lengths, n in open_packs]


def slots(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where each rank of a length goes."""
    rows, ranks, sequence = [], {}, 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            rank = ranks.get(length, 0)
            rows.append((length, rank, sequence, offset))
            ranks[length] = rank + n
            offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def ranked(parts: DataFrame, salts: int) -> DataFrame:
    """``parts`` with ``rank``, 0 .. n-1 within each length. A length with most of the rows is
    numbered in ``salts`` shares, which are then put one after the other."""
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    share = Window.partitionBy("length", "salt")
    before = (parts.groupBy("length", "salt").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
              .select("length", "salt", "before"))
    return (parts.withColumn("rank", F.row_number().over(share.orderBy("doc_id", "start", "ids_crc32")) - 1)
            .join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
            .drop("salt", "before"))


def pack(parts: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` with the sequence and offset of each."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(shortest_pack_first(counts, size))
    step = int(table[:, 1].max(initial=0)) + 1
    keys = table[:, 0] * step + table[:, 1] if len(table) else table[:, 0]

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * step + np.minimum(rank, step - 1), side="right") - 1
            row = table[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    salts = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (ranked(parts, salts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
            .mapInArrow(assign, PACKED))


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None,
                   size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(stored(pieces(docs, json_path, ranks_path, pattern, size, end_id, id_col, text_col)), size)
