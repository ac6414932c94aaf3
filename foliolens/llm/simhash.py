"""Near-duplicates by SimHash: pigeonhole blocks, join on blocks, then Hamming distance.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Two of at
most ``distance`` differing bits agree on at least ``blocks - distance`` of the blocks that
the bits are cut into, so they share one of the tables that key a fingerprint by that many
blocks. Documents of equal fingerprints are merged first. In a bucket (table, key) a
breadth-first search emits a spanning forest of the links instead of all pairs; components
of those edges are components of all links.

Null texts count as empty, and texts without words have fingerprint zero, which links like
any other. Repeated rows link to each other; rows that share an id but not their text are
rows of their own. Empty tables give no rows. A null id takes no part in choosing the
smallest id of a component unless all its ids are null. Other columns are ignored by
``near_duplicates`` and kept by ``keep_first``. A very long text is one
fingerprint like any other, from its words in one task; ties of ids cannot change a component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import map_texts, stored
from foliolens.llm.components import components

BITS, BLOCKS, DISTANCE, SHINGLE, SEED = 64, 6, 3, 3, 42


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 row_col: str | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number; with ``row_col`` (doc_id, row, fp)."""
    def make(batches):
        import xxhash

        h64 = xxhash.xxh64_intdigest
        for batch in batches:
            prints = []
            for text in batch.column(1).to_pylist():
                # On bytes, lower() changes A-Z alone and split() cuts at 0x20 and 0x09-0x0D.
                words = (text or "").encode().lower().split()
                n = max(1, len(words) - shingle + 1) if words else 0
                if len(words) <= shingle:
                    hashes = [h64(b" ".join(words), SEED)] if words else []
                else:
                    hashes = [h64(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)))]
                if not hashes:
                    prints.append(0)
                    continue
                ones = np.zeros(BITS, np.int64)
                raw = np.array(hashes, np.uint64)
                for at in range(0, n, 65536):
                    octets = raw[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
                    ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
                prints.append(int(np.packbits(2 * ones > n).view(">i8")[0]))
            numbers = [batch.column(0), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*(c.cast(pa.int64()) for c in numbers), pa.array(prints, pa.int64())], names)
    names = ["doc_id", *(["row"] if row_col else []), "fp"]
    return map_texts(docs, [id_col, text_col, *([row_col] if row_col else [])], make, ", ".join(f"{c} long" for c in names))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each table the mask of the bits it keys by, as signed 64-bit numbers."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links prints at most ``distance`` apart.

    Each step compares one print with all that are not reached yet, so a dense group costs
    little more than its size and nothing is kept but the group itself.
    """
    edges = []
    left = prints
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                reached = left[near]
                edges += [(at, other) for other in reached]
                queue += list(reached)
                left = left[~near]
    return edges


def bucket_edges(batches, distance: int, chunk: int):
    """Rows sorted by (tab, key, part): one bucket after another, each through ``forest``."""
    def edges_of(tab, key, part, fp):
        cut = np.flatnonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        bounds = np.concatenate([[0], cut, [len(tab)]])
        sizes = np.diff(bounds)
        pairs = bounds[:-1][sizes == 2]
        a, b = fp[pairs], fp[pairs + 1]
        near = np.bitwise_count(a ^ b) <= distance
        out = [np.stack([a[near], b[near]], axis=1)]
        for i in np.flatnonzero(sizes > 2):
            found = forest(np.unique(fp[bounds[i]:bounds[i + 1]]), distance)
            if found:
                out.append(np.array(found, np.uint64))
        got = np.concatenate(out).astype(np.int64, casting="unsafe")
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tab", "key", "part", "fp")]
        now[3] = now[3].astype(np.uint64, casting="unsafe")
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        tab, key, part, _ = now
        # The last bucket may go on in the next batch.
        last = np.flatnonzero((tab != tab[-1]) | (key != key[-1]) | (part != part[-1]))
        end = int(last[-1]) + 1 if len(last) else 0
        held = [x[end:] for x in now]
        if end:
            yield edges_of(*(x[:end] for x in now))
    if held is not None and len(held[0]):
        yield edges_of(*held)


def links(prints: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, chunk: int = 20_000) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints which links connect.

    ``prints`` has distinct ``fp``. A bucket of more than ``chunk`` prints is cut into shares,
    and each pair of shares is a bucket of its own, so that memory stays bounded and several
    tasks take part; no pair is left out.
    """
    masks = F.array(*(F.struct(F.lit(i).alias("tab"), F.lit(m).alias("mask")) for i, m in enumerate(block_masks(blocks, distance))))
    keyed = (prints.select("fp", F.explode(masks).alias("t"))
             .select("fp", F.col("t.tab").alias("tab"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key")))
    sizes = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    shares = F.ceil(F.col("n") / F.lit(chunk / 2)).cast("int")
    mine = F.when(F.col("n") <= chunk, 0).otherwise(F.pmod(F.xxhash64("fp"), shares).cast("int"))
    parts = F.when(F.col("n") <= chunk, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), shares - 1),
                    lambda other: F.least(other, F.col("mine")) * shares + F.greatest(other, F.col("mine"))))
    dealt = (keyed.join(sizes, ["tab", "key"]).withColumn("mine", mine)
             .select("tab", "key", "fp", F.explode(parts).alias("part")))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.repartition(n, "tab", "key", "part").sortWithinPartitions("tab", "key", "part")
            .mapInArrow(lambda batches: bucket_edges(batches, distance, chunk), "a long, b long").distinct())


def grouped(prints: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """``prints``, of distinct ``fp``, with the smallest fingerprint that links reach as ``component``."""
    roots = components(links(prints.select("fp"), blocks, distance))
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS,
                    distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id, n_same): the smallest id that links reach, and how many rows
    have the same fingerprint."""
    rows = stored(fingerprints(docs, id_col, text_col))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same")))
    groups = grouped(prints, blocks, distance)
    least = groups.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = groups.join(least, "component").select("fp", "n_same", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "n_same")


def fingerprint_text(fp) -> "F.Column":
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id, a null id last, and one of
    those that repeat this id. Rows are numbered in a written table, so that it is rows that
    go, not all that share an id."""
    row = "row"
    while row.lower() in {c.lower() for c in docs.columns}:
        row += "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = stored(fingerprints(numbered, id_col, text_col, row_col=row))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    groups = grouped(stored(rows.groupBy("fp").agg(F.min(order).alias("first"))))
    firsts = groups.groupBy("component").agg(F.min("first").alias("first")).select("first.row")
    drop = stored(rows.select("row").join(firsts, "row", "left_anti").withColumnRenamed("row", row))
    return numbered.join(drop, row, "left_anti").select(docs.columns)
