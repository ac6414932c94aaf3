"""Near-duplicate vectors of equal label: small-world graphs per shard, audited beams, exact cosines.

Equal vectors are one class first. The classes of a label (and length) are dealt to shards of about
``shard_rows``; a task builds each shard's graph and widens its beam until planted queries at the
limit are found 99 % of the time. Then blocks of classes query every shard of their label. Vectors
within nearly half the limit's angle of a node form its group: all of a group link to each other, and
a query near enough links to the whole group, so crowds of near copies are counted without a pair
of them being made. All other members of groups within reach are compared in double precision. A query
returns how many vectors it links to and, for the components, one edge for each component of the
shard that it touches, so what is shuffled grows with the vectors, not with their links.

Cosines are those of vectors divided by their largest component first, so nothing overflows. A null
label, a null or zero vector, or one with null or non-finite components links with nothing; so
do vectors of different lengths. Rows that share a vec_id are vectors of their own, and equal ones link;
a null vec_id names a component only if all its ids are null. Empty tables give no rows. There are no
texts; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm import hnsw
from foliolens.llm.common import stored
from foliolens.llm.components import components

COSINE, SHARD_ROWS, BLOCK_ROWS, TOP_LEVEL, SLACK, PAIRS = 0.93, 16_384, 4_096, 6, 1e-9, 200_000
SHARD = "space string, shard int, cid string, n long, min_id long, unit binary, node long, level int, links array<binary>, width int, root string"


def usable(vector: Column) -> Column:
    value = lambda x: x.cast("double")
    return (F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
            & F.exists(vector, lambda x: value(x) != 0))


def classed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, cid, space, v): each row with the key of its class, null where it cannot link."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    # Adding zero makes -0.0 the zero that it equals.
    rows = rows.select("vec_id", F.when(F.col("label").isNotNull() & usable(F.col("v")),
                                        F.transform("v", lambda x: x.cast("double") + F.lit(0.0))).alias("v"), "label")
    space = F.when(F.col("v").isNotNull(), F.concat(F.size("v").cast("string"), F.lit(":"), F.col("label").cast("string")))
    rows = rows.withColumn("space", space)
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), "space", "v")), 16, "0")
    return rows.withColumn("cid", F.when(F.col("v").isNotNull(), F.concat(half(1), half(2))))


def units(batches):
    """Vectors of length one, as the bytes of their doubles."""
    for batch in batches:
        made = []
        for v in batch.column("v").to_pylist():
            x = np.array(v)
            x /= np.abs(x).max()
            made.append((x / np.sqrt(x @ x)).tobytes())
        kept = [c for c in batch.schema.names if c != "v"]
        yield pa.record_batch([batch.column(c) for c in kept] + [pa.array(made, pa.binary())], names=kept + ["unit"])


def array_of(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values)).reshape(len(values), -1) if values else np.zeros((0, 1))


def linked_groups(graph, members, first, queries, weights, width, cosine, slack_angle, own=None):
    """(links by query, pairs (query, node) of linked groups). ``members``: the units of the shard
    by node, those of node i from ``first[i]`` to ``first[i + 1]``, the node itself first."""
    limit, sizes = math.acos(cosine), np.diff(first)
    group_weight = np.add.reduceat(weights, first[:-1])
    angle = lambda a, b: np.arccos(np.clip(np.einsum("pd,pd->p", a, b), -1, 1))
    reach = np.maximum.reduceat(angle(members, np.repeat(members[first[:-1]], sizes, axis=0)), first[:-1])
    low = math.cos(limit + slack_angle) - 1e-4
    q, nodes = graph.within(queries.astype(np.float32), low, width, own)
    counts, found = np.zeros(len(queries), np.int64), []
    for at in range(0, len(q), PAIRS):
        a, b = q[at:at + PAIRS], nodes[at:at + PAIRS]
        far = angle(queries[a], members[first[b]])
        whole = (sizes[b] > 1) & (far <= limit - reach[b] - SLACK)
        np.add.at(counts, a[whole], group_weight[b[whole]])
        found.append((a[whole], b[whole]))
        a, b = a[~whole], b[~whole]
        ends = np.cumsum(sizes[b])
        start = 0
        while start < len(a):  # members one by one, in bounded steps of at least one group
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            n = sizes[b[start:stop]]
            pair = np.repeat(np.arange(start, stop), n)
            row = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + first[b[pair]]
            hit = np.einsum("pd,pd->p", queries[a[pair]], members[row]) >= cosine
            np.add.at(counts, a[pair[hit]], weights[row[hit]])
            touched = np.unique(pair[hit])
            found.append((a[touched], b[touched]))
            start = stop
    pairs = [np.concatenate(p) for p in zip(*found)] if found else [np.zeros(0, int)] * 2
    return counts, *pairs


def shard_index(cosine: float):
    """One shard's rows with their node, the nodes' links, the audited beam and the component's first class."""
    limit = math.acos(cosine)
    radius = 0.49 * limit  # two of a group are nearer than the limit

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        cids, rows = table.column("cid").to_pylist(), array_of(table.column("unit"))
        draw = [max(int(c[:13], 16), 1) / 16**13 for c in cids]
        levels = np.array([min(TOP_LEVEL, int(-math.log(u) / math.log(hnsw.DEGREE))) for u in draw], np.int8)
        graph, leaders, node = hnsw.built(rows, levels, math.cos(radius))
        width = hnsw.audited_width(graph, rows, node, cosine, math.cos(limit + radius) - 1e-4)
        is_leader = np.zeros(len(cids), bool)
        is_leader[leaders] = True
        order = np.lexsort((~is_leader, node))
        first = np.concatenate([np.searchsorted(node[order], np.arange(graph.size)), [len(cids)]])
        _, a, b = linked_groups(graph, rows[order], first, rows[leaders], np.ones(len(cids), np.int64), width, cosine, radius, np.arange(graph.size))
        root = np.arange(graph.size)
        while True:  # the smallest node of each component
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        links: list = [None] * len(cids)
        for i, at in enumerate(leaders):
            links[at] = [layer[i].tobytes() for layer in graph.links]
        level = np.zeros(len(cids), np.int32)
        level[leaders] = graph.levels
        table = table.select(["space", "shard", "cid", "n", "min_id", "unit"])
        for name, values in (("node", pa.array(node, pa.int64())), ("level", pa.array(level, pa.int32())),
                             ("links", pa.array(links, pa.list_(pa.binary()))), ("width", pa.array([width] * len(cids), pa.int32())),
                             ("root", pa.array([cids[leaders[r]] for r in root[node]], pa.string()))):
            table = table.append_column(name, values)
        return table

    return make


def shard_queries(cosine: float):
    """What one block of classes links to in one shard: (cid, links, roots)."""
    limit = math.acos(cosine)

    def make(shard: pa.Table, block: pa.Table) -> pa.Table:
        cids = block.column("cid").to_pylist()
        if not len(shard) or not cids:
            return pa.table({"cid": pa.array([], pa.string()), "links": pa.array([], pa.int64()), "roots": pa.array([], pa.list_(pa.string()))})
        node = shard.column("node").to_numpy()
        leads = np.array([x is not None for x in shard.column("links").to_pylist()])
        order = np.lexsort((~leads, node))
        shard = shard.take(pa.array(order))
        node, members = node[order], array_of(shard.column("unit"))
        first = np.concatenate([np.searchsorted(node, np.arange(node[-1] + 1)), [len(node)]])
        at = first[:-1]
        links = [[np.frombuffer(layer, np.int32) for layer in x] for x in shard.column("links").take(pa.array(at)).to_pylist()]
        graph = hnsw.Graph(members[at].astype(np.float32), shard.column("level").to_numpy()[at].astype(np.int8), [np.stack(x) for x in zip(*links)])
        place = {c: int(n) for c, n in zip(shard.column("cid").to_pylist(), node)}
        own = np.array([place.get(c, -1) for c in cids])
        weights = shard.column("n").to_numpy()
        counts, a, b = linked_groups(graph, members, first, array_of(block.column("unit")), weights, int(shard.column("width")[0].as_py()),
                                     cosine, 0.49 * limit, own)
        roots = shard.column("root").to_pylist()
        found: list[set] = [set() for _ in cids]
        for q, lead in zip(a.tolist(), first[b].tolist()):
            found[q].add(roots[lead])
        some = [i for i, f in enumerate(found) if f]
        return pa.table({"cid": pa.array([cids[i] for i in some], pa.string()), "links": pa.array(counts[some], pa.int64()),
                         "roots": pa.array([sorted(found[i]) for i in some], pa.list_(pa.string()))})

    return make


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                cosine: float = COSINE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each vector: vec_id, n_links (other vectors of cosine ``cosine`` or more),
    component_id (the smallest vec_id reachable by links), kept."""
    rows = classed(vectors, id_col, vector_col, label_col)
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(
        F.any_value("space").alias("space"), F.any_value("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("min_id"))
    classes = stored(classes.mapInArrow(units, "cid string, space string, n long, min_id long, unit binary"))
    # One row for each label; the runtime splits a label of very many classes in this join.
    counts = classes.groupBy("space").agg(F.count("*").alias("classes"))
    many = lambda n: F.ceil(F.col("classes") / F.lit(n)).cast("int")
    placed = classes.join(counts.select("space", many(shard_rows).alias("shards"), many(block_rows).alias("blocks")), "space")
    part = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "cid"), F.col(of)).cast("int")
    placed = placed.withColumn("shard", part(3, "shards")).withColumn("block", part(5, "blocks"))
    index = stored(placed.select("space", "shard", "cid", "n", "min_id", "unit").groupBy("space", "shard")
                   .applyInArrow(shard_index(cosine), SHARD))
    keys = ["space", "shard", "block"]
    shards = index.join(counts.select("space", many(block_rows).alias("blocks")), "space").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    queries = placed.drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*keys, "cid", "unit")
    found = stored(shards.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(
        shard_queries(cosine), "cid string, links long, roots array<string>"))
    # A group's members link to its node's class, and what links to the group is in its component.
    edges = (found.select(F.col("cid").alias("a"), F.explode("roots").alias("b"))
             .unionByName(index.select(F.col("cid").alias("a"), F.col("root").alias("b"))).where("a <> b"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = (classes.select("cid", "n", "min_id").join(links, "cid", "left")
              .join(components(edges).withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    joined = stored(joined)
    smallest = joined.groupBy("component").agg(F.min("min_id").alias("component_id"))
    of_class = joined.join(smallest, "component").select(
        "cid", (F.greatest(F.coalesce("links", F.lit(0)), F.col("n")) - 1).alias("n_links"), "component_id")
    linked = rows.where("cid IS NOT NULL").select("vec_id", "cid").join(of_class, "cid").select("vec_id", "n_links", "component_id")
    alone = rows.where("cid IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
