"""Near-duplicate vectors against all pairs, with shards and blocks of few rows."""

import math

import numpy as np
import pytest

from foliolens.llm import hnsw, vector_copies

SCHEMA = "vec_id long, embedding array<double>, label int, cid string, space string, n long"


def plain(rows, cosine=0.93):
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(good):
        for b in good[:k]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and unit[a] @ unit[b] >= cosine:
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            smallest[find(i)] = min(smallest.get(find(i), v), v)
    return sorted([(v, links[i], smallest.get(find(i)), v == smallest.get(find(i))) for i, (v, _, _) in enumerate(rows)], key=repr)


def found(spark, rows, **parameters):
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], label, "c", "s", 5) for i, v, label in rows], SCHEMA)
    out = vector_copies.near_copies(df, **parameters)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted([tuple(r) for r in out.collect()], key=repr)


def crowd(seed, n, dimensions=16):
    """Vectors alone, tight crowds, wide crowds about the limit, chains and exact copies."""
    draw = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre, kind = draw.standard_normal(dimensions), draw.integers(5)
        size, noise = [(1, 0), (12, 0.05), (25, 0.27), (8, 0.25), (4, 0)][kind]
        for _ in range(size):
            out.append((centre + noise * draw.standard_normal(dimensions)).tolist())
            if kind == 3:
                centre = np.array(out[-1])
    return [(int(i), v, int(draw.integers(2))) for i, v in zip(draw.permutation(3 * len(out)), out)]


@pytest.mark.parametrize("parameters", [{}, dict(shard_rows=40, block_rows=30)])
def test_links_equal_all_pairs(spark, parameters):
    rows = crowd(1, 400)
    one = rows[0][1]
    rows += [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [math.nan] * 16, 1), (9005, [math.inf] + [0.0] * 15, 0),
             (9006, [None] + [1.0] * 15, 0), (9007, one, None), (9008, one, 0), (9009, one, 1), (9008, [x * 1e300 for x in one], 0),
             (9010, [x * 1e-300 for x in one], 1), (9011, one[:8], 0), (None, one, 0), (None, [1.0] + [0.0] * 15, 5), rows[0], rows[0],
             (9012, [-0.0, 1.0], 7), (9013, [0.0, 1.0], 7), (9014, [1.0, 0.0], 7)]
    assert found(spark, rows, **parameters) == plain(rows)


def test_hot_crowd_makes_no_pairs(spark):
    """Half of all vectors are near copies of one; what is kept between jobs stays a few rows each."""
    draw = np.random.default_rng(4)
    centre = draw.standard_normal(16)
    rows = [(i, (centre + 0.05 * draw.standard_normal(16) if i % 2 else draw.standard_normal(16)).tolist(), 1) for i in range(800)]
    assert found(spark, rows, shard_rows=300, block_rows=200) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, None), (1, None, 2)]) == [(1, 0, 1, True)] * 2


@pytest.mark.parametrize("n", [1, 2, 700, 3000])
def test_graph_finds_what_is_within_the_limit(n):
    """Graph search against all pairs: recall of at least 0.99 also for planted pairs at the limit."""
    draw = np.random.default_rng(n)
    x = draw.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = draw.standard_normal(x[: n // 4].shape)
    x[n - n // 4:] = x[: n // 4] + 0.39 * away / np.linalg.norm(away, axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[draw.permutation(n)]
    levels = np.minimum(6, (-np.log(draw.random(n)) / math.log(hnsw.DEGREE)).astype(int)).astype(np.int8)
    graph, leaders, node = hnsw.built(x, levels, math.cos(0.18))
    assert graph.size <= n and (np.einsum("qd,qd->q", x, x[leaders[node]]) >= math.cos(0.18) - 1e-9).all()
    width = hnsw.audited_width(graph, x, node, 0.93, 0.84)
    got = graph.within(x.astype(np.float32), 0.84, width)
    truth = np.argwhere(x.astype(np.float32) @ graph.vectors.T >= 0.84)
    assert len(set(zip(*got)) & set(map(tuple, truth))) >= 0.99 * len(truth) and len(got[0]) <= len(truth)
    assert all((layer < graph.size).all() for layer in graph.links) and graph.links[0].shape == (graph.size, 2 * hnsw.DEGREE)
