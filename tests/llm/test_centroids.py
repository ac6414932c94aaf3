"""Centroid clustering against plain Python on hand-made rows."""

import hashlib
import math
import random

import pytest

from foliolens.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string, h string"


def plain(rows, clusters, rounds, dimensions, scale):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
             if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centres = [v for i, v in sorted(whole, key=lambda r: (r[0] is None, key(r[0]), r[1]))[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    place = lambda: [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in whole]
    for _ in range(rounds):
        at = place()
        for c in set(at):
            own = [v for (_, v), a in zip(whole, at) if a == c]
            centres[c] = [sum(column) // len(own) for column in zip(*own)]
    at = place()
    d = [far(v, centres[c]) for (_, v), c in zip(whole, at)]
    inertia = {c: sum(x for x, a in zip(d, at) if a == c) for c in set(at)}
    return sorted([(i, a, x, inertia[a], sum(d), hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest())
                   for (i, _), a, x in zip(whole, at, d)], key=repr)


def found(spark, rows, **parameters):
    rows = [(i, v and [x if x is None else float(x) for x in v], 0, "v", "c", "h") for i, v in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted([tuple(r) for r in centroids.digests(centroids.cluster(df, **parameters)).collect()], key=repr)


def random_rows(seed, n, dimensions):
    pick = random.Random(seed)
    # Multiples of 1/128 are exact as float: halves of a whole number test the floor of negative values.
    return [(pick.randrange(-20, n), [pick.randrange(-256, 256) / 128 for _ in range(dimensions)]) for _ in range(n)]


@pytest.mark.parametrize("n,clusters", [(60, 5), (200, 16), (3, 5), (1, 1)])
def test_clusters_equal_plain_python(spark, n, clusters):
    rows = random_rows(n, n, 4) + [(n + 5, None), (n + 6, []), (n + 7, [1.0] * 3), (n + 8, [1.0, None, 0.0, 0.0]),
                                   (n + 9, [math.nan, 0, 0, 0.0]), (n + 10, [-math.inf, 0, 0, 0.0]), (None, [0.0] * 4)]
    rows += [rows[0]] * 7  # a repeated row
    parameters = dict(clusters=clusters, rounds=3, dimensions=4, scale=64)
    assert found(spark, rows, **parameters) == plain(rows, **parameters)


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [0.5, -0.25]) for i in range(40)] + [(50, [3.0, 3.0])]
    parameters = dict(clusters=16, rounds=3, dimensions=2, scale=64)
    assert found(spark, rows, **parameters) == plain(rows, **parameters)


def test_empty_table_and_values_out_of_range(spark):
    assert found(spark, [(1, None)]) == [] and found(spark, []) == []
    with pytest.raises(Exception, match="beyond"):
        found(spark, [(1, [3e30, 0.0])], dimensions=2)


def test_distances_stay_in_expressions_of_the_jvm(spark):
    whole = centroids.whole_vectors(spark.createDataFrame([(i, v, 0, "", "", "") for i, v in random_rows(1, 50, 64)], SCHEMA))
    near = whole.select(centroids.nearest([[1] * 64, [2] * 64])["cluster"].alias("c")).groupBy("c").count()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" in plan and "array_min" in plan and "Python" not in plan and "Arrow" not in plan
