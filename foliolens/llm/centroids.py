"""Centroid clustering of vectors in whole numbers, by DataFrame functions alone.

A component x becomes floor(``scale`` * x). The squared distance to a centroid is ``zip_with``
and ``aggregate`` over the vector and a literal array, ``array_min`` of (distance, number)
structs picks the nearest (ties: the smaller number), and a round's new centroids come from one
aggregate of as many column sums as there are components, which combines before its shuffle:
at most ``clusters`` rows leave a task or reach the driver, whatever the sizes of clusters.
The whole numbers are written once; each round is one scan of them.

Sums and distances are exact: a component of over ``LARGEST`` in absolute value is an error,
since its squared distances could leave 64 bits. Vectors that are null, of another length, or
hold null or non-finite components are left out. Rows that share a vec_id are vectors of their
own; among the first centroids, ties of the keyed hash (the same vec_id) go by the components,
and a null vec_id comes last. Fewer vectors than ``clusters`` give fewer centroids, an empty
table no rows. A text of any length plays no part; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
LARGEST = 2**27


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                  dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the usable vectors as arrays of whole numbers."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where((F.size(vector_col) == dimensions) & finite)
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    checked = lambda x: F.when(F.abs(scaled(x)) < LARGEST, F.floor(scaled(x))).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, checked).alias("v"))


def nearest(centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid to ``v``."""
    def distance(centroid):
        squares = F.zip_with("v", F.lit(centroid).cast("array<long>"), lambda x, y: (x - y) * (x - y))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, d: total + d)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster"))
                                 for i, c in enumerate(centroids)]))


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest keyed hashes of their ids: a top-k, no full sort."""
    hashed = whole.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [list(r["v"]) for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()]


def moved(whole: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floor of each cluster's mean; empty clusters stay."""
    places = range(len(centroids[0]))
    near = whole.select(nearest(centroids)["cluster"].alias("cluster"), *[F.col("v")[i].alias(f"x{i}") for i in places])
    sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in places])
    new = list(centroids)
    for row in sums.collect():  # at most one row for each centroid
        new[row["cluster"]] = [row[f"x{i}"] // row["n"] for i in places]
    return new


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per usable vector: vec_id, v (its whole numbers), cluster, distance (squared, to the final
    centroid), cluster_inertia and inertia (distances summed), centroid (the final one)."""
    whole = stored(whole_vectors(vectors, id_col, vector_col, dimensions, scale))
    centroids = first_centroids(whole, clusters, seed)
    if not centroids:
        return whole.select("vec_id", "v", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in (
            "distance", "cluster_inertia", "inertia")], F.col("v").alias("centroid"))
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    placed = stored(whole.select("vec_id", "v", nearest(centroids).alias("near"))
                    .select("vec_id", "v", "near.cluster", "near.distance"))
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of_cluster = F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centroids))])
    final = F.array(*[F.lit(c).cast("array<long>") for c in centroids])
    return placed.withColumns({"cluster_inertia": of_cluster[F.col("cluster")],
                               "inertia": F.lit(sum(inertia.values())).cast("long"), "centroid": final[F.col("cluster")]})


def digests(clustered: DataFrame) -> DataFrame:
    """The rows of ``cluster`` with a sha256 of the centroid in place of the arrays."""
    joined = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(joined, 256).alias("centroid_sha256"))
