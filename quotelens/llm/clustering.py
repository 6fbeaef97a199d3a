"""Operator 13: centroid clustering with JVM expressions.

Vectors become integers, so that every distance, sum and mean is exact and
runs agree whatever the partitions.  A round is one pass: ``zip_with`` and
``aggregate`` give the squared distances to the centroids, which are literals
of the plan, ``array_min`` of (distance, number) structs picks the nearest, and
one column sum per component and cluster, combined before the shuffle, gives
the next centroids.  Only k rows of sums reach the driver in a round; no
vector moves.

Defined cases: vectors that are NULL, have another number of components, or
hold a NULL or non-finite component are left out; rows with a NULL id are
clustered, but never start a centroid; repeated rows count as often as they
occur (of rows with one id, the least vector starts a centroid first); fewer
vectors than centroids leave fewer centroids; an empty table gives no rows.
Components count up to 2^26 after scaling; beyond, distances overflow and
Spark raises an arithmetic error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

CENTROIDS, ROUNDS, COMPONENTS, SCALE, SEED = 16, 3, 64, 64, 1


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): components as floor(scale * x); vectors with a NULL or non-finite component are left out."""
    x = F.transform(vectors[vec_col], lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.where(vectors[vec_col].isNotNull() & finite)
            .select(vectors[id_col].alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v")))


def start_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the k smallest sha256 of ``<seed>:<id>``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.where("id IS NOT NULL").select("v", h.alias("h")).orderBy("h", "v").limit(k)
    return [list(r["v"]) for r in first.collect()]


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid; ties go to the smaller number."""
    literal = F.expr("array({})".format(", ".join("array({})".format(", ".join(f"{x}L" for x in c)) for c in centroids)))

    def to(c: Column, i: Column) -> Column:
        squares = F.zip_with(v, c, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0).cast("long"), lambda s, x: s + x).alias("distance"),
                        i.cast("int").alias("cluster"))

    return F.array_min(F.transform(literal, to))


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid becomes its vectors' componentwise floor(sum / count)."""
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))]
    rows = (kept.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
            .groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect())  # k rows
    out = list(centroids)
    for r in rows:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS,
                    rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid (its components)."""
    spark = vectors.sparkSession
    kept = staged(scaled(vectors, id_col, vec_col, scale).where(F.size("v") == components), "vectors")
    centroids = start_centroids(kept, k, seed)
    if not centroids:
        return kept.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"),
                           F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"),
                           F.col("v").alias("centroid")).where(F.lit(False))
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    found = staged(kept.select("id", nearest(F.col("v"), centroids).alias("_n")).select("id", "_n.cluster", "_n.distance"), "clusters")
    total = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = spark.createDataFrame([(c, s, sum(total.values()), centroids[c]) for c, s in total.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return (found.join(F.broadcast(facts), "cluster")
            .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid"))


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
