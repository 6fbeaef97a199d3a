"""Connected components of a link table, as Spark jobs.

Each task first contracts its own links with union-find (a forest has fewer
links than nodes), then large-star and small-star steps alternate: a node's
neighbours are tied to the least of them until every component is a star
around its least node.  Every step is a grouping with a partial minimum and a
join; step tables are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, staged


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one task's batches of links; yields (node, least node of its local tree)."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        links = [(x, root(x)) for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()),
                                          pa.array([y for _, y in links], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (u, v), both long; the component is its least node."""
    ship(links.sparkSession)
    edges = staged(links.select("u", "v").mapInArrow(_forest, "u long, v long").distinct(), "stars")
    while True:
        # large star: larger neighbours of a node go to the least node around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = staged(small, "stars")
        # done when every node has one link, to a node without a smaller one
        low = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        centres = after.select(F.col("v").alias("u")).distinct()
        if low.where("n > 1").isEmpty() and low.join(centres, "u", "left_semi").isEmpty():
            return (after.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionByName(centres.select(F.col("u").alias("node"), F.col("u").alias("component"))))
        edges = after
