"""Connected components of an edge table by alternating star steps.

A large-star step ties every larger neighbour of a node to the node's smallest
neighbour, a small-star step does so with the smaller ones (Kiveris et al.,
"Connected Components in MapReduce and Beyond").  Both are a minimum per node,
which combines before the shuffle, and a join back, whose hot keys adaptive
execution splits; no neighbourhood is collected.  Every round is a table in
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.llm.base import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m")
    )
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a")
    return (
        tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b"))).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge table (a, b); the root is the component's smallest node."""
    seen = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "components")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == seen or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(now)
