"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.shared import hot_keys, join_by_key, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): for every node of the edges (a, b) the least node that it is connected with.

    Every round links the neighbours of each node to the least of them, first the greater neighbours, then the lesser ones; after a number of rounds that grows with the logarithm of the
    longest path only stars are left. A node with very many neighbours is summed up before a shuffle and dealt out by a salt in the joins that follow. Repeated edges and edges from a node to itself change nothing,
    edges with a null end are passed over, other columns are not read, and without edges there are no rows.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = written(join_by_key(both.where("v > u"), least.select("u", "m"), "u", hot_keys(least, "u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        lesser = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_by_key(large, lesser.select("a", "m"), "a", hot_keys(lesser, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(lesser.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        now = written(small)
        if (new := _state(now)) == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
