"""Connected components of an edge table, by alternating stars in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``edges`` (a, b; any order, loops allowed).

    Each round hangs a node's larger neighbours on its smallest one, then the smaller
    ones, and writes the edges anew. A round has aggregates with a map side and joins that may be
    split, so a hub costs no task its size. Ends when a round changes nothing, after about log(n) rounds.
    """
    spark = edges.sparkSession
    now = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    if not state[0]:
        return spark.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, root {edges.schema['b'].dataType.simpleString()}")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.materialize(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = common.materialize(small, "edges")
        common.discard(large)
        common.discard(now)
        now, before, state = new, state, _state(new)
        if state == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
