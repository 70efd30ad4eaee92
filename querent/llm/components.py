"""Connected components over an edge table, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import materialize, new_path, remove


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that can be reached.

    Alternates large-star and small-star steps: each replaces a node's edges by edges to the smallest
    neighbour, so a hub with any number of neighbours costs one row per neighbour and its minimum is
    combined before the shuffle. Every round is written to the shared folder. Self-loops and nulls in
    edges are ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    kind = edges.schema[left].dataType
    now = edges.select(F.col(left).alias("a"), F.col(right).cast(kind).alias("b")).where("a <> b")
    now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = new_path(spark, "edges")
    now = materialize(now, "edges", path)
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.where("b > a").join(least, "a")
            .select(F.col("b").alias("x"), F.least("a", "m").alias("y"))
        )
        large = large.where("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y")
        after = small.union(low.select("x", "m")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        fresh = new_path(spark, "edges")
        after = materialize(after, "edges", fresh)
        stats = after.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        state = (stats["n"], stats["h"])
        remove(spark, path)
        now, path = after, fresh
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components: not settled; raise max_rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(now.select("b", "b")).groupBy("node").agg(F.min("root").alias("root"))
