"""Connected components as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b), root being its smallest node.

    Alternating large-star and small-star steps: each hangs a node's neighbours on the smallest of
    them, until nothing changes. Minima are combined before the shuffle; the joins have one row per
    node on one side, so that AQE can split a hub. Every round is a written table, so lineage stays
    short and a lost executor costs one round at most.
    """
    current = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node hang on the smallest of its neighbourhood.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(low.toDF("a", "b"))
        current = stage(small.distinct(), name)
        before, mark = mark, _mark(current)
        if mark == before:
            break
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
