"""Group statistics. All of them combine on the map side, so a hot group costs no extra shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_sizes(df: DataFrame, key: str, out: str = "cluster_volume") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(out))


def count_and_mean(df: DataFrame, key: str, counted: str, averaged: str, n: str = "n", mean: str = "mean") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(counted).alias(n), F.avg(averaged).alias(mean)
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(
        F.count("*").alias("n")
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts over equal bins of [0, 1]; 1.0 belongs to the last bin."""
    numbered = F.least(F.width_bucket(F.col(column), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return df.where(F.col(column).isNotNull()).groupBy(numbered.cast("int").alias("bin")).agg(
        F.count("*").alias("n")
    )


def comment_summary(comments: DataFrame) -> DataFrame:
    return comments.groupBy("video_id").agg(
        F.count("*").alias("comments_count_fetched"),
        F.sum(F.coalesce("like_count", F.lit(0))).alias("top_comment_like_total"),
    )


def group_mode(df: DataFrame, key: str, column: str) -> DataFrame:
    """Most frequent value per group, the smallest among equals.

    Values are counted first, so a large group arrives as a handful of counts.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("_n"))
    return counted.groupBy(key).agg(
        F.min_by(F.col(column), F.struct(-F.col("_n"), F.col(column))).alias(column)
    )


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent non-null value of each column (smallest among equals), as plain values."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("p")
    rows = df.select(pairs).select("p.*")
    return {r["feature"]: r["value"] for r in group_mode(rows, "feature", "value").collect()}
