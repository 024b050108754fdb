"""Joins: new rows, attached details, refreshed metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.constants import LIVE_METRICS
from tidewatch.functions.numeric import number
from tidewatch.functions.text import blank_to_null

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def new_rows(df: DataFrame, done: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows whose id is not in ``done``, compared as text; rows without an id count as new.

    Rows without an id cannot match, so they pass by the join and are never shuffled into
    one place. Repeated ids on the left are split by AQE's skew handling.
    """
    seen = done.select(F.col(key).cast("string").alias("_id")).where("_id is not null").distinct()
    named = df.where(F.col(key).isNotNull()).withColumn("_id", F.col(key).cast("string"))
    unseen = named.join(seen, "_id", "left_anti").drop("_id")
    return unseen.unionByName(df.where(F.col(key).isNull()))


def small(dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring that the side is small in rows and bytes; else leave the choice to AQE."""
    wide = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in dim.columns]
    size = F.coalesce(F.sum(sum(wide[1:], wide[0])), F.lit(0))
    rows, held = dim.limit(max_rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(dim) if rows <= max_rows and held <= max_bytes else dim


def lookup(df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, Column], bounded: bool = False) -> DataFrame:
    """Left join on a table with one row per key, with a default for what is not found.

    ``bounded=True`` is for tables whose size is fixed by construction (clusters, topics).
    """
    wanted = dim.select(key, *defaults)
    joined = df.join(F.broadcast(wanted) if bounded else small(wanted), key, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), d) for n, d in defaults.items()})


def attach_comments(df: DataFrame, comment_texts: DataFrame) -> DataFrame:
    """Fill a blank ``comments_text_full`` from (video_id, comments_text) rows."""
    own = blank_to_null(F.col("comments_text_full")) if "comments_text_full" in df.columns else F.lit(None)
    joined = df.join(comment_texts.select("video_id", "comments_text"), "video_id", "left")
    filled = F.coalesce(own.cast("string"), F.col("comments_text"), F.lit(""))
    return joined.withColumn("comments_text_full", filled).drop("comments_text")


def refresh_metrics(df: DataFrame, latest: DataFrame | None) -> DataFrame:
    """Replace counts by the newest snapshot; items without one get 0. No table, no change."""
    if latest is None:
        return df
    live = [c for c in LIVE_METRICS if c in latest.columns]
    stale = [c for c in LIVE_METRICS if c in df.columns]
    joined = df.drop(*stale).join(latest.select("video_id", *live), "video_id", "left")
    return joined.withColumns({c: number(c) for c in live})


def attach_predictions(df: DataFrame, predictions: DataFrame, order: str) -> DataFrame:
    """Attach each item's first prediction by ``order``, which must tell an item's predictions apart."""
    from tidewatch.operators.ranking import first_per_key

    wanted = [c for c in ("viral_probability", "predicted_viral") if c in predictions.columns]
    one = first_per_key(predictions, ["video_id"], [F.col(order).asc_nulls_last()]).select("video_id", *wanted)
    return df.drop(*wanted).join(one, "video_id", "left")


def resolvable(targets: DataFrame, details: DataFrame, key: str = "video_id") -> DataFrame:
    """Targets for which a payload exists."""
    return targets.join(details.select(key), key, "left_semi")


def with_group_size(df: DataFrame, key: str, out: str = "cluster_volume", sizes: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """Rows per group as a column.

    Counted by a partial aggregate and joined back, so a large group is never gathered in one
    task. ``bounded=True`` is for groups that are clusters, of which there are at most fifty; a table
    of any other groups is measured before it is broadcast.
    """
    if sizes is None:
        sizes = df.groupBy(key).agg(F.count("*").alias(out))
    return df.join(F.broadcast(sizes) if bounded else small(sizes), key, "left")
