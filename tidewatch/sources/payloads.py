"""Flattening of API payloads (JSON text) into the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import number
from tidewatch.functions.temporal import minutes_since, utc
from tidewatch.sources.schemas import CHANNEL_ITEM, COMMENT_PAGE, VIDEO_ITEM

SHARES = "not_available"


def _text(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(""))


def _count(path: str) -> Column:
    return number(F.col(path)).cast("bigint")


def channel_stats(df: DataFrame, json_col: str = "payload") -> DataFrame:
    """(channel_id, channel_subscriber_count) from channel payloads."""
    item = df.select(F.from_json(F.col(json_col), CHANNEL_ITEM).alias("c"))
    return item.select(
        F.col("c.id").alias("channel_id"),
        _count("c.statistics.subscriberCount").alias("channel_subscriber_count"),
    )


def _item_columns(url_prefix: str) -> dict[str, Column]:
    return {
        "video_id": _text("v.id"),
        "title": _text("v.snippet.title"),
        "description": _text("v.snippet.description"),
        "channel_id": _text("v.snippet.channelId"),
        "channel_title": _text("v.snippet.channelTitle"),
        "published_at": utc(F.col("v.snippet.publishedAt")),
        "url": F.concat(F.lit(url_prefix), _text("v.id")),
        "duration": _text("v.contentDetails.duration"),
        "category_id": _text("v.snippet.categoryId"),
        "tags": F.coalesce(F.array_join("v.snippet.tags", "|"), F.lit("")),
        "view_count": _count("v.statistics.viewCount"),
        "like_count": _count("v.statistics.likeCount"),
        "favorite_count": _count("v.statistics.favoriteCount"),
        "comment_count": _count("v.statistics.commentCount"),
        "definition": _text("v.contentDetails.definition"),
        "caption": _text("v.contentDetails.caption"),
        "licensed_content": F.col("v.contentDetails.licensedContent"),
        "share_count": F.lit(SHARES),
    }


def flatten_items(df: DataFrame, url_prefix: str, json_col: str = "payload", keep: list[str] = ()) -> DataFrame:
    """Video payloads to raw item rows; missing nested fields become "" or 0."""
    parsed = df.select(*keep, F.from_json(F.col(json_col), VIDEO_ITEM).alias("v"))
    return parsed.select(*keep, *[c.alias(n) for n, c in _item_columns(url_prefix).items()])


def flatten_snapshots(df: DataFrame, url_prefix: str, snapshot_time: Column, json_col: str = "payload", keep: list[str] = ()) -> DataFrame:
    """Video payloads to snapshot rows taken at ``snapshot_time``."""
    rows = flatten_items(df, url_prefix, json_col, keep)
    rows = rows.withColumn("snapshot_time", snapshot_time)
    rows = rows.withColumn(
        "minutes_since_publish", minutes_since(F.col("published_at"), F.col("snapshot_time"))
    )
    return rows.drop("description", "category_id", "tags", "definition", "caption", "licensed_content")


def flatten_comments(df: DataFrame, json_col: str = "payload", keep: list[str] = ()) -> DataFrame:
    """Comment-thread pages to one row per top-level comment."""
    pages = df.select(*keep, F.from_json(F.col(json_col), COMMENT_PAGE).alias("p"))
    items = pages.select(*keep, F.explode("p.items").alias("i"))
    s = "i.snippet.topLevelComment.snippet"
    return items.select(
        *keep,
        _text("i.id").alias("comment_id"),
        _text(f"{s}.authorDisplayName").alias("author"),
        _text(f"{s}.authorChannelUrl").alias("author_channel_url"),
        _text(f"{s}.textDisplay").alias("text"),
        F.coalesce(F.col(f"{s}.likeCount"), F.lit(0)).alias("like_count"),
        utc(F.col(f"{s}.publishedAt")).alias("published_at"),
        utc(F.col(f"{s}.updatedAt")).alias("updated_at"),
    )
