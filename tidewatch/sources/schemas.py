"""Declared schemas of the tables. Raw files are read as text and typed afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatch.constants import HISTORY_DDL

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def table(columns: str) -> T.StructType:
    """Schema of a flat ``name type, ...`` list, without needing a session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


VIDEO_RAW = table(
    "keyword string, video_id string, title string, description string, channel_id string, "
    "channel_title string, channel_subscriber_count bigint, published_at timestamp, url string, "
    "duration string, category_id string, tags string, view_count bigint, like_count bigint, "
    "favorite_count bigint, comment_count bigint, definition string, caption string, "
    "licensed_content boolean, transcript_status string, transcript_language string, "
    "transcript string, share_count string, comments_text_full string, extracted_at timestamp"
)

COMMENT_RAW = table(
    "keyword string, video_id string, comment_id string, author string, "
    "author_channel_url string, text string, like_count bigint, published_at timestamp, "
    "updated_at timestamp, extracted_at timestamp"
)

SNAPSHOT = table(
    "video_id string, keyword string, snapshot_time timestamp, published_at timestamp, "
    "minutes_since_publish double, title string, channel_id string, channel_title string, "
    "channel_subscriber_count bigint, url string, duration string, view_count bigint, "
    "like_count bigint, favorite_count bigint, comment_count bigint, share_count string, "
    "comments_text_full string, comments_count_fetched bigint, top_comment_like_total bigint, "
    "transcript_language string, transcript string"
)

TRACKING_HISTORY = table(HISTORY_DDL + ", tracking_timestamp timestamp")

# Nested payloads, as DDL for from_json.
VIDEO_ITEM = (
    "id string, "
    "snippet struct<title:string, description:string, channelId:string, channelTitle:string, "
    "publishedAt:string, categoryId:string, tags:array<string>>, "
    "statistics struct<viewCount:string, likeCount:string, favoriteCount:string, "
    "commentCount:string>, "
    "contentDetails struct<duration:string, definition:string, caption:string, "
    "licensedContent:boolean>"
)

CHANNEL_ITEM = ("id string, statistics struct<subscriberCount:string>")

COMMENT_PAGE = (
    "items array<struct<id:string, snippet:struct<topLevelComment:struct<snippet:struct<"
    "authorDisplayName:string, authorChannelUrl:string, textDisplay:string, likeCount:bigint, "
    "publishedAt:string, updatedAt:string>>>>>"
)


def as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
