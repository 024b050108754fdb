"""Query registry and the adapters that give the driver tables the engine's shapes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from textwrap import dedent

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.lookups import with_group_size
from tidewatch.operators.sketches import RANK_ERROR
from tidewatch.operators.slicing import running_totals
from tidewatch.sources.files import spread


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a query; ``ctes`` are put in front of its SQL."""
    def register(fn: Callable[["Tables"], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        text = None
        if sql is not None:
            head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
            text = head + dedent(sql).strip()
        REGISTRY[name] = Query(run, text)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def within_rank(under: str, upto: str, n: str, q: float) -> Column:
    """Whether a value with these counts of smaller and of no greater values stands at rank ``q``, but for the sketches' error."""
    return (F.col(under) <= (q + RANK_ERROR) * F.col(n) + 1) & (F.col(upto) >= (q - RANK_ERROR) * F.col(n) - 1)


V_SNAP = """v_snap0 AS (
  SELECT CAST(user_id AS VARCHAR) AS video_id, event_id, CAST(ts AS TIMESTAMP) AS tracking_timestamp,
    value AS virality_score,
    CAST(SUM(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) OVER w AS BIGINT) AS view_count,
    CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS like_count,
    CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS comment_count,
    CASE WHEN event_type = 'error' THEN 1E0 ELSE 0E0 END AS pharma_risk_score
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v_snap AS (
  SELECT *, CASE WHEN view_count > 0 THEN CAST(like_count + comment_count AS DOUBLE) / view_count ELSE 0E0 END
    AS engagement_rate
  FROM v_snap0)"""

V_VIDEO = """v_video AS (
  SELECT CAST(doc_id AS VARCHAR) AS video_id, doc_id AS ord, source AS keyword, source AS channel_title,
    concat('Report from ', source, ' in ', lang) AS title, text AS description,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS published_at,
    concat('PT', CAST(doc_id % 3 AS VARCHAR), 'H', CAST(doc_id % 60 AS VARCHAR), 'M') AS duration,
    n_chars * 10 AS view_count, n_chars % 97 AS like_count, n_chars % 31 AS comment_count
  FROM documents)"""

V_COMMENT = """v_comment AS (
  SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS comment_id, text, length(text) % 11 AS like_count
  FROM conversations)"""

# Every document is kept; those without a vector share one more cluster.
V_SCORED = """v_scored AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS video_id, d.doc_id AS ord, d.source AS cluster_topic_name,
    d.lang AS topic_keywords, concat('Report from ', d.source, ' in ', d.lang) AS title,
    coalesce(e.label, 10) AS narrative_cluster_id,
    (d.n_chars * 31 % 1000) / 1000E0 AS viral_probability,
    coalesce(l.toxic, 0) * 0.5E0 + (d.n_chars % 50) / 100E0 AS toxicity_score,
    CAST(d.n_chars % 4 AS DOUBLE) AS pharma_risk_score,
    CASE WHEN d.n_chars % 4 > 0 THEN 'high_risk' ELSE 'low_risk' END AS pharma_risk_label,
    (d.n_chars * 7 % 500) / 10E0 AS trend_score,
    CAST(d.n_chars * 13 % 400 - 200 AS DOUBLE) AS growth_acceleration,
    d.n_chars * 97 % 300000 AS subscriber_count,
    CAST(COUNT(*) OVER (PARTITION BY coalesce(e.label, 10)) AS BIGINT) AS cluster_volume,
    (d.n_chars % 77) / 7E0 AS narrative_trend_score,
    CASE WHEN d.n_chars % 77 > 72 THEN 'emerging' ELSE 'normal' END AS emerging_narrative,
    CASE d.doc_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS sentiment_label,
    coalesce(l.quality, 0) AS viral_label, d.n_chars * 10 AS view_count
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


class Tables:
    """Driver tables of one scale, and the adapters over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def texts(self) -> DataFrame:
        """Documents for text-heavy work, dealt out over the cores if they came in a few files."""
        return spread(self.documents)

    def snapshot_events(self) -> DataFrame:
        """Events as increments, before they are summed up per item."""
        return self.events.selectExpr(
            "CAST(user_id AS STRING) AS video_id", "event_id", "CAST(ts AS TIMESTAMP) AS tracking_timestamp",
            "value AS virality_score", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS views",
            "CASE WHEN event_type = 'click' THEN 1L ELSE 0L END AS likes",
            "CASE WHEN event_type = 'error' THEN 1L ELSE 0L END AS comments",
            "CASE WHEN event_type = 'error' THEN 1E0 ELSE 0E0 END AS pharma_risk_score",
        )

    def snap(self) -> DataFrame:
        rows = running_totals(self.snapshot_events(), "video_id", ["tracking_timestamp", "event_id"], {
            "view_count": F.col("views"), "like_count": F.col("likes"), "comment_count": F.col("comments"),
        }).drop("views", "likes", "comments")
        rate = "CASE WHEN view_count > 0 THEN CAST(like_count + comment_count AS DOUBLE) / view_count ELSE 0E0 END"
        return rows.withColumn("engagement_rate", F.expr(rate))

    def video(self) -> DataFrame:
        return self.texts().selectExpr(
            "CAST(doc_id AS STRING) AS video_id", "doc_id AS ord", "source AS keyword",
            "source AS channel_title", "concat('Report from ', source, ' in ', lang) AS title",
            "text AS description",
            "TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS published_at",
            "concat('PT', CAST(doc_id % 3 AS STRING), 'H', CAST(doc_id % 60 AS STRING), 'M') AS duration",
            "n_chars * 10 AS view_count", "n_chars % 97 AS like_count", "n_chars % 31 AS comment_count",
        )

    def comment(self) -> DataFrame:
        return self.conversations.selectExpr(
            "CAST(conv_id AS STRING) AS video_id", "turn AS comment_id", "text", "CAST(length(text) % 11 AS BIGINT) AS like_count"
        )

    def scored(self) -> DataFrame:
        joined = (
            self.documents.alias("d")
            .join(self.embeddings.alias("e"), F.expr("d.doc_id = e.vec_id"), "left")
            .join(self.labels.alias("l"), F.expr("d.doc_id = l.doc_id"), "left")
        )
        rows = joined.selectExpr(
            "CAST(d.doc_id AS STRING) AS video_id", "d.doc_id AS ord", "d.source AS cluster_topic_name",
            "d.lang AS topic_keywords", "concat('Report from ', d.source, ' in ', d.lang) AS title",
            "coalesce(e.label, 10) AS narrative_cluster_id",
            "(d.n_chars * 31 % 1000) / 1000E0 AS viral_probability",
            "coalesce(l.toxic, 0) * 0.5E0 + (d.n_chars % 50) / 100E0 AS toxicity_score",
            "CAST(d.n_chars % 4 AS DOUBLE) AS pharma_risk_score",
            "CASE WHEN d.n_chars % 4 > 0 THEN 'high_risk' ELSE 'low_risk' END AS pharma_risk_label",
            "(d.n_chars * 7 % 500) / 10E0 AS trend_score",
            "CAST(d.n_chars * 13 % 400 - 200 AS DOUBLE) AS growth_acceleration",
            "d.n_chars * 97 % 300000 AS subscriber_count",
            "(d.n_chars % 77) / 7E0 AS narrative_trend_score",
            "CASE WHEN d.n_chars % 77 > 72 THEN 'emerging' ELSE 'normal' END AS emerging_narrative",
            "CASE d.doc_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS sentiment_label",
            "coalesce(l.quality, 0) AS viral_label", "d.n_chars * 10 AS view_count",
        )
        return with_group_size(rows, "narrative_cluster_id", "cluster_volume", bounded=True)
