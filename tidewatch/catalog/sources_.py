"""A: sources and sinks. Files are derived from the driver tables by Spark, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.models_ import trained
from tidewatch.catalog.registry import V_SCORED, V_VIDEO, Tables, query, rounded
from tidewatch.operators.alerts import Thresholds, fan_out, prepare
from tidewatch.plans import virality
from tidewatch.session import scratch_path
from tidewatch.sources import files, payloads, sinks, terms
from tidewatch.sources.schemas import table

URL = "https://media.example/watch?v="
DOC = table("doc_id bigint, text string, lang string, source string, n_chars bigint")
EVENT = table("event_id bigint, user_id bigint, event_type string, value double, ts timestamp")


def _csv(t: Tables, df, name: str) -> str:
    path = scratch_path(t.spark, name)
    (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@query("a1_raw_csv", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars
    FROM documents""")
def a1(t: Tables):
    return files.read_raw_csv(t.spark, _csv(t, t.documents, "a1"), DOC)


@query("a2_typed_csv", """
    SELECT event_id, user_id, event_type, round(value, 6) AS value, epoch_us(ts) AS ts_us FROM events""")
def a2(t: Tables):
    stamped = t.events.select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))
    rows = files.read_typed_csv(t.spark, _csv(t, stamped, "a2"), EVENT, multiline=False)
    return rounded(rows.withColumn("ts_us", F.unix_micros("ts")).drop("ts"))


@query("a3_optional_source", "SELECT doc_id, source FROM documents")
def a3(t: Tables):
    present = files.read_optional(t.spark, f"{t.dir}/documents.parquet", DOC)
    absent = files.read_optional(t.spark, f"{t.dir}/not_there.parquet", DOC)
    return present.unionByName(absent).select("doc_id", "source")


@query("a4_latest_file", "SELECT event_id, user_id, 2 AS version FROM events")
def a4(t: Tables):
    root = scratch_path(t.spark, "a4")
    for version in (1, 2):
        rows = t.events.select("event_id", "user_id", F.lit(version).alias("version"))
        rows.write.parquet(f"{root}/export_{version}")
    schema = table("event_id bigint, user_id bigint, version int")
    return files.read_latest(t.spark, f"{root}/export_*", schema, folders=True)


@query("a5_column_pruned_read", "SELECT CAST(doc_id AS VARCHAR) AS video_id FROM documents")
def a5(t: Tables):
    return files.read_columns(t.spark, f"{t.dir}/documents.parquet", ["doc_id"]).select(
        F.col("doc_id").cast("string").alias("video_id")
    )


@query("a6_overwrite_sink", "SELECT doc_id, text, lang, source, n_chars, 2 AS twins FROM documents")
def a6(t: Tables):
    path, twin = scratch_path(t.spark, "a6"), scratch_path(t.spark, "a6-csv")
    sinks.overwrite(t.documents.withColumn("text", F.lit("stale")), path)
    sinks.overwrite(t.documents, path, twin)
    stored = t.spark.read.schema(DOC).parquet(path)
    copy = files.read_typed_csv(t.spark, twin, DOC).select("doc_id", F.xxhash64("text").alias("h"))
    both = stored.withColumn("h", F.xxhash64("text")).join(copy, ["doc_id", "h"], "left_semi").drop("h")
    return both.withColumn("twins", F.lit(2))


@query("a7_append_sink", """
    SELECT event_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS ingest_date FROM events
    UNION ALL SELECT event_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) FROM events WHERE event_type = 'error'""")
def a7(t: Tables):
    path = scratch_path(t.spark, "a7")
    rows = t.events.select("event_id", "event_type", "ts")
    sinks.append(rows, path, "ts")
    sinks.append(rows.where("event_type = 'error'"), path, "ts")
    stored = t.spark.read.parquet(path)
    return stored.select("event_id", "event_type", F.col("ingest_date").cast("string").alias("ingest_date"))


@query("a8_empty_result_sink", """
    SELECT video_id, title, '' AS channel_title, '' AS alert_type, '' AS alert_priority, '' AS alert_reason,
      0E0 AS alert_score, 0E0 AS ravs_score, viral_probability
    FROM v_scored WHERE viral_probability > 2""", V_SCORED)
def a8(t: Tables):
    nothing = fan_out(prepare(t.scored()), Thresholds(viral=2.0, toxicity=2.0, risk=99.0))
    path = scratch_path(t.spark, "a8")
    sinks.write_alerts(nothing, path)
    return t.spark.read.parquet(path)


def _item_json(t: Tables):
    return t.video().withColumn("payload", F.to_json(F.struct(
        F.col("video_id").alias("id"),
        F.struct(
            "title", "description", F.col("keyword").alias("channelId"),
            F.when(F.length("description") > 1000, F.col("channel_title")).alias("channelTitle"),
            F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
            F.array("keyword", F.lit("tag")).alias("tags"),
        ).alias("snippet"),
        F.struct(
            F.col("view_count").cast("string").alias("viewCount"),
            F.when(F.col("like_count") > 10, F.col("like_count").cast("string")).alias("likeCount"),
        ).alias("statistics"),
        F.struct("duration", F.lit(True).alias("licensedContent")).alias("contentDetails"),
    )))


@query("a9_flatten_items", f"""
    SELECT video_id, title, description, keyword AS channel_id,
      CASE WHEN length(description) > 1000 THEN channel_title ELSE '' END AS channel_title,
      epoch_us(published_at) AS published_us, concat('{URL}', video_id) AS url, duration, '' AS category_id,
      concat(keyword, '|tag') AS tags, view_count,
      CASE WHEN like_count > 10 THEN like_count ELSE 0 END AS like_count, CAST(0 AS BIGINT) AS comment_count,
      true AS licensed_content, 'not_available' AS share_count
    FROM v_video""", V_VIDEO)
def a9(t: Tables):
    rows = payloads.flatten_items(_item_json(t), URL)
    return rows.withColumn("published_us", F.unix_micros("published_at")).drop(
        "published_at", "favorite_count", "definition", "caption"
    )


@query("a10_flatten_snapshots", f"""
    SELECT video_id, title, keyword AS channel_id, epoch_us(published_at) AS published_us, duration,
      concat('{URL}', video_id) AS url, view_count,
      round((epoch_us(TIMESTAMP '2025-01-01 00:00:30') - epoch_us(published_at)) / 6E7, 2) AS minutes_since_publish
    FROM v_video""", V_VIDEO)
def a10(t: Tables):
    rows = payloads.flatten_snapshots(_item_json(t), URL, F.expr("TIMESTAMP '2025-01-01 00:00:30'"))
    return rows.select(
        "video_id", "title", "channel_id", F.unix_micros("published_at").alias("published_us"), "duration", "url",
        "view_count", "minutes_since_publish",
    )


@query("a11_flatten_comments", """
    SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(turn AS VARCHAR) AS comment_id, role AS author, text,
      CASE WHEN turn > 2 THEN length(text) % 11 ELSE 0 END AS like_count
    FROM conversations""")
def a11(t: Tables):
    thread = F.struct(
        F.col("turn").cast("string").alias("id"),
        F.struct(F.struct(F.struct(
            F.col("role").alias("authorDisplayName"), F.col("text").alias("textDisplay"),
            F.when(F.col("turn") > 2, F.length("text") % 11).alias("likeCount"),
        ).alias("snippet")).alias("topLevelComment")).alias("snippet"),
    )
    pages = t.conversations.select(
        F.col("conv_id").cast("string").alias("video_id"), F.to_json(F.struct(F.array(thread).alias("items"))).alias("payload")
    )
    return payloads.flatten_comments(pages, keep=["video_id"]).select(
        "video_id", "comment_id", "author", "text", "like_count"
    )


@query("a12_term_list", r"""
    SELECT term, min(ord) AS ord FROM lines WHERE term <> '' AND NOT starts_with(term, '#') GROUP BY term""", r"""lines AS (
      SELECT doc_id * 1000000 + i AS ord, regexp_replace(string_split(text, chr(10))[i + 1], '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS term
      FROM documents, unnest(range(len(string_split(text, chr(10))))) AS u(i))""")
def a12(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    numbered = lines.select((F.col("doc_id") * 1_000_000 + F.col("i")).alias("ord"), "line")
    return terms.distinct_terms(terms.file_terms(numbered, "ord", "line"))


@query("a13_model_save_load")
def a13(t: Tables):
    done = trained(t)
    path = scratch_path(t.spark, "a13")
    virality.save(done.model, path)
    scored = virality.predict(virality.load(path), t.scored(), done.features)
    return scored.select("video_id", "viral_probability", "predicted_viral")
