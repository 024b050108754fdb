"""C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import V_COMMENT, V_SCORED, V_SNAP, V_VIDEO, Tables, query, rounded
from tidewatch.catalog.shaping_ import STRIP
from tidewatch.operators import lookups, narratives
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.ranking import latest_values
from tidewatch.plans.cleaning import comment_texts

V_LATEST = """v_latest AS (
  SELECT video_id,
    last(view_count ORDER BY tracking_timestamp NULLS LAST, event_id) FILTER (WHERE view_count IS NOT NULL) AS view_count,
    last(like_count ORDER BY tracking_timestamp NULLS LAST, event_id) FILTER (WHERE like_count IS NOT NULL) AS like_count,
    last(comment_count ORDER BY tracking_timestamp NULLS LAST, event_id) FILTER (WHERE comment_count IS NOT NULL) AS comment_count
  FROM v_gaps GROUP BY video_id)"""

# Snapshots with missing values and times, as failed fetches leave them.
V_GAPS = """v_gaps AS (
  SELECT video_id, event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE tracking_timestamp END AS tracking_timestamp,
    CASE WHEN event_id % 2 = 0 THEN view_count END AS view_count,
    CASE WHEN event_id % 3 > 0 THEN like_count END AS like_count, comment_count
  FROM v_snap)"""


def gaps(t: Tables):
    return t.snap().selectExpr(
        "video_id", "event_id", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE tracking_timestamp END AS snapshot_time",
        "CASE WHEN event_id % 2 = 0 THEN view_count END AS view_count",
        "CASE WHEN event_id % 3 > 0 THEN like_count END AS like_count", "comment_count",
    )


def latest(t: Tables):
    return latest_values(gaps(t), "video_id", "snapshot_time", "event_id", ["view_count", "like_count", "comment_count"])


@query("c1_new_rows_only", """
    SELECT video_id, title FROM v_video WHERE video_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
    UNION ALL SELECT NULL, source FROM documents""", V_VIDEO)
def c1(t: Tables):
    unnamed = t.documents.select(F.lit(None).cast("string").alias("video_id"), F.col("source").alias("title"))
    done = t.labels.select(F.col("doc_id").alias("video_id"))
    return lookups.new_rows(t.video().select("video_id", "title").unionByName(unnamed), done)


@query("c2_attach_comment_text", """
    SELECT v.video_id, coalesce(CASE WHEN v.ord % 4 = 0 THEN v.title END, c.comments_text, '') AS comments_text_full
    FROM v_video v LEFT JOIN texts c ON v.video_id = c.video_id""", V_VIDEO, V_COMMENT, f"""texts AS (
      SELECT video_id, string_agg({STRIP.format('text')}, chr(10) || chr(10) ORDER BY comment_id) AS comments_text
      FROM v_comment WHERE {STRIP.format('text')} <> '' GROUP BY video_id)""")
def c2(t: Tables):
    rows = t.video().selectExpr("video_id", "CASE WHEN ord % 4 = 0 THEN title ELSE ' ' END AS comments_text_full")
    return lookups.attach_comments(rows, comment_texts(t.comment()))


@query("c3_overwrite_live_metrics", """
    SELECT v.video_id, v.title, CAST(coalesce(l.view_count, 0) AS DOUBLE) AS view_count,
      CAST(coalesce(l.like_count, 0) AS DOUBLE) AS like_count, CAST(coalesce(l.comment_count, 0) AS DOUBLE) AS comment_count
    FROM v_video v LEFT JOIN v_latest l ON v.video_id = l.video_id""", V_SNAP, V_GAPS, V_LATEST, V_VIDEO)
def c3(t: Tables):
    rows = t.video().select("video_id", "title", "view_count", "like_count", "comment_count")
    return lookups.refresh_metrics(rows, latest(t))


@query("c4_attach_group_size", """
    SELECT video_id, cluster_topic_name, count(*) OVER (PARTITION BY cluster_topic_name) AS cluster_volume
    FROM v_scored""", V_SCORED)
def c4(t: Tables):
    rows = t.scored().select("video_id", "cluster_topic_name")
    return lookups.with_group_size(rows, "cluster_topic_name")


@query("c5_attach_predictions", """
    SELECT v.video_id, v.title, p.viral_probability, p.predicted_viral
    FROM v_video v LEFT JOIN (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY ord) = 1) p
      ON v.video_id = p.video_id""", V_VIDEO, """predictions AS (
      SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS ord, round(value / 100, 4) AS viral_probability,
        CASE WHEN round(value / 100, 4) >= 0.7E0 THEN 1 ELSE 0 END AS predicted_viral FROM events)""")
def c5(t: Tables):
    predictions = t.events.selectExpr(
        "CAST(user_id AS STRING) AS video_id", "event_id AS ord", "round(value / 100, 4) AS viral_probability",
        "CASE WHEN round(value / 100, 4) >= 0.7E0 THEN 1 ELSE 0 END AS predicted_viral",
    )
    return lookups.attach_predictions(t.video().select("video_id", "title"), predictions, "ord")


@query("c6_dictionary_lookup", """
    SELECT e.event_id, CAST(e.user_id AS BIGINT) AS channel_id, coalesce(d.source, 'unclassified') AS channel_title,
      coalesce(d.n_chars, 0) AS channel_subscriber_count
    FROM events e LEFT JOIN labels l ON e.user_id = l.doc_id LEFT JOIN documents d ON l.doc_id = d.doc_id""")
def c6(t: Tables):
    channels = t.labels.select("doc_id").join(t.documents, "doc_id").select(
        F.col("doc_id").alias("channel_id"), F.col("source").alias("channel_title"),
        F.col("n_chars").alias("channel_subscriber_count"),
    )
    rows = t.events.select("event_id", F.col("user_id").alias("channel_id"))
    return lookups.lookup(rows, channels, "channel_id", {
        "channel_title": F.lit("unclassified"), "channel_subscriber_count": F.lit(0),
    })


@query("c7_resolvable_targets", """
    SELECT video_id, keyword FROM v_video WHERE video_id IN (SELECT CAST(user_id AS VARCHAR) FROM events)""", V_VIDEO)
def c7(t: Tables):
    details = t.events.select(F.col("user_id").cast("string").alias("video_id"))
    return lookups.resolvable(t.video().select("video_id", "keyword"), details)


@query("c8_nearest_neighbour_score", """
    SELECT e.vec_id, coalesce(b.best, 0E0) AS narrative_similarity_score FROM embeddings e LEFT JOIN (
      SELECT a.vec_id, round_even(max(list_dot_product(a.v, b.v)), 4) AS best
      FROM sample a JOIN sample b ON a.vec_id <> b.vec_id GROUP BY a.vec_id) b ON e.vec_id = b.vec_id""",
       """sample AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1000)""")
def c8(t: Tables):
    return narratives.neighbour_scores(t.embeddings, "vec_id", "embedding").select("vec_id", "narrative_similarity_score")


@query("c8_all_rows_score")
def c8_all(t: Tables):
    """The score over all rows; a test holds it against all pairs."""
    return narratives.all_neighbour_scores(t.embeddings.select("vec_id", "embedding"), "embedding").select("vec_id", "narrative_similarity_score")


@query("c9_global_threshold_compare", """
    SELECT video_id, narrative_trend_score >= (SELECT quantile_cont(narrative_trend_score, 0.95) FROM v_scored) AS over
    FROM (SELECT video_id, round(narrative_trend_score, 6) AS r, narrative_trend_score FROM v_scored)""", V_SCORED)
def c9(t: Tables):
    rows = t.scored().select("video_id", "narrative_trend_score")
    cut = exact_quantiles(rows, {"t": (F.col("narrative_trend_score"), 0.95)})["t"]
    return rows.select("video_id", (F.col("narrative_trend_score") >= F.lit(cut)).alias("over"))
