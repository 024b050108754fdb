"""E, F, G: windows, ranking, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.joins_ import V_GAPS  # noqa: F401
from tidewatch.catalog.registry import V_SCORED, V_SNAP, V_VIDEO, Tables, query, rounded
from tidewatch.operators import alerts, lookups, ranking
from tidewatch.operators.shaping import without_blanks
from tidewatch.plans import tracking

V_TRACK = """v_lag AS (
  SELECT *, lag(view_count) OVER w AS prev_views, lag(like_count) OVER w AS prev_likes,
    lag(comment_count) OVER w AS prev_comments, lag(engagement_rate) OVER w AS prev_engagement,
    lag(tracking_timestamp) OVER w AS prev_timestamp
  FROM v_snap WINDOW w AS (PARTITION BY video_id ORDER BY tracking_timestamp, event_id)),
v_hours AS (
  SELECT *, nullif((epoch_us(tracking_timestamp) - epoch_us(prev_timestamp)) / 3.6E9, 0) AS time_diff_hours FROM v_lag),
v_vel AS (
  SELECT *, (view_count - prev_views) / time_diff_hours AS view_velocity,
    (like_count - prev_likes) / time_diff_hours AS like_velocity,
    (comment_count - prev_comments) / time_diff_hours AS comment_velocity,
    (engagement_rate - prev_engagement) / time_diff_hours AS engagement_velocity
  FROM v_hours),
v_acc AS (
  SELECT *, lag(view_velocity) OVER w AS prev_view_velocity, view_velocity - lag(view_velocity) OVER w AS growth_acceleration
  FROM v_vel WINDOW w AS (PARTITION BY video_id ORDER BY tracking_timestamp, event_id)),
v_trend AS (
  SELECT *, coalesce(like_velocity, 0) + coalesce(comment_velocity, 0) AS engagement_momentum,
    coalesce(view_velocity, 0) * 0.35E0 + coalesce(like_velocity, 0) * 0.15E0 + coalesce(comment_velocity, 0) * 0.15E0
      + (coalesce(like_velocity, 0) + coalesce(comment_velocity, 0)) * 0.15E0 + coalesce(virality_score, 0) * 0.10E0
      + pharma_risk_score * 0.10E0 AS trend_score
  FROM v_acc),
v_cut AS (
  SELECT quantile_cont(trend_score, 0.95) AS trend_cut, quantile_cont(coalesce(growth_acceleration, 0), 0.95) AS acc_cut
  FROM v_trend)"""


@query("e1_previous_values", """
    SELECT video_id, event_id, prev_views, prev_likes, prev_comments, round(prev_engagement, 6) AS prev_engagement,
      epoch_us(prev_timestamp) AS prev_us FROM v_lag""", V_SNAP, V_TRACK)
def e1(t: Tables):
    rows = tracking.previous_values(t.snap())
    return rounded(rows.select(
        "video_id", "event_id", "prev_views", "prev_likes", "prev_comments", "prev_engagement",
        F.unix_micros("prev_timestamp").alias("prev_us"),
    ))


@query("e2_velocities", """
    SELECT video_id, event_id, round(time_diff_hours, 6) AS time_diff_hours, round(view_velocity, 6) AS view_velocity,
      round(like_velocity, 6) AS like_velocity, round(comment_velocity, 6) AS comment_velocity,
      round(engagement_velocity, 6) AS engagement_velocity FROM v_vel""", V_SNAP, V_TRACK)
def e2(t: Tables):
    rows = tracking.with_velocities(tracking.previous_values(t.snap()))
    return rounded(rows.select(
        "video_id", "event_id", "time_diff_hours", "view_velocity", "like_velocity", "comment_velocity", "engagement_velocity"
    ))


@query("e3_acceleration", """
    SELECT video_id, event_id, round(prev_view_velocity, 6) AS prev_view_velocity,
      round(growth_acceleration, 6) AS growth_acceleration FROM v_acc""", V_SNAP, V_TRACK)
def e3(t: Tables):
    rows = tracking.with_velocities(tracking.previous_values(t.snap()))
    return rounded(rows.select("video_id", "event_id", "prev_view_velocity", "growth_acceleration"))


@query("e4_latest_row_per_key", """
    SELECT video_id, event_id, view_count, like_count, comment_count FROM v_snap
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY tracking_timestamp DESC, event_id DESC) = 1""", V_SNAP)
def e4(t: Tables):
    rows = ranking.latest_rows(t.snap(), "video_id", ["tracking_timestamp", "event_id"])
    return rows.select("video_id", "event_id", "view_count", "like_count", "comment_count")


@query("e5_dedup_keep_best", """
    SELECT video_id, alert_type, event_id, round(alert_score, 6) AS alert_score FROM candidates
    QUALIFY row_number() OVER (PARTITION BY video_id, alert_type ORDER BY alert_score DESC, event_id DESC) = 1""", """candidates AS (
      SELECT CAST(user_id AS VARCHAR) AS video_id, event_type AS alert_type, event_id, value AS alert_score FROM events)""")
def e5(t: Tables):
    rows = t.events.selectExpr("CAST(user_id AS STRING) AS video_id", "event_type AS alert_type", "event_id", "value AS alert_score")
    return rounded(ranking.best_alerts(rows))


@query("e6_dedup_keep_first", """
    SELECT video_id, event_id, keyword FROM targets WHERE trim(video_id) <> ''
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY event_id) = 1""", """targets AS (
      SELECT CASE WHEN event_type = 'error' THEN ' ' ELSE CAST(user_id AS VARCHAR) END AS video_id, event_id, event_type AS keyword
      FROM events)""")
def e6(t: Tables):
    rows = t.events.selectExpr(
        "CASE WHEN event_type = 'error' THEN ' ' ELSE CAST(user_id AS STRING) END AS video_id", "event_id", "event_type AS keyword"
    )
    return ranking.first_per_key(without_blanks(rows, ["video_id"]), ["video_id"], [F.col("event_id")])


@query("e7_first_term_wins", """
    SELECT video_id, keyword FROM (
      SELECT CAST(e.user_id AS VARCHAR) AS video_id, e.event_type AS keyword, k.place, e.event_id FROM events e JOIN terms k USING (event_type))
    QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY place, event_id) = 1""", """terms AS (
      SELECT event_type, min(event_id) AS place FROM events GROUP BY event_type)""")
def e7(t: Tables):
    terms = t.events.groupBy("event_type").agg(F.min("event_id").alias("place"))
    found = lookups.lookup(t.events.select("user_id", "event_type", "event_id"), terms, "event_type", {"place": F.lit(None).cast("bigint")})
    rows = found.selectExpr("CAST(user_id AS STRING) AS video_id", "event_type AS keyword", "place", "event_id")
    return ranking.first_per_key(rows, ["video_id"], [F.col("place"), F.col("event_id")]).select("video_id", "keyword")


@query("e8_group_size_column", """
    SELECT video_id, narrative_cluster_id, count(*) OVER (PARTITION BY narrative_cluster_id) AS cluster_volume FROM v_scored""", V_SCORED)
def e8(t: Tables):
    return lookups.with_group_size(t.scored().select("video_id", "narrative_cluster_id"), "narrative_cluster_id", bounded=True)


@query("f1_sort_by_item_and_time", """
    SELECT video_id, event_id, view_count FROM v_snap ORDER BY video_id, tracking_timestamp, event_id""", V_SNAP)
def f1(t: Tables):
    return t.snap().orderBy("video_id", "tracking_timestamp", "event_id").select("video_id", "event_id", "view_count")


@query("f2_top_n_by_score", """
    SELECT video_id, narrative_cluster_id, round(viral_probability, 6) AS viral_probability FROM v_scored
    ORDER BY viral_probability DESC, video_id LIMIT 100""", V_SCORED)
def f2(t: Tables):
    return rounded(ranking.top(t.scored(), 100, "viral_probability", "video_id").select(
        "video_id", "narrative_cluster_id", "viral_probability"
    ))


@query("f3_best_row_by_preference", """
    SELECT * FROM (SELECT 'Highest Regulatory Risk' AS scenario, video_id, pharma_risk_score AS score FROM v_scored ORDER BY 3 DESC, ord LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'Highest Viral Threat', video_id, viral_probability FROM v_scored ORDER BY 3 DESC, ord LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'Highest Toxicity Signal', video_id, toxicity_score FROM v_scored ORDER BY 3 DESC, ord LIMIT 1)""", V_SCORED)
def f3(t: Tables):
    rows = ranking.best_rows(t.scored(), "ord")
    chosen = F.create_map(*[x for name, cols in ranking.SCENARIOS.items() for x in (F.lit(name), F.col(cols[0]))])
    return rows.select("scenario", "video_id", F.element_at(chosen, F.col("scenario")).alias("score"))


@query("g1_append_history", """
    SELECT video_id, tracking_us, view_count, virality_score, title FROM (
      SELECT video_id, epoch_us(tracking_timestamp) AS tracking_us, view_count, round(virality_score, 6) AS virality_score,
        CAST(NULL AS VARCHAR) AS title FROM v_snap
      UNION ALL SELECT video_id, epoch_us(TIMESTAMP '2025-01-01 00:00:00'), view_count, NULL, title FROM v_video
      UNION ALL SELECT video_id, epoch_us(TIMESTAMP '2025-01-01 00:00:00'), view_count, NULL, title FROM v_video)""", V_SNAP, V_VIDEO)
def g1(t: Tables):
    history = t.snap().select("video_id", "tracking_timestamp", "view_count", "virality_score")
    new = t.video().select("video_id", "title", "view_count", F.expr("TIMESTAMP '2025-01-01 00:00:00'").alias("tracking_timestamp"))
    rows = tracking.append_history(tracking.append_history(history, new), new)
    return rounded(rows.withColumn("tracking_us", F.unix_micros("tracking_timestamp")).drop("tracking_timestamp"))


V_CUTS = """cuts AS (
  SELECT quantile_cont(narrative_trend_score, 0.95) AS narrative, quantile_cont(growth_acceleration, 0.95) AS acceleration,
    quantile_cont(trend_score, 0.90) AS trend FROM v_scored)"""

V_FIRED = """fired AS (
  SELECT video_id, 'viral_emerging' AS alert_type, 'high' AS alert_priority FROM v_scored WHERE viral_probability >= 0.80E0
  UNION ALL SELECT video_id, 'toxicity_spike', 'high' FROM v_scored WHERE toxicity_score >= 0.75E0
  UNION ALL SELECT video_id, 'pharma_risk', 'critical' FROM v_scored WHERE pharma_risk_score >= 1
  UNION ALL SELECT video_id, 'emerging_narrative', 'medium' FROM v_scored, cuts WHERE narrative_trend_score >= narrative
  UNION ALL SELECT video_id, 'growth_spike', 'medium' FROM v_scored, cuts WHERE growth_acceleration >= acceleration
  UNION ALL SELECT video_id, 'influencer_amplification', 'high' FROM v_scored, cuts WHERE subscriber_count >= 100000 AND trend_score >= trend)"""


@query("g2_alert_fan_out", "SELECT * FROM fired", V_SCORED, V_CUTS, V_FIRED)
def g2(t: Tables):
    rows = alerts.prepare(t.scored())
    return alerts.fan_out(rows, alerts.learn_thresholds(rows)).select("video_id", "alert_type", "alert_priority")
