"""J: report views, and the composite tables they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.models_ import STOP_WORDS, TOPICS, lexicon_sql
from tidewatch.catalog.registry import V_COMMENT, V_SCORED, V_SNAP, V_VIDEO, Tables, query, rounded
from tidewatch.catalog.scalars_ import ALERT_SCORE, AS_OF, NORMAL, V_RAVS, V_TIMES, risk_hits
from tidewatch.catalog.shaping_ import STRIP
from tidewatch.catalog.windows_ import V_CUTS, V_FIRED, V_TRACK
from tidewatch.operators import alerts as rules
from tidewatch.operators import ranking, scoring
from tidewatch.plans import alerting, cleaning, features, narrative, tracking, views

V_ALERTS = f"""v_alerts AS (
  SELECT f.video_id, s.title, f.alert_type, f.alert_priority, CASE f.alert_type {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in rules.RULES.items())} END
    AS alert_reason, s.ravs_score, s.viral_probability, s.pharma_risk_score, s.topic_keywords, {ALERT_SCORE} AS alert_score
  FROM fired f JOIN v_ravs s ON f.video_id = s.video_id
  ORDER BY alert_score DESC, f.video_id, f.alert_type LIMIT 100)"""
ALERT_CTES = (V_SCORED, V_RAVS, V_CUTS, V_FIRED, V_ALERTS)


def alerts(t: Tables):
    return alerting.build_alerts(t.scored())


def items(t: Tables):
    return rules.with_ravs(t.scored())


@query("alert_table", """
    SELECT video_id, title, alert_type, alert_priority, alert_reason, ravs_score, round(viral_probability, 6) AS viral_probability,
      pharma_risk_score, round(alert_score, 6) AS alert_score FROM v_alerts""", *ALERT_CTES)
def alert_table(t: Tables):
    return rounded(alerts(t).select(
        "video_id", "title", "alert_type", "alert_priority", "alert_reason", "ravs_score", "viral_probability",
        "pharma_risk_score", "alert_score",
    ))


@query("tracking_table", """
    SELECT video_id, event_id, round(coalesce(view_velocity, 0), 6) AS view_velocity, round(coalesce(growth_acceleration, 0), 6) AS growth_acceleration,
      round(trend_score, 6) AS trend_score, CASE WHEN trend_score >= trend_cut THEN 'trending' ELSE 'normal' END AS trend_label,
      CASE WHEN growth_acceleration > acc_cut THEN 1 ELSE 0 END AS spike_detected
    FROM v_trend, v_cut""", V_SNAP, V_TRACK)
def tracking_table(t: Tables):
    return rounded(tracking.build_tracking(t.snap()).select(
        "video_id", "event_id", "view_velocity", "growth_acceleration", "trend_score", "trend_label", "spike_detected"
    ))


V_ANALYSIS = f"""v_analysis AS (
  SELECT *, mins * 60 + hrs * 3600 AS duration_seconds,
    {STRIP.format("concat_ws(chr(10), keyword, title, " + STRIP.format('description') + ", nullif(comments_text_full, ''), channel_title)")} AS analysis_text_en
  FROM (SELECT v.*, CAST(ord % 3 AS INTEGER) AS hrs, CAST(ord % 60 AS INTEGER) AS mins, coalesce(c.comments_text, '') AS comments_text_full
    FROM v_video v LEFT JOIN (SELECT video_id, string_agg({STRIP.format('text')}, chr(10) || chr(10) ORDER BY comment_id) AS comments_text
      FROM v_comment WHERE {STRIP.format('text')} <> '' GROUP BY video_id) c ON v.video_id = c.video_id))"""


@query("clean_table", "SELECT video_id, duration_seconds, comments_text_full, analysis_text_en FROM v_analysis", V_VIDEO, V_COMMENT, V_ANALYSIS)
def clean_table(t: Tables):
    return cleaning.clean_items(t.video(), t.comment()).select("video_id", "duration_seconds", "comments_text_full", "analysis_text_en")


_MOOD = lexicon_sql(scoring.SENTIMENT_WORDS, "neutral", False, "v_text", "mood_")
_FEEL = lexicon_sql(scoring.EMOTION_WORDS, "neutral", False, "v_text", "feel_")
_HARM = lexicon_sql(scoring.TOXICITY_WORDS, None, True, "v_text", "harm_")


@query("feature_table", """
    SELECT id AS video_id, duration_seconds, round(engagement_rate, 6) AS engagement_rate, round(views_per_hour, 6) AS views_per_hour,
      text_length, word_count, sentiment_label, emotion_label, toxicity_label, pharma_risk_score, round(virality_score, 6) AS virality_score,
      CASE WHEN virality_score >= (SELECT quantile_cont(virality_score, 0.95) FROM v_whole) THEN 1 ELSE 0 END AS viral_label FROM v_whole""",
       V_VIDEO, V_COMMENT, V_ANALYSIS, f"v_text AS (SELECT *, video_id AS id, {NORMAL.format('analysis_text_en')} AS text FROM v_analysis)",
       _MOOD[0], _FEEL[0], _HARM[0], f"""v_whole AS (
      SELECT *, engagement_rate * 0.4E0 + views_per_hour * 0.3E0 + comment_count / hours * 0.2E0 + sentiment_score * 0.1E0 AS virality_score FROM (
        SELECT t.id, duration_seconds, (like_count + comment_count) / view_count AS engagement_rate, view_count / hours AS views_per_hour, comment_count, hours,
          CAST(length(text) AS INTEGER) AS text_length, CAST(len(string_split(text, ' ')) AS INTEGER) AS word_count, m.label AS sentiment_label,
          m.score AS sentiment_score, e.label AS emotion_label, h.label AS toxicity_label, {risk_hits('text', True)} AS pharma_risk_score
        FROM (SELECT *, (epoch_us({AS_OF}) - epoch_us(published_at)) / 3.6E9 AS hours FROM v_text) t
          JOIN ({_MOOD[1]}) m ON t.id = m.id JOIN ({_FEEL[1]}) e ON t.id = e.id JOIN ({_HARM[1]}) h ON t.id = h.id))""")
def feature_table(t: Tables):
    clean = cleaning.clean_items(t.video(), t.comment())
    rows = features.build_features(clean, F.expr(AS_OF))
    return rounded(rows.select(
        "video_id", "duration_seconds", "engagement_rate", "views_per_hour", "text_length", "word_count", "sentiment_label",
        "emotion_label", "toxicity_label", "pharma_risk_score", "virality_score", "viral_label",
    ))


@query("narrative_table")
def narrative_table(t: Tables):
    rows = t.texts().selectExpr(
        "CAST(doc_id AS STRING) AS video_id", "doc_id AS ord", "text AS analysis_text_en", "1E0 AS virality_score",
        "CAST(n_chars % 50 AS DOUBLE) AS trend_score",
    )
    return narrative.build_narratives(rows, TOPICS, STOP_WORDS, order="ord").select(
        "video_id", "narrative_cluster_id", "cluster_topic_name", "dominant_topic_id", "topic_keywords",
        "narrative_similarity_score", "cluster_volume", "narrative_trend_score", "emerging_narrative",
    )


@query("j1_overview_kpis", """
    SELECT count(*) AS total_videos, count(*) FILTER (WHERE emerging_narrative = 'emerging') AS emerging_narratives,
      count(*) FILTER (WHERE ravs_score >= 0.7E0) AS high_risk, round(avg(viral_probability), 6) AS avg_viral_score,
      (SELECT count(*) FROM v_alerts) AS active_alerts FROM v_ravs""", *ALERT_CTES)
def j1(t: Tables):
    return rounded(views.overview(items(t), alerts(t)))


@query("j2_probability_histogram", """
    SELECT CAST(least(floor(viral_probability * 20) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM v_scored GROUP BY 1""", V_SCORED)
def j2(t: Tables):
    return views.probability_histogram(t.scored())


@query("j3_sentiment_distribution", "SELECT sentiment_label AS label, count(*) AS n FROM v_scored GROUP BY 1", V_SCORED)
def j3(t: Tables):
    return views.sentiment_share(t.scored())


@query("j4_active_alerts", """
    SELECT title, alert_type, alert_priority, ravs_score, round(viral_probability, 6) AS viral_probability, pharma_risk_score
    FROM v_alerts ORDER BY alert_score DESC, video_id, alert_type LIMIT 10""", *ALERT_CTES)
def j4(t: Tables):
    return rounded(views.active_alerts(alerts(t)))


@query("j5_top_clusters", """
    SELECT narrative_cluster_id, count(video_id) AS count, round(avg(viral_probability), 6) AS avg_vp FROM v_scored GROUP BY 1
    ORDER BY avg(viral_probability) DESC, 1 LIMIT 15""", V_SCORED)
def j5(t: Tables):
    return rounded(views.cluster_ranking(t.scored(), "narrative_cluster_id", 15))


@query("j6_top_topics", """
    SELECT topic_keywords, count(video_id) AS count, round(avg(viral_probability), 6) AS avg_vp FROM v_topics GROUP BY 1
    ORDER BY avg(viral_probability) DESC, 1 LIMIT 12""", V_SCORED, """v_topics AS (
      SELECT concat(topic_keywords, ' ', cluster_topic_name) AS topic_keywords, video_id, viral_probability FROM v_scored)""")
def j6(t: Tables):
    rows = t.scored().withColumn("topic_keywords", F.concat_ws(" ", "topic_keywords", "cluster_topic_name"))
    return rounded(views.cluster_ranking(rows, "topic_keywords", 12))


@query("j7_narrative_feed", """
    SELECT title, topic_keywords, round(viral_probability, 6) AS viral_probability, ravs_score, sentiment_label, emerging_narrative
    FROM v_ravs ORDER BY v_ravs.viral_probability DESC, ord LIMIT 50""", V_SCORED, V_RAVS)
def j7(t: Tables):
    return rounded(views.narrative_feed(items(t), "ord"))


@query("j8_alerts_by_priority", """
    SELECT count(*) FILTER (WHERE alert_priority = 'critical') AS critical, count(*) FILTER (WHERE alert_priority = 'high') AS high,
      count(*) FILTER (WHERE alert_priority = 'medium') AS medium FROM v_alerts""", *ALERT_CTES)
def j8(t: Tables):
    return views.alert_priorities(alerts(t))


@query("j8_alert_detail", """
    SELECT title, alert_type, alert_priority, alert_reason, ravs_score, round(viral_probability, 6) AS viral_probability, pharma_risk_score
    FROM v_alerts""", *ALERT_CTES)
def j8_detail(t: Tables):
    return rounded(views.alert_detail(alerts(t)))


V_TOTAL = """v_total AS (
  SELECT *, CAST(trunc(ravs_speed_of_engagement * 0.30E0 + ravs_regulatory_relevance * 0.25E0 + ravs_safety_implications * 0.20E0
    + ravs_influencer_reach * 0.15E0 + ravs_topic_sensitivity * 0.10E0) AS INTEGER) AS ravs_total FROM v_ravs)"""
TIER = "CASE WHEN {0} >= 70 THEN 'High Risk' WHEN {0} >= 35 THEN 'Medium Risk' ELSE 'Low Risk' END"


@query("j9_scenario_pick", f"""
    SELECT scenario, p.video_id, ravs_total, {TIER.format('ravs_total')} AS risk_tier, time_to_virality,
      CASE time_to_virality WHEN '< 1 hr' THEN '< 1 hr' WHEN '~1–2 hrs' THEN '1–2 hrs' WHEN '> 24 hrs' THEN '12–24 hrs' ELSE '6–8 hrs' END AS response_window
    FROM picks p JOIN v_total v ON p.video_id = v.video_id JOIN v_times x ON p.video_id = x.video_id""", V_SCORED, V_RAVS, V_TOTAL, V_TIMES, """picks AS (
      SELECT * FROM (SELECT 'Highest Regulatory Risk' AS scenario, video_id FROM v_scored ORDER BY pharma_risk_score DESC, ord LIMIT 1)
      UNION ALL SELECT * FROM (SELECT 'Highest Viral Threat', video_id FROM v_scored ORDER BY viral_probability DESC, ord LIMIT 1)
      UNION ALL SELECT * FROM (SELECT 'Highest Toxicity Signal', video_id FROM v_scored ORDER BY toxicity_score DESC, ord LIMIT 1))""")
def j9(t: Tables):
    return views.scenario_cards(t.scored(), "ord").select(
        "scenario", "video_id", "ravs_total", "risk_tier", "time_to_virality", "response_window"
    )


@query("j10_top_risk_row", f"""
    SELECT video_id, ravs_score, ravs_speed_of_engagement, ravs_regulatory_relevance, ravs_safety_implications, ravs_influencer_reach,
      ravs_topic_sensitivity, ravs_total, {TIER.format('ravs_total')} AS risk_tier FROM v_total ORDER BY ravs_score DESC, ord LIMIT 1""",
       V_SCORED, V_RAVS, V_TOTAL)
def j10(t: Tables):
    return views.top_risk(items(t), "ord").select(
        "video_id", "ravs_score", "ravs_speed_of_engagement", "ravs_regulatory_relevance", "ravs_safety_implications",
        "ravs_influencer_reach", "ravs_topic_sensitivity", "ravs_total", "risk_tier",
    )


@query("j11_top_narratives", f"""
    SELECT cluster_topic_name, round(mean, 6) AS ravs_score, video_count, round(trend, 6) AS trend_score, cluster_topic_name AS narrative,
      CAST(trunc(mean * 100) AS INTEGER) AS score_display, CASE WHEN trend > 0.3E0 THEN 'rising' ELSE 'stable' END AS trend_direction,
      {TIER.format('trunc(mean * 100)')} AS risk_tier
    FROM (SELECT cluster_topic_name, avg(ravs_score) AS mean, count(video_id) AS video_count, avg(trend_score) AS trend FROM v_ravs GROUP BY 1)
    ORDER BY mean DESC, 1 LIMIT 10""", V_SCORED, V_RAVS)
def j11(t: Tables):
    return rounded(views.narrative_ranking(items(t), "ord"))


@query("j11_top_items_without_topics", f"""
    SELECT video_id, title AS narrative, ravs_score, CAST(trunc(ravs_score * 100) AS INTEGER) AS score_display,
      {TIER.format('trunc(ravs_score * 100)')} AS risk_tier FROM v_ravs ORDER BY ravs_score DESC, ord LIMIT 10""", V_SCORED, V_RAVS)
def j11_items(t: Tables):
    rows = items(t).drop("cluster_topic_name", "topic_keywords")
    return views.narrative_ranking(rows, "ord").select("video_id", "narrative", "ravs_score", "score_display", "risk_tier")


@query("j12_safety_kpis", """
    SELECT round(avg(toxicity_score), 3) AS avg_toxicity_score, round(avg(pharma_risk_score), 3) AS avg_pharma_risk_score,
      round(avg(viral_probability), 3) AS avg_viral_probability FROM v_scored""", V_SCORED)
def j12(t: Tables):
    return views.safety_means(t.scored())


@query("j12_risk_distribution", "SELECT pharma_risk_label AS label, count(*) AS n FROM v_scored GROUP BY 1", V_SCORED)
def j12_risk(t: Tables):
    return views.risk_distribution(t.scored())


@query("j13_toxicity_points", """
    SELECT video_id, round(toxicity_score, 6) AS toxicity_score, round(viral_probability, 6) AS viral_probability, pharma_risk_label
    FROM v_scored WHERE pharma_risk_label = 'high_risk'""", V_SCORED)
def j13(t: Tables):
    rows = t.scored().withColumn("toxicity_score", F.expr("CASE WHEN pharma_risk_label = 'high_risk' THEN toxicity_score END"))
    return rounded(views.toxicity_points(rows))


@query("j14_main_table", """
    SELECT video_id, ravs_score, 'narrative' AS source FROM v_ravs UNION ALL SELECT video_id, ravs_score, 'features' FROM v_ravs""", V_SCORED, V_RAVS)
def j14(t: Tables):
    rows = t.scored()
    chosen = views.main_table(rows, rows.limit(0)).select("video_id", "ravs_score", F.lit("narrative").alias("source"))
    missing = rows.withColumn("ravs_score", F.lit(None).cast("double"))
    return chosen.unionByName(views.main_table(rows.limit(0), missing).select("video_id", "ravs_score", F.lit("features").alias("source")))


@query("j15_run_summary", """
    SELECT CAST(sum(CASE WHEN viral_probability >= 0.7E0 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_viral, count(*) AS total FROM v_scored""", V_SCORED)
def j15(t: Tables):
    rows = t.scored().withColumn("predicted_viral", F.expr("CASE WHEN viral_probability >= 0.7E0 THEN 1 ELSE 0 END"))
    return views.run_summary(rows)
