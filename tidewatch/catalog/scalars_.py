"""H: scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import V_SCORED, V_SNAP, V_VIDEO, Tables, query, rounded
from tidewatch.catalog.shaping_ import STRIP
from tidewatch.catalog.windows_ import V_CUTS, V_FIRED, V_TRACK
from tidewatch.constants import RANGE_CUTS, RISK_PHRASES
from tidewatch.functions import labels, numeric, scores, temporal, text
from tidewatch.operators import alerts, lexicon, narratives
from tidewatch.plans import features, tracking, views

AS_OF = "TIMESTAMP '2025-01-01 00:00:00'"

NORMAL = r"""trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(lower({0}),
      'http[^ \t\r\n]+', '', 'g'), 'www[^ \t\r\n]+', '', 'g'), '@[\p{{L}}\p{{N}}_]+', '', 'g'), '#', ''), '[ \t\r\n]+', ' ', 'g'))"""

V_CLEAN = f"""v_clean AS (
  SELECT video_id, ord, {NORMAL.format('raw')} AS clean
  FROM (SELECT video_id, ord, concat(description, CASE ord % 4 WHEN 0 THEN ' HTTP://x.y/z  www.a b' WHEN 1 THEN ' @Name_1 #Tag' ELSE '' END,
    CASE ord % 3 WHEN 0 THEN ' 😀😀 🚀? !' WHEN 1 THEN ' 🇫🇷 ☀ Side Effects, FDA warning' ELSE '' END) AS raw FROM v_video))"""


def clean(t: Tables):
    raw = t.video().selectExpr("video_id", "ord", """concat(description,
      CASE ord % 4 WHEN 0 THEN ' HTTP://x.y/z  www.a b' WHEN 1 THEN ' @Name_1 #Tag' ELSE '' END,
      CASE ord % 3 WHEN 0 THEN ' 😀😀 🚀? !' WHEN 1 THEN ' 🇫🇷 ☀ Side Effects, FDA warning' ELSE '' END) AS raw""")
    return raw.select("video_id", "ord", text.normalise(F.col("raw")).alias("clean"))


@query("h1_normalise_text", "SELECT video_id, clean FROM v_clean", V_VIDEO, V_CLEAN)
def h1(t: Tables):
    return clean(t).select("video_id", "clean")


@query("h2_text_length_words", """
    SELECT video_id, CAST(length(clean) AS INTEGER) AS text_length,
      CAST(CASE WHEN clean = '' THEN 0 ELSE len(string_split(clean, ' ')) END AS INTEGER) AS word_count FROM v_clean""", V_VIDEO, V_CLEAN)
def h2(t: Tables):
    c = F.col("clean")
    return clean(t).select("video_id", F.length(c).alias("text_length"), text.word_count(c).alias("word_count"))


@query("h3_emoji_runs", r"""
    SELECT video_id, CAST(len(regexp_extract_all(clean,
      '[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+')) AS INTEGER) AS emoji_count FROM v_clean""", V_VIDEO, V_CLEAN)
def h3(t: Tables):
    return clean(t).select("video_id", text.emoji_runs(F.col("clean")).alias("emoji_count"))


@query("h4_punctuation_counts", r"""
    SELECT video_id, CAST(len(regexp_extract_all(clean, '\?')) AS INTEGER) AS question_mark_count,
      CAST(len(regexp_extract_all(clean, '!')) AS INTEGER) AS exclamation_count FROM v_clean""", V_VIDEO, V_CLEAN)
def h4(t: Tables):
    c = F.col("clean")
    return clean(t).select(
        "video_id", text.occurrences(c, "?").alias("question_mark_count"), text.occurrences(c, "!").alias("exclamation_count")
    )


def risk_hits(column: str, fold: bool) -> str:
    return " + ".join(
        f"CAST(contains(lower({column}), '{p.lower() if fold else p}') AS INTEGER)" for p in RISK_PHRASES
    )


@query("h5_risk_phrase_score", f"""
    SELECT video_id, {risk_hits('clean', True)} AS folded, {risk_hits('clean', False)} AS as_written FROM v_clean""", V_VIDEO, V_CLEAN)
def h5(t: Tables):
    c = F.col("clean")
    return clean(t).select(
        "video_id", text.phrase_score(c).alias("folded"), text.phrase_score(c, fold_lexicon=False).alias("as_written")
    )


V_LEXICON = """v_lexicon AS (
  SELECT DISTINCT lower(left(text, 4 + length(text) % 5)) AS phrase FROM conversations WHERE text <> '')"""


@query("h5_lexicon_table", """
    SELECT doc_id, CAST(count(phrase) AS INTEGER) AS hits, md5(coalesce(string_agg(phrase, '|' ORDER BY phrase), '')) AS phrases_md5
    FROM documents LEFT JOIN v_lexicon ON contains(lower(text), phrase) GROUP BY doc_id""", V_LEXICON)
def h5_lexicon(t: Tables):
    """The ways conversations begin, as a table of phrases looked for in every document."""
    phrases = t.conversations.where("text <> ''").selectExpr("lower(left(text, 4 + length(text) % 5)) AS phrase")
    found = lexicon.with_phrases(t.texts().select("doc_id", F.lower("text").alias("low")), "low", phrases)
    return found.select("doc_id", F.size("phrases").alias("hits"), F.md5(F.array_join("phrases", "|")).alias("phrases_md5"))


@query("h6_risk_label", f"""
    SELECT video_id, CASE WHEN {risk_hits('clean', True)} > 0 THEN 'high_risk' ELSE 'low_risk' END AS pharma_risk_label
    FROM v_clean""", V_VIDEO, V_CLEAN)
def h6(t: Tables):
    return features.with_risk(clean(t), "clean").select("video_id", "pharma_risk_label")


@query("h7_analysis_text", f"""
    SELECT video_id, {STRIP.format("concat_ws(chr(10), nullif(keyword, ''), nullif(title, ''), nullif(description, ''), nullif(channel_title, ''))")}
      AS analysis_text_en FROM (SELECT video_id, CASE WHEN ord % 5 > 0 THEN keyword ELSE '' END AS keyword, title, description, channel_title FROM v_video)""", V_VIDEO)
def h7(t: Tables):
    rows = t.video().selectExpr(
        "video_id", "CASE WHEN ord % 5 > 0 THEN keyword ELSE '' END AS keyword_en", "title AS title_en",
        "description AS description_en", "channel_title AS channel_title_en",
    )
    return rows.select("video_id", text.analysis_text(rows.columns).alias("analysis_text_en"))


@query("h8_english_twins", f"""
    SELECT video_id, {STRIP.format("coalesce(raw, '')")} AS description_en FROM (
      SELECT video_id, CASE WHEN ord % 9 = 0 THEN NULL ELSE concat(chr(10), ' ', description, chr(9)) END AS raw FROM v_video)""", V_VIDEO)
def h8(t: Tables):
    raw = F.expr("CASE WHEN ord % 9 = 0 THEN NULL ELSE concat('\n ', description, '\t') END")
    return t.video().select("video_id", text.strip(F.coalesce(raw, F.lit(""))).alias("description_en"))


@query("h9_fixed_size_chunks", """
    SELECT doc_id, CAST(i AS INTEGER) AS chunk, substr(text, i * 4000 + 1, 4000) AS part
    FROM documents, unnest(range((length(text) - 1) // 4000 + 1)) AS u(i) WHERE length(text) > 0""")
def h9(t: Tables):
    return t.documents.select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk", "part"))


V_DURATION = """v_duration AS (
  SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat('PT', CAST(n_chars % 50 AS VARCHAR), 'M', CAST(n_chars % 60 AS VARCHAR), 'S')
    WHEN 1 THEN concat('PT', CAST(n_chars % 30 AS VARCHAR), 'H') WHEN 2 THEN 'PT' WHEN 3 THEN 'P1DT2H' WHEN 4 THEN NULL
    WHEN 5 THEN concat(' PT', CAST(n_chars % 4 AS VARCHAR), 'H', CAST(n_chars % 60 AS VARCHAR), 'M', CAST(n_chars % 59 AS VARCHAR), 'S ')
    ELSE lang END AS duration FROM documents),
v_seconds AS (
  SELECT doc_id, duration, CAST(CASE WHEN regexp_full_match(trim(duration), 'PT([0-9]+H)?([0-9]+M)?([0-9]+S)?') THEN
    coalesce(TRY_CAST(regexp_extract(duration, '([0-9]+)H', 1) AS INTEGER), 0) * 3600
    + coalesce(TRY_CAST(regexp_extract(duration, '([0-9]+)M', 1) AS INTEGER), 0) * 60
    + coalesce(TRY_CAST(regexp_extract(duration, '([0-9]+)S', 1) AS INTEGER), 0) ELSE 0 END AS INTEGER) AS duration_seconds FROM v_duration)"""


def durations(t: Tables):
    raw = t.documents.selectExpr("doc_id", """CASE doc_id % 7 WHEN 0 THEN concat('PT', CAST(n_chars % 50 AS STRING), 'M', CAST(n_chars % 60 AS STRING), 'S')
      WHEN 1 THEN concat('PT', CAST(n_chars % 30 AS STRING), 'H') WHEN 2 THEN 'PT' WHEN 3 THEN 'P1DT2H' WHEN 4 THEN NULL
      WHEN 5 THEN concat(' PT', CAST(n_chars % 4 AS STRING), 'H', CAST(n_chars % 60 AS STRING), 'M', CAST(n_chars % 59 AS STRING), 'S ')
      ELSE lang END AS duration""")
    return raw.select("doc_id", temporal.duration_seconds(F.col("duration")).alias("duration_seconds"))


@query("h10_iso_duration_seconds", "SELECT doc_id, duration_seconds FROM v_seconds", V_DURATION)
def h10(t: Tables):
    return durations(t)


@query("h11_duration_minutes_text", """
    SELECT doc_id, round(duration_seconds / 60, 2) AS duration_minutes, CASE WHEN duration_seconds = 0 THEN ''
      WHEN duration_seconds >= 3600 THEN printf('%02d:%02d:%02d', duration_seconds // 3600, duration_seconds % 3600 // 60, duration_seconds % 60)
      ELSE printf('%02d:%02d', duration_seconds // 60, duration_seconds % 60) END AS duration_text FROM v_seconds""", V_DURATION)
def h11(t: Tables):
    s = F.col("duration_seconds")
    return durations(t).select(
        "doc_id", temporal.duration_minutes(s).alias("duration_minutes"), temporal.duration_text(s).alias("duration_text")
    )


V_PUBLISHED = f"""v_published AS (
  SELECT *, (epoch_us({AS_OF}) - epoch_us(published)) / 3.6E9 AS hours FROM (
    SELECT *, CASE WHEN ord % 11 = 0 THEN NULL ELSE published_at END AS published FROM v_video))"""


def published(t: Tables):
    raw = F.expr("CASE WHEN ord % 11 = 0 THEN 'soon' ELSE date_format(published_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END")
    return features.with_publish_features(t.video().withColumn("published_at", raw), F.expr(AS_OF))


@query("h12_publish_features", """
    SELECT video_id, round(hours, 6) AS hours_since_publish, round(hours / 24, 6) AS days_since_publish,
      CAST(hour(published) AS INTEGER) AS publish_hour, dayname(published) AS publish_weekday, CAST(month(published) AS INTEGER) AS publish_month,
      CASE WHEN isodow(published) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM v_published""", V_VIDEO, V_PUBLISHED)
def h12(t: Tables):
    return rounded(published(t).select(
        "video_id", "hours_since_publish", "days_since_publish", "publish_hour", "publish_weekday", "publish_month", "is_weekend"
    ))


@query("h13_minutes_since_publish", f"""
    SELECT video_id, round((epoch_us({AS_OF}) - epoch_us(published)) / 6.0E7, 2) AS minutes_since_publish FROM v_published""", V_VIDEO, V_PUBLISHED)
def h13(t: Tables):
    return published(t).select(
        "video_id", temporal.minutes_since(F.col("published_at"), F.expr(AS_OF)).alias("minutes_since_publish")
    )


V_ENGAGED = """v_engaged AS (
  SELECT *, CAST(likes + comments AS DOUBLE) AS engagement_total,
    CASE WHEN views > 0 THEN (likes + comments) / views ELSE 0 END AS engagement_rate,
    CASE WHEN hours > 0 THEN views / hours ELSE 0 END AS views_per_hour, CASE WHEN hours > 0 THEN likes / hours ELSE 0 END AS likes_per_hour,
    CASE WHEN hours > 0 THEN comments / hours ELSE 0 END AS comments_per_hour
  FROM (SELECT *, CASE WHEN ord % 13 = 0 THEN 0 ELSE view_count END AS views, like_count AS likes,
    CASE WHEN ord % 17 = 0 THEN 0 ELSE comment_count END AS comments FROM v_published))"""


def engaged(t: Tables):
    return features.with_engagement(published(t).withColumns({
        "view_count": F.expr("CASE WHEN ord % 13 = 0 THEN '0' ELSE CAST(view_count AS STRING) END"),
        "comment_count": F.expr("CASE WHEN ord % 17 = 0 THEN 'disabled' ELSE CAST(comment_count AS STRING) END"),
    }))


@query("h14_engagement_features", """
    SELECT video_id, engagement_total, round(engagement_rate, 6) AS engagement_rate, round(views_per_hour, 6) AS views_per_hour,
      round(likes_per_hour, 6) AS likes_per_hour, round(comments_per_hour, 6) AS comments_per_hour FROM v_engaged""", V_VIDEO, V_PUBLISHED, V_ENGAGED)
def h14(t: Tables):
    return rounded(engaged(t).select(
        "video_id", "engagement_total", "engagement_rate", "views_per_hour", "likes_per_hour", "comments_per_hour"
    ))


V_VIRAL = """v_viral AS (
  SELECT *, engagement_rate * 0.4E0 + views_per_hour * 0.3E0 + comments_per_hour * 0.2E0 + sentiment_score * 0.1E0 AS virality_score
  FROM (SELECT *, CAST(ord % 10 AS DOUBLE) / 10 AS sentiment_score FROM v_engaged))"""


def viral(t: Tables):
    return features.with_virality(engaged(t).withColumn("sentiment_score", F.expr("CAST(ord % 10 AS DOUBLE) / 10")))


@query("h15_virality_score", "SELECT video_id, round(virality_score, 6) AS virality_score FROM v_viral", V_VIDEO, V_PUBLISHED, V_ENGAGED, V_VIRAL)
def h15(t: Tables):
    return rounded(viral(t).select("video_id", "virality_score"))


@query("h16_viral_label", """
    SELECT video_id, CASE WHEN virality_score >= (SELECT quantile_cont(virality_score, 0.95) FROM v_viral) THEN 1 ELSE 0 END AS viral_label
    FROM v_viral""", V_VIDEO, V_PUBLISHED, V_ENGAGED, V_VIRAL)
def h16(t: Tables):
    return features.with_viral_label(viral(t).select("video_id", "virality_score")).select("video_id", "viral_label")


def tracked(t: Tables):
    return tracking.tracking_rows(t.snap())


@query("h17_momentum", """
    SELECT video_id, event_id, round(engagement_momentum, 6) AS engagement_momentum FROM v_trend""", V_SNAP, V_TRACK)
def h17(t: Tables):
    return rounded(tracked(t).select("video_id", "event_id", "engagement_momentum"))


@query("h18_trend_score", "SELECT video_id, event_id, round(trend_score, 6) AS trend_score FROM v_trend", V_SNAP, V_TRACK)
def h18(t: Tables):
    return rounded(tracked(t).select("video_id", "event_id", "trend_score"))


@query("h19_trend_label", """
    SELECT video_id, event_id, CASE WHEN trend_score >= trend_cut THEN 'trending' ELSE 'normal' END AS trend_label
    FROM v_trend, v_cut""", V_SNAP, V_TRACK)
def h19(t: Tables):
    return tracking.build_tracking(t.snap()).select("video_id", "event_id", "trend_label")


@query("h20_spike_flag", """
    SELECT video_id, event_id, CASE WHEN growth_acceleration > acc_cut THEN 1 ELSE 0 END AS spike_detected
    FROM v_trend, v_cut""", V_SNAP, V_TRACK)
def h20(t: Tables):
    return tracking.build_tracking(t.snap()).select("video_id", "event_id", "spike_detected")


@query("h21_post_fill", """
    SELECT video_id, event_id, round(coalesce(view_velocity, 0), 6) AS view_velocity, round(coalesce(like_velocity, 0), 6) AS like_velocity,
      round(coalesce(comment_velocity, 0), 6) AS comment_velocity, round(coalesce(engagement_velocity, 0), 6) AS engagement_velocity,
      round(coalesce(growth_acceleration, 0), 6) AS growth_acceleration, round(engagement_momentum, 6) AS engagement_momentum,
      round(prev_view_velocity, 6) AS prev_view_velocity
    FROM v_trend""", V_SNAP, V_TRACK)
def h21(t: Tables):
    return rounded(tracking.build_tracking(t.snap()).select("video_id", "event_id", *tracking.FILLED, "prev_view_velocity"))


V_NARRATIVE = """v_narrative AS (
  SELECT video_id, cluster_volume * 0.4E0 + viral_probability * 0.3E0 + trend_score * 0.3E0 AS narrative_trend_score FROM v_scored)"""


def narrative(t: Tables):
    rows = t.scored().drop("cluster_volume", "narrative_trend_score", "emerging_narrative")
    return narratives.with_narrative_trend(rows.withColumn("virality_score", F.col("viral_probability")))


@query("h22_narrative_trend_score", """
    SELECT video_id, round(narrative_trend_score, 6) AS narrative_trend_score FROM v_narrative""", V_SCORED, V_NARRATIVE)
def h22(t: Tables):
    return rounded(narrative(t).select("video_id", "narrative_trend_score"))


@query("h23_emerging_flag", """
    SELECT video_id, CASE WHEN narrative_trend_score >= (SELECT quantile_cont(narrative_trend_score, 0.95) FROM v_narrative)
      THEN 'emerging' ELSE 'normal' END AS emerging_narrative FROM v_narrative""", V_SCORED, V_NARRATIVE)
def h23(t: Tables):
    return narratives.with_emerging(narrative(t)).select("video_id", "emerging_narrative")


_RANGED = [c for c in RANGE_CUTS if c in (
    "viral_probability", "toxicity_score", "pharma_risk_score", "cluster_volume", "growth_acceleration", "trend_score",
    "narrative_trend_score",
)]


@query("h24_range_labels", "SELECT video_id, " + ", ".join(
    f"CASE WHEN {c} < {RANGE_CUTS[c][0]:E} THEN 'Low' WHEN {c} < {RANGE_CUTS[c][1]:E} THEN 'Medium' ELSE 'High' END AS {c}_range"
    for c in _RANGED) + " FROM v_scored", V_SCORED)
def h24(t: Tables):
    return alerts.with_range_labels(t.scored()).select("video_id", *[f"{c}_range" for c in _RANGED])


V_RAVS = """v_ravs AS (
  SELECT *, round_even(viral_probability * 0.30E0 + toxicity_score * 0.20E0 + (trend_score - t0) / (t1 - t0) * 0.20E0
      + (pharma_risk_score - r0) / (r1 - r0) * 0.20E0 + CASE WHEN subscriber_count >= 100000 THEN 0.10E0 ELSE 0E0 END, 4) AS ravs_score,
    CAST(trunc(least(greatest(viral_probability * 100, 40), 100)) AS INTEGER) AS ravs_speed_of_engagement,
    CAST(trunc(least(greatest(CASE WHEN pharma_risk_score > 0 THEN pharma_risk_score / 5 * 82 ELSE viral_probability * 75 END, 35), 100)) AS INTEGER)
      AS ravs_regulatory_relevance,
    CAST(trunc(least(greatest(toxicity_score * 100, 20), 100)) AS INTEGER) AS ravs_safety_implications,
    CASE WHEN subscriber_count > 0 THEN CAST(trunc(least(greatest(CAST(subscriber_count AS DOUBLE) / 500000 * 61, 25), 100)) AS INTEGER) ELSE 35 END
      AS ravs_influencer_reach,
    CAST(trunc(least(greatest(CASE WHEN cluster_volume > 0 THEN CAST(cluster_volume AS DOUBLE) / 50 * 59 ELSE viral_probability * 60 END, 25), 100)) AS INTEGER)
      AS ravs_topic_sensitivity
  FROM v_scored, (SELECT min(trend_score) AS t0, max(trend_score) AS t1, min(pharma_risk_score) AS r0, max(pharma_risk_score) AS r1 FROM v_scored))"""


@query("h25_ravs_score", "SELECT video_id, ravs_score FROM v_ravs", V_SCORED, V_RAVS)
def h25(t: Tables):
    return alerts.with_ravs(t.scored()).select("video_id", "ravs_score")


@query("h26_ravs_components", """
    SELECT video_id, ravs_speed_of_engagement, ravs_regulatory_relevance, ravs_safety_implications, ravs_influencer_reach,
      ravs_topic_sensitivity FROM v_ravs""", V_SCORED, V_RAVS)
def h26(t: Tables):
    return alerts.with_ravs(t.scored()).select("video_id", *scores.PART_WEIGHTS)


ALERT_SCORE = """viral_probability * 0.30E0 + toxicity_score * 0.20E0 + trend_score * 0.20E0 + growth_acceleration * 0.15E0
  + pharma_risk_score * 0.15E0"""


@query("h27_alert_score", f"SELECT video_id, round({ALERT_SCORE}, 6) AS alert_score FROM v_scored", V_SCORED)
def h27(t: Tables):
    return rounded(alerts.with_alert_score(t.scored()).select("video_id", "alert_score"))


@query("h28_alert_rules", "SELECT alert_type, alert_priority, count(*) AS n FROM fired GROUP BY 1, 2", V_SCORED, V_CUTS, V_FIRED)
def h28(t: Tables):
    rows = alerts.prepare(t.scored())
    return alerts.fan_out(rows, alerts.learn_thresholds(rows)).groupBy("alert_type", "alert_priority").agg(F.count("*").alias("n"))


@query("h29_predicted_flag", """
    SELECT event_id, round_even(value / 137, 4) AS viral_probability, CASE WHEN round_even(value / 137, 4) >= 0.7E0 THEN 1 ELSE 0 END AS predicted_viral
    FROM events""")
def h29(t: Tables):
    p = F.bround(F.col("value") / 137, 4)
    return t.events.select("event_id", p.alias("viral_probability"), numeric.flag(p >= 0.7, 1, 0).alias("predicted_viral"))


@query("h30_ravs_total", """
    SELECT video_id, CAST(trunc(speed * 0.30E0 + ravs_regulatory_relevance * 0.25E0 + ravs_safety_implications * 0.20E0
      + ravs_influencer_reach * 0.15E0 + ravs_topic_sensitivity * 0.10E0) AS INTEGER) AS ravs_total
    FROM (SELECT *, CASE WHEN ord % 3 = 0 THEN 77 ELSE ravs_speed_of_engagement END AS speed FROM v_ravs)""", V_SCORED, V_RAVS)
def h30(t: Tables):
    rows = t.scored().withColumn("ravs_speed_of_engagement", F.expr("CASE WHEN ord % 3 = 0 THEN 77 ELSE 0 END"))
    return rows.select("video_id", views.components(rows)["ravs_total"].alias("ravs_total"))


def _contribution(test: str, value: str, low: int, otherwise: int | None = None) -> str:
    clipped = f"CAST(trunc(least(greatest({value}, {low}), 100)) AS INTEGER)"
    return clipped if otherwise is None else f"CASE WHEN {test} > 0 THEN {clipped} ELSE {otherwise} END"


@query("h31_signal_contributions", f"""
    SELECT video_id, {_contribution('', 'viral_probability * 95', 40)} AS engagement_velocity_signal,
      {_contribution('subscriber_count', 'CAST(subscriber_count AS DOUBLE) / 500000 * 75', 28, 38)} AS influencer_reach_signal,
      {_contribution('pharma_risk_score', 'pharma_risk_score / 5 * 68', 25, 42)} AS regulatory_sensitivity_signal,
      {_contribution('cluster_volume', 'CAST(cluster_volume AS DOUBLE) / 50 * 55', 18, 33)} AS cross_platform_spread_signal,
      {_contribution('', 'toxicity_score * 100', 15)} AS safety_amplification_signal FROM v_scored""", V_SCORED)
def h31(t: Tables):
    rows = t.scored()
    return rows.select("video_id", *[c.alias(n) for n, c in views.contributions(rows).items()])


@query("h32_risk_tier", """
    SELECT video_id, CASE WHEN ord % 101 >= 70 THEN 'High Risk' WHEN ord % 101 >= 35 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_tier
    FROM v_scored""", V_SCORED)
def h32(t: Tables):
    return t.scored().select("video_id", labels.risk_tier(F.col("ord") % 101).alias("risk_tier"))


V_TIMES = """v_times AS (
  SELECT video_id, viral_probability, CASE WHEN viral_probability >= 0.88E0 THEN '< 1 hr' WHEN viral_probability >= 0.80E0 THEN '~1–2 hrs'
      WHEN viral_probability >= 0.65E0 THEN '~3.2 hrs' WHEN viral_probability >= 0.50E0 THEN '~6–12 hrs' ELSE '> 24 hrs' END AS time_to_virality
  FROM v_scored)"""


@query("h33_time_to_virality", """
    SELECT video_id, time_to_virality, CASE time_to_virality WHEN '< 1 hr' THEN 'Already surging' WHEN '~1–2 hrs' THEN 'Critical threshold'
      WHEN '~3.2 hrs' THEN 'Estimated soon' WHEN '~6–12 hrs' THEN 'Moderate trajectory' ELSE 'Low momentum' END AS time_note FROM v_times""", V_SCORED, V_TIMES)
def h33(t: Tables):
    found = t.scored().select("video_id", labels.time_to_virality(F.col("viral_probability")).alias("v"))
    return found.select("video_id", F.col("v.label").alias("time_to_virality"), F.col("v.note").alias("time_note"))


@query("h34_response_window", """
    SELECT video_id, CASE WHEN label = '< 1 hr' THEN '< 1 hr' WHEN label = '~1–2 hrs' THEN '1–2 hrs' WHEN label = '> 24 hrs' THEN '12–24 hrs'
      ELSE '6–8 hrs' END AS response_window, CASE WHEN label = '< 1 hr' THEN 'Immediate action required' WHEN label = '~1–2 hrs' THEN 'Act within the hour'
      WHEN label = '> 24 hrs' THEN 'Monitor and prepare' ELSE 'Before peak reach' END AS response_note
    FROM (SELECT v.video_id, CASE WHEN s.ord % 10 = 0 THEN 'other' ELSE time_to_virality END AS label
          FROM v_times v JOIN v_scored s ON v.video_id = s.video_id)""", V_SCORED, V_TIMES)
def h34(t: Tables):
    label = F.when(F.col("ord") % 10 == 0, "other").otherwise(labels.time_to_virality(F.col("viral_probability"))["label"])
    found = t.scored().select("video_id", labels.response_window(label).alias("w"))
    return found.select("video_id", F.col("w.label").alias("response_window"), F.col("w.note").alias("response_note"))


V_CURVE = """v_curve AS (
  SELECT video_id, CAST(i AS INTEGER) AS step, x, k / (1 + (k - v) / greatest(v, 1) * exp(-r * x))
      + CASE WHEN a > 0 THEN a * x * exp(-x / 5) * v * 0.08E0 ELSE 0 END AS projected_views
  FROM (SELECT video_id, i, i * 24E0 / 299 AS x, CAST(view_count AS DOUBLE) AS v, growth_acceleration AS a, greatest(view_count * 80E0, 50000) AS k,
      least(greatest(viral_probability * 1000 / greatest(view_count, 1), 0.008E0), 0.45E0) AS r
    FROM v_scored, range(300) AS g(i)))"""


def curve_input(t: Tables):
    return t.scored().withColumn("views_per_hour", F.col("viral_probability") * 1000)


@query("h35_growth_projection", """
    SELECT video_id, step, round(x, 6) AS t, round(projected_views, 3) AS projected_views FROM v_curve""", V_SCORED, V_CURVE)
def h35(t: Tables):
    rows = views.growth_curve(curve_input(t), "video_id")
    return rows.select("video_id", "step", F.round("t", 6).alias("t"), F.round("projected_views", 3).alias("projected_views"))


@query("h35_growth_peak", """
    SELECT video_id, step AS peak_step, round(projected_views, 3) AS peak_views, round(projected_views * 0.82E0, 3) AS viral_threshold
    FROM v_curve QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY projected_views DESC, step) = 1""", V_SCORED, V_CURVE)
def h35_peak(t: Tables):
    return rounded(views.growth_peak(curve_input(t), "video_id"), 3)


@query("h36_display_shaping", """
    SELECT doc_id, CASE WHEN length(text) > 88 THEN concat(left(text, 88), '…') ELSE text END AS narrative,
      CAST(trunc(CASE WHEN score <= 1 THEN score * 100 ELSE score END) AS INTEGER) AS score_display,
      CASE WHEN score > 0.3E0 THEN 'rising' ELSE 'stable' END AS trend_direction
    FROM (SELECT doc_id, text, (n_chars % 700) / 500E0 AS score FROM documents)""")
def h36(t: Tables):
    score = F.expr("(n_chars % 700) / 500E0")
    return t.documents.select(
        "doc_id", text.ellipsis(F.col("text")).alias("narrative"), labels.percent_display(score).alias("score_display"),
        labels.trend_direction(score).alias("trend_direction"),
    )


@query("h37_parse_with_default", """
    SELECT doc_id, coalesce(CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END, 40E0) AS value FROM (
      SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN 'nan' WHEN 2 THEN NULL ELSE concat(' ', CAST(n_chars AS VARCHAR), 'e1') END AS raw
      FROM documents)""")
def h37(t: Tables):
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN 'nan' WHEN 2 THEN NULL ELSE concat(' ', CAST(n_chars AS STRING), 'e1') END")
    return t.documents.select("doc_id", numeric.number(raw, 40.0).alias("value"))


@query("h38_label_decode", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' ELSE lang END AS label FROM documents""")
def h38(t: Tables):
    raw = F.expr("CASE WHEN doc_id % 4 < 3 THEN concat('LABEL_', CAST(doc_id % 4 AS STRING)) ELSE lang END")
    return t.documents.select("doc_id", labels.decode_label(raw).alias("label"))


@query("h39_arg_max_of_label_map", """
    SELECT doc_id, CASE WHEN best IS NULL THEN 'unknown' WHEN best < 0.5E0 THEN 'non_toxic' WHEN a = best THEN 'toxicity'
      WHEN b = best THEN 'insult' ELSE 'threat' END AS label, coalesce(round_even(best, 4), 0E0) AS score
    FROM (SELECT *, greatest(a, b, c) AS best FROM (
      SELECT doc_id, CASE WHEN n_chars % 10 > 0 THEN (n_chars % 13) / 13E0 END AS a, CASE WHEN n_chars % 10 > 0 THEN (n_chars % 7) / 13E0 END AS b,
        CASE WHEN n_chars % 10 > 0 THEN (n_chars % 11) / 13E0 END AS c FROM documents))""")
def h39(t: Tables):
    order = ["toxicity", "insult", "threat"]
    scored = t.documents.selectExpr("doc_id", """CASE WHEN n_chars % 10 > 0 THEN map('threat', (n_chars % 11) / 13E0,
      'insult', (n_chars % 7) / 13E0, 'toxicity', (n_chars % 13) / 13E0) END AS m""")
    best = scored.select("doc_id", labels.top_label(F.col("m"), order, 0.5, "non_toxic").alias("b"))
    return best.select("doc_id", F.col("b.label").alias("label"), F.col("b.score").alias("score"))


@query("h40_scorer_input_cut", "SELECT doc_id, substr(text, 1, 512) AS scorer_input, CAST(length(text) AS INTEGER) AS whole_length FROM documents")
def h40(t: Tables):
    return t.documents.select("doc_id", text.scorer_input(F.col("text")).alias("scorer_input"), F.length("text").alias("whole_length"))
