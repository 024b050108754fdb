"""B: projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import V_SCORED, V_VIDEO, Tables, query, rounded
from tidewatch.functions.numeric import number
from tidewatch.operators import shaping
from tidewatch.plans.cleaning import EXTRAS, clean_items

# Trims the whitespace that occurs in the driver texts.
STRIP = r"regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"


@query("b1_safe_numeric", """
    SELECT doc_id, coalesce(CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END, 0E0) AS value
    FROM raw""", """raw AS (
      SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS raw
      FROM documents)""")
def b1(t: Tables):
    raw = t.documents.selectExpr(
        "doc_id", "CASE doc_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL ELSE CAST(n_chars AS STRING) END AS raw"
    )
    return raw.select("doc_id", number("raw").alias("value"))


@query("b2_ensure_columns", """
    SELECT video_id, view_count, 0 AS subscriber_count, '' AS analysis_text_en, CAST(NULL AS DOUBLE) AS emotion_score
    FROM v_video""", V_VIDEO)
def b2(t: Tables):
    return shaping.ensure_columns(t.video().select("video_id", "view_count"), {
        "view_count": F.lit(-1), "subscriber_count": F.lit(0), "analysis_text_en": F.lit(""),
        "emotion_score": F.lit(None).cast("double"),
    })


@query("b3_ordered_projection", """
    SELECT keyword, keyword AS keyword_en, video_id, title, title AS title_en, duration,
      (doc * 3600 + mins * 60) AS duration_seconds
    FROM (SELECT *, CAST(ord % 3 AS INTEGER) AS doc, CAST(ord % 60 AS INTEGER) AS mins FROM v_video)""", V_VIDEO)
def b3(t: Tables):
    rows = clean_items(t.video().select("keyword", "video_id", "title", "duration"))
    return shaping.interleaved(rows, ["keyword", "video_id", "title", "duration"], EXTRAS).select(
        "keyword", "keyword_en", "video_id", "title", "title_en", "duration", "duration_seconds"
    )


@query("b4_existing_only", "SELECT video_id, title, trend_score, view_count FROM v_scored", V_SCORED)
def b4(t: Tables):
    return shaping.existing_only(t.scored(), ["video_id", "title", "emotion_label", "trend_score", "view_count"])


@query("b5_threshold_filter", """
    SELECT video_id, viral_probability, toxicity_score, pharma_risk_score FROM v_scored
    WHERE viral_probability >= 0.80E0 AND toxicity_score >= 0.25E0 AND pharma_risk_score >= 1""", V_SCORED)
def b5(t: Tables):
    rows = t.scored()
    for score, threshold in (("viral_probability", 0.80), ("toxicity_score", 0.25), ("pharma_risk_score", 1)):
        rows = shaping.at_least(rows, score, threshold)
    return rows.select("video_id", "viral_probability", "toxicity_score", "pharma_risk_score")


@query("b6_group_phrase_filter", """
    SELECT video_id, 'matched' AS filter FROM v_video WHERE contains(lower(keyword), 'src1') OR contains(lower(keyword), 'src20')
    UNION ALL SELECT video_id, 'unmatched' FROM v_video
    UNION ALL SELECT video_id, 'all' FROM v_video""", V_VIDEO)
def b6(t: Tables):
    groups = {"All Products": [], "First": ["src1", "src20"]}
    rows = t.video().select("video_id", "keyword")

    def kept(group, table, name):
        return shaping.indication_filter(rows, group, table).select("video_id", F.lit(name).alias("filter"))

    return (
        kept("First", groups, "matched")
        .unionByName(kept("Oncology", {"Oncology": ["trastuzumab"]}, "unmatched"))
        .unionByName(kept("All Products", groups, "all"))
    )


@query("b7_time_range_filter", """
    SELECT video_id, epoch_us(published_at) AS published_us FROM v_video
    WHERE published_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '72' HOUR
      AND published_at <= TIMESTAMP '2024-02-05 12:00:00'""", V_VIDEO)
def b7(t: Tables):
    after = shaping.lookback(F.expr("TIMESTAMP '2024-02-01 00:00:00'"), 72)
    rows = shaping.published_between(t.video(), after, F.expr("TIMESTAMP '2024-02-05 12:00:00'"))
    return rows.select("video_id", F.unix_micros("published_at").alias("published_us"))


@query("b8_drop_null_rows", """
    SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL""")
def b8(t: Tables):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return shaping.without_nulls(rows, ["quality", "toxic"])


@query("b9_drop_blank_keys", f"""
    SELECT doc_id, i, line FROM lines WHERE {STRIP.format('line')} <> ''""", """lines AS (
      SELECT doc_id, CAST(i AS INTEGER) AS i, string_split(text, '. ')[i + 1] AS line
      FROM documents, unnest(range(len(string_split(text, '. ')))) AS u(i))""")
def b9(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "line"))
    return shaping.without_blanks(lines, ["line"])


@query("b10_text_source_fallback", """
    SELECT video_id, 'en' AS source, description AS analysis_text_clean FROM v_video
    UNION ALL SELECT video_id, 'clean', coalesce(CASE WHEN ord % 2 = 0 THEN title END, '') FROM v_video""", V_VIDEO)
def b10(t: Tables):
    only_en = t.video().select("video_id", F.lit("en").alias("source"), F.col("description").alias("analysis_text_en"))
    both = t.video().select(
        "video_id", F.lit("clean").alias("source"), F.col("description").alias("analysis_text_en"),
        F.expr("CASE WHEN ord % 2 = 0 THEN title END").alias("analysis_text_clean"),
    )
    wanted = ["video_id", "source", "analysis_text_clean"]
    return shaping.analysis_source(only_en).select(*wanted).unionByName(shaping.analysis_source(both).select(*wanted))
