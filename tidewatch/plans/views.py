"""Report tables over the scored items and alerts."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import labels, scores
from tidewatch.functions.numeric import number
from tidewatch.functions.text import ellipsis
from tidewatch.operators import aggregates
from tidewatch.operators.alerts import subscribers, with_ravs
from tidewatch.operators.ranking import best_rows, preferred, top
from tidewatch.operators.shaping import existing_only, without_nulls

log = logging.getLogger(__name__)
HIGH_RAVS = 0.70
TASKS_PER_CORE = 4
# The columns of the feed and alert tables.
FEED = ["title", "topic_keywords", "viral_probability", "ravs_score", "sentiment_label", "emerging_narrative"]
ALERT_BRIEF = ["title", "alert_type", "alert_priority", "ravs_score", "viral_probability", "pharma_risk_score"]
ALERT_DETAIL = [
    "title", "alert_type", "alert_priority", "alert_reason", "ravs_score", "viral_probability",
    "pharma_risk_score",
]


def main_table(narrative: DataFrame, features: DataFrame) -> DataFrame:
    """Narratives where there are any, else features; RAVS computed if missing or all NULL.

    Rows the score cannot be computed for get 0.
    """
    rows = features if narrative.isEmpty() else narrative
    if "ravs_score" not in rows.columns or rows.where("ravs_score is not null").isEmpty():
        try:
            return with_ravs(rows.drop("ravs_score"))
        except AnalysisException as error:  # a column the score needs is missing or of another kind
            log.warning("RAVS set to 0: %s", error.getCondition())
            return rows.withColumn("ravs_score", F.lit(0.0))
    return rows


def overview(df: DataFrame, alerts: DataFrame, high: float = HIGH_RAVS) -> DataFrame:
    """One row of headline counts; ``high=70`` is the cut of a score on a 0..100 scale."""
    items = df.agg(
        F.count("*").alias("total_videos"),
        F.count_if(F.col("emerging_narrative") == "emerging").alias("emerging_narratives"),
        F.count_if(F.col("ravs_score") >= high).alias("high_risk"),
        F.avg("viral_probability").alias("avg_viral_score"),
    )
    active = alerts.agg(F.count("*").alias("active_alerts"))
    return items.select("*", active.scalar().alias("active_alerts"))


def probability_histogram(df: DataFrame) -> DataFrame:
    return aggregates.histogram(df, "viral_probability")


def sentiment_share(df: DataFrame) -> DataFrame:
    return aggregates.value_counts(df, "sentiment_label")


def active_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` alerts of the ranked alert table."""
    return existing_only(top(alerts, n, "alert_score", "video_id", "alert_type"), ALERT_BRIEF)


def cluster_ranking(df: DataFrame, key: str, n: int) -> DataFrame:
    means = aggregates.count_and_mean(df, key, "video_id", "viral_probability", "count", "avg_vp")
    return top(means, n, "avg_vp", key)


def narrative_feed(df: DataFrame, tiebreak: str, n: int = 50) -> DataFrame:
    return existing_only(top(df, n, "viral_probability", tiebreak), FEED)


def alert_priorities(alerts: DataFrame) -> DataFrame:
    p = F.lower("alert_priority")
    return alerts.agg(*[F.count_if(p == x).alias(x) for x in ("critical", "high", "medium")])


def alert_detail(alerts: DataFrame) -> DataFrame:
    return existing_only(alerts, ALERT_DETAIL)


def _score(df: DataFrame, c: str, default: float = 0.0) -> Column:
    """The column with NULL as 0; ``default`` is for a column that is not there."""
    return number(c) if c in df.columns else F.lit(default)


def components(df: DataFrame) -> dict[str, Column]:
    """The five components, stored values first, and their weighted total."""
    parts = scores.stored_or(scores.ravs_parts(
        _score(df, "viral_probability"), _score(df, "pharma_risk_score"), _score(df, "toxicity_score"),
        subscribers(df), _score(df, "cluster_volume"),
    ), df.columns)
    return {**parts, "ravs_total": scores.parts_total(parts)}


def contributions(df: DataFrame) -> dict[str, Column]:
    return scores.signal_contributions(
        _score(df, "viral_probability"), subscribers(df), _score(df, "pharma_risk_score"),
        _score(df, "cluster_volume"), _score(df, "toxicity_score"),
    )


def _curves(df: DataFrame, key: str) -> DataFrame:
    """(key, _p): the growth projection of every item as an array, with the page's defaults for absent inputs.

    The inputs are parsed once a row, before the rows are dealt out: inside the 300 points they would be parsed at
    each of them. The narrow rows alone are so small that a few tasks would make all points.
    """
    inputs = {"_v": _score(df, "view_count", 5000.0), "_h": _score(df, "views_per_hour", 800.0), "_a": _score(df, "growth_acceleration", 40.0)}
    parsed = df.select(key, *[c.alias(name) for name, c in inputs.items()])
    rows = parsed.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    return rows.select(key, scores.projection(*map(F.col, inputs)).alias("_p"))


def growth_curve(df: DataFrame, key: str) -> DataFrame:
    """(key, step, t, projected_views) for every item."""
    return _curves(df, key).select(key, F.inline("_p"))


def growth_peak(df: DataFrame, key: str) -> DataFrame:
    """Peak step, its value and the viral threshold line at 82 % of it; the curve stays in its row."""
    # Parsed once a row without a shuffle: a lambda's argument is evaluated once.
    inputs = F.array(F.struct(_score(df, "view_count", 5000.0).alias("v"), _score(df, "views_per_hour", 800.0).alias("h"), _score(df, "growth_acceleration", 40.0).alias("a")))
    points = df.select(key, F.transform(inputs, lambda x: scores.projection(x["v"], x["h"], x["a"]))[0].alias("_p"))
    best = F.array_max(F.transform("_p", lambda p: F.struct(p["projected_views"], (-p["step"]).alias("s"))))
    return points.select(key, best.alias("_b")).select(
        key, (-F.col("_b.s")).alias("peak_step"), F.col("_b.projected_views").alias("peak_views"),
        (F.col("_b.projected_views") * 0.82).alias("viral_threshold"),
    )


def _card(row: DataFrame) -> DataFrame:
    row = row.withColumns({**components(row), **contributions(row)})
    row = row.withColumn("_t", labels.time_to_virality(_score(row, "viral_probability", 0.91)))
    row = row.withColumn("_w", labels.response_window(F.col("_t.label")))
    return row.withColumns({
        "risk_tier": labels.risk_tier(F.col("ravs_total")),
        "time_to_virality": F.col("_t.label"), "time_note": F.col("_t.note"),
        "response_window": F.col("_w.label"), "response_note": F.col("_w.note"),
    }).drop("_t", "_w")


def scenario_cards(df: DataFrame, tiebreak: str) -> DataFrame:
    """The cards of all scenarios, from one pass over the table."""
    return _card(best_rows(df, tiebreak))


def top_risk(df: DataFrame, tiebreak: str) -> DataFrame:
    column = preferred(df.columns, ["ravs_score", "viral_probability", "virality_score"])
    row = top(df.withColumn("_s", number(column)), 1, "_s", tiebreak).drop("_s")
    row = row.withColumns(components(row))
    return row.withColumn("risk_tier", labels.risk_tier(F.col("ravs_total")))


def _shaped(df: DataFrame, text: str, score: str) -> DataFrame:
    trend = number("trend_score") if "trend_score" in df.columns else F.lit(0.0)
    df = df.withColumn("score_display", labels.percent_display(F.col(score)))
    return df.withColumns({
        "narrative": ellipsis(F.col(text).cast("string")),
        "trend_direction": labels.trend_direction(trend),
        "risk_tier": labels.risk_tier(F.col("score_display")),
    })


def narrative_ranking(df: DataFrame, tiebreak: str, n: int = 10) -> DataFrame:
    """Ten narratives by mean score with trend direction; single items where topics have no names."""
    score = preferred(df.columns, ["ravs_score", "viral_probability"])
    scored = df.withColumn(score, number(score))
    if "cluster_topic_name" in df.columns:
        means = [F.avg(score).alias(score), F.count("video_id").alias("video_count")]
        if "trend_score" in df.columns:
            means.append(F.avg("trend_score").alias("trend_score"))
        grouped = scored.where("cluster_topic_name is not null").groupBy("cluster_topic_name").agg(*means)
        return _shaped(top(grouped, n, score, "cluster_topic_name"), "cluster_topic_name", score)
    title = preferred(df.columns, ["topic_keywords", "title_en", "title", "analysis_text_clean"])
    return _shaped(top(scored, n, score, tiebreak), title, score)


def safety_means(df: DataFrame) -> DataFrame:
    wanted = [c for c in ("toxicity_score", "pharma_risk_score", "viral_probability") if c in df.columns]
    return df.agg(*[F.round(F.avg(c), 3).alias(f"avg_{c}") for c in wanted])


def risk_distribution(df: DataFrame) -> DataFrame:
    return aggregates.value_counts(df, "pharma_risk_label")


def toxicity_points(df: DataFrame) -> DataFrame:
    rows = without_nulls(df, ["toxicity_score", "viral_probability"])
    return existing_only(rows, ["video_id", "toxicity_score", "viral_probability", "pharma_risk_label"])


def run_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.sum("predicted_viral").alias("predicted_viral"), F.count("*").alias("total")
    )
