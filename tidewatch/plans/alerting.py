"""Predicted rows to the alert table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import plain
from tidewatch.operators import alerts as rules
from tidewatch.operators.quantiles import bounds
from tidewatch.operators.ranking import latest_rows
from tidewatch.session import stage

LEARNED = ["trend_score", "pharma_risk_score", "narrative_trend_score", "growth_acceleration"]


def learn(df: DataFrame) -> tuple[rules.Thresholds, dict]:
    """Rule thresholds and score limits of a table, from four of its columns written once."""
    narrow = stage(rules.prepare(df).select(*LEARNED), "scores")
    limits = bounds(narrow, {"trend": plain("trend_score"), "risk": plain("pharma_risk_score")})
    return rules.learn_thresholds(narrow), limits


def scored_alerts(df: DataFrame, thresholds: rules.Thresholds | None = None, limits: dict | None = None, label_after_score: bool = False) -> DataFrame:
    """Every fired rule with its alert score, before deduplication.

    With given thresholds and limits the plan is one pass without any action. Range labels are
    set before the alert score exists, so that score gets none unless ``label_after_score``.
    """
    rows = rules.prepare(df)
    if thresholds is None or limits is None:
        found = learn(rows)
        thresholds, limits = thresholds or found[0], limits or found[1]
    rows = rules.with_ravs(rows, limits)
    if label_after_score:
        return rules.with_range_labels(rules.with_alert_score(rules.fan_out(rows, thresholds)))
    return rules.with_alert_score(rules.fan_out(rules.with_range_labels(rows), thresholds))


def build_alerts(predicted: DataFrame, n: int = rules.TOP_ALERTS, latest_only: bool = False) -> DataFrame:
    """The top alerts of all rows, or of the newest row per item; rows of one time are told apart by their content."""
    if latest_only and "tracking_timestamp" in predicted.columns:
        content = F.xxhash64(*[F.col(c) for c in predicted.columns])
        predicted = latest_rows(predicted.withColumn("_content", content), "video_id", ["tracking_timestamp", "_content"]).drop("_content")
    return rules.final_alerts(scored_alerts(predicted), n)
