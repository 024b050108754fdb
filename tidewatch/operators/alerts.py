"""Alert rules, fan-out, scoring and the final table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.constants import ALERT_COLUMNS
from tidewatch.functions.numeric import number, plain, scaled
from tidewatch.functions.labels import range_label, range_labels
from tidewatch.functions.scores import (
    ALERT_WEIGHTS, INFLUENCER_SUBSCRIBERS, ravs, ravs_parts, weighted,
)
from tidewatch.operators.quantiles import bounds, exact_quantiles
from tidewatch.operators.ranking import best_alerts, top
from tidewatch.operators.shaping import existing_only

TOP_ALERTS = 100

# Rule name -> (priority, reason).
RULES = {
    "viral_emerging": ("high", "High virality probability detected"),
    "toxicity_spike": ("high", "High toxicity content detected"),
    "pharma_risk": ("critical", "Potential pharma safety risk detected"),
    "emerging_narrative": ("medium", "Narrative cluster accelerating rapidly"),
    "growth_spike": ("medium", "Rapid growth acceleration detected"),
    "influencer_amplification": ("high", "High influence channel accelerating narrative spread"),
}

INPUTS = [
    "viral_probability", "toxicity_score", "pharma_risk_score", "trend_score",
    "growth_acceleration", "view_velocity", "engagement_rate", "narrative_trend_score",
    "cluster_volume",
]


@dataclass(frozen=True)
class Thresholds:
    """Cut points of the six rules; the last three are quantiles of the scored table."""

    viral: float = 0.80
    toxicity: float = 0.75
    risk: float = 1.0
    narrative: float | None = None
    acceleration: float | None = None
    trend: float | None = None
    subscribers: int = INFLUENCER_SUBSCRIBERS


def prepare(df: DataFrame) -> DataFrame:
    """The nine score inputs as doubles, absent ones as 0."""
    return df.withColumns({c: number(c) if c in df.columns else F.lit(0.0) for c in INPUTS})


def subscribers(df: DataFrame) -> Column:
    """Channel subscribers, else the item's own count, else 0."""
    found = [number(c, None) for c in ("channel_subscriber_count", "subscriber_count") if c in df.columns]
    return F.coalesce(*found, F.lit(0.0))


def learn_thresholds(df: DataFrame, q: float = 0.95, trend_q: float = 0.90, min_acceleration: float | None = None) -> Thresholds:
    """Quantile cut points of a prepared table; read only its three score columns."""
    found = exact_quantiles(df, {
        "narrative": (F.col("narrative_trend_score"), q),
        "acceleration": (F.col("growth_acceleration"), q),
        "trend": (F.col("trend_score"), trend_q),
    })
    if min_acceleration is not None and found["acceleration"] is not None:
        found["acceleration"] = max(found["acceleration"], min_acceleration)
    return Thresholds(**found)


def with_ravs(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """Add ``ravs_score`` and its components. ``limits`` are (min, max) of trend and risk."""
    def score(c: str) -> Column:
        return plain(c) if c in df.columns else F.lit(0.0)

    if limits is None:
        limits = bounds(df, {"trend": score("trend_score"), "risk": score("pharma_risk_score")})
    subs = subscribers(df)
    total = ravs(
        score("viral_probability"), score("toxicity_score"),
        scaled(score("trend_score"), *limits["trend"]),
        scaled(score("pharma_risk_score"), *limits["risk"]), subs,
    )
    parts = ravs_parts(
        score("viral_probability"), score("pharma_risk_score"), score("toxicity_score"),
        subs, score("cluster_volume"),
    )
    return df.withColumns({"ravs_score": total, **parts})


def with_range_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({
        name: range_label(number(c), low, high)
        for name, (c, low, high) in range_labels(df.columns).items()
    })


def rule_tests(df: DataFrame, t: Thresholds) -> dict[str, Column]:
    def reached(c: str, threshold: float | None) -> Column:
        return F.lit(False) if threshold is None else F.col(c) >= F.lit(float(threshold))

    # The influencer rule reads the canonical subscriber count, so channel counts reach it too.
    return {
        "viral_emerging": reached("viral_probability", t.viral),
        "toxicity_spike": reached("toxicity_score", t.toxicity),
        "pharma_risk": reached("pharma_risk_score", t.risk),
        "emerging_narrative": reached("narrative_trend_score", t.narrative),
        "growth_spike": reached("growth_acceleration", t.acceleration),
        "influencer_amplification": (subscribers(df) >= t.subscribers)
        & reached("trend_score", t.trend),
    }


def fan_out(df: DataFrame, t: Thresholds) -> DataFrame:
    """One row per rule that fires, from one pass over the input and without a shuffle."""
    fired = [
        F.when(test, F.struct(
            F.lit(name).alias("alert_type"), F.lit(RULES[name][0]).alias("alert_priority"),
            F.lit(RULES[name][1]).alias("alert_reason"),
        ))
        for name, test in rule_tests(df, t).items()
    ]
    return df.withColumn("_a", F.explode(F.array_compact(F.array(*fired)))).select(
        *df.columns, "_a.alert_type", "_a.alert_priority", "_a.alert_reason"
    )


def with_alert_score(df: DataFrame) -> DataFrame:
    return df.withColumn("alert_score", weighted(ALERT_WEIGHTS))


def final_alerts(scored: DataFrame, n: int = TOP_ALERTS) -> DataFrame:
    """Best row per (video_id, alert_type), highest ``n`` scores, report columns only."""
    best = top(best_alerts(scored), n, "alert_score", "video_id", "alert_type")
    return existing_only(best, ALERT_COLUMNS)


def summary(alerts: DataFrame, topics: int = 10) -> DataFrame:
    """(section, label, n): total, counts by type and priority, most frequent topic strings."""
    counted = alerts.groupingSets(
        [[], ["alert_type"], ["alert_priority"]], "alert_type", "alert_priority"
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "type").otherwise("priority")
    out = counted.select(
        section.alias("section"), F.coalesce("alert_type", "alert_priority", F.lit("all")).alias("label"), "n"
    )
    if "topic_keywords" in alerts.columns:
        from tidewatch.operators.aggregates import value_counts

        words = value_counts(alerts, "topic_keywords").orderBy(F.desc("n"), "label").limit(topics)
        out = out.unionByName(words.select(F.lit("topic").alias("section"), "label", "n"))
    return out
