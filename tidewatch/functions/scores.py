"""Score formulas. Inputs are Columns already free of NULL unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.numeric import clipped_int, plain, rate

INFLUENCER_SUBSCRIBERS = 100_000

# Weights of the linear scores.
VIRALITY_WEIGHTS = {
    "engagement_rate": 0.4, "views_per_hour": 0.3, "comments_per_hour": 0.2, "sentiment_score": 0.1,
}
TREND_WEIGHTS = {
    "view_velocity": 0.35, "like_velocity": 0.15, "comment_velocity": 0.15,
    "engagement_momentum": 0.15, "virality_score": 0.10, "pharma_risk_score": 0.10,
}
NARRATIVE_WEIGHTS = {"cluster_volume": 0.4, "virality_score": 0.3, "trend_score": 0.3}
ALERT_WEIGHTS = {
    "viral_probability": 0.30, "toxicity_score": 0.20, "trend_score": 0.20,
    "growth_acceleration": 0.15, "pharma_risk_score": 0.15,
}


def weighted(weights: dict[str, float], columns: list[str] | None = None) -> Column:
    """Weighted sum of the named columns, NULL counted as 0, in the order of the weights."""
    total = None
    for name, weight in weights.items():
        value = plain(name) if columns is None or name in columns else F.lit(0.0)
        term = value * F.lit(weight)
        total = term if total is None else total + term
    return total


def engagement(views: Column, likes: Column, comments: Column, hours: Column) -> dict[str, Column]:
    total = likes + comments
    return {
        "engagement_total": total,
        "engagement_rate": rate(total, views),
        "views_per_hour": rate(views, hours),
        "likes_per_hour": rate(likes, hours),
        "comments_per_hour": rate(comments, hours),
    }


def ravs(viral: Column, toxicity: Column, trend01: Column, risk01: Column, subscribers: Column) -> Column:
    """Risk-adjusted virality; trend and risk come in scaled to 0..1."""
    influencer = (subscribers >= INFLUENCER_SUBSCRIBERS).cast("double")
    return F.bround(
        viral * F.lit(0.30) + toxicity * F.lit(0.20) + trend01 * F.lit(0.20)
        + risk01 * F.lit(0.20) + influencer * F.lit(0.10),
        4,
    )


def ravs_parts(viral: Column, risk: Column, toxicity: Column, subscribers: Column, volume: Column) -> dict[str, Column]:
    """The five 0..100 components shown beside the score."""
    return {
        "ravs_speed_of_engagement": clipped_int(viral * 100.0, 40),
        "ravs_regulatory_relevance": F.when(
            risk > 0, clipped_int(risk / F.lit(5.0) * 82.0, 35)
        ).otherwise(clipped_int(viral * 75.0, 35)),
        "ravs_safety_implications": clipped_int(toxicity * 100.0, 20),
        "ravs_influencer_reach": F.when(
            subscribers > 0, clipped_int(subscribers / F.lit(500000.0) * 61.0, 25)
        ).otherwise(F.lit(35)),
        "ravs_topic_sensitivity": F.when(
            volume > 0, clipped_int(volume / F.lit(50.0) * 59.0, 25)
        ).otherwise(clipped_int(viral * 60.0, 25)),
    }


# Weights of the component total.
PART_WEIGHTS = {
    "ravs_speed_of_engagement": 0.30, "ravs_regulatory_relevance": 0.25,
    "ravs_safety_implications": 0.20, "ravs_influencer_reach": 0.15, "ravs_topic_sensitivity": 0.10,
}


def stored_or(parts: dict[str, Column], columns: list[str]) -> dict[str, Column]:
    """A stored component wins over the computed one where it is positive."""
    chosen = {}
    for name, computed in parts.items():
        if name in columns:
            stored = plain(name)
            chosen[name] = F.when(stored > 0, stored.cast("int")).otherwise(computed)
        else:
            chosen[name] = computed
    return chosen


def parts_total(parts: dict[str, Column]) -> Column:
    total = None
    for name, weight in PART_WEIGHTS.items():
        term = parts[name] * F.lit(weight)
        total = term if total is None else total + term
    return total.cast("int")


def signal_contributions(viral: Column, subscribers: Column, risk: Column, volume: Column, toxicity: Column) -> dict[str, Column]:
    return {
        "engagement_velocity_signal": clipped_int(viral * 95.0, 40),
        "influencer_reach_signal": F.when(
            subscribers > 0, clipped_int(subscribers / F.lit(500000.0) * 75.0, 28)
        ).otherwise(F.lit(38)),
        "regulatory_sensitivity_signal": F.when(
            risk > 0, clipped_int(risk / F.lit(5.0) * 68.0, 25)
        ).otherwise(F.lit(42)),
        "cross_platform_spread_signal": F.when(
            volume > 0, clipped_int(volume / F.lit(50.0) * 55.0, 18)
        ).otherwise(F.lit(33)),
        "safety_amplification_signal": clipped_int(toxicity * 100.0, 15),
    }


GRID_POINTS = 300


def projection(views: Column, per_hour: Column, acceleration: Column, hours: float = 24.0) -> Column:
    """Array of (t, projected views): a logistic curve plus a decaying acceleration bump."""
    base = F.greatest(views, F.lit(1.0))
    ceiling = F.greatest(views * 80.0, F.lit(50000.0))
    growth = F.least(F.greatest(per_hour / base, F.lit(0.008)), F.lit(0.45))

    def point(i: Column) -> Column:
        t = i.cast("double") * F.lit(hours) / F.lit(float(GRID_POINTS - 1))
        curve = ceiling / (F.lit(1.0) + (ceiling - views) / base * F.exp(-growth * t))
        bump = acceleration * t * F.exp(-t / 5.0) * views * 0.08
        value = curve + F.when(acceleration > 0, bump).otherwise(F.lit(0.0))
        return F.struct(i.cast("int").alias("step"), t.alias("t"), value.alias("projected_views"))

    return F.transform(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1)), point)
