"""Tracking history, velocities and trend labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numeric import flag, number, plain
from tidewatch.functions.scores import TREND_WEIGHTS, weighted
from tidewatch.functions.temporal import hours_between
from tidewatch.operators.lookups import refresh_metrics
from tidewatch.operators.quantiles import quantiles_once
from tidewatch.operators.ranking import latest_values
from tidewatch.operators.shaping import ensure_columns
from tidewatch.operators.slicing import HOT_ROWS, previous_rows
from tidewatch.constants import LIVE_METRICS
from tidewatch.sources.schemas import TRACKING_HISTORY

COUNTS = ["view_count", "like_count", "comment_count"]
# Carried beside the fixed history columns, so later stages find what they ask for.
CARRIED = [
    "keyword", "views_per_hour", "likes_per_hour", "comments_per_hour", "text_length", "word_count",
    "emoji_count", "question_mark_count", "exclamation_count",
]
# Column -> what it holds of the previous snapshot.
PREVIOUS = {
    "prev_views": "view_count", "prev_likes": "like_count", "prev_comments": "comment_count",
    "prev_engagement": "engagement_rate", "prev_timestamp": "tracking_timestamp",
}
FILLED = [
    "view_velocity", "like_velocity", "comment_velocity", "engagement_velocity",
    "growth_acceleration", "engagement_momentum",
]


def latest_metrics(snapshots: DataFrame, tiebreak: str) -> DataFrame:
    """Newest known counts per item."""
    live = [c for c in LIVE_METRICS if c in snapshots.columns]
    return latest_values(snapshots, "video_id", "snapshot_time", tiebreak, live)


def snapshot(features: DataFrame, at: Column, latest: DataFrame | None = None, recompute_rates: bool = False) -> DataFrame:
    """One history row per item, stamped ``at``, with live counts where snapshots exist.

    ``recompute_rates`` re-derives engagement and virality from the refreshed counts.
    """
    rows = refresh_metrics(features, latest)
    if recompute_rates:
        from tidewatch.plans.features import with_engagement, with_virality

        rows = with_virality(with_engagement(rows))
    fields = [f for f in TRACKING_HISTORY.fields if f.name != "tracking_timestamp"]
    rows = ensure_columns(rows, {f.name: F.lit(None).cast(f.dataType) for f in fields})
    subs = [number(c, None) for c in ("channel_subscriber_count", "subscriber_count") if c in rows.columns]
    rows = rows.withColumn("subscriber_count", F.coalesce(*subs, F.lit(0.0)))
    kept = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields]
    extra = [c for c in CARRIED if c in rows.columns]
    return rows.select(*kept, *extra, at.alias("tracking_timestamp"))


def append_history(history: DataFrame | None, new: DataFrame) -> DataFrame:
    """History plus new rows, aligned by name; duplicates stay."""
    return new if history is None else history.unionByName(new, allowMissingColumns=True)


def _tiebreak(df: DataFrame) -> list[str]:
    return [c for c in ("event_id",) if c in df.columns]


def previous_values(df: DataFrame, order: Sequence[str] | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """Counts, engagement and time of the previous snapshot of the same item.

    One exchange and one sort by item; also yields the velocity of the previous row, from
    the row before it.
    """
    order = list(order or ["tracking_timestamp", *_tiebreak(df)])
    df = ensure_columns(df, {c: F.lit(0.0) for c in [*COUNTS, "engagement_rate"]})
    rows = previous_rows(df, "video_id", order, [*COUNTS, "engagement_rate", "tracking_timestamp"], limit)
    return rows.withColumns({out: F.col(f"_prev1.{c}") for out, c in PREVIOUS.items()})


def _velocity(now: Column, before: Column, hours: Column) -> Column:
    return (now - before).cast("double") / F.nullif(hours, F.lit(0.0))


def with_velocities(df: DataFrame) -> DataFrame:
    """Change per hour against the previous snapshot, and its own change.

    Equal timestamps give NULL, as does a missing previous snapshot.
    """
    hours = F.nullif(hours_between(F.col("tracking_timestamp"), F.col("prev_timestamp")), F.lit(0.0))
    df = df.withColumn("time_diff_hours", hours)
    h = F.col("time_diff_hours")
    before = hours_between(F.col("_prev1.tracking_timestamp"), F.col("_prev2.tracking_timestamp"))
    df = df.withColumns({
        "view_velocity": _velocity(F.col("view_count"), F.col("prev_views"), h),
        "like_velocity": _velocity(F.col("like_count"), F.col("prev_likes"), h),
        "comment_velocity": _velocity(F.col("comment_count"), F.col("prev_comments"), h),
        "engagement_velocity": _velocity(F.col("engagement_rate"), F.col("prev_engagement"), h),
        "prev_view_velocity": _velocity(F.col("_prev1.view_count"), F.col("_prev2.view_count"), before),
    }).drop("_prev1", "_prev2")
    return df.withColumn("growth_acceleration", F.col("view_velocity") - F.col("prev_view_velocity"))


def with_trend_score(df: DataFrame) -> DataFrame:
    momentum = plain("like_velocity") + plain("comment_velocity")
    df = df.withColumn("engagement_momentum", momentum)
    return df.withColumn("trend_score", weighted(TREND_WEIGHTS, df.columns))


def trend_thresholds(df: DataFrame, q: float = 0.95) -> dict[str, float | None]:
    return quantiles_once(df, {
        "trend": (plain("trend_score"), q), "acceleration": (plain("growth_acceleration"), q),
    })


def with_trend_labels(df: DataFrame, thresholds: dict[str, float | None]) -> DataFrame:
    """Trend label (at or above) and spike flag (strictly above); then velocities NULL -> 0."""
    def beyond(c: str, t: float | None, strict: bool) -> Column:
        if t is None:
            return F.lit(False)
        return F.col(c) > F.lit(t) if strict else F.col(c) >= F.lit(t)

    labelled = df.withColumns({
        "trend_label": flag(beyond("trend_score", thresholds["trend"], False), "trending", "normal"),
        "spike_detected": flag(beyond("growth_acceleration", thresholds["acceleration"], True), 1, 0),
    })
    return labelled.na.fill(0.0, subset=[c for c in FILLED if c in labelled.columns])


def tracking_rows(history: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """History with velocities and trend score, before the table-wide labels."""
    numeric = ["engagement_rate", "virality_score", "pharma_risk_score"]
    history = history.withColumns({c: plain(c) for c in numeric if c in history.columns})
    return with_trend_score(with_velocities(previous_values(history, limit=limit)))


def build_tracking(history: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """All tracking features.

    The thresholds come from a first pass over counts and times only; the second pass carries
    the texts. Writing the wide rows in between would cost more than that narrow pass.
    """
    rows = tracking_rows(history, limit)
    return with_trend_labels(rows, trend_thresholds(rows))
