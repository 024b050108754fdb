"""First/best rows, sorting and top-n. Every order ends with a unique tiebreak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numeric import number

# Which column each scenario ranks by, first existing one wins.
SCENARIOS = {
    "Highest Regulatory Risk": ["pharma_risk_score", "toxicity_score", "viral_probability"],
    "Highest Viral Threat": ["viral_probability", "trend_score", "growth_acceleration"],
    "Highest Toxicity Signal": ["toxicity_score", "pharma_risk_score", "viral_probability"],
}
SCENARIO_ELSE = ["viral_probability", "ravs_score"]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, by order. The row limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return first_per_key(df, [key], [F.col(c).desc() for c in order])


def latest_values(df: DataFrame, key: str, time: str, tiebreak: str, columns: Sequence[str]) -> DataFrame:
    """Newest non-null value of each column; rows without a time count as newest.

    (key, time) is unique in a snapshot table; rows without a time follow their ``tiebreak``
    number. Order and values are plain numbers, so the aggregate hashes, combines on the map
    side, and a hot key is one small buffer per task.
    """
    undated = F.lit(1 << 62) + F.coalesce(F.col(tiebreak).try_cast("bigint"), F.lit(0))
    rank = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), undated)
    ranked = df.withColumn("_rank", rank)

    def newest(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c)

    return ranked.groupBy(key).agg(*[newest(c) for c in columns])


def best_alerts(alerts: DataFrame) -> DataFrame:
    """Highest-scored row per (video_id, alert_type); rows equal in score, time and id go by their content."""
    order = [F.desc("alert_score")]
    order += [F.desc(c) for c in ("tracking_timestamp", "event_id") if c in alerts.columns]
    order.append(F.xxhash64(*[F.col(c).cast("string") for c in sorted(alerts.columns)]))
    return first_per_key(alerts, ["video_id", "alert_type"], order)


def top(df: DataFrame, n: int, score: str, *tiebreak: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), *tiebreak).limit(n)


def preferred(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    return next((c for c in wanted if c in columns), None)


def best_row(df: DataFrame, scenario: str, tiebreak: str) -> DataFrame:
    """The row a scenario puts first, NULL scores counting as 0."""
    choice = next((cols for name, cols in SCENARIOS.items() if name in scenario), SCENARIO_ELSE)
    column = preferred(df.columns, choice)
    order = [F.desc("_score")] if column else []
    score = number(column) if column else F.lit(0.0)
    return df.withColumn("_score", score).orderBy(*order, F.col(tiebreak)).limit(1).drop("_score")


def best_rows(df: DataFrame, tiebreak: str) -> DataFrame:
    """The leading row of every scenario with its name, from one pass over the table."""
    row = F.struct(*[F.col(c) for c in df.columns])
    leaders = []
    for scenario, choice in SCENARIOS.items():
        column = preferred(df.columns, choice)
        score = number(column) if column else F.lit(0.0)
        leaders.append(F.struct(F.lit(scenario).alias("scenario"), F.min_by(row, F.struct(-score, F.col(tiebreak))).alias("row")))
    picked = df.agg(F.array(*leaders).alias("_l")).select(F.inline("_l"))
    return picked.where("row is not null").select("scenario", "row.*")
