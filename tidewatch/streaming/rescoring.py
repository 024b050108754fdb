"""Micro-batch alerts against persisted thresholds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.functions.numeric import plain
from tidewatch.operators import alerts as rules
from tidewatch.operators.ranking import best_alerts
from tidewatch.operators.sketches import merged_bounds, merged_quantiles, value_sketches
from tidewatch.plans.alerting import LEARNED, learn, scored_alerts
from tidewatch.session import stage
from tidewatch.streaming.ingest import batch_table, write_batch

_LIMITED = ("trend_score", "pharma_risk_score")
_LIMITS = ("trend_low", "trend_high", "risk_low", "risk_high")


def save_thresholds(df: DataFrame, path: str) -> None:
    """Learn the cut points of a scored table and store them as one row."""
    thresholds, limits = learn(df)
    row = asdict(thresholds) | dict(zip(_LIMITS, (*limits["trend"], *limits["risk"])))
    ddl = ", ".join(f"{c} {'int' if c == 'subscribers' else 'double'}" for c in row)
    df.sparkSession.createDataFrame([tuple(row.values())], ddl).coalesce(1).write.mode("overwrite").parquet(path)


def store_scores(df: DataFrame, path: str, batch_id: int) -> None:
    """Sum up one batch's scores under its number: a sketch of each learned column; a replay replaces it."""
    rows = rules.prepare(df)
    write_batch(value_sketches(rows, {c: F.col(c) for c in LEARNED} | {f"plain_{c}": plain(c) for c in _LIMITED}), path, batch_id)


def thresholds_from_sketches(spark: SparkSession, path: str, before: int | None = None, q: float = 0.95, trend_q: float = 0.90) -> tuple[rules.Thresholds, dict]:
    """Cut points over all stored batches (or those before a number), without reading any scored row.

    Quantiles are within the sketches' rank error of ``learn``'s; the limits are exact.
    """
    stored = batch_table(spark, path)
    if stored is None:
        return rules.Thresholds(), {"trend": (None, None), "risk": (None, None)}
    if before is not None:
        stored = stored.where(F.col("batch_id") < before)
    found = merged_quantiles(stored, {
        "narrative": ("narrative_trend_score", q), "acceleration": ("growth_acceleration", q), "trend": ("trend_score", trend_q),
    })
    limits = merged_bounds(stored, [f"plain_{c}" for c in _LIMITED])
    return rules.Thresholds(**found), dict(zip(("trend", "risk"), limits.values()))


def load_thresholds(spark: SparkSession, path: str) -> tuple[rules.Thresholds, dict]:
    row = spark.read.parquet(path).first().asDict()
    limits = {"trend": (row.pop("trend_low"), row.pop("trend_high")), "risk": (row.pop("risk_low"), row.pop("risk_high"))}
    return rules.Thresholds(**row), limits


def alert_stream(stream: DataFrame, thresholds: str, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] | None = None, learn_on: bool = False) -> DataStreamWriter:
    """Score each batch, raise its alerts and keep the best per (item, type) of the batch.

    ``thresholds`` is the stored row of cut points. With ``learn_on`` it is a folder of sketches: each batch
    adds its own scores and is judged by the cut points of all batches up to and with itself.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = score(batch) if score else batch
        if learn_on:
            rows = stage(rows, "scored-batch")
            store_scores(rows, thresholds, batch_id)
            cuts, limits = thresholds_from_sketches(batch.sparkSession, thresholds, batch_id + 1)
        else:
            cuts, limits = load_thresholds(batch.sparkSession, thresholds)
        write_batch(best_alerts(scored_alerts(rows, cuts, limits)), out, batch_id)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def current_alerts(spark: SparkSession, out: str, n: int = rules.TOP_ALERTS) -> DataFrame:
    """The alert table over all batches so far."""
    return rules.final_alerts(batch_table(spark, out).drop("batch_id"), n)

