"""Labels cut from scores, and decoding of scorer output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.constants import RANGE_CUTS

# Raw class names of a three-way sentiment scorer.
SENTIMENT_CLASSES = {"LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive"}

# Fixed values: (lower probability bound, label, note).
VIRALITY_TIMES = [
    (0.88, "< 1 hr", "Already surging"),
    (0.80, "~1–2 hrs", "Critical threshold"),
    (0.65, "~3.2 hrs", "Estimated soon"),
    (0.50, "~6–12 hrs", "Moderate trajectory"),
]
VIRALITY_TIME_ELSE = ("> 24 hrs", "Low momentum")

# Time label -> (response window, note).
RESPONSE_WINDOWS = {
    "< 1 hr": ("< 1 hr", "Immediate action required"),
    "~1–2 hrs": ("1–2 hrs", "Act within the hour"),
    "~3.2 hrs": ("6–8 hrs", "Before peak reach"),
    "~6–12 hrs": ("6–8 hrs", "Before peak reach"),
    "> 24 hrs": ("12–24 hrs", "Monitor and prepare"),
}
RESPONSE_ELSE = ("6–8 hrs", "Before peak reach")


def range_label(score: Column, low: float, high: float) -> Column:
    return F.when(score < low, "Low").when(score < high, "Medium").otherwise("High")


def range_labels(columns: Sequence[str], cuts: dict = RANGE_CUTS) -> dict[str, tuple]:
    """Label column name -> (score column, cuts), for the scores that exist."""
    return {f"{c}_range": (c, *cuts[c]) for c in cuts if c in columns}


def risk_tier(score: Column) -> Column:
    return F.when(score >= 70, "High Risk").when(score >= 35, "Medium Risk").otherwise("Low Risk")


def time_to_virality(probability: Column) -> Column:
    """struct(label, note) for a viral probability."""
    def pick(position: int) -> Column:
        out = None
        for row in VIRALITY_TIMES:
            test = probability >= row[0]
            out = F.when(test, row[position]) if out is None else out.when(test, row[position])
        return out.otherwise(VIRALITY_TIME_ELSE[position - 1])

    return F.struct(pick(1).alias("label"), pick(2).alias("note"))


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def response_window(time_label: Column) -> Column:
    """struct(label, note) for a time-to-virality label, with a default pair."""
    def pick(i: int) -> Column:
        found = _lookup(time_label, {k: v[i] for k, v in RESPONSE_WINDOWS.items()})
        return F.coalesce(found, F.lit(RESPONSE_ELSE[i]))

    return F.struct(pick(0).alias("label"), pick(1).alias("note"))


def decode_label(label: Column, names: dict[str, str] = SENTIMENT_CLASSES) -> Column:
    return F.coalesce(_lookup(label, names), label)


def top_label(scores: Column, order: Sequence[str], floor: float | None = None, floor_label: str = "") -> Column:
    """struct(label, score) of the best entry of a label -> score map.

    Equal scores go to the label listed first in ``order``. Below ``floor`` the label
    is replaced and the score kept. A missing or empty map gives ('unknown', 0.0).
    """
    ranked = F.transform(
        F.array(*[F.lit(name) for name in order]),
        lambda name: F.struct(scores[name].alias("score"), (-F.array_position(
            F.array(*[F.lit(n) for n in order]), name)).alias("rank"), name.alias("label")),
    )
    best = F.array_max(F.filter(ranked, lambda r: r["score"].isNotNull()))
    label = best["label"]
    if floor is not None:
        label = F.when(best["score"] < floor, F.lit(floor_label)).otherwise(label)
    return F.struct(
        F.coalesce(label, F.lit("unknown")).alias("label"),
        F.coalesce(F.bround(best["score"], 4), F.lit(0.0)).alias("score"),
    )


def trend_direction(trend: Column) -> Column:
    return F.when(trend > 0.3, "rising").otherwise("stable")


def percent_display(score: Column) -> Column:
    return F.when(score <= 1.0, (score * 100.0).cast("int")).otherwise(score.cast("int"))
