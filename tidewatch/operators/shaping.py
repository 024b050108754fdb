"""Column sets and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.constants import INDICATION_GROUPS, TRANSLATED
from tidewatch.functions.text import any_phrase, strip


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add the missing columns only, each with its default."""
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def existing_only(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def interleaved(df: DataFrame, base: Sequence[str], extras: Sequence[str]) -> DataFrame:
    """Base columns, each text column followed by its ``_en`` twin, extras last."""
    order: list[str] = []
    for c in base:
        order.append(c)
        if c in TRANSLATED:
            order.append(f"{c}_en")
    order += [c for c in extras if c not in order]
    return existing_only(df, order)


def at_least(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.where(F.col(score) >= threshold)


def indication_filter(df: DataFrame, group: str, groups: dict[str, list[str]] = INDICATION_GROUPS, column: str = "keyword") -> DataFrame:
    """Items whose keyword contains a phrase of the group.

    A group without phrases, or one that matches nothing, keeps every row.
    """
    phrases = groups.get(group, [])
    if not phrases or column not in df.columns:
        return df
    hit = any_phrase(F.col(column), phrases)
    any_hit = df.select(F.bool_or(hit)).scalar()
    return df.where(hit | ~F.coalesce(any_hit, F.lit(False)))


def published_between(df: DataFrame, after: Column | None = None, before: Column | None = None) -> DataFrame:
    if after is not None:
        df = df.where(F.col("published_at") >= after)
    if before is not None:
        df = df.where(F.col("published_at") <= before)
    return df


def lookback(as_of: Column, hours: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(0), F.lit(hours))


def without_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def without_blanks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(strip(F.col(c)) != "")
    return df


def analysis_source(df: DataFrame) -> DataFrame:
    """Make ``analysis_text_clean`` present and never NULL, from ``analysis_text_en`` if need be."""
    for c in ("analysis_text_clean", "analysis_text_en"):
        if c in df.columns:
            return df.withColumn("analysis_text_clean", F.coalesce(F.col(c), F.lit("")))
    raise ValueError("neither analysis_text_clean nor analysis_text_en is present")
