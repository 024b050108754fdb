"""Timestamps, ISO durations and publish-time features; ``as_of`` is always explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import strip

_DURATION = r"\APT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?\z"


def utc(c: Column) -> Column:
    """Timestamp of text or timestamp input; anything unparsable is NULL."""
    return F.try_to_timestamp(c.cast("string"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def duration_seconds(c: Column) -> Column:
    """Seconds of ``PT[nH][nM][nS]``; days, blanks and anything else give 0."""
    text = strip(F.coalesce(c, F.lit("")))

    def part(group: int) -> Column:
        digits = F.nullif(F.regexp_extract(text, _DURATION, group), F.lit(""))
        return F.coalesce(digits.try_cast("bigint"), F.lit(0))

    total = part(1) * 3600 + part(2) * 60 + part(3)
    return F.when(text.rlike(_DURATION), total).otherwise(F.lit(0)).try_cast("int")


def duration_minutes(seconds: Column) -> Column:
    return F.round(seconds / F.lit(60.0), 2)


def duration_text(seconds: Column) -> Column:
    hours = F.floor(seconds / 3600)
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    rest = F.pmod(seconds, F.lit(60))
    long_form = F.format_string("%02d:%02d:%02d", hours, minutes, rest)
    short_form = F.format_string("%02d:%02d", minutes, rest)
    return F.when(seconds <= 0, "").when(hours > 0, long_form).otherwise(short_form)


def publish_features(published: Column, as_of: Column) -> dict[str, Column]:
    age = hours_between(as_of, published)
    return {
        "hours_since_publish": age,
        "days_since_publish": age / F.lit(24.0),
        "publish_hour": F.hour(published),
        "publish_weekday": F.date_format(published, "EEEE"),
        "publish_month": F.month(published),
        "is_weekend": F.coalesce((F.weekday(published) >= 5).cast("int"), F.lit(0)),
    }


def minutes_since(published: Column, at: Column) -> Column:
    return F.round((F.unix_micros(at) - F.unix_micros(published)) / F.lit(6.0e7), 2)
