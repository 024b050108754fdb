"""Raw items and comments to clean items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.constants import TRANSLATED
from tidewatch.functions import temporal
from tidewatch.functions.text import analysis_text
from tidewatch.operators.lookups import attach_comments, new_rows
from tidewatch.operators.scoring import Translator, translate_column
from tidewatch.operators.shaping import interleaved, without_blanks
from tidewatch.operators.slicing import ordered_concat

EXTRAS = ["duration_seconds", "duration_minutes", "duration_text", "analysis_text_en"]


def comment_texts(comments: DataFrame, order: str = "comment_id", separator: str = "\n\n") -> DataFrame:
    """(video_id, comments_text) of the non-blank comments, in order."""
    solid = without_blanks(comments, ["video_id"])
    return ordered_concat(solid, "video_id", [order], F.col("text"), separator, "comments_text")


def with_duration(df: DataFrame) -> DataFrame:
    seconds = F.col("duration_seconds")
    return df.withColumn("duration_seconds", temporal.duration_seconds(F.col("duration"))).withColumns({
        "duration_minutes": temporal.duration_minutes(seconds),
        "duration_text": temporal.duration_text(seconds),
    })


def clean_items(videos: DataFrame, comments: DataFrame | None = None, done: DataFrame | None = None, translator: Translator | None = None, comment_order: str = "comment_id") -> DataFrame:
    """Attach comment texts, parse durations, add English twins and the analysis text."""
    rows = videos if done is None else new_rows(videos, done)
    base = rows.columns
    if comments is not None:
        rows = attach_comments(rows, comment_texts(comments, comment_order))
        base = base if "comments_text_full" in base else [*base, "comments_text_full"]
    rows = with_duration(rows)
    for c in TRANSLATED:
        if c in rows.columns:
            rows = translate_column(rows, c, f"{c}_en", translator)
    rows = rows.withColumn("analysis_text_en", analysis_text(rows.columns))
    return interleaved(rows, base, EXTRAS)
