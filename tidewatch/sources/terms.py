"""Search-term lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import strip


def list_terms(df: DataFrame, list_col: str) -> DataFrame:
    """(ord, term) of a comma list held in a column of a one-list table."""
    parts = df.select(F.posexplode(F.split(list_col, ",")).alias("ord", "term"))
    return parts.select(F.col("ord").cast("bigint"), strip(F.col("term")).alias("term")).where(
        "term <> ''"
    )


def file_terms(lines: DataFrame, ord_col: str, text_col: str) -> DataFrame:
    """(ord, term) of text lines; blanks and ``#`` comments are skipped."""
    term = strip(F.col(text_col))
    rows = lines.select(F.col(ord_col).cast("bigint").alias("ord"), term.alias("term"))
    return rows.where((F.col("term") != "") & ~F.startswith("term", F.lit("#")))


def distinct_terms(terms: DataFrame) -> DataFrame:
    """Each term once, at its first place."""
    return terms.groupBy("term").agg(F.min("ord").alias("ord"))


def term_list(spark: SparkSession, raw: str | None, path: str | None, default: Sequence[str]) -> DataFrame:
    """Terms of a comma list followed by those of a text file, or the default list if neither has any."""
    found = None
    if raw:
        found = list_terms(spark.createDataFrame([(raw,)], "raw string"), "raw")
    if path:
        text = spark.read.option("wholetext", True).text(path)
        lines = text.select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("ord", "line"))
        from_file = file_terms(lines, "ord", "line").withColumn("ord", F.col("ord") + (1 << 32))
        found = from_file if found is None else found.unionByName(from_file)
    if found is None or found.isEmpty():
        found = spark.createDataFrame([(i, t) for i, t in enumerate(default)], "ord bigint, term string")
    return distinct_terms(found)
