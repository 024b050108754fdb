"""Table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.constants import EMPTY_ALERT_COLUMNS


def _csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since CSV has no nested form."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ])


def overwrite(df: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Replace a table; with ``csv_path`` also write its CSV twin from the Parquet just written."""
    df.write.mode("overwrite").parquet(path)
    if csv_path:
        written = df.sparkSession.read.schema(df.schema).parquet(path)
        _csv_ready(written).write.mode("overwrite").option("header", True).option(
            "escape", '"'
        ).csv(csv_path)


def append(df: DataFrame, path: str, date_from: str) -> None:
    """Add rows under their ingest date; earlier files are never rewritten.

    Rows are not pulled together by date first, so a day holding most rows
    still writes from every task.
    """
    dated = df.withColumn("ingest_date", F.to_date(date_from))
    dated.write.mode("append").partitionBy("ingest_date").parquet(path)


def replace_run(df: DataFrame, path: str, date_from: str, run: int) -> None:
    """Add the rows of one run; a repeated run replaces its own rows and no others."""
    dated = df.withColumns({"ingest_date": F.to_date(date_from), "run": F.lit(run)})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_date", "run").parquet(path)


def empty_alerts(spark: SparkSession) -> DataFrame:
    ddl = ", ".join(
        f"{c} {'double' if c.endswith('_score') or c == 'viral_probability' else 'string'}"
        for c in EMPTY_ALERT_COLUMNS
    )
    return spark.createDataFrame([], ddl)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Overwrite the alert table; no alerts leaves an empty table with the short header."""
    overwrite(empty_alerts(alerts.sparkSession) if alerts.isEmpty() else alerts, path)
