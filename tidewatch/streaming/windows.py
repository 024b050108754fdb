"""Counts per event-time window: fixed, overlapping and session windows under a watermark.

A window is written once, when the watermark has passed its end. Rows that come after that are not counted
in any window; ``late_counts`` keeps their number per batch, so that counts and late rows add up to all rows.
NULL times belong to no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.streaming.ingest import batch_table, write_batch


def windowed_counts(stream: DataFrame, time: str, span: Column, delay: str, by: Sequence[str] = ()) -> DataFrame:
    """(window_start, window_end, *by, n) of a stream or a table. ``span`` is ``F.window(...)`` or ``F.session_window(...)``.

    Counts combine on the map side before the shuffle; the state holds one number per open window and group.
    """
    counted = stream.withWatermark(time, delay).groupBy(span.alias("_w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, "n")


def count_stream(stream: DataFrame, out: str, checkpoint: str, time: str, span: Column, delay: str, by: Sequence[str] = ()) -> DataStreamWriter:
    """Append closed windows to ``out``, each exactly once. Start it with ``.start()``; it takes what is there and stops."""
    return (
        windowed_counts(stream, time, span, delay, by).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def late_counts(stream: DataFrame, out: str, checkpoint: str, time: str, closes: Column, delay: str) -> DataStreamWriter:
    """Per batch: rows that came after their window was written, all rows, and the newest time.

    ``closes`` is the end of a row's last window, for instance ``F.window("ts", "1 day").end``. The watermark of a batch is the
    newest time of the batches before it less ``delay``, as the stream keeps it; it is read from their stored
    rows, so a replayed batch finds the same one.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        known = batch_table(batch.sparkSession, out)
        newest = None if known is None else known.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else closes <= F.lit(newest) - F.expr(f"INTERVAL {delay}")
        write_batch(batch.agg(
            F.count_if(late).alias("late"), F.count("*").alias("rows"), F.max(time).alias("newest")), out, batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)
