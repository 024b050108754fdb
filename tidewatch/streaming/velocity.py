"""Velocities of new snapshots, from the last two snapshots kept per item.

Each run snapshots every tracked item, so a run reads a tail table of the size of its
own input instead of the whole history. The tail has two slots, written in turn: a
replayed batch finds the slot it read before unchanged. Batch rows go through the same
operators as the history form, including the slicing of hot items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.operators.slicing import HOT_ROWS
from tidewatch.plans.tracking import previous_values, with_velocities
from tidewatch.streaming.ingest import write_batch


def _tail(spark, state: str, batch_id: int) -> DataFrame | None:
    if batch_id == 0:
        return None
    try:
        return spark.read.parquet(f"{state}/slot={(batch_id - 1) % 2}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _place(order: Sequence[str]) -> Column:
    """Place of a row in its item's order, NULLs last as in the batch form."""
    return F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"_no{i}"), F.col(c).alias(f"_o{i}"))])


def split_late(batch: DataFrame, tail: DataFrame | None, order: Sequence[str] = ("tracking_timestamp", "event_id")) -> tuple[DataFrame, DataFrame]:
    """Rows after the newest known snapshot of their item in the whole ``order``, and the others."""
    if tail is None:
        return batch, batch.limit(0)
    newest = tail.groupBy("video_id").agg(F.max(_place(order)).alias("_newest"))
    marked = batch.join(newest, "video_id", "left").withColumn(
        "_late", F.coalesce(_place(order) <= F.col("_newest"), F.lit(False))
    ).drop("_newest")
    return marked.where("not _late").drop("_late"), marked.where("_late").drop("_late")


def velocities(stream: DataFrame, out: str, state: str, late: str, checkpoint: str, order: tuple[str, ...] = ("tracking_timestamp", "event_id"), limit: int = HOT_ROWS) -> DataStreamWriter:
    """Write each batch's velocities to ``out``.

    Rows older than the newest known snapshot of their item are stored in ``late``; they are
    part of the history and take effect when the batch form recomputes it.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        tail = _tail(batch.sparkSession, state, batch_id)
        batch.persist()
        on_time, behind = split_late(batch, tail, order)
        if tail is not None:
            write_batch(behind, late, batch_id)
        known = on_time.withColumn("_old", F.lit(False))
        if tail is not None:
            known = known.unionByName(tail.withColumn("_old", F.lit(True)))
        rows = with_velocities(previous_values(known, list(order), limit))
        write_batch(rows.where("not _old").drop("_old"), out, batch_id)
        w = Window.partitionBy("video_id").orderBy(*[F.col(c).desc_nulls_first() for c in order])
        last_two = known.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2").drop("_rn", "_old")
        last_two.write.mode("overwrite").parquet(f"{state}/slot={batch_id % 2}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
