"""Incremental ingest and snapshot append."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.operators.lookups import new_rows
from tidewatch.operators.ranking import first_per_key

BUCKETS = 256


def batch_table(spark, path: str) -> DataFrame | None:
    """A table written as ``batch_id=<n>`` folders, or None before the first batch."""
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch folder; a replayed batch replaces its own folder only."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def fresh_rows(batch: DataFrame, done: DataFrame | None, order: list[Column], key: str = "video_id") -> DataFrame:
    """Unseen ids, each once (first by ``order``); rows without an id all count as new."""
    named = batch.where(F.col(key).isNotNull())
    unseen = named if done is None else new_rows(named, done, key)
    return first_per_key(unseen, [key], order).unionByName(batch.where(F.col(key).isNull()))


def ingest(stream: DataFrame, path: str, checkpoint: str, order: list[Column], transform: Callable[[DataFrame], DataFrame] | None = None, key: str = "video_id") -> DataStreamWriter:
    """Process and store only ids not stored before, over all earlier batches.

    Start it with ``.start()``; it takes what is available and stops.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        stored = batch_table(batch.sparkSession, path)
        done = None if stored is None else stored.where(F.col("batch_id") < batch_id).select(key)
        rows = fresh_rows(batch, done, order, key)
        write_batch(transform(rows) if transform else rows, path, batch_id)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def id_bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def seen_ids(spark, index: str, touched: Sequence[int], before: int, key: str = "video_id") -> DataFrame | None:
    """Ids that batches before ``before`` stored, in the ``touched`` buckets; no other bucket's files are read."""
    try:
        known = spark.read.schema(f"{key} string, id_bucket int, batch_id long").parquet(index)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return known.where(F.col("id_bucket").isin(list(touched)) & (F.col("batch_id") < before)).select(key)


def ingest_indexed(stream: DataFrame, path: str, index: str, checkpoint: str, order: list[Column], transform: Callable[[DataFrame], DataFrame] | None = None, key: str = "video_id", buckets: int = BUCKETS) -> DataStreamWriter:
    """``ingest`` with the stored ids in a table of their own, by hash bucket and batch.

    A batch reads only the buckets of its own ids, and adds its new ids to them by dynamic partition
    overwrite: a replayed batch replaces its own parts and leaves all others alone. The number of
    buckets is a property of the index and stays as it was at its first batch.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        named = batch.where(F.col(key).isNotNull())
        touched = [r[0] for r in named.select(id_bucket(key, buckets).alias("b")).distinct().collect()]
        done = seen_ids(spark, index, touched, batch_id, key) if touched else None
        rows = fresh_rows(batch, done, order, key)
        write_batch(transform(rows) if transform else rows, path, batch_id)
        stored = spark.read.parquet(f"{path}/batch_id={batch_id}").select(F.col(key).cast("string").alias(key))
        ids = stored.where(F.col(key).isNotNull()).withColumns({"id_bucket": id_bucket(key, buckets), "batch_id": F.lit(batch_id)})
        ids.repartition("id_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id_bucket", "batch_id").parquet(index)
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def ingest_recent(stream: DataFrame, path: str, checkpoint: str, time: str, delay: str, key: str = "video_id") -> DataStreamWriter:
    """Append each id once within ``delay`` of event time; rows without an id all count.

    No table is looked up: ids live in the stream's state and are forgotten once the watermark has passed them,
    so an id that comes again later than ``delay`` is stored again. Which of an id's rows stays is not fixed.
    """
    once = stream.where(F.col(key).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    rows = once.unionByName(stream.where(F.col(key).isNull()))
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def append_snapshots(stream: DataFrame, path: str, checkpoint: str, time: str = "snapshot_time") -> DataStreamWriter:
    """Exactly-once append of every snapshot under its date."""
    return (
        stream.withColumn("ingest_date", F.to_date(time)).writeStream.format("parquet")
        .outputMode("append").partitionBy("ingest_date").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
