"""Velocities of new snapshots with keyed state: the last two snapshots of every item, in a RocksDB state store.

A micro-batch reads and writes the state of the items it holds and of no others. Spark groups the batch's snapshots by item, so a task sees one item at a time. What
it holds of an item is that item's share of one micro-batch, ten numbers a snapshot, which the stream's
``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bounds. State is versioned with the checkpoint, and the file sink takes a
batch once, so a batch that is run again gives the same table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.plans.tracking import PREVIOUS, with_velocities

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_TIME = (1 << 63) - 1  # a missing time or id stands behind all others
NO_ROW = -(1 << 63)
_VALUES = ["view_count", "like_count", "comment_count", "engagement_rate"]
_STATE = "t1 long, e1 long, view_count1 double, like_count1 double, comment_count1 double, engagement_rate1 double, t2 long, view_count2 double"
_ROW = "absent boolean, item string, micros long, place long, view_count double, like_count double, comment_count double, engagement_rate double"
_OUT = f"{_ROW}, late boolean, micros1 long, micros2 long, view_count2 double, " + ", ".join(f"{c}1 double" for c in _VALUES)


def _nullable(value: float) -> float | None:
    return None if pd.isna(value) else float(value)


class LastTwo(StatefulProcessor):
    """Gives each snapshot the one and two before it in its item's order; those at or before the newest known one are late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # An item has few rows a batch and is called for each: plain arrays, and one frame at the end.
        frames = list(rows)
        held = {c: np.concatenate([f[c].to_numpy() for f in frames]) for c in frames[0].columns}
        order = np.lexsort((held["place"], held["micros"]))
        held = {c: x[order] for c, x in held.items()} | {c: held[c][order].astype(float) for c in _VALUES}
        micros, place = held["micros"].astype(np.int64), held["place"].astype(np.int64)
        known = self.last.get() if self.last.exists() else None
        late = np.zeros(len(order), bool)
        if known is not None:
            late = (micros < known[0]) | ((micros == known[0]) & (place <= known[1]))
        fresh = np.flatnonzero(~late)
        before = known or (NO_ROW, NO_ROW, None, None, None, None, NO_ROW, None)
        n = len(fresh)
        times = np.concatenate([np.array([before[6], before[0]], np.int64), micros[fresh]])
        values = {c: np.concatenate([np.array([before[2 + k]], float), held[c][fresh]]) for k, c in enumerate(_VALUES)}
        views = np.concatenate([np.array([before[7]], float), values["view_count"]])
        added = {c: np.full(len(order), NO_ROW) for c in ("micros1", "micros2")} | {c: np.full(len(order), np.nan) for c in ("view_count2", *(f"{c}1" for c in _VALUES))}
        if n:
            added["micros1"][fresh], added["micros2"][fresh], added["view_count2"][fresh] = times[1:n + 1], times[:n], views[:n]
            for c in _VALUES:
                added[f"{c}1"][fresh] = values[c][:n]
            newest = fresh[-1]
            self.last.update((int(micros[newest]), int(place[newest]), *(_nullable(held[c][newest]) for c in _VALUES), int(times[n]), _nullable(views[n])))
        yield pd.DataFrame(held | {"late": late} | added, copy=False)

    def close(self) -> None:
        pass


def _time(micros: str) -> Column:
    c = F.col(micros)
    return F.when((c != NO_TIME) & (c != NO_ROW), F.timestamp_micros(c))


def _value(name: str) -> Column:
    return F.nanvl(F.col(name), F.lit(None).cast("double"))


def with_previous(stream: DataFrame, order: tuple[str, str] = ("tracking_timestamp", "event_id"), key: str = "video_id") -> DataFrame:
    """``stream`` reduced to key, order and values, with velocities and ``late``. Values are exact up to 2^53."""
    time, event = order
    types = dict(stream.dtypes)
    rows = stream.select(
        F.col(key).isNull().alias("absent"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.unix_micros(time), F.lit(NO_TIME)).alias("micros"), F.coalesce(F.col(event).cast("long"), F.lit(NO_TIME)).alias("place"),
        *[F.col(c).cast("double").alias(c) for c in _VALUES])
    found = rows.groupBy("absent", "item").transformWithStateInPandas(LastTwo(), _OUT, "Append", "None")
    one = {"tracking_timestamp": _time("micros1")} | {c: _value(f"{c}1").cast(types[c]) for c in _VALUES}
    two = {"tracking_timestamp": _time("micros2"), "view_count": _value("view_count2").cast(types["view_count"])}
    shaped = found.select(
        F.when(~F.col("absent"), F.col("item")).cast(types[key]).alias(key), _time("micros").alias("tracking_timestamp"),
        F.when(F.col("place") != NO_TIME, F.col("place")).cast(types[event]).alias(event), *[_value(c).cast(types[c]).alias(c) for c in _VALUES], F.col("late").alias("late"),
        F.when(F.col("micros1") != NO_ROW, F.struct(*[c.alias(n) for n, c in one.items()])).alias("_prev1"),
        F.when(F.col("micros2") != NO_ROW, F.struct(*[c.alias(n) for n, c in two.items()])).alias("_prev2"))
    return with_velocities(shaped.withColumns({out: F.col(f"_prev1.{c}") for out, c in PREVIOUS.items()}))


def start(stream: DataFrame, out: str, checkpoint: str, order: tuple[str, str] = ("tracking_timestamp", "event_id")) -> StreamingQuery:
    """Append velocities to ``out``, on-time and late rows in folders of their own; takes what is available and stops.

    The state store's provider is set for this query only.
    """
    conf = stream.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STORE)
    try:
        return (
            with_previous(stream, order).writeStream.format("parquet").outputMode("append").partitionBy("late")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The table that ``start`` writes; its folder names hold ``late`` as text."""
    return spark.read.parquet(out).withColumn("late", F.col("late").cast("boolean"))
