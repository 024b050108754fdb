"""Ordered per-key work that survives a key holding a large share of all rows.

A plain ``Window.partitionBy(key)`` puts one key into one task. Keys above a row limit
are cut into consecutive slices of their order column; windows then run per (key, slice)
and a small carry table, with a bounded number of rows per slice, links the slices. There are at
most rows / limit hot keys and about twice as many slices, so the list of cuts is broadcast;
the carry table joins on the window's own partitioning and moves no row of the big side.
Without hot keys the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 2_000_000
_SLICE = "_slice"
_BLOCK = 100


def _position(df: DataFrame, order: str) -> Column:
    if isinstance(df.schema[order].dataType, T.TimestampType):
        return F.unix_micros(order)
    return F.col(order)


def hot_keys(df: DataFrame, key: str, limit: int = HOT_ROWS) -> list:
    """Keys with more than ``limit`` rows and their counts: at most rows / limit of them, 50,000 for 10^11 rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()


def _cuts_below(cuts: Column, every: Column, position: Column) -> Column:
    """How many ascending cuts lie below a position.

    ``every`` holds each hundredth cut: it finds the block, and only that block is compared.
    """
    blocks = F.size(F.filter(every, lambda c: c < position))
    first = F.greatest(blocks - 1, F.lit(0)) * _BLOCK
    return first + F.size(F.filter(F.slice(cuts, first + 1, _BLOCK), lambda c: c < position))


def with_slices(df: DataFrame, key: str, order: str, limit: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Add ``_slice`` (0 for ordinary keys); the flag says whether any key was cut.

    Rows with equal order values stay in one slice, rows without one come last.
    """
    hot = hot_keys(df, key, limit)
    if not hot:
        return df.withColumn(_SLICE, F.lit(0)), False
    spark = df.sparkSession
    pieces = min(10_000, 1 + max(ceil(r["n"] / limit) for r in hot))
    steps = [i / pieces for i in range(1, pieces)]
    schema = T.StructType([df.schema[key], T.StructField("_n", T.LongType())])
    named = spark.createDataFrame([(r[key], r["n"]) for r in hot], schema)
    # Each key keeps cuts in proportion to its rows, so all cuts together are about rows / limit.
    own = F.least(F.lit(pieces), F.ceil(F.col("_n") / limit).cast("int") + 1)
    cuts = (
        _join(df.select(key, _position(df, order).alias("_p")), F.broadcast(named), key, "inner")
        .groupBy(key, "_n")
        .agg(F.percentile_approx("_p", steps, 100 * pieces).alias("_grid"))
        .withColumn("_own", own)
        .select(key, F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.col("_own") - 1),
            lambda i: F.element_at("_grid", F.floor(i * pieces / F.col("_own")).cast("int")),
        )).alias("_cuts"))
        .withColumn("_every", F.filter("_cuts", lambda c, i: i % _BLOCK == 0))
    )
    position = _position(df, order)
    sliced = _join(df, F.broadcast(cuts), key, "left").withColumn(
        _SLICE,
        F.when(F.col("_cuts").isNull(), 0)
        .when(position.isNull(), F.size("_cuts") + 1)
        .otherwise(_cuts_below(F.col("_cuts"), F.col("_every"), position)),
    )
    return sliced.withColumn("_hot", F.col("_cuts").isNotNull()).drop("_cuts", "_every"), True


def _join(df: DataFrame, side: DataFrame, key: str, how: str) -> DataFrame:
    """Join a broadcast side by key, NULL matching NULL: rows without a key can be a hot group too."""
    return df.join(side.withColumnRenamed(key, "_other"), F.col(key).eqNullSafe(F.col("_other")), how).drop("_other")


def _solid(df: DataFrame, key: str) -> DataFrame:
    """Add ``_key``, which is never NULL, so that windows and the carry's join agree on rows without a key."""
    return df.withColumn("_key", F.struct(F.col(key)))


def _asc(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def previous_rows(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], limit: int = HOT_ROWS) -> DataFrame:
    """Add structs ``_prev1`` and ``_prev2``: ``columns`` of the one and two rows before."""
    payload = F.struct(*[F.col(c) for c in columns])
    sliced, cut = with_slices(df, key, order[0], limit)
    if not cut:
        w = Window.partitionBy(key).orderBy(*_asc(order))
        return df.withColumns({"_prev1": F.lag(payload, 1).over(w), "_prev2": F.lag(payload, 2).over(w)})

    sliced = _solid(sliced, key)
    part = Window.partitionBy("_key", _SLICE)
    w = part.orderBy(*_asc(order))
    ends = (
        sliced.where("_hot")
        .withColumn("_back", F.row_number().over(part.orderBy(*[F.col(c).desc_nulls_first() for c in order])))
        .where("_back <= 2")
    )
    across = Window.partitionBy("_key").orderBy(_SLICE, F.desc("_back"))
    carry = (
        ends.select(
            "_key", _SLICE, "_back",
            F.lag(payload, 1).over(across).alias("_c1"),
            F.lag(payload, 2).over(across).alias("_c2"),
            F.max("_back").over(part).alias("_first"),
        )
        .where("_back = _first")
        .select("_key", _SLICE, "_c1", "_c2")
    )
    local = sliced.withColumns({
        "_rn": F.row_number().over(w),
        "_l1": F.lag(payload, 1).over(w),
        "_l2": F.lag(payload, 2).over(w),
    })
    linked = local.join(carry, ["_key", _SLICE], "left")
    return linked.withColumns({
        "_prev1": F.when(F.col("_rn") == 1, F.col("_c1")).otherwise(F.col("_l1")),
        "_prev2": F.when(F.col("_rn") == 1, F.col("_c2"))
        .when(F.col("_rn") == 2, F.col("_c1"))
        .otherwise(F.col("_l2")),
    }).drop("_rn", "_l1", "_l2", "_c1", "_c2", "_hot", "_key", _SLICE)


def running_totals(df: DataFrame, key: str, order: Sequence[str], totals: dict[str, Column], limit: int = HOT_ROWS) -> DataFrame:
    """Add running sums per key, up to and including the current row."""
    sliced, cut = with_slices(df, key, order[0], limit)
    rows = (Window.unboundedPreceding, Window.currentRow)
    if not cut:
        w = Window.partitionBy(key).orderBy(*_asc(order)).rowsBetween(*rows)
        return df.withColumns({name: F.sum(c).over(w) for name, c in totals.items()})
    sliced = _solid(sliced, key)
    w = Window.partitionBy("_key", _SLICE).orderBy(*_asc(order)).rowsBetween(*rows)
    before = Window.partitionBy("_key").orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sliced.where("_hot").groupBy("_key", _SLICE)
        .agg(*[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
        .select("_key", _SLICE, *[F.sum(f"_t_{n}").over(before).alias(f"_b_{n}") for n in totals])
    )
    local = sliced.withColumns({f"_s_{n}": F.sum(c).over(w) for n, c in totals.items()})
    linked = local.join(carry, ["_key", _SLICE], "left")
    zero = F.lit(0)
    return linked.withColumns(
        {n: F.col(f"_s_{n}") + F.coalesce(F.col(f"_b_{n}"), zero) for n in totals}
    ).drop(*[p + n for n in totals for p in ("_s_", "_b_")], "_hot", "_key", _SLICE)


def ordered_concat(df: DataFrame, key: str, order: Sequence[str], text: Column, separator: str, out: str, parts: bool = False, limit: int = HOT_ROWS) -> DataFrame:
    """Join the non-blank texts of each key in order.

    Hot keys are joined slice by slice before the slices are joined. ``parts=True`` keeps one row
    per (key, part) instead, for keys whose whole text would not fit into one value.
    """
    from tidewatch.functions.text import strip

    named = df.withColumn("_text", strip(text))
    sliced, cut = with_slices(named, key, order[0], limit)
    nulls_last = [x for c in order for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    ranked = F.struct(*nulls_last, F.col("_text"))

    def joined(column: str, field: str) -> Column:
        texts = F.transform(F.array_sort(F.collect_list(column)), lambda x: x[field])
        return F.array_join(texts, separator)

    solid = sliced.where("_text <> ''").select(key, _SLICE, ranked.alias("_r"))
    per_slice = solid.groupBy(key, _SLICE).agg(joined("_r", "_text").alias(out))
    if parts:
        return per_slice.withColumnRenamed(_SLICE, "part")
    if not cut:
        return per_slice.drop(_SLICE)
    piece = F.struct(F.col(_SLICE), F.col(out))
    return per_slice.select(key, piece.alias("_r")).groupBy(key).agg(joined("_r", out).alias(out))
