"""Mergeable summaries: quantiles and distinct counts of data that is not read again.

A table is summed up once, for instance per batch or per day; later answers merge the stored summaries, a
few hundred kilobytes each, and cost nothing that grows with the rows behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch, and the error it keeps with 99 % confidence, as a share of all ranks.
QUANTILE_K = 4000
RANK_ERROR = 0.002
#: Registers of a distinct-count sketch as a power of two, and three standard errors of its estimate.
DISTINCT_BITS = 14
DISTINCT_ERROR = 0.03


def _solid(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def value_sketches(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = (), k: int = QUANTILE_K) -> DataFrame:
    """One row (per group) with, for each column, a sketch of its values and their exact least and greatest.

    NULL and NaN are skipped. Groups combine on the map side, so a hot group is no burden to one task.
    """
    aggs = [a for name, c in columns.items() for a in (
        F.kll_sketch_agg_double(_solid(c), k).alias(name), F.min(_solid(c)).alias(f"{name}_least"), F.max(_solid(c)).alias(f"{name}_greatest"),
    )]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def merged_quantiles(stored: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """Approximate quantiles over all stored sketches: name -> (sketch column, q). None where no value was seen."""
    def quantile(c: str, q: float) -> Column:
        merged = F.kll_merge_agg_double(c)
        return F.when(F.kll_sketch_get_n_double(merged) > 0, F.kll_sketch_get_quantile_double(merged, F.lit(q)))

    # Groups without a value have an empty sketch, and a table without rows none at all.
    row = stored.agg(*[quantile(c, q).alias(name) for name, (c, q) in wanted.items()]).first()
    return row.asDict()


def merged_bounds(stored: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Exact (min, max) of each sketched column."""
    row = stored.agg(*[a for c in columns for a in (F.min(f"{c}_least").alias(f"lo_{c}"), F.max(f"{c}_greatest").alias(f"hi_{c}"))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def approx_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], k: int = QUANTILE_K) -> dict[str, float | None]:
    """Quantiles of any number of columns in one pass of bounded memory, within ``RANK_ERROR`` of their rank."""
    found = value_sketches(df, {name: c for name, (c, _) in wanted.items()}, k=k)
    return merged_quantiles(found, {name: (name, q) for name, (_, q) in wanted.items()})


def distinct_sketches(df: DataFrame, key: str, by: Sequence[str], out: str = "ids") -> DataFrame:
    """A distinct-count sketch of ``key`` per group, for instance per ingest date. NULL keys are not counted."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(key, DISTINCT_BITS).alias(out))


def distinct_estimate(stored: DataFrame, sketch: str = "ids", out: str = "videos") -> DataFrame:
    """One row: the estimated number of different keys over all groups, within ``DISTINCT_ERROR``; 0 without rows."""
    estimate = F.hll_sketch_estimate(F.hll_union_agg(sketch))
    return stored.agg(F.coalesce(estimate, F.lit(0)).cast("long").alias(out))
