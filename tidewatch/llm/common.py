"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import stage

__all__ = ["blocks", "column_bytes", "crc_fold", "first_schema", "free_prefix", "stage", "whole_text"]


def whole_text(name: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_fold(name: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % folds


def blocks(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int, max_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a block has at most ``max_rows`` and about ``max_bytes`` in ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(column_bytes(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + max_rows, int(np.searchsorted(ends, before + max_bytes, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def column_bytes(column: pa.Array) -> np.ndarray:
    """Bytes per value of a string column; null counts 0."""
    return np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)


def first_schema(df: DataFrame, *names: str) -> str:
    """DDL of the named columns."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def free_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, lengthened until no column of ``df`` starts with it, so that working columns never clash."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix
