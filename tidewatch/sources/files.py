"""File sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.numeric import number
from tidewatch.functions.temporal import utc
from tidewatch.sources.schemas import as_text, empty

SPREAD_BYTES = 256 << 20


def csv_reader(spark: SparkSession, schema: T.StructType, multiline: bool = True):
    """CSV with a header, doubled quotes and, by default, quoted line breaks.

    A multi-line file cannot be split, so one file is one task: land many files, or set
    ``multiline=False`` where the producer writes no line breaks inside fields.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("encoding", "UTF-8")
    )


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """Every column as text; a missing path gives an empty table."""
    text = as_text(schema)
    try:
        rows = csv_reader(spark, text, multiline).csv(path)
        return rows.select(*[F.col(f.name) for f in text.fields])
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, text)
        raise


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to their declared types; bad numbers become 0, bad times NULL."""
    def one(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.LongType, T.IntegerType)):
            c = F.coalesce(c.try_cast("bigint"), number(c).try_cast("bigint")).cast(field.dataType)
        elif isinstance(field.dataType, T.DoubleType):
            c = number(c)
        elif isinstance(field.dataType, T.TimestampType):
            c = utc(c)
        elif not isinstance(field.dataType, T.StringType):
            c = c.try_cast(field.dataType)
        return c.alias(field.name)

    return df.select(*[one(f) for f in schema.fields if f.name in df.columns])


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    return typed(read_raw_csv(spark, path, schema, multiline), schema)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, schema)
        raise


def read_latest(spark: SparkSession, pattern: str, schema: T.StructType, fmt: str = "parquet", folders: bool = False, **options) -> DataFrame:
    """Rows of the newest export matching ``pattern``; none gives an empty table.

    An export is a file, or with ``folders`` a folder of part files. Only file metadata is
    read to find it; the data scan is then limited to that export.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", folders)
    try:
        found = listing.load(pattern).select("path", "modificationTime")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, schema)
        raise
    export = F.regexp_extract("path", "(.*)/[^/]+", 1) if folders else F.col("path")
    newest = found.groupBy(export.alias("path")).agg(F.max("modificationTime").alias("at"))
    first = newest.orderBy(F.desc("at"), F.desc("path")).first()
    if first is None:
        return empty(spark, schema)
    return spark.read.schema(schema).options(**options).format(fmt).load(first["path"])


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def spread(df: DataFrame, max_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Deal the rows of a table of at most ``max_bytes`` in fewer files than cores out over all cores.

    For CPU-heavy work on a small table, whose files may each hold one unsplittable row group. The
    size is that of the files, as the optimizer knows it; a larger table is returned as it is, unshuffled,
    and its file names are not listed.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if size <= max_bytes and len(df.inputFiles()) < cores else df
