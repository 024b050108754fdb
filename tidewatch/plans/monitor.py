"""One monitoring run over stored tables: new items in, alerts out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.scoring import Scorer, Translator
from tidewatch.operators.shaping import lookback, published_between
from tidewatch.plans import alerting, cleaning, features, narrative, tracking, virality
from tidewatch.sources import sinks
from tidewatch.streaming.ingest import fresh_rows


@dataclass(frozen=True)
class Tables:
    """Folder of each persisted table under one root."""

    root: str

    def __getattr__(self, name: str) -> str:
        return f"{self.root}/{name}"


@dataclass(frozen=True)
class Hooks:
    """Models over a list of texts (see ``operators.scoring``); without one its lexicon or hashed form is used."""

    translator: Translator | None = None
    sentiment: Scorer | None = None
    emotion: Scorer | None = None
    toxicity: Scorer | None = None
    embedding: Callable[[list[str]], np.ndarray] | None = None
    naming: str = "lexicon"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def run_once(spark: SparkSession, tables: Tables, videos: DataFrame, as_of: Column, topic_lexicon: Mapping[str, Sequence[str]], stop_words: Sequence[str], comments: DataFrame | None = None, snapshots: DataFrame | None = None, model: PipelineModel | None = None, lookback_hours: int | None = None, hooks: Hooks = Hooks()) -> DataFrame:
    """Run every stage that has its input; without a model it stops after the narratives.

    Items and features already stored by other runs are not processed again. A run is known by its ``as_of``: repeated, say
    after a failure, it replaces its own features and history rows; those of other runs are never rewritten. Of rows with
    one id in ``videos`` the first by keyword counts, then by content; rows without an id all count.
    """
    run = spark.range(1).select(F.unix_micros(as_of)).first()[0]
    as_of = F.timestamp_micros(F.lit(run))  # one clock for the whole run
    if lookback_hours is not None:
        videos = published_between(videos, after=lookback(as_of, lookback_hours))
    by = [F.col("keyword").asc_nulls_last()] if "keyword" in videos.columns else []
    content = F.xxhash64(*[F.col(c).cast("string") for c in videos.columns])
    videos = fresh_rows(videos, None, [*by, content])
    done = stored(spark, tables.features)
    done = None if done is None else done.where(F.col("run") != run)
    clean = cleaning.clean_items(videos, comments, done, hooks.translator)
    rows = features.build_features(clean, as_of, None, hooks.sentiment, hooks.emotion, hooks.toxicity)
    sinks.replace_run(rows.withColumn("processed_at", as_of), tables.features, "processed_at", run)

    latest = None if snapshots is None else tracking.latest_metrics(snapshots, "snapshot_time")
    taken = tracking.snapshot(spark.read.parquet(tables.features).drop("run"), as_of, latest)
    sinks.replace_run(taken, tables.history, "tracking_timestamp", run)

    history = spark.read.parquet(tables.history).drop("ingest_date", "run")
    tracked = tracking.build_tracking(history)
    found = narrative.build_narratives(tracked, topic_lexicon, stop_words, model=hooks.embedding, strategy=hooks.naming)
    sinks.overwrite(found, tables.narratives)
    found = spark.read.parquet(tables.narratives)
    if model is None:
        return found
    sinks.overwrite(virality.predict_with_ranges(model, found), tables.predictions)
    sinks.write_alerts(alerting.build_alerts(spark.read.parquet(tables.predictions)), tables.alerts)
    return spark.read.parquet(tables.alerts)
