"""Training, applying and judging the virality classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.constants import CATEGORICAL_FEATURES, LEAKING_FEATURES, NUMERIC_FEATURES
from tidewatch.functions.numeric import flag, plain
from tidewatch.operators import metrics
from tidewatch.operators.aggregates import most_frequent
from tidewatch.operators.alerts import with_range_labels
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.shaping import ensure_columns
from tidewatch.session import stage

SEED = 42
TRAIN_SHARE = 0.8
PREDICTED_FROM = 0.7


@dataclass(frozen=True)
class Features:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def select_features(df: DataFrame, label: str = "viral_label", without_leaks: bool = False) -> Features:
    """Model inputs that exist, split by type; the label must exist."""
    if label not in df.columns:
        raise ValueError(f"{label} column missing")
    skip = set(LEAKING_FEATURES) if without_leaks else set()
    found = [c for c in [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES] if c in df.columns and c not in skip]
    number = {c for c in found if isinstance(df.schema[c].dataType, T.NumericType)}
    return Features(tuple(c for c in found if c in number), tuple(c for c in found if c not in number))


def impute_values(df: DataFrame, features: Features) -> dict[str, object]:
    """Median of each numeric and most frequent value of each categorical feature."""
    medians = exact_quantiles(df, {c: (F.col(c), 0.5) for c in features.numeric}) if features.numeric else {}
    modes = most_frequent(df, list(features.categorical)) if features.categorical else {}
    values: dict[str, object] = {c: medians.get(c) if medians.get(c) is not None else 0.0 for c in features.numeric}
    values.update({c: modes.get(c) or "unknown" for c in features.categorical})
    return values


def split(df: DataFrame, key: str, label: str, seed: int = SEED, share: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Stratified split by a hash of the key: per label, the lowest ``share`` of hashes train.

    Depends on keys only, so it is the same after a retry or on another partitioning.
    """
    # 2^-53 keeps every hash an exact double.
    h = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), 11).cast("double")
    rows = df.withColumn("_h", h).withColumn("_y", F.col(label).cast("int"))
    cuts = exact_quantiles(rows, {f"c{y}": (F.when(F.col("_y") == y, F.col("_h")), share) for y in (0, 1)})
    cut = F.when(F.col("_y") == 1, F.lit(cuts["c1"])).otherwise(F.lit(cuts["c0"]))
    train = F.coalesce(F.col("_h") <= cut, F.lit(False))
    return rows.where(train).drop("_h", "_y"), rows.where(~train).drop("_h", "_y")


def scaling_values(df: DataFrame, features: Features, fill: dict[str, object]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of each numeric feature after imputation; a constant scales by 1."""
    if not features.numeric:
        return {}
    filled = {c: plain(c, float(fill[c])) for c in features.numeric}
    row = df.agg(
        *[F.avg(x).alias(f"{c}__m") for c, x in filled.items()],
        *[F.stddev_pop(x).alias(f"{c}__s") for c, x in filled.items()],
    ).first()
    return {c: (row[f"{c}__m"] or 0.0, row[f"{c}__s"] or 1.0) for c in features.numeric}


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shape_stage(features: Features, fill: dict[str, object], scale: dict[str, tuple[float, float]]) -> SQLTransformer:
    """Imputation and standardisation as one projection with the learned values as literals."""
    numeric = [
        f"(coalesce(nanvl(cast(`{c}` as double), null), {float(fill[c])!r}D) - ({scale[c][0]!r}D)) / {scale[c][1]!r}D AS `{c}__n`"
        for c in features.numeric
    ]
    text = [f"coalesce(cast(`{c}` as string), {_sql_text(str(fill[c]))}) AS `{c}__c`" for c in features.categorical]
    return SQLTransformer(statement=f"SELECT *, {', '.join(numeric + text)} FROM __THIS__")


def preprocessing(df: DataFrame, features: Features) -> list:
    """Impute, scale the numbers, one-hot the labels; labels unseen in training become all zeros."""
    fill = impute_values(df, features)
    stages: list = [_shape_stage(features, fill, scaling_values(df, features, fill))]
    inputs = [f"{c}__n" for c in features.numeric]
    if features.categorical:
        stages += [
            StringIndexer(
                inputCols=[f"{c}__c" for c in features.categorical],
                outputCols=[f"{c}__i" for c in features.categorical], handleInvalid="keep",
            ),
            OneHotEncoder(
                inputCols=[f"{c}__i" for c in features.categorical],
                outputCols=[f"{c}__h" for c in features.categorical],
            ),
        ]
        inputs += [f"{c}__h" for c in features.categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def train(df: DataFrame, features: Features, label: str = "viral_label", trees: int = 200, depth: int = 6) -> PipelineModel:
    booster = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.05,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED,
    )
    return Pipeline(stages=[*preprocessing(df, features), booster]).fit(df)


def predict(model: PipelineModel, df: DataFrame, features: Features | None = None, digits: int | None = 4) -> DataFrame:
    """Add ``viral_probability`` and ``predicted_viral``; absent features get 0 or 'unknown'."""
    numeric = features.numeric if features else NUMERIC_FEATURES
    text = features.categorical if features else CATEGORICAL_FEATURES
    fill = {c: F.lit(0.0) for c in numeric} | {c: F.lit("unknown") for c in text}
    df = df.drop("viral_probability", "predicted_viral")
    scored = model.transform(ensure_columns(df, fill))
    p = vector_to_array("probability")[1]
    out = df.columns + [c for c in fill if c not in df.columns]
    rows = scored.select(*out, (p if digits is None else F.bround(p, digits)).alias("viral_probability"))
    return rows.withColumn("predicted_viral", flag(F.col("viral_probability") >= PREDICTED_FROM, 1, 0))


def predict_with_ranges(model: PipelineModel, df: DataFrame, features: Features | None = None) -> DataFrame:
    return with_range_labels(predict(model, df, features))


def importance(model: PipelineModel, features: Features) -> DataFrame:
    """(feature, importance), the slots of a one-hot feature summed."""
    from pyspark.sql import SparkSession

    weights = model.stages[-1].featureImportances.toArray().tolist()
    owners = list(features.numeric)
    if features.categorical:
        indexer = next(s for s in model.stages if s.__class__.__name__ == "StringIndexerModel")
        for c, labels in zip(features.categorical, indexer.labelsArray):
            owners += [c] * len(labels)
    totals = dict.fromkeys(features.all, 0.0)
    for owner, weight in zip(owners, weights):
        totals[owner] += weight
    spark = SparkSession.active()
    return spark.createDataFrame(list(totals.items()), "feature string, importance double")


def top_importance(table: DataFrame, n: int = 15) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(n)


@dataclass
class Training:
    model: PipelineModel
    features: Features
    heldout: DataFrame
    metrics: DataFrame
    report: DataFrame
    importance: DataFrame


def run_training(df: DataFrame, key: str = "video_id", label: str = "viral_label", trees: int = 200, depth: int = 6, without_leaks: bool = False) -> Training:
    """Split, fit, score the held-out rows (kept apart from live predictions) and report."""
    features = select_features(df, label, without_leaks)
    rows = stage(df.withColumn(label, plain(label).cast("int")), "training")
    fit_rows, held = split(rows, key, label)
    model = train(fit_rows, features, label, trees, depth)
    scored = stage(predict(model, held, features, digits=None), "heldout")
    return Training(
        model, features, scored, metrics.metrics_row(scored, label, "viral_probability"),
        metrics.class_report(scored, label, "viral_probability"), importance(model, features),
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
