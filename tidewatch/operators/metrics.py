"""Classifier metrics as aggregates over (label, probability) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.slicing import HOT_ROWS, running_totals

EPSILON = 2.220446049250313e-16
CUT = 0.5


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str, probability: str, cut: float = CUT) -> DataFrame:
    y, p = F.col(label) == 1, F.col(probability) >= cut
    return df.agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"),
    )


def classification(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1 and MCC of a confusion row; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        _share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _share(tp * tn - fp * fn, spread).alias("mcc"),
    )


def probabilistic(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Brier, log loss, RMSE, MAE, MAPE of the positives in percent (NULL without any)."""
    y, p = F.col(label).cast("double"), F.col(probability)
    safe = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    loss = -(y * F.ln(safe) + (1 - y) * F.ln(1 - safe))
    miss = F.abs(y - p)
    return df.agg(
        F.avg(miss * miss).alias("brier_score"),
        F.avg(loss).alias("log_loss"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(miss).alias("mae"),
        (F.avg(F.when(y == 1, miss)) * 100).alias("mape_viral"),
        F.count("*").alias("test_samples"),
        F.count_if(y == 1).alias("viral_in_test"),
    )


def roc_auc(df: DataFrame, label: str, probability: str, limit: int = HOT_ROWS) -> DataFrame:
    """Rank statistic with ties averaged.

    Rows are first reduced to one per distinct probability; the running count over those
    is cut into slices once there are more than ``limit`` of them.
    """
    y = F.col(label)
    per_score = df.groupBy(F.col(probability).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")
    ).withColumn("_all", F.lit(0))
    ranked = running_totals(per_score, "_all", ["score"], {"upto": F.col("neg")}, limit)
    below = F.col("upto") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.try_divide(wins, pairs).alias("roc_auc"))


def class_report(df: DataFrame, label: str, probability: str, cut: float = CUT) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    c = confusion(df, label, probability, cut)
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))

    def line(name: str, hit: Column, extra: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), _share(hit, hit + extra).alias("precision"),
            _share(hit, hit + missed).alias("recall"),
            _share(2 * hit, 2 * hit + extra + missed).alias("f1_score"),
            (hit + missed).cast("bigint").alias("support"),
        )

    lines = c.select(F.array(line("non-viral", tn, fn, fp), line("viral", tp, fp, fn)).alias("c"))
    a, b = F.col("c")[0], F.col("c")[1]
    n = a["support"] + b["support"]
    measures = ("precision", "recall", "f1_score")
    macro = F.struct(
        F.lit("macro avg").alias("class"),
        *[((a[m] + b[m]) / 2.0).alias(m) for m in measures], n.alias("support"),
    )
    weighted = F.struct(
        F.lit("weighted avg").alias("class"),
        *[_share(a[m] * a["support"] + b[m] * b["support"], n).alias(m) for m in measures],
        n.alias("support"),
    )
    return lines.select(F.inline(F.concat("c", F.array(macro, weighted))))


def metrics_row(df: DataFrame, label: str, probability: str, cut: float = CUT) -> DataFrame:
    """The rounded one-row metrics table."""
    parts = [
        classification(confusion(df, label, probability, cut)),
        roc_auc(df, label, probability),
        probabilistic(df, label, probability),
    ]
    row = parts[0].withColumn("_k", F.lit(0))
    for p in parts[1:]:
        row = row.join(p.withColumn("_k", F.lit(0)), "_k")
    four = ["accuracy", "roc_auc", "precision", "recall", "f1_score", "mcc", "brier_score", "log_loss", "rmse", "mae"]
    return row.select(
        *[F.round(c, 4).alias(c) for c in four],
        F.round("mape_viral", 2).alias("mape_viral"), "test_samples", "viral_in_test",
    )
