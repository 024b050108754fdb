import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import sketches
from tidewatch.session import scratch_path, stage
from tidewatch.streaming import rescoring


def ranks(x, value):
    return (x < value).mean() - sketches.RANK_ERROR, (x <= value).mean() + sketches.RANK_ERROR


def test_merged_quantiles_keep_their_rank(spark):
    """A third of the values equal, missing ones, and one group that has none."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(200_000) < 1 / 3, 7.0, rng.lognormal(2, 1, 200_000))
    rows = [(i % 5, float(v), None if i % 2 else float(-v)) for i, v in enumerate(x)] + [(9, None, None), (9, float("nan"), None)]
    df = spark.createDataFrame(rows, "day int, x double, y double")
    stored = stage(sketches.value_sketches(df, {"x": F.col("x"), "y": F.col("y")}, ["day"]), "sketches")
    assert stored.count() == 6
    for q in (0.0, 0.05, 0.5, 0.9, 1.0):
        found = sketches.merged_quantiles(stored, {"x": ("x", q), "y": ("y", q)})
        low, high = ranks(x, found["x"])
        assert low <= q <= high
        low, high = ranks(-x[::2], found["y"])
        assert low <= q <= high
    assert sketches.merged_bounds(stored, ["x"])["x"] == (x.min(), x.max())


def test_nothing_seen(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "id int, x double")
    for rows in (df, df.limit(0)):
        assert sketches.approx_quantiles(rows, {"x": (F.col("x"), 0.5)}) == {"x": None}
        assert sketches.merged_quantiles(sketches.value_sketches(rows, {"x": F.col("x")}, ["id"]), {"x": ("x", 0.5)}) == {"x": None}
        assert sketches.merged_bounds(sketches.value_sketches(rows, {"x": F.col("x")}), ["x"]) == {"x": (None, None)}
    assert sketches.distinct_estimate(sketches.distinct_sketches(df.limit(0), "id", ["x"])).first()[0] == 0


def test_distinct_ids_over_days(spark):
    """Ids that come on several days count once; NULL does not."""
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 10 > 0, (F.col("id") % 20_000).cast("string")).alias("video_id"))
    stored = stage(sketches.distinct_sketches(df, "video_id", ["day"]), "days")
    assert stored.count() == 7
    assert sketches.distinct_estimate(stored).first().videos == pytest.approx(18_000, rel=sketches.DISTINCT_ERROR)


def scored(spark, n, low=0):
    return spark.range(low, low + n).selectExpr(
        "cast(id as string) video_id", "cast(id as double) trend_score", "cast(id % 4 as double) pharma_risk_score", "id / 10d narrative_trend_score",
        "cast(id as double) - 500 growth_acceleration", "0.5d viral_probability", "0.1d toxicity_score")


def test_thresholds_from_batches(spark):
    """Cut points of two batches are those of all rows; a replayed batch is not counted twice; none without batches."""
    path = scratch_path(spark, "score-sketches")
    assert rescoring.thresholds_from_sketches(spark, path)[0].trend is None
    rescoring.store_scores(scored(spark, 600), path, 0)
    for _ in range(2):
        rescoring.store_scores(scored(spark, 400, 600), path, 1)
    cuts, limits = rescoring.thresholds_from_sketches(spark, path)
    assert cuts.trend == pytest.approx(899, abs=3) and cuts.narrative == pytest.approx(94.9, abs=0.4) and cuts.acceleration == pytest.approx(449, abs=3)
    assert limits == {"trend": (0.0, 999.0), "risk": (0.0, 3.0)}
    assert rescoring.thresholds_from_sketches(spark, path, before=1)[0].trend == pytest.approx(539, abs=3)


def test_alert_stream_learns_as_it_goes(spark):
    landing, cuts, out, log = (scratch_path(spark, x) for x in ("landing", "cuts", "out", "log"))
    for low in (0, 1000):
        scored(spark, 1000, low).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(scored(spark, 1).schema).parquet(landing)
        rescoring.alert_stream(stream, cuts, out, log, learn_on=True).start().awaitTermination()
    assert spark.read.parquet(f"{cuts}/batch_id=*").count() == 2
    assert rescoring.current_alerts(spark, out).count() > 0
