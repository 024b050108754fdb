"""Sliced forms against the plain ones, with limits small enough that one key must be cut."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.slicing import ordered_concat, previous_rows, running_totals, with_slices
from tidewatch.plans.tracking import tracking_rows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = [("hot", i, rng.randint(0, 400), rng.randint(0, 9)) for i in range(600)]
    data += [(f"k{i % 40}", 600 + i, rng.randint(0, 400), rng.randint(0, 9)) for i in range(300)]
    data += [("hot", 2000, None, 5), ("k1", 2001, None, 5)]
    return spark.createDataFrame(data, "key string, id long, at long, v long").repartition(6, "id")


@pytest.mark.parametrize("limit", [20, 100])
def test_hot_null_key(spark, limit):
    """Rows without a key are one hot group; it is cut like any other."""
    data = [(None if i % 3 else f"k{i % 7}", i, (i * 37) % 211, i % 5) for i in range(400)]
    df = spark.createDataFrame(data, "key string, id long, at long, v long").repartition(5, "id")
    sizes = with_slices(df, "key", "at", limit)[0].where("key IS NULL").groupBy("_slice").count().collect()
    assert len(sizes) > 2 and sum(r["count"] for r in sizes) == 266
    order = ["at", "id"]

    def rows(n):
        before = previous_rows(df, "key", order, ["id"], n).selectExpr("id", "coalesce(_prev1.id, -1L) p1", "coalesce(_prev2.id, -1L) p2")
        return collected(before, "id", "p1", "p2")

    def sums(n):
        return collected(running_totals(df, "key", order, {"s": F.col("v")}, n), "id", "s")

    def texts(n):
        joined = ordered_concat(df, "key", order, F.col("id").cast("string"), "|", "t", limit=n)
        return collected(joined.select(F.coalesce("key", F.lit("")).alias("key"), "t"), "key", "t")

    assert rows(limit) == rows(10**9) and sums(limit) == sums(10**9) and texts(limit) == texts(10**9)


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_hot_key_is_cut(skewed):
    sliced, cut = with_slices(skewed, "key", "at", 100)
    sizes = {(r["key"], r["_slice"]): r["count"] for r in sliced.groupBy("key", "_slice").count().collect()}
    assert cut and sum(k == "hot" for k, _ in sizes) >= 5
    assert max(sizes.values()) < 250 and sum(sizes.values()) == skewed.count()
    assert not with_slices(skewed, "key", "at")[1]


@pytest.mark.parametrize("limit", [20, 100, 599])
def test_previous_rows(skewed, limit):
    def run(n):
        rows = previous_rows(skewed, "key", ["at", "id"], ["id", "v"], n)
        return collected(rows.selectExpr("id", "coalesce(_prev1.id, -1L) p1", "coalesce(_prev2.id, -1L) p2"), "id", "p1", "p2")

    assert run(limit) == run(10**9)


@pytest.mark.parametrize("limit", [20, 100])
def test_running_totals(skewed, limit):
    def run(n):
        return collected(running_totals(skewed, "key", ["at", "id"], {"s": F.col("v"), "n": F.lit(1)}, n), "id", "s", "n")

    assert run(limit) == run(10**9)


def test_ordered_concat(skewed):
    def run(n, **more):
        return ordered_concat(skewed, "key", ["at", "id"], F.concat(F.lit(" "), F.col("id")), "|", "t", limit=n, **more)

    assert collected(run(50), "key", "t") == collected(run(10**9), "key", "t")
    pieces = run(50, parts=True)
    assert pieces.count() > 45
    whole = {r["key"]: r["t"] for r in run(10**9).collect()}
    parts = {}
    for r in pieces.orderBy("key", "part").collect():
        parts.setdefault(r["key"], []).append(r["t"])
    assert {k: "|".join(v) for k, v in parts.items()} == whole


def test_tracking_with_a_hot_item(skewed):
    history = skewed.where("at is not null").selectExpr(
        "key as video_id", "id as event_id", "timestamp_seconds(at * 60) as tracking_timestamp", "id as view_count",
        "v as like_count", "v as comment_count", "0.1D as engagement_rate", "1D as virality_score", "0 as pharma_risk_score",
    )

    def run(n):
        rows = tracking_rows(history, n).selectExpr("event_id", "coalesce(view_velocity, -1e9) a", "coalesce(growth_acceleration, -1e9) b", "trend_score")
        return collected(rows, "event_id", "a", "b", "trend_score")

    assert run(60) == run(10**9)


def test_auc_in_slices(spark):
    rng = random.Random(3)
    data = [(int(rng.random() < 0.3), round(rng.random(), 3)) for _ in range(2000)]
    df = spark.createDataFrame(data, "y int, p double")
    y, p = np.array(data).T
    pos, neg = p[y == 1], p[y == 0]
    expected = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    for limit in (100, 10**9):
        assert metrics.roc_auc(df, "y", "p", limit).first()[0] == pytest.approx(expected, abs=1e-12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.sampled_from([0.0, 1.0, 2.5]), st.floats(-1e6, 1e6)), min_size=1, max_size=400),
    st.sampled_from([0.0, 0.5, 0.9, 0.95, 1.0]),
)
def test_quantiles_by_narrowing(spark, data, q):
    df = spark.createDataFrame([(x,) for x in data] + [(None,), (float("nan"),)], "x double")
    expected = float(np.quantile(np.array(data), q))
    for small in (5, 10**6):
        assert exact_quantiles(df, {"x": (F.col("x"), q)}, small)["x"] == pytest.approx(expected, rel=1e-12, abs=1e-12)


def test_quantile_of_ties_is_exactly_the_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0.1).otherwise(F.col("id") / 7.0).alias("x"))
    x = np.array([r[0] for r in df.collect()])
    for q in (0.1, 0.2, 0.3, 0.95):
        assert exact_quantiles(df, {"x": (F.col("x"), q)}, 50)["x"] == pytest.approx(np.quantile(x, q), rel=1e-14)
    assert exact_quantiles(df, {"x": (F.col("x"), 0.2)}, 50)["x"] == 0.1


def _mixed(spark, columns: int):
    """Columns of different spread: distinct, mostly equal, a third equal, with gaps, in steps."""
    x = F.col("id")
    shapes = [
        (x * 7919 % 100003).cast("double"), F.when(x % 50 == 0, x.cast("double")).otherwise(4.0),
        F.when(x % 3 == 0, 0.1).otherwise(x / 7.0), F.when(x % 4 != 1, -x / 3.0), F.floor(x / 40).cast("double"),
    ]
    return spark.range(6000).repartition(5).select(*[(shapes[i % 5] + i).alias(f"c{i}") for i in range(columns)])


def test_quantiles_of_many_columns_together(spark):
    df = _mixed(spark, 21)
    wanted = {f"{c}_{round(1000 * q)}": (F.col(c), q) for c in df.columns for q in (0.0, 0.25, 0.5, 0.999, 1.0)}
    found = exact_quantiles(df, wanted, 40)
    table = df.toPandas()
    for name, (_, q) in wanted.items():
        solid = table[name.split("_")[0]].dropna().to_numpy()
        assert found[name] == pytest.approx(np.quantile(solid, q), rel=1e-13, abs=1e-13), name


def test_quantile_jobs_do_not_grow_with_the_columns(spark):
    """The same jobs narrow one column and twenty: jobs follow the rounds."""
    context = spark.sparkContext
    seen = []
    for n in (5, 20):
        df = _mixed(spark, n)
        context.setJobGroup(f"quantiles-{n}", "jobs of a joint selection")
        exact_quantiles(df, {c: (F.col(c), 0.5) for c in df.columns}, 40)
        seen.append(len(context.statusTracker().getJobIdsForGroup(f"quantiles-{n}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert seen[0] == seen[1] > 0


def test_quantile_of_nothing(spark):
    assert exact_quantiles(spark.range(0).selectExpr("cast(id as double) x"), {"x": (F.col("x"), 0.5)})["x"] is None


def test_many_slices(spark):
    rows = spark.range(3000).selectExpr("'hot' AS key", "id", "id * 7919 % 3001 AS at", "id % 5 AS v")
    sliced, cut = with_slices(rows, "key", "at", 10)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert cut and len(sizes) > 200 and max(sizes) < 60
    order = sliced.groupBy("_slice").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("_slice").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(order, order[1:]))
    total = running_totals(rows, "key", ["at"], {"s": F.col("v")}, 10).agg(F.max("s")).first()[0]
    assert total == sum(i % 5 for i in range(3000))
