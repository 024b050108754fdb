"""Shapes of physical plans: what is scanned, pushed down, shuffled and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog.registry import Tables
from tidewatch.operators import alerts, lookups, narratives, ranking
from tidewatch.plans import tracking, views
from tidewatch.session import scratch_path, scratch_root, stage
from tidewatch.sources.files import read_columns, spread

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def t(spark):
    return Tables(spark, SF)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node: str) -> int:
    return len(re.findall(rf"\b{node}\b", plan(df)))


def test_only_wanted_columns_are_read(spark):
    assert re.search(r"ReadSchema: struct<doc_id:bigint>$", plan(read_columns(spark, f"{SF}/documents.parquet", ["doc_id"])).strip())


def test_filters_reach_the_scan(t):
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,1.0)]" in plan(t.events.where(F.col("value") >= 1.0))


def test_velocity_needs_one_exchange_and_one_sort(t):
    rows = tracking.tracking_rows(t.snapshot_events().selectExpr(
        "video_id", "event_id", "tracking_timestamp", "views view_count", "likes like_count", "comments comment_count",
        "0D engagement_rate", "virality_score", "pharma_risk_score"))
    assert (count(rows, "Exchange"), count(rows, "Sort"), count(rows, "Window"), count(rows, "FileScan")) == (1, 1, 1, 1)


def test_fan_out_is_one_scan_without_shuffle(t):
    cuts = alerts.Thresholds(narrative=1.0, acceleration=1.0, trend=1.0)
    rows = alerts.fan_out(alerts.prepare(t.events.selectExpr("event_id", "value viral_probability")), cuts)
    assert (count(rows, "FileScan"), count(rows, "Exchange")) == (1, 0)


def test_dedup_limits_rows_before_the_shuffle(t):
    rows = ranking.best_alerts(t.events.selectExpr("user_id video_id", "event_type alert_type", "event_id", "value alert_score"))
    assert count(rows, "WindowGroupLimit") == 2 and count(rows, "Exchange") == 1


def test_top_n_is_not_a_full_sort(t):
    assert "TakeOrderedAndProject" in plan(ranking.top(t.events, 100, "value", "event_id"))


def test_newest_values_are_combined_before_the_shuffle(t):
    rows = ranking.latest_values(t.events, "user_id", "ts", "event_id", ["value", "event_type"])
    assert "partial_max_by" in plan(rows) and count(rows, "Exchange") == 1


@pytest.mark.parametrize("build", [
    lambda t: lookups.new_rows(t.video(), t.labels.select(F.col("doc_id").alias("video_id"))),
    lambda t: lookups.with_group_size(t.scored(), "cluster_topic_name"),
    lambda t: alerts.with_ravs(t.scored()),
    lambda t: views.overview(alerts.with_ravs(t.scored()), t.scored()),
    lambda t: views.growth_peak(t.scored(), "video_id"),
    lambda t: tracking.build_tracking(t.snap()),
])
def test_no_nested_loops(t, build):
    text = plan(build(t))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_windows_are_partitioned(t):
    for df in (t.snap(), tracking.tracking_rows(t.snap())):
        assert "SinglePartition" not in plan(df)


def test_peak_stays_in_its_row(t):
    assert count(views.growth_peak(t.events.selectExpr("event_id", "value view_count"), "event_id"), "Exchange") == 0


def test_thresholds_read_staged_columns_only(t):
    staged = stage(t.scored(), "shape")
    assert "struct<trend_score:double>" in plan(staged.agg(F.max("trend_score")))


def test_large_tables_are_not_dealt_out(spark):
    path = scratch_path(spark, "many")
    spark.range(64).repartition(16).write.parquet(path)
    many = spark.read.parquet(path)
    assert spread(many) is many
    one = spark.read.parquet(f"{SF}/events.parquet")
    assert spread(one) is not one
    assert spread(one, max_bytes=1000) is one


def test_scratch_follows_the_session(spark, monkeypatch):
    real = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *d: "hdfs://shared/x/" if key == "spark.checkpoint.dir" else real(self, key, *d))
    assert scratch_root(spark) == "hdfs://shared/x"


def test_curve_inputs_are_parsed_once_a_row(spark):
    """Not at each of the 300 points, and the rows are dealt out before the points are made."""
    rows = spark.createDataFrame(
        [("a", 100, 5.0, 3.0), ("a", 100, 5.0, 3.0), (None, None, None, -1.0)],
        "video_id string, view_count long, views_per_hour double, growth_acceleration double").coalesce(1)
    above, _, below = views.growth_curve(rows, "video_id")._jdf.queryExecution().optimizedPlan().toString().partition("Repartition")
    assert "RLIKE" in below and "RLIKE" not in above
    curve = views.growth_curve(rows, "video_id")
    assert curve.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert curve.groupBy("video_id").count().collect() and curve.count() == 900
    assert {(r.video_id, r.peak_step is None) for r in views.growth_peak(rows, "video_id").collect()} == {("a", False), (None, False)}


def test_words_are_looked_for_once_a_text(spark):
    rows = spark.createDataFrame([(1, "aa bb aa"), (1, "aa"), (2, None)], "cluster int, text string")
    named = narratives.term_names(rows, ["the"], "cluster", "text")
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert {r.cluster: r.cluster_topic_name for r in named.collect()} == {1: "Aa Bb Aa Bb", 2: "Cluster 2"}
