from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.constants import ALERT_COLUMNS, RANGE_CUTS
from tidewatch.operators import alerts, lookups, narratives, ranking, shaping
from tidewatch.plans import alerting, tracking


def test_new_rows_compare_ids_as_text(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c"), (None, "d"), ("1", "e")], "video_id string, t string")
    done = spark.createDataFrame([(1,), (1,), (None,)], "video_id long")
    assert sorted(r["t"] for r in lookups.new_rows(df, done).collect()) == ["b", "c", "d"]


def test_metrics_without_snapshot_become_zero(spark):
    df = spark.createDataFrame([("a", 5, 1), ("b", 6, 2)], "video_id string, view_count long, like_count long")
    assert lookups.refresh_metrics(df, None) is df
    latest = spark.createDataFrame([("a", 9)], "video_id string, view_count long")
    fresh = lookups.refresh_metrics(df, latest)
    assert {r.video_id: r.view_count for r in fresh.collect()} == {"a": 9.0, "b": 0.0}
    assert fresh.columns == ["video_id", "view_count"]


def test_latest_values_skip_nulls_and_rank_missing_times_last(spark):
    data = [("a", datetime(2025, 1, 1), 1, 10, 1), ("a", datetime(2025, 1, 2), 2, None, 2), ("b", datetime(2025, 1, 1), 3, 7, 7), ("b", None, 4, 8, None)]
    df = spark.createDataFrame(data, "video_id string, snapshot_time timestamp, id long, view_count long, like_count long")
    got = ranking.latest_values(df, "video_id", "snapshot_time", "id", ["view_count", "like_count"])
    assert {r.video_id: (r.view_count, r.like_count) for r in got.collect()} == {"a": (10, 2), "b": (8, 7)}


def test_indication_filter_keeps_all_without_match(spark):
    df = spark.createDataFrame([("NuvaRing",), ("asthma",), (None,)], "keyword string")
    kept = lambda group: shaping.indication_filter(df, group).count()
    assert (kept("Contraception"), kept("Oncology"), kept("All Products"), kept("unknown")) == (1, 3, 3, 3)


def test_lookup_broadcasts_only_small_tables(spark):
    df, dim = spark.range(10).withColumnRenamed("id", "k"), spark.range(5).selectExpr("id as k", "id * 2 as v")
    assert lookups.lookup(df, dim, "k", {"v": F.lit(-1)}).where("v = -1").count() == 5
    assert lookups.small(dim, 4) is dim and lookups.small(dim, 5) is not dim


def snapshots(spark, data):
    return spark.createDataFrame([(v, datetime(2025, 1, d, h), n, c) for v, d, h, n, c in data],
                                 "video_id string, tracking_timestamp timestamp, event_id long, view_count long") \
        .selectExpr("*", "0L like_count", "0L comment_count", "0D engagement_rate", "0D virality_score", "0 pharma_risk_score")


def test_velocity_edges(spark):
    rows = snapshots(spark, [("a", 1, 0, 1, 10), ("a", 1, 0, 2, 20), ("a", 1, 2, 3, 50), ("a", 1, 3, 4, 90), ("b", 1, 0, 5, 3)])
    got = {r.event_id: (r.view_velocity, r.growth_acceleration) for r in tracking.tracking_rows(rows).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (15.0, None), 4: (40.0, 25.0), 5: (None, None)}
    filled = {r.event_id: r.growth_acceleration for r in tracking.build_tracking(rows).collect()}
    assert filled == {1: 0.0, 2: 0.0, 3: 0.0, 4: 25.0, 5: 0.0}


def test_spike_is_strict_and_trend_is_not(spark):
    rows = snapshots(spark, [("a", 1, h, h, 0) for h in range(5)])
    got = tracking.build_tracking(rows).select("trend_label", "spike_detected").distinct().collect()
    assert [tuple(r) for r in got] == [("trending", 0)]


def test_history_keeps_extra_columns_and_duplicates(spark):
    old = spark.sql("SELECT 'a' video_id, 1L view_count")
    new = spark.sql("SELECT 'a' video_id, 'k' keyword")
    rows = tracking.append_history(tracking.append_history(old, new), new)
    assert rows.count() == 3 and rows.where("view_count is null and keyword = 'k'").count() == 2


def test_snapshot_columns(spark):
    features = spark.sql("SELECT 'a' video_id, 5L view_count, 7L channel_subscriber_count, 'w' keyword, 0.5D views_per_hour")
    row = tracking.snapshot(features, F.expr("TIMESTAMP '2025-01-01'")).first()
    assert (row.view_count, row.subscriber_count, row.keyword, row.views_per_hour, row.title) == (5, 7, "w", 0.5, None)


@pytest.fixture(scope="module")
def scored(spark):
    return spark.range(500).selectExpr(
        "cast(id % 170 as string) video_id", "id event_id", "(id * 37 % 100) / 100D viral_probability", "(id * 13 % 100) / 100D toxicity_score",
        "id * 7 % 4 pharma_risk_score", "id * 11 % 97 / 1D trend_score", "id * 5 % 89 - 40D growth_acceleration", "id * 3 % 71 / 1D narrative_trend_score",
        "id * 991 % 200000 subscriber_count", "id % 60 cluster_volume",
    )


def test_alert_invariants(scored):
    rows = alerts.prepare(scored)
    cuts = alerts.learn_thresholds(rows)
    tests = alerts.rule_tests(rows, cuts)
    counts = rows.agg(*[F.count_if(test).alias(name) for name, test in tests.items()]).first().asDict()
    fired = {r.alert_type: r["count"] for r in alerts.fan_out(rows, cuts).groupBy("alert_type").count().collect()}
    assert fired == counts and len(fired) == 6
    final = alerting.build_alerts(scored).collect()
    assert 0 < len(final) <= 100
    assert len({(r.video_id, r.alert_type) for r in final}) == len(final)
    assert [r.alert_score for r in final] == sorted((r.alert_score for r in final), reverse=True)


def test_alert_columns_and_label_order(scored):
    got = alerting.build_alerts(scored)
    assert got.columns == [c for c in ALERT_COLUMNS if c in got.columns]
    assert "ravs_score_range" in got.columns and "alert_score_range" not in got.columns
    assert "alert_score_range" in alerting.scored_alerts(scored, label_after_score=True).columns
    assert len(RANGE_CUTS) == 20


def test_latest_only(spark, scored):
    dated = scored.withColumn("tracking_timestamp", F.timestamp_seconds("event_id"))
    newest = alerting.build_alerts(dated, n=10**6, latest_only=True)
    assert newest.where(F.unix_seconds("tracking_timestamp") < 330).isEmpty()


def test_minimum_acceleration(scored):
    rows = alerts.prepare(scored)
    assert alerts.learn_thresholds(rows, min_acceleration=1e9).acceleration == 1e9


def test_topic_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "Alpha BETA"), (1, "gamma"), (2, "none"), (3, None)], "c int, t string")
    topics = {"X": ["gamma"], "Y": ["alpha"], "Z": ["alpha", "beta"], "W": ["alpha", "gamma"]}
    assert [tuple(r) for r in narratives.lexicon_names(df, topics, "c", "t").collect()] == [(1, "Z")]
    many = {"Big": [f"w{i}" for i in range(70)]}
    words = spark.createDataFrame([(1, "w69 w3")], "c int, t string")
    assert narratives.lexicon_names(words, many, "c", "t").first()["cluster_topic_name"] == "Big"


def test_word_boundaries(spark):
    df = spark.createDataFrame([(1, "a bad road"), (2, "an ad.")], "c int, t string")
    topics = {"Ads": ["ad"]}
    assert narratives.lexicon_names(df, topics, "c", "t").count() == 2
    assert [r["c"] for r in narratives.lexicon_names(df, topics, "c", "t", word_boundary=True).collect()] == [2]


def test_cluster_names_fall_back_to_terms(spark):
    df = spark.createDataFrame([(1, "blue whale blue whale"), (2, "alpha"), (3, "!")], "c int, t string")
    got = narratives.cluster_names(df, {"A": ["alpha"]}, ["the"], "c", "t")
    assert dict(map(tuple, got.collect())) == {1: "Whale Blue Whale Blue", 2: "A", 3: "Cluster 3"}


def test_neighbour_scores(spark):
    vectors = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0], [1.0, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<float>")
    score = lambda n: [r[0] for r in narratives.neighbour_scores(df, "id", "v", n).orderBy("id").select("narrative_similarity_score").collect()]
    assert score(1000) == [1.0, 0.8, 0.8, 1.0]
    assert score(3) == [0.6, 0.8, 0.8, 0.0]
    assert score(1) == [0.0] * 4
