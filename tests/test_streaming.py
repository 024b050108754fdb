from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.plans import monitor, tracking, virality
from tidewatch.session import scratch_path
from tidewatch.streaming import ingest, velocity

SCHEMA = "video_id string, event_id long, tracking_timestamp timestamp, view_count long, like_count long, comment_count long, engagement_rate double"
START = datetime(2025, 1, 1)


def landed(spark, schema, name):
    path = scratch_path(spark, name)

    def land(data):
        df = data if hasattr(data, "schema") else spark.createDataFrame(data, schema)
        df.write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)

    return land


def test_ingest_again_adds_nothing(spark):
    land = landed(spark, "video_id string, ord long", "ingest")
    table, log = scratch_path(spark, "table"), scratch_path(spark, "log")
    for data in ([("a", 1), ("a", 2), (None, 3), (None, 4)], [("a", 5), ("b", 6)], [("a", 7), ("b", 8)]):
        ingest.ingest(land(data), table, log, [F.col("ord")]).start().awaitTermination()
    got = ingest.batch_table(spark, table).select("video_id", "ord", "batch_id").collect()
    assert sorted((r.video_id or "", r.ord, r.batch_id) for r in got) == [("", 3, 0), ("", 4, 0), ("a", 1, 0), ("b", 6, 1)]
    stream = land([("c", 9)])
    ingest.ingest(stream, table, log, [F.col("ord")]).start().awaitTermination()
    ingest.ingest(stream, table, log, [F.col("ord")]).start().awaitTermination()
    assert ingest.batch_table(spark, table).where("video_id = 'c'").count() == 1


def test_indexed_ingest_reads_only_its_buckets(spark):
    """Equal to the table form, for rows without an id and for a batch that is run again too."""
    land = landed(spark, "video_id string, ord long", "indexed")
    table, index, log = (scratch_path(spark, x) for x in ("table", "ids", "log"))
    start = lambda stream, state: ingest.ingest_indexed(stream, table, index, state, [F.col("ord")], buckets=32).start().awaitTermination()
    for data in ([("a", 1), ("a", 2), (None, 3), (None, 4)], [("a", 5), ("b", 6)], [("a", 7), ("b", 8)], [(None, 9)]):
        stream = land(data)
        start(stream, log)
    stored = lambda: sorted((r.video_id or "", r.ord, r.batch_id) for r in ingest.batch_table(spark, table).select("video_id", "ord", "batch_id").collect())
    expected = [("", 3, 0), ("", 4, 0), ("", 9, 3), ("a", 1, 0), ("b", 6, 1)]
    assert stored() == expected
    assert sorted((r.video_id, r.batch_id) for r in spark.read.parquet(index).collect()) == [("a", 0), ("b", 1)]

    bucket = spark.createDataFrame([("b",)], "video_id string").select(ingest.id_bucket("video_id", 32)).first()[0]
    known = ingest.seen_ids(spark, index, [bucket], 3)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "id_bucket#" in plan.split("PartitionFilters")[1]
    for part in Path(index.removeprefix("file:")).glob("id_bucket=*/batch_id=0/part-*"):
        part.write_bytes(b"unreadable")  # the bucket of "a"
    assert [r.video_id for r in known.collect()] == ["b"]
    assert ingest.seen_ids(spark, index, [bucket], 1).isEmpty()

    start(stream, scratch_path(spark, "log"))  # a lost checkpoint: everything comes again as batch 0
    assert [r for r in stored() if r[2] == 0] == [("", 3, 0), ("", 4, 0), ("", 9, 0), ("a", 1, 0), ("b", 6, 0)]


def test_ids_once_within_the_watermark(spark):
    land = landed(spark, "video_id string, at timestamp", "recent")
    table, log = scratch_path(spark, "table"), scratch_path(spark, "log")
    day = lambda n: START + timedelta(days=n)
    waves = ([("a", day(0)), ("a", day(0)), (None, day(0)), (None, day(0))], [("a", day(1)), ("b", day(1))], [("c", day(30))], [("d", day(30))], [("a", day(31))])
    for data in waves:
        ingest.ingest_recent(land(data), table, log, "at", "2 days").start().awaitTermination()
    got = sorted(r.video_id or "" for r in spark.read.parquet(table).collect())
    assert got == ["", "", "a", "a", "b", "c", "d"]  # after a month the first "a" is forgotten


def history(spark):
    data = [(f"v{i % 3}", i, START + timedelta(hours=i), i * i, i, i // 2, i / 100) for i in range(30)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("limit", [3, 10**9])
def test_stream_velocity_equals_batch(spark, limit):
    rows = history(spark)
    land = landed(spark, SCHEMA, "velocity")
    out, state, late, log = (scratch_path(spark, x) for x in ("out", "state", "late", "log"))
    for low in (0, 7, 8, 20):
        high = {0: 7, 7: 8, 8: 20, 20: 30}[low]
        stream = land(rows.where((F.col("event_id") >= low) & (F.col("event_id") < high)))
        velocity.velocities(stream, out, state, late, log, limit=limit).start().awaitTermination()
    columns = ["event_id", "prev_views", "view_velocity", "engagement_velocity", "growth_acceleration"]
    key = lambda r: r[0]
    got = sorted((tuple(r) for r in ingest.batch_table(spark, out).select(*columns).collect()), key=key)
    expected = tracking.with_velocities(tracking.previous_values(rows)).select(*columns).collect()
    assert got == sorted((tuple(r) for r in expected), key=key)
    assert ingest.batch_table(spark, late).count() == 0


def test_late_snapshots_are_kept_aside(spark):
    land = landed(spark, SCHEMA, "late")
    out, state, late, log = (scratch_path(spark, x) for x in ("out", "state", "late", "log"))
    rows = history(spark)
    for part in (rows.where("event_id >= 3 and event_id < 12"), rows.where("event_id < 3 or event_id >= 12")):
        velocity.velocities(land(part), out, state, late, log).start().awaitTermination()
    assert sorted(r.event_id for r in ingest.batch_table(spark, late).collect()) == [0, 1, 2]
    assert ingest.batch_table(spark, out).count() == 27


def test_tie_across_batches_is_on_time_by_the_second_order_column(spark):
    land = landed(spark, SCHEMA, "tie")
    out, state, late, log = (scratch_path(spark, x) for x in ("out", "state", "late", "log"))
    rows = [("v", 1, START, 10, 1, 0, 0.1), ("v", 5, START, 20, 2, 0, 0.2), ("v", 3, START, 30, 3, 0, 0.3)]
    for r in rows:
        velocity.velocities(land(spark.createDataFrame([r], SCHEMA)), out, state, late, log).start().awaitTermination()
    assert sorted(r.event_id for r in ingest.batch_table(spark, out).collect()) == [1, 5]
    assert [r.event_id for r in ingest.batch_table(spark, late).collect()] == [3]


def test_two_monitoring_runs(spark):
    videos = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "cast(doc_id as string) video_id", "source keyword", "source channel_title", "lang title", "text description",
        "TIMESTAMP '2024-01-01' + doc_id * INTERVAL '1' HOUR published_at", "'PT4M' duration", "n_chars * 10 view_count",
        "n_chars % 97 like_count", "n_chars % 31 comment_count", "n_chars * 97 % 300000 channel_subscriber_count",
    )
    comments = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").selectExpr(
        "cast(conv_id as string) video_id", "turn comment_id", "text")
    tables = monitor.Tables(scratch_path(spark, "monitor"))
    topics, stops = {"Signs": ["***"], "Words": ["the "]}, ["the", "of", "and"]
    old = videos.where("cast(video_id as int) < 150")
    first = monitor.run_once(spark, tables, old, F.expr("TIMESTAMP '2025-01-01'"), topics, stops, comments)
    assert first.count() == 150
    done = virality.run_training(first.withColumn("row_key", F.col("video_id")), trees=2, depth=2)
    live = videos.selectExpr("video_id", "TIMESTAMP '2025-01-01 06:00:00' snapshot_time", "view_count * 2 view_count",
                             "like_count", "comment_count", "channel_subscriber_count")
    alerts = monitor.run_once(
        spark, tables, videos, F.expr("TIMESTAMP '2025-01-01 06:00:00'"), topics, stops, comments, live, done.model
    )
    features = spark.read.parquet(tables.features)
    assert features.count() == 200 and features.select("video_id").distinct().count() == 200
    assert spark.read.parquet(tables.history).count() == 350
    predicted = spark.read.parquet(tables.predictions)
    assert predicted.count() == 350 and predicted.where("view_velocity > 0").count() > 100
    assert predicted.where("keyword is null").isEmpty() and "views_per_hour" in predicted.columns
    assert 0 < alerts.count() <= 100
    monitor.run_once(spark, tables, videos, F.expr("TIMESTAMP '2025-01-01 06:00:00'"), topics, stops, comments, live)
    assert spark.read.parquet(tables.history).count() == 350 and spark.read.parquet(tables.features).count() == 200
    twice = videos.where("video_id = '3'").withColumn("keyword", F.lit("~other"))
    hooks = monitor.Hooks(sentiment=lambda texts: [{"LABEL_0": 0.9, "LABEL_1": 0.1, "LABEL_2": 0.0} for _ in texts])
    other = monitor.Tables(scratch_path(spark, "monitor"))
    monitor.run_once(spark, other, videos.unionByName(twice), F.expr("TIMESTAMP '2025-01-01'"), topics, stops, hooks=hooks)
    stored = spark.read.parquet(other.features)
    assert stored.count() == 200 and stored.where("keyword = '~other'").isEmpty()
    assert stored.where("sentiment_label != 'negative'").isEmpty()
    assert not alerts.where("subscriber_count > 0").isEmpty()
