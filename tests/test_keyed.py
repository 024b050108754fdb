from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewatch.plans import monitor, tracking
from tidewatch.session import scratch_path
from tidewatch.streaming import keyed

SCHEMA = "video_id string, event_id long, tracking_timestamp timestamp, view_count long, like_count long, comment_count long, engagement_rate double"
START = datetime(2025, 1, 1)
COLUMNS = ["video_id", "event_id", "prev_views", "prev_likes", "prev_timestamp", "view_velocity", "engagement_velocity", "prev_view_velocity", "growth_acceleration"]


def run_waves(spark, waves):
    """Each wave is a micro-batch of its own; the queries and the rows written."""
    landing, out, log = (scratch_path(spark, x) for x in ("keyed-landing", "keyed-out", "keyed-log"))
    queries = []
    for wave in waves:
        if wave:
            spark.createDataFrame(wave, SCHEMA).repartition(3).write.mode("append").parquet(landing)
        query = keyed.start(spark.readStream.schema(SCHEMA).parquet(landing), out, log)
        query.awaitTermination()
        queries.append(query)
    return queries, keyed.read(spark, out)


def as_set(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def updated(query):
    return sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"])


def test_three_waves_equal_the_batch_form(spark):
    """With ties in time, missing ids, missing counts and an item with many rows in one wave."""
    rows = [(f"v{i % 4}" if i % 9 else None, i, START + timedelta(hours=i // 3), None if i % 13 == 5 else i * i, i, i // 2, i / 100) for i in range(120)]
    waves = [rows[:40], rows[40:41], rows[41:]]
    _, got = run_waves(spark, waves)
    expected = tracking.with_velocities(tracking.previous_values(spark.createDataFrame(rows, SCHEMA)))
    assert got.where("late").isEmpty() and as_set(got) == as_set(expected)


def test_a_batch_of_one_item_touches_one_key(spark):
    first = [(f"v{i}", i, START, i, i, i, 0.1) for i in range(50)]
    queries, got = run_waves(spark, [first, [("v7", 99, START + timedelta(hours=1), 30, 9, 9, 0.2)], []])
    assert updated(queries[0]) == 50 and updated(queries[1]) == 1
    assert got.count() == 51  # the third start finds nothing new and adds nothing
    assert got.where("event_id = 99").first().view_velocity == 23.0


def test_late_rows_and_ties_across_batches(spark):
    at = START + timedelta(hours=5)
    waves = [[("v", 1, at, 10, 1, 0, 0.1)], [("v", 5, at, 20, 2, 0, 0.2), ("v", 9, START, 1, 1, 0, 0.0)], [("v", 3, at, 30, 3, 0, 0.3), ("v", 4, None, 40, 3, 0, 0.3)]]
    _, got = run_waves(spark, waves)
    assert sorted(r.event_id for r in got.where("late").collect()) == [3, 9]
    kept = {r.event_id: r for r in got.where("not late").collect()}
    assert sorted(kept) == [1, 4, 5] and kept[5].prev_views == 10 and kept[5].view_velocity is None and kept[4].prev_views == 20


def test_runs_with_rows_without_an_id(spark):
    """Narrative rows equal history rows, and a repeated run replaces its own features and history."""
    videos = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).selectExpr(
        "CASE WHEN doc_id % 3 > 0 THEN cast(doc_id AS string) END video_id", "source keyword", "source channel_title", "lang title", "text description",
        "TIMESTAMP '2024-01-01' published_at", "'PT4M' duration", "n_chars * 10 view_count", "n_chars % 97 like_count",
        "n_chars % 31 comment_count", "n_chars * 97 % 300000 channel_subscriber_count")
    tables = monitor.Tables(scratch_path(spark, "monitor"))
    for _ in range(2):
        found = monitor.run_once(spark, tables, videos, F.expr("TIMESTAMP '2025-01-01'"), {"Signs": ["***"]}, ["the", "of"])
        assert spark.read.parquet(tables.features).count() == spark.read.parquet(tables.history).count() == found.count() == 60


def test_an_item_is_handled_without_work_on_frames(monkeypatch):
    """A frame's own sort, filter and assignments cost milliseconds an item, whatever its few rows."""
    def refused(*_, **__):
        raise AssertionError("frame by frame")

    frames = [pd.DataFrame({"absent": False, "item": "v", "micros": m, "place": p, **{c: np.array(v, float) for c in keyed._VALUES}}) for m, p, v in (
        ([30, 10], [1, 2], [3.0, np.nan]), ([10], [1], [7.0]))]
    for name in ("sort_values", "assign"):
        monkeypatch.setattr(pd.DataFrame, name, refused)
    held = {}

    class Last:
        exists = staticmethod(lambda: "v" in held)
        get = staticmethod(lambda: held["v"])
        update = staticmethod(lambda v: held.update(v=v))

    handler = keyed.LastTwo()
    handler.last = Last
    (out,) = handler.handleInputRows(("v",), iter(frames), None)
    assert out["micros"].tolist() == [10, 10, 30] and out["place"].tolist() == [1, 2, 1] and not out["late"].any()
    assert out["micros1"].tolist() == [keyed.NO_ROW, 10, 10] and out["micros2"].tolist() == [keyed.NO_ROW, keyed.NO_ROW, 10]
    assert out["view_count1"].isna().tolist() == [True, False, True] and out["view_count2"].tolist()[2] == 7.0
    assert held["v"] == (30, 1, 3.0, 3.0, 3.0, 3.0, 10, None)
    (again,) = handler.handleInputRows(("v",), iter([frames[1]]), None)
    assert again["late"].tolist() == [True] and again["micros1"].tolist() == [keyed.NO_ROW] and held["v"][0] == 30
    assert list(again) == [x.split()[0] for x in keyed._OUT.split(", ")]
