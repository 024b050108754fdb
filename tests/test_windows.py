from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.session import scratch_path
from tidewatch.streaming import ingest, windows

START = datetime(2025, 3, 1)
SCHEMA = "ts timestamp, kind string"


def run(spark, waves, span, closes=None):
    landing, out, log, late, late_log = (scratch_path(spark, x) for x in ("landing", "out", "log", "late", "late-log"))
    for wave in waves:
        spark.createDataFrame([(START + timedelta(minutes=m) if m is not None else None, k) for m, k in wave], SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(SCHEMA).parquet(landing)
        windows.count_stream(stream, out, log, "ts", span, "10 minutes", ["kind"]).start().awaitTermination()
        if closes is not None:
            windows.late_counts(stream, late, late_log, "ts", closes, "10 minutes").start().awaitTermination()
    rows = spark.read.schema("window_start timestamp, window_end timestamp, kind string, n long").parquet(out).collect()
    minutes = lambda t: int((t - START).total_seconds() // 60)
    return {(minutes(r.window_start), minutes(r.window_end), r.kind): r.n for r in rows}, late


def test_fixed_windows_and_late_rows(spark):
    """Open windows are not written; rows too late for theirs are counted apart, the others still count."""
    span = F.window("ts", "1 hour")
    waves = [
        [(5, "a"), (50, "a"), (50, None), (59, "b"), (None, "a")],
        [(125, "a"), (58, "a")],      # the watermark is still at 49 minutes: 58 is in time
        [(10, "a"), (100, "b"), (130, "a")],  # now at 115: the first window is closed, the second is not
        [(600, "end")],
    ]
    got, late = run(spark, waves, span, span.end)
    assert got == {(0, 60, "a"): 3, (0, 60, None): 1, (0, 60, "b"): 1, (60, 120, "b"): 1, (120, 180, "a"): 2}
    counts = {r.batch_id: (r.late, r["rows"]) for r in ingest.batch_table(spark, late).collect()}
    assert counts == {0: (0, 5), 1: (0, 2), 2: (1, 3), 3: (0, 1)}
    assert sum(n for _, n in counts.values()) == sum(got.values()) + 1 + 2  # one late, one without a time, one window open


def test_overlapping_windows(spark):
    got, _ = run(spark, [[(70, "a")], [(900, "end")]], F.window("ts", "2 hours", "1 hour"))
    assert got == {(0, 120, "a"): 1, (60, 180, "a"): 1}


def test_sessions_grow_across_batches(spark):
    got, _ = run(spark, [[(0, "a"), (5, "a"), (0, "b")], [(12, "a"), (40, "a")], [(900, "end")]], F.session_window("ts", "20 minutes"))
    assert got == {(0, 32, "a"): 3, (0, 20, "b"): 1, (40, 60, "a"): 1}


def test_a_table_is_counted_the_same_way(spark):
    df = spark.createDataFrame([(START, "a"), (START + timedelta(minutes=61), "a")], SCHEMA)
    assert windows.windowed_counts(df, "ts", F.window("ts", "1 hour"), "1 hour", ["kind"]).count() == 2
    assert windows.windowed_counts(df.limit(0), "ts", F.window("ts", "1 hour"), "1 hour").count() == 0
