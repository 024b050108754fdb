"""K: incremental forms. Driver tables are landed as files and picked up by file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.registry import V_SCORED, V_SNAP, V_VIDEO, Tables, query, rounded, within_rank
from tidewatch.catalog.views_ import ALERT_CTES
from tidewatch.catalog.windows_ import V_TRACK
from tidewatch.session import scratch_path
from tidewatch.streaming import ingest, keyed, rescoring, velocity, windows


def _finish(writer) -> None:
    writer.start().awaitTermination()


def _land(df, path: str) -> None:
    df.write.mode("append").parquet(path)


def _stream(t: Tables, df, path: str):
    return t.spark.readStream.schema(df.schema).parquet(path)


def _waves(snap) -> list:
    """Snapshots in three consecutive spans of time."""
    cuts = [F.expr(f"TIMESTAMP '{x}'") for x in ("2024-01-11 00:00:00", "2024-01-21 00:00:00")]
    at = F.col("tracking_timestamp")
    return [snap.where(at < cuts[0]), snap.where((at >= cuts[0]) & (at < cuts[1])), snap.where(at >= cuts[1])]


@query("k1_incremental_ingest", """
    SELECT video_id, title, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS batch FROM v_video v LEFT JOIN labels l ON v.ord = l.doc_id""", V_VIDEO)
def k1(t: Tables):
    landing, table, state = (scratch_path(t.spark, f"k1-{x}") for x in ("landing", "table", "state"))
    videos = t.video()
    seen = t.labels.select(F.col("doc_id").alias("ord"))
    for wave in (videos.join(seen, "ord", "left_semi").select(*videos.columns), videos, videos):
        _land(wave, landing)
        _finish(ingest.ingest(_stream(t, videos, landing), table, state, [F.col("ord")]))
    rows = ingest.batch_table(t.spark, table)
    return rows.select("video_id", "title", F.col("batch_id").cast("int").alias("batch"))


@query("k1_seen_index", """
    SELECT video_id, title, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS batch FROM v_video v LEFT JOIN labels l ON v.ord = l.doc_id""", V_VIDEO)
def k1_indexed(t: Tables):
    landing, table, index, state = (scratch_path(t.spark, f"k1-index-{x}") for x in ("landing", "table", "ids", "state"))
    videos = t.video()
    seen = t.labels.select(F.col("doc_id").alias("ord"))
    for wave in (videos.join(seen, "ord", "left_semi").select(*videos.columns), videos, videos):
        _land(wave, landing)
        _finish(ingest.ingest_indexed(_stream(t, videos, landing), table, index, state, [F.col("ord")], buckets=16))
    return ingest.batch_table(t.spark, table).select("video_id", "title", F.col("batch_id").cast("int").alias("batch"))


@query("k1_within_watermark", "SELECT video_id, title FROM v_video", V_VIDEO)
def k1_recent(t: Tables):
    landing, table, state = (scratch_path(t.spark, f"k1-recent-{x}") for x in ("landing", "table", "state"))
    videos = t.video().select("video_id", "title", "published_at")
    for _ in range(2):
        _land(videos, landing)
        _finish(ingest.ingest_recent(_stream(t, videos, landing), table, state, "published_at", "36500 days"))
    return t.spark.read.parquet(table).select("video_id", "title")


@query("k2_stateful_velocity", """
    SELECT video_id, event_id, prev_views, round(view_velocity, 6) AS view_velocity, round(comment_velocity, 6) AS comment_velocity,
      round(prev_view_velocity, 6) AS prev_view_velocity, round(growth_acceleration, 6) AS growth_acceleration FROM v_acc""", V_SNAP, V_TRACK)
def k2(t: Tables):
    landing, out, state, late, log = (scratch_path(t.spark, f"k2-{x}") for x in ("landing", "out", "state", "late", "log"))
    snap = t.snap()
    for wave in _waves(snap):
        _land(wave, landing)
        _finish(velocity.velocities(_stream(t, snap, landing), out, state, late, log))
    return rounded(ingest.batch_table(t.spark, out).select(
        "video_id", "event_id", "prev_views", "view_velocity", "comment_velocity", "prev_view_velocity", "growth_acceleration"
    ))


@query("k2_keyed_state", """
    SELECT video_id, event_id, prev_views, round(view_velocity, 6) AS view_velocity, round(comment_velocity, 6) AS comment_velocity,
      round(engagement_velocity, 6) AS engagement_velocity, round(prev_view_velocity, 6) AS prev_view_velocity,
      round(growth_acceleration, 6) AS growth_acceleration FROM v_acc""", V_SNAP, V_TRACK)
def k2_keyed(t: Tables):
    landing, out, log = (scratch_path(t.spark, f"k2-keyed-{x}") for x in ("landing", "out", "log"))
    snap = t.snap()
    for wave in _waves(snap):
        _land(wave, landing)
        keyed.start(_stream(t, snap, landing), out, log).awaitTermination()
    return rounded(keyed.read(t.spark, out).where("not late").select(
        "video_id", "event_id", "prev_views", "view_velocity", "comment_velocity", "engagement_velocity", "prev_view_velocity", "growth_acceleration"
    ))


@query("k3_snapshot_append", """
    SELECT video_id, event_id, view_count, CAST(CAST(tracking_timestamp AS DATE) AS VARCHAR) AS ingest_date FROM v_snap""", V_SNAP)
def k3(t: Tables):
    landing, table, log = (scratch_path(t.spark, f"k3-{x}") for x in ("landing", "table", "log"))
    snap = t.snap().select("video_id", "event_id", "view_count", "tracking_timestamp")
    for wave in _waves(snap):
        _land(wave, landing)
        _finish(ingest.append_snapshots(_stream(t, snap, landing), table, log, "tracking_timestamp"))
    rows = t.spark.read.parquet(table)
    return rows.select("video_id", "event_id", "view_count", F.col("ingest_date").cast("string").alias("ingest_date"))


@query("k4_micro_batch_alerts", """
    SELECT video_id, alert_type, alert_priority, ravs_score, round(alert_score, 6) AS alert_score FROM v_alerts""", *ALERT_CTES)
def k4(t: Tables):
    landing, cuts, out, log = (scratch_path(t.spark, f"k4-{x}") for x in ("landing", "cuts", "out", "log"))
    rows = t.scored()
    rescoring.save_thresholds(rows, cuts)
    for half in (rows.where("sentiment_label = 'negative'"), rows.where("sentiment_label <> 'negative'")):
        _land(half, landing)
        _finish(rescoring.alert_stream(_stream(t, rows, landing), cuts, out, log))
    return rounded(rescoring.current_alerts(t.spark, out).select(
        "video_id", "alert_type", "alert_priority", "ravs_score", "alert_score"
    ))


@query("k4_sketched_thresholds", """
    SELECT 'growth_acceleration' AS score, count(growth_acceleration) AS n, true AS within FROM v_scored
    UNION ALL SELECT 'narrative_trend_score', count(narrative_trend_score), true FROM v_scored
    UNION ALL SELECT 'trend_score', count(trend_score), true FROM v_scored""", V_SCORED)
def k4_sketched(t: Tables):
    """Cut points merged from two batches' sketches, held to their exact ranks in the whole table."""
    path, rows = scratch_path(t.spark, "k4-sketches"), t.scored()
    for i, half in enumerate((rows.where("sentiment_label = 'negative'"), rows.where("sentiment_label <> 'negative'"))):
        rescoring.store_scores(half, path, i)
    cuts, _ = rescoring.thresholds_from_sketches(t.spark, path)
    checks = [("growth_acceleration", cuts.acceleration, 0.95), ("narrative_trend_score", cuts.narrative, 0.95), ("trend_score", cuts.trend, 0.90)]
    ranks = rows.agg(*[x for c, v, _ in checks for x in (
        F.count(c).alias(f"n_{c}"), F.count_if(F.col(c) < v).alias(f"under_{c}"), F.count_if(F.col(c) <= v).alias(f"upto_{c}"))])
    return ranks.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("score"), F.col(f"n_{c}").alias("n"), within_rank(f"under_{c}", f"upto_{c}", f"n_{c}", q).alias("within")) for c, _, q in checks
    ])))


def _closing_row(t: Tables):
    """An event of its own kind, far behind all others: its time carries the watermark past every window."""
    return t.events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit("~end").alias("event_type"))


def _windowed(t: Tables, name: str, span, by):
    landing, out, log = (scratch_path(t.spark, f"k5-{name}-{x}") for x in ("landing", "out", "log"))
    rows = t.events.select("ts", "user_id", "event_type")
    cut = F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'") if dict(rows.dtypes)["ts"] == "timestamp_ntz" else F.expr("TIMESTAMP '2024-01-16 00:00:00'")
    rows, end = rows.withColumn("_first", F.col("ts") < cut), _closing_row(t)
    instants = [w.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type") for w in (
        rows.where("_first"), rows.where("not coalesce(_first, false)"), end)]
    for wave in instants:
        _land(wave, landing)
        _finish(windows.count_stream(_stream(t, wave, landing), out, log, "ts", span, "1 hour", by))
    return t.spark.read.parquet(out).where("window_start is not null")


@query("k5_fixed_windows", """
    SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS window_start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def k5_fixed(t: Tables):
    return _windowed(t, "fixed", F.window("ts", "1 day"), ["event_type"]).select("event_type", F.to_date("window_start").cast("string").alias("window_start"), "n")


@query("k5_sliding_windows", """
    SELECT event_type, CAST(day AS VARCHAR) AS window_start, count(*) AS n FROM (
      SELECT event_type, CAST(ts AS DATE) AS day FROM events WHERE ts IS NOT NULL
      UNION ALL SELECT event_type, CAST(ts AS DATE) - 1 FROM events WHERE ts IS NOT NULL) GROUP BY 1, 2""")
def k5_sliding(t: Tables):
    return _windowed(t, "sliding", F.window("ts", "2 days", "1 day"), ["event_type"]).select("event_type", F.to_date("window_start").cast("string").alias("window_start"), "n")


@query("k5_session_windows", """
    SELECT user_id, epoch_us(min(ts)) AS window_start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS window_end, count(*) AS n FROM (
      SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM (
        SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
        FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, visit""")
def k5_session(t: Tables):
    closed = _windowed(t, "session", F.session_window("ts", "6 hours"), ["user_id"]).where("user_id is not null")
    return closed.select("user_id", *[F.unix_micros(c).alias(c) for c in ("window_start", "window_end")], "n")
