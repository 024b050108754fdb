import pytest
from pyspark.sql import functions as F

from tidewatch.operators.alerts import TOP_ALERTS
from tidewatch.session import scratch_path
from tidewatch.sources import files, payloads, sinks, terms
from tidewatch.sources.schemas import COMMENT_RAW, SNAPSHOT, TRACKING_HISTORY, VIDEO_RAW, table

DOC = table("id bigint, text string, at timestamp, score double")


def write(path, body: bytes):
    path.write_bytes(body)
    return str(path)


def test_raw_csv_keeps_everything_as_text(spark, tmp_path):
    path = write(tmp_path / "a.csv", b'\xef\xbb\xbfid,text,at,score\r\n1,"a ""b""\nc, d",2025-01-01T00:00:00Z,x\r\n2, padded ,,1.5\r\n')
    got = [tuple(r) for r in files.read_raw_csv(spark, path, DOC).orderBy("id").collect()]
    assert got == [("1", 'a "b"\nc, d', "2025-01-01T00:00:00Z", "x"), ("2", " padded ", None, "1.5")]


def test_typed_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", b"id,text,at,score\n7,x,2025-01-01T01:00:00+01:00,nope\nbad,y,soon,2\n")
    got = files.read_typed_csv(spark, path, DOC).withColumn("at", F.unix_seconds("at")).collect()
    assert [tuple(r) for r in got] == [(7, "x", 1735689600, 0.0), (0, "y", None, 2.0)]


def test_large_ids_stay_exact(spark, tmp_path):
    path = write(tmp_path / "a.csv", b"id,text,at,score\n9007199254740993,x,,\n")
    assert files.read_typed_csv(spark, path, DOC).first()["id"] == 9007199254740993


def test_missing_sources_are_empty(spark, tmp_path):
    for df in (
        files.read_raw_csv(spark, str(tmp_path / "none.csv"), DOC),
        files.read_optional(spark, str(tmp_path / "none"), DOC),
        files.read_latest(spark, str(tmp_path / "none*.parquet"), DOC),
    ):
        assert df.columns == DOC.names and df.isEmpty()


def test_latest_file(spark, tmp_path):
    import os

    for name, at, body in (("a", 2_000_000_000, b"id\n1\n"), ("b", 1_900_000_000, b"id\n2\n")):
        path = write(tmp_path / f"{name}_export.csv", body)
        os.utime(path, (at, at))
    got = files.read_latest(spark, str(tmp_path / "*_export.csv"), table("id bigint"), "csv", header=True)
    assert [r[0] for r in got.collect()] == [1]


def test_overwrite_and_append(spark):
    path, dated = scratch_path(spark, "t"), scratch_path(spark, "t")
    df = spark.sql("SELECT 1L id, 'a\n\"b\"' text, TIMESTAMP '2025-01-01' at, array(1, 2) parts")
    sinks.overwrite(df, path, path + "-csv")
    sinks.overwrite(df, path, path + "-csv")
    assert spark.read.parquet(path).count() == 1
    assert files.read_raw_csv(spark, path + "-csv", table("id bigint, text string, at timestamp, parts string")).first()["text"] == 'a\n"b"'
    for _ in range(2):
        sinks.append(df, dated, "at")
    assert [str(r[0]) for r in spark.read.parquet(dated).select("ingest_date").collect()] == ["2025-01-01"] * 2


def test_no_alerts_leave_a_header(spark):
    path = scratch_path(spark, "alerts")
    sinks.write_alerts(spark.sql("SELECT 'a' video_id WHERE false"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 0 and len(stored.columns) == 9 and TOP_ALERTS == 100


def test_payload_defaults(spark):
    df = spark.createDataFrame([('{"id":"v"}',), ('{"id":"w","snippet":{"tags":["a","b"]},"statistics":{"viewCount":"12"}}',)], "payload string")
    a, b = payloads.flatten_items(df, "https://media.example/").collect()
    assert (a.title, a.tags, a.view_count, a.published_at, a.url) == ("", "", 0, None, "https://media.example/v")
    assert (b.tags, b.view_count, b.share_count) == ("a|b", 12, "not_available")


def test_channel_payload(spark):
    df = spark.createDataFrame([('{"id":"c","statistics":{"subscriberCount":"5"}}',), ('{"id":"d"}',)], "payload string")
    assert [tuple(r) for r in payloads.channel_stats(df).collect()] == [("c", 5), ("d", 0)]


def test_comment_pages(spark):
    df = spark.createDataFrame([("v", '{"items":[{"id":"1","snippet":{"topLevelComment":{"snippet":{"textDisplay":"hi","likeCount":3}}}},{"id":"2"}]}'), ("w", "{}")],
                               "video_id string, payload string")
    got = payloads.flatten_comments(df, keep=["video_id"]).select("video_id", "comment_id", "text", "like_count").collect()
    assert [tuple(r) for r in got] == [("v", "1", "hi", 3), ("v", "2", "", 0)]


@pytest.mark.parametrize("raw, body, expected", [
    (" b, a ,,b", None, ["b", "a"]),
    ("b", "# note\n\n a \nb\r\nc", ["b", "a", "c"]),
    (None, "#\n\n", ["x", "y"]),
    (None, None, ["x", "y"]),
])
def test_term_list(spark, tmp_path, raw, body, expected):
    path = write(tmp_path / "t.txt", body.encode()) if body is not None else None
    got = terms.term_list(spark, raw, path, ["x", "y", "x"])
    assert [r["term"] for r in got.orderBy("ord").collect()] == expected


def test_schema_sizes():
    assert (len(VIDEO_RAW), len(COMMENT_RAW), len(SNAPSHOT), len(TRACKING_HISTORY)) == (25, 10, 21, 25)


def test_topic_lexicon_round_trip(spark):
    from tidewatch.operators.narratives import read_topics, topic_table

    topics = {"Signs": ["***", "$$$"], "Words": ["the ", "of "]}
    path = scratch_path(spark, "topics")
    topic_table(spark, topics).write.parquet(path)
    found = read_topics(spark, path)
    assert list(found) == list(topics) and found == {k: sorted(v) for k, v in topics.items()}
