import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels, numeric, scores, temporal, text
from tidewatch.operators.alerts import with_range_labels, with_ravs


def values(spark, inputs, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_normalise(spark):
    raw = ["http://x y", "www.a b", "@名前 z", "#tag", "a  b　c", None, "A\x1cB\n\t C", " @a_1!x "]
    assert values(spark, raw, "string", text.normalise) == ["y", "b", "z", "tag", "a b c", "", "a b c", "!x"]


def test_strip_is_unicode(spark):
    assert values(spark, [" \n a b\x1f　", "", " \t"], "string", text.strip) == ["a b", "", ""]


def test_word_count(spark):
    assert values(spark, ["", "a", "a b c"], "string", text.word_count) == [0, 1, 3]


def test_emoji_runs(spark):
    raw = ["😀😀", "😀 😀", "🇫🇷", "☀", "", "a🚀b🚀", "𝄞"]
    assert values(spark, raw, "string", text.emoji_runs) == [1, 2, 1, 0, 0, 2, 0]


def test_phrases(spark):
    raw = ["Side Effects seen", "FDA warning", "precalled", None]
    assert values(spark, raw, "string", text.phrase_score) == [2, 1, 1, 0]
    assert values(spark, raw, "string", lambda c: text.phrase_score(c, fold_lexicon=False)) == [2, 0, 1, 0]


def test_duration(spark):
    raw = ["PT4M32S", "PT1H", "PT", "P1DT2H", "P0D", "", None, " PT1H2M3S\n", "PT5X", "PT99999999999999999999H"]
    assert values(spark, raw, "string", temporal.duration_seconds) == [272, 3600, 0, 0, 0, 0, 0, 3723, 0, 0]


def test_duration_text(spark):
    assert values(spark, [0, 59, 272, 3600, 36061], "int", temporal.duration_text) == [
        "", "00:59", "04:32", "01:00:00", "10:01:01"
    ]
    assert values(spark, [0, 272], "int", temporal.duration_minutes) == [0.0, 4.53]


def test_publish_features(spark):
    as_of = F.expr("TIMESTAMP '2025-01-06 12:00:00'")
    raw = ["soon", "2025-01-04T10:00:00Z", "2025-01-06T01:30:00+01:00", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    got = df.select("i", *[c.alias(n) for n, c in temporal.publish_features(temporal.utc(F.col("v")), as_of).items()])
    bad, saturday, monday, missing = got.orderBy("i").collect()
    assert bad.is_weekend == 0 and bad.hours_since_publish is None and missing.publish_weekday is None
    assert (saturday.publish_weekday, saturday.is_weekend, saturday.hours_since_publish) == ("Saturday", 1, 50.0)
    assert (monday.publish_weekday, monday.is_weekend, monday.publish_hour) == ("Monday", 0, 0)


def test_number(spark):
    raw = ["12", " 1e3 ", "n/a", "NaN", None, "", "5d", "2f", "0x1p3", "-0.5", "inf"]
    got = values(spark, raw, "string", numeric.number)
    assert got == [12.0, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -0.5, float("inf")]
    assert values(spark, ["x", "1"], "string", lambda c: numeric.number(c, None)) == [None, 1.0]
    assert values(spark, [float("nan"), None, 2.0], "double", numeric.plain) == [0.0, 0.0, 2.0]


def test_rates_guard_the_denominator(spark):
    df = spark.createDataFrame([(0.0, -1.0), (10.0, None), (10.0, 2.0)], "views double, hours double")
    got = df.select(*[c.alias(n) for n, c in scores.engagement(
        F.col("views"), F.lit(3.0), F.lit(1.0), F.col("hours")).items()]).collect()
    assert [(r.engagement_rate, r.views_per_hour) for r in got] == [(0.0, 0.0), (0.4, 0.0), (0.4, 5.0)]


def test_range_labels_at_the_cuts(spark):
    df = spark.createDataFrame([(0.4, "x", 0.0), (0.39, "1", -1.0), (0.7, None, 500.0), (None, "3", None)],
                               "viral_probability double, pharma_risk_score string, growth_acceleration double")
    got = with_range_labels(df).select("viral_probability_range", "pharma_risk_score_range", "growth_acceleration_range")
    assert [tuple(r) for r in got.collect()] == [
        ("Medium", "Low", "Medium"), ("Low", "Medium", "Low"), ("High", "Low", "High"), ("Low", "High", "Medium"),
    ]


@pytest.mark.parametrize("scores_, expected", [
    ({"toxicity": 0.4999, "insult": 0.1}, ("non_toxic", 0.4999)),
    ({"toxicity": 0.5}, ("toxicity", 0.5)),
    ({"insult": 0.6, "toxicity": 0.6}, ("toxicity", 0.6)),
    ({}, ("unknown", 0.0)),
    (None, ("unknown", 0.0)),
    ({"insult": 0.12345, "toxicity": 0.0}, ("non_toxic", 0.1234)),
])
def test_top_label(spark, scores_, expected):
    df = spark.createDataFrame([(scores_,)], "m map<string,double>")
    got = df.select(labels.top_label(F.col("m"), ["toxicity", "insult"], 0.5, "non_toxic").alias("b")).first()["b"]
    assert tuple(got) == expected


def test_ravs_components_stay_in_bounds(spark):
    df = spark.createDataFrame(
        [(float(p), float(t), float(r), s, v) for p in (0, 0.5, 3) for t in (0, 1.5) for r in (0, 9) for s in (0, 10**9) for v in (0, 400)],
        "viral_probability double, toxicity_score double, pharma_risk_score double, subscriber_count long, cluster_volume int",
    )
    low = {"ravs_speed_of_engagement": 40, "ravs_regulatory_relevance": 35, "ravs_safety_implications": 20,
           "ravs_influencer_reach": 25, "ravs_topic_sensitivity": 25}
    for row in with_ravs(df).collect():
        assert all(low[c] <= row[c] <= 100 for c in low)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(0.5, 3.0), (0.5, 3.0)], "viral_probability double, trend_score double")
    assert {r.ravs_score for r in with_ravs(df).collect()} == {0.15}


def test_channel_subscribers_win(spark):
    df = spark.createDataFrame([(200_000, 1), (None, 100_000), (None, None)], "channel_subscriber_count long, subscriber_count long")
    assert [r.ravs_score for r in with_ravs(df).collect()] == [0.1, 0.1, 0.0]


def test_chunks_keep_the_whole_text(spark):
    body = "".join(chr(97 + i % 26) for i in range(9001))
    assert ["".join(x) for x in values(spark, [body, ""], "string", text.chunks)] == [body, ""]
    assert [len(x) for x in values(spark, [body], "string", text.chunks)[0]] == [4000, 4000, 1001]


def test_null_is_zero_and_a_missing_column_its_default(spark):
    from tidewatch.plans import views

    df = spark.createDataFrame([("a", None, None), ("b", 0.95, 100)], "video_id string, viral_probability double, view_count long")
    found = df.select("video_id", views._score(df, "viral_probability", 0.91).alias("p"), views._score(df, "views_per_hour", 800.0).alias("h"))
    assert {r.video_id: (r.p, r.h) for r in found.collect()} == {"a": (0.0, 800.0), "b": (0.95, 800.0)}
    curves = {r.video_id: r.projected_views for r in views.growth_curve(df, "video_id").where("step = 0").collect()}
    assert curves["a"] < curves["b"]
