import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import quality
from tidewatch.llm.common import crc_fold


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(True))
    scored = quality.classify(docs, quality.fit(docs, labels, ~held))
    rows = scored.withColumn("held", held).join(labels, "doc_id").where("held").collect()
    assert scored.count() == docs.count() and len(rows) > 40
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in rows) >= 0.92 * len(rows)


def test_features_match_brute_force():
    texts = ["ab cd ab", "", None, "x", "é\tq q"]
    docs, slots = quality.features(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        words = len(raw.split())
        pairs = sum(max(words - g, 0) for g in quality.WORD_GAPS)
        assert (docs == i).sum() == sum(max(len(raw) - k + 1, 0) for k in quality.ORDERS) + words + pairs
        alone = quality.features([t])[1]
        assert sorted(alone) == sorted(slots[docs == i])
    # a repeated word gives the same pair feature whatever the word
    one, two = quality.features(["qq qq"])[1], quality.features(["zz zz"])[1]
    assert set(one) & set(two)


def test_score_is_the_softmax_of_the_average():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.25)
    texts = ["one two two", ""]
    _, slots = quality.features(texts[:1])
    assert np.allclose(quality.score(texts, model), [1 / (1 + np.exp(-model.weights[slots].mean() - 0.25)), 1 / (1 + np.exp(-0.25))])


def test_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (6, 0), (99, 1), (3, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.classify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    assert quality.classify(odd.limit(0), model).count() == 0
    assert quality.fit(odd.limit(0), labels).bias == 0.0
