import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.catalog.models_ import STOP_WORDS
from tidewatch.catalog.registry import Tables
from tidewatch.operators import narratives, scoring, topics
from tidewatch.plans import narrative, virality
from tidewatch.session import read_in_parts, scratch_path, stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


@pytest.mark.parametrize("n, k", [(3, 3), (5, 5), (4999, 5), (7000, 7), (10**6, 50)])
def test_cluster_count(n, k):
    assert topics.cluster_count(n) == k


@pytest.mark.parametrize("valid, vocabulary, k", [(10, 2000, 3), (100, 2000, 5), (10**6, 2000, 10), (10**6, 2, 2)])
def test_topic_count(valid, vocabulary, k):
    assert topics.topic_count(valid, vocabulary) == k


def test_clusters_are_repeatable(t):
    ids = [sorted(map(tuple, topics.cluster(t.embeddings, "embedding").select("vec_id", "narrative_cluster_id").collect())) for _ in range(2)]
    assert ids[0] == ids[1] and len({c for _, c in ids[0]}) == 5


def test_embedding_hook(spark):
    df = spark.createDataFrame([("ab",), ("",), (None,)], "t string")
    got = topics.embed(df, "t", "e", lambda texts: np.array([[3.0 * len(x), 4.0 * len(x)] for x in texts])).collect()
    assert got[0]["e"] == pytest.approx([0.6, 0.8]) and got[1]["e"] == [0.0, 0.0]


def test_scorer_hook_isolates_bad_texts(spark):
    def scorer(texts):
        if "boom" in texts:
            raise ValueError
        return [{"LABEL_2": 0.91234567, "LABEL_0": 0.1} for _ in texts]

    df = spark.createDataFrame([("x",), ("boom",), (None,)], "t string").coalesce(1)
    got = scoring.score_sentiment(df, "t", scorer).select("sentiment_label", "sentiment_score").collect()
    assert [tuple(r) for r in got] == [("positive", 0.9123), ("unknown", 0.0), ("positive", 0.9123)]


def test_scorer_sees_whole_texts_unless_limited(spark):
    df = spark.createDataFrame([("a" * 600 + " hate",)], "t string")
    assert scoring.score_toxicity(df, "t").first()["toxicity_label"] == "toxicity"
    assert scoring.score_toxicity(df, "t", max_chars=512).first()["toxicity_label"] == "non_toxic"


def test_translation_falls_back_and_runs_once_per_text(spark):
    df = spark.createDataFrame([(1, " un "), (2, "un"), (3, "bad"), (4, None), (5, "  ")], "i int, t string")

    calls = []

    def translator(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise RuntimeError
        return [x.upper() + " " for x in texts]

    got = scoring.translate_column(df, "t", "o", translator).orderBy("i").collect()
    assert [r["o"] for r in got] == ["UN", "UN", "bad", "", ""]
    assert [r["o"] for r in scoring.translate_column(df, "t", "o").orderBy("i").collect()] == ["un", "un", "bad", "", ""]


def test_topics(spark, t):
    rows = stage(t.documents.select("doc_id", "text"), "topics")
    short = rows.limit(3).select("doc_id", F.lit("tiny").alias("text"))
    result = topics.model_topics(rows.unionByName(short), "text", STOP_WORDS, iterations=2)
    assert result.rows.where("length(text) < 10 and dominant_topic_id <> 0").isEmpty()
    words = [r["topic_keywords"].split(", ") for r in result.words.collect()]
    assert len(words) == topics.topic_count(rows.count(), 2000) and all(len(w) == 10 for w in words)
    assert topics.with_topic_keywords(result).where("topic_keywords is null").isEmpty()


def _plain_inference(model, ids, counts):
    """One text at a time, as the definition has it."""
    known, now = np.exp(topics._log_mean(model.words))[:, ids], model.start
    while True:
        share = np.exp(topics._log_mean(now))
        then = share * (known @ (counts / (share @ known))) + model.prior
        moved, now = np.abs(then - now).mean(), then
        if moved <= topics.SETTLED:
            share = np.exp(topics._log_mean(now))
            return now, share[:, None] * known * (counts / (share @ known))


def test_topic_inference_in_slots_is_that_of_each_text(monkeypatch):
    monkeypatch.setattr(topics, "SLOT_NUMBERS", 300)
    rng = np.random.default_rng(3)
    model = topics.TopicModel(rng.gamma(1.0, 5.0, (4, 90)) + 0.01, np.array([0.1, 0.2, 0.3, 0.4]), rng.gamma(100, 0.01, 4))
    sizes = np.concatenate([rng.integers(0, 60, 70), [90, 1, 0]])
    ids = [np.sort(rng.choice(90, n, replace=False)) for n in sizes]
    counts = [rng.integers(1, 40, n) for n in sizes]
    weights, sums = model.infer(sizes, np.concatenate(ids), np.concatenate(counts))
    wanted = np.zeros((4, 90))
    for got, i, c in zip(weights, ids, counts, strict=True):
        if not len(i):
            assert not got.any()
            continue
        now, part = _plain_inference(model, i, c)
        assert np.allclose(got, now, rtol=1e-9)
        wanted[:, i] += part
    assert np.allclose(sums, wanted, rtol=1e-9)
    assert model.infer(sizes[-1:], np.zeros(0, int), np.zeros(0, int))[0].shape == (1, 4)


def test_steps_in_single_precision_give_the_same_topics(monkeypatch):
    monkeypatch.setattr(topics, "SINGLE", 20)
    rng = np.random.default_rng(6)
    model = topics.TopicModel(rng.gamma(0.5, 9.0, (4, 90)) + 0.01, np.array([0.1, 0.2, 0.3, 0.4]), rng.gamma(100, 0.01, 4))
    sizes = np.array([*rng.integers(0, 40, 60), 90, 0])
    ids = np.concatenate([np.sort(rng.choice(90, n, replace=False)) for n in sizes])
    counts = rng.integers(1, 6, len(ids))
    exact, wanted = model.infer(sizes, ids, counts)
    weights, sums = model.infer_by_size(sizes, ids, counts)
    single = np.array([x.sum() <= 80 for x in np.split(counts, np.cumsum(sizes)[:-1])])
    assert 10 < single.sum() < 55 and np.allclose(weights[~single], exact[~single], rtol=1e-9)
    assert np.allclose(weights, exact, rtol=1e-2) and np.allclose(sums, wanted, rtol=1e-2)
    assert (weights.argmax(axis=1) == exact.argmax(axis=1)).all()


def test_topics_tokenise_texts_once(spark):
    """Best topics are found from the terms that were written for the fit, and passes read files of like size, a task each."""
    rows = spark.createDataFrame([(i, f"alpha beta{i % 5} Beta{i % 5} gamma{i % 7}, x") for i in range(200)] + [(200, "tiny"), (201, None)], "i int, text string")
    result = topics.model_topics(rows, "text", ["gamma0"], iterations=2)
    assert "regexp" not in result.rows._jdf.queryExecution().optimizedPlan().toString()
    assert result.rows.columns == ["i", "text", "dominant_topic_id"] and result.rows.count() == 202
    spread = stage(spark.range(4000).repartition(20), "spread")
    with read_in_parts(spark, 20):
        assert len([n for n in spread.rdd.glom().map(len).collect() if n]) == 20
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_terms_of_a_text(spark):
    import pyarrow as pa

    found = topics._text_terms(pa.array([["b", "a", "b"], [], None, ["c", "a"]])).to_pylist()
    assert [dict(zip(x["terms"], x["counts"], strict=True)) for x in found] == [{"b": 2, "a": 1}, {}, {}, {"c": 1, "a": 1}]
    sizes, ids, counts = topics._known_terms(pa.array(["c", "b"]), pa.array([["b", "a"], None, ["a", "b", "c"]]), pa.array([[2, 1], None, [1, 4, 3]]))
    assert sizes.tolist() == [1, 0, 2] and ids.tolist() == [1, 0, 1] and counts.tolist() == [2, 3, 4]


def test_topics_do_not_depend_on_partitions(spark):
    """Spark's LDA starts the texts of each partition from other weights and draws texts anew, so it gave other topics for other partitions."""
    rng = np.random.default_rng(11)
    pools = [[f"{p}{q}{r}" for q in "abcde" for r in "uvwxyz"] for p in ("ka", "lo", "mi")]
    texts = [(i, " ".join(rng.choice(pools[i % 3], 25)) + " common words") for i in range(240)]
    rows = spark.createDataFrame([*texts, (240, "tiny"), (241, None), (242, "- - - - - - - -")], "i int, text string")
    found = []
    for df in (rows.repartition(6, "i"), rows.coalesce(1)):
        result = topics.model_topics(df, "text", [], iterations=5, max_topics=3)
        found.append((sorted(map(tuple, result.words.collect())), {r["i"]: r["dominant_topic_id"] for r in result.rows.collect()}))
    assert found[0] == found[1]
    best = found[0][1]
    assert best[240] == best[241] == best[242] == 0 and len(best) == 243


def test_split_is_stratified_and_stable(t):
    rows = t.scored()
    sides = [{r["video_id"] for r in side.collect()} for side in virality.split(rows, "video_id", "viral_label")]
    again = {r["video_id"] for r in virality.split(rows.repartition(7), "video_id", "viral_label")[0].collect()}
    assert sides[0] == again and not sides[0] & sides[1] and len(sides[0] | sides[1]) == rows.count()
    for label in (0, 1):
        ids = {r["video_id"] for r in rows.where(F.col("viral_label") == label).collect()}
        assert abs(len(ids & sides[0]) - 0.8 * len(ids)) <= 1


def test_training_learns_saves_and_reports(spark, t):
    rows = t.scored().withColumn("viral_label", (F.col("trend_score") > 40).cast("int"))
    done = virality.run_training(rows, trees=4, depth=3)
    metrics = done.metrics.first()
    assert metrics.roc_auc > 0.9 and metrics.test_samples == done.heldout.count()
    weights = {r.feature: r.importance for r in done.importance.collect()}
    assert sum(weights.values()) == pytest.approx(1.0) and max(weights, key=weights.get) == "trend_score"
    assert virality.top_importance(done.importance, 3).count() == 3
    path = scratch_path(spark, "model")
    virality.save(done.model, path)
    columns = ["video_id", "viral_probability"]
    before, after = (
        sorted(map(tuple, virality.predict(m, rows, done.features).select(*columns).collect()))
        for m in (done.model, virality.load(path))
    )
    assert before == after
    bare = virality.predict(done.model, rows.select("video_id"), done.features)
    assert bare.select("viral_probability").distinct().count() == 1
    odd = rows.withColumn("sentiment_label", F.lit("never seen"))
    assert virality.predict(done.model, odd, done.features).count() == rows.count()
    clean = virality.run_training(rows, trees=2, depth=2, without_leaks=True)
    assert "trend_score" not in clean.features.all


def test_missing_label_is_refused(spark):
    with pytest.raises(ValueError):
        virality.select_features(spark.range(1))


@pytest.mark.parametrize("strategy", ["lexicon", "modal"])
def test_narratives(spark, t, strategy):
    rows = t.documents.selectExpr(
        "cast(doc_id as string) video_id", "text analysis_text_en", "1D virality_score", "cast(n_chars as double) trend_score"
    )
    got = narrative.build_narratives(rows, {"Signs": ["***"]}, STOP_WORDS, strategy=strategy)
    stored = got.collect()
    assert len(stored) == rows.count()
    assert {r.narrative_cluster_id for r in stored} == set(range(5))
    sizes = {}
    for r in stored:
        sizes[r.narrative_cluster_id] = sizes.get(r.narrative_cluster_id, 0) + 1
    assert all(r.cluster_volume == sizes[r.narrative_cluster_id] and r.cluster_topic_name for r in stored)
    assert len({(r.narrative_cluster_id, r.cluster_topic_name) for r in stored}) == 5
    share = sum(r.emerging_narrative == "emerging" for r in stored) / len(stored)
    assert 0.05 <= share < 0.2
    assert "trend_score_range" in got.columns and "embedding" not in got.columns


def test_neighbour_scores_of_all_rows(spark):
    """Copies exactly, and at least nine rows in ten to their exact value, against all pairs."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:130] = v[5]
    v[200] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v.astype(np.float32))] + [(3000, None)]
    df = spark.createDataFrame(rows, "id long, e array<float>")
    got = {r.id: r.narrative_similarity_score for r in narratives.all_neighbour_scores(df, "e").collect()}
    cosine = v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T
    np.fill_diagonal(cosine, -1)
    exact = cosine.max(axis=1)
    assert len(got) == 3001 and got[200] == 0 and got[3000] == 0
    assert all(got[i] == 1.0 for i in (5, *range(100, 130)))
    others = [i for i in range(3000) if i != 200]
    assert np.mean([abs(got[i] - exact[i]) < 2e-4 for i in others]) >= 0.9
    assert all(got[i] <= exact[i] + 2e-4 for i in others)
    tight = {r.id: r.narrative_similarity_score for r in narratives.all_neighbour_scores(df, "e", limit=1100).collect()}
    assert np.mean([abs(tight[i] - exact[i]) < 2e-4 for i in others]) >= 0.9 and all(tight[i] <= exact[i] + 2e-4 for i in others)
    assert narratives.all_neighbour_scores(df.limit(0), "e").count() == 0
    assert [r.narrative_similarity_score for r in narratives.all_neighbour_scores(df.limit(1), "e").collect()] == [0.0]


def test_neighbour_scores_are_exact_where_cells_miss_neighbours(spark):
    """One cell a vector misses many neighbours: the pairs of blocks find them, copies, opposite and empty vectors included."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 24))
    v[:300] = v[300:600] + 0.2 * rng.normal(size=(300, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[10], v[11], v[12], v[13] = v[400], v[401], 0, -v[700]
    v = v.astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, e array<float>")
    got = {r.id: r.narrative_similarity_score for r in narratives.all_neighbour_scores(df, "e", probes=1, limit=100).collect()}
    cosine = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(cosine, -2)
    cosine[:, 12] = -2
    exact = np.round(cosine.max(axis=1), 4)
    exact[12] = 0
    assert len(got) == 901 and got[900] == 0
    assert np.abs(np.array([got[i] for i in range(900)]) - exact).max() < 1e-9


def test_blocks_find_the_nearest_of_vectors_nearly_alike(spark):
    rng = np.random.default_rng(9)
    v = 1 + 1e-2 * rng.normal(size=(350, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for kind in ("float", "double"):
        w = v.astype(np.float32).astype(float) if kind == "float" else v
        rows = [(i, [float(x) for x in r], -2.0) for i, r in enumerate(w)]
        distinct = spark.createDataFrame(rows, f"_vec long, _v array<{kind}>, _best double")
        found = narratives.closer_in_blocks(distinct, 350, 64).groupBy("_vec").agg(F.max("_best").alias("b"))
        cosine = w @ w.T
        np.fill_diagonal(cosine, -2)
        assert np.allclose([r.b for r in found.orderBy("_vec").collect()], np.minimum(cosine.max(axis=1), 2), atol=1e-12)
    alone = spark.createDataFrame([(1, [1.0, 0.0], -2.0)], "_vec long, _v array<float>, _best double")
    assert narratives.closer_in_blocks(alone, 1, 64).count() == 0


def test_neighbour_cells_stay_within_their_limit(spark):
    """Texts of one kind and vectors nearly alike: no cell grows beyond the limit and no vector is left out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    rng = np.random.default_rng(3)
    alike = [([float(x) for x in r],) for r in (1 + 1e-4 * rng.normal(size=(500, 8))).astype(np.float32)]
    for vectors, limit in ((topics.embed(docs, "text", "e").select("e"), 300), (spark.createDataFrame(alike, "e array<float>"), 64)):
        solid = vectors.where(F.exists("e", lambda x: x != 0))
        distinct = stage(solid.select(F.xxhash64("e").alias("_vec"), F.col("e").alias("_v")).dropDuplicates(["_vec"]), "distinct")
        cells = stage(narratives.neighbour_cells(distinct, distinct.count(), limit=limit), "cells")
        assert cells.groupBy("_cell").count().agg(F.max("count")).first()[0] <= limit
        assert cells.select("_vec").distinct().count() == distinct.count()
