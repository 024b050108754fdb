"""I: scoring, clustering, topics and the classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.catalog.registry import V_SCORED, Tables, query, rounded
from tidewatch.catalog.shaping_ import STRIP
from tidewatch.operators import narratives, scoring, topics
from tidewatch.plans import virality
from tidewatch.plans.narrative import modal_names

# Phrases and stop words that fit the driver texts.
FEELINGS = {"negative": ["nicht", "death", "heha"], "neutral": [], "positive": ["that ", "pour", "stat"]}
EMOTIONS = {"anger": ["nnot"], "disgust": ["ekel"], "fear": ["heha"], "joy": ["that "], "neutral": [], "sadness": ["pour"], "surprise": ["***"]}
HARMS = {"toxicity": ["nicht", "heha"], "severe_toxicity": ["death"], "obscene": ["$$$"], "threat": ["the"], "insult": ["***"], "identity_attack": ["una"]}
TOPICS = {
    "Romance words": ["pour", "que ", "una ", "los ", "des "], "Germanic words": ["nicht", "und ", "sich", "von "],
    "Signs": ["***", "$$$", "@", "%%%"], "Endings": ["keit", "tion", "ing", "death", "statin"],
}
STOP_WORDS = ["the", "of", "de", "and", "to", "in", "la", "der", "is", "that", "en", "it", "for", "was", "on", "die", "with", "que", "le"]
SQL_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def lexicon_sql(lexicon: dict, resting: str | None, floor: bool, raw: str = "raw", name: str = "") -> tuple[str, str]:
    """CTEs that score ``raw(id, text)`` by a lexicon, and the final select."""
    hits = ", ".join(
        f"({' + '.join([f'CAST(contains(lower(text), {p!r}) AS INTEGER)' for p in phrases]) or '0'}) AS {label}"
        for label, phrases in lexicon.items()
    )
    total = " + ".join(lexicon)
    shares = ", ".join(
        f"CASE WHEN total > 0 THEN {label} / total ELSE {1.0 if label == resting else 0.0} END AS {label}" for label in lexicon
    )
    first = " ".join(f"WHEN {label} = best THEN '{label}'" for label in lexicon)
    low = "WHEN best < 0.5 THEN 'non_toxic' " if floor else ""
    ctes = f"""{name}hits AS (SELECT id, {hits} FROM {raw}),
{name}totals AS (SELECT *, {total} AS total FROM {name}hits),
{name}shares AS (SELECT id, {shares} FROM {name}totals),
{name}bests AS (SELECT *, greatest({', '.join(lexicon)}) AS best FROM {name}shares)"""
    return ctes, f"SELECT id, CASE {low}{first} END AS label, round_even(best, 4) AS score FROM {name}bests"


RAW = "raw AS (SELECT doc_id AS id, text FROM documents)"
_SENTIMENT = lexicon_sql(FEELINGS, "neutral", False)
_EMOTION = lexicon_sql(EMOTIONS, "neutral", False)
_TOXICITY = lexicon_sql(HARMS, None, True)


def _raw(t: Tables):
    return t.texts().select(F.col("doc_id").alias("id"), "text")


def _named(df, prefix: str):
    return df.select("id", F.col(f"{prefix}_label").alias("label"), F.col(f"{prefix}_score").alias("score"))


@query("i1_sentiment_scoring", _SENTIMENT[1], RAW, _SENTIMENT[0])
def i1(t: Tables):
    return _named(scoring.score_lexicon(_raw(t), "text", "sentiment", FEELINGS, "neutral"), "sentiment")


@query("i2_emotion_scoring", _EMOTION[1], RAW, _EMOTION[0])
def i2(t: Tables):
    return _named(scoring.score_lexicon(_raw(t), "text", "emotion", EMOTIONS, "neutral"), "emotion")


@query("i3_toxicity_scoring", _TOXICITY[1], RAW, _TOXICITY[0])
def i3(t: Tables):
    """Through the Arrow hook, with a scorer that shares out phrase hits."""
    harms = HARMS

    def scorer(texts):
        found = []
        for text in texts:
            lowered = text.lower()
            hits = {name: sum(p in lowered for p in phrases) for name, phrases in harms.items()}
            total = sum(hits.values())
            found.append({name: n / total if total else 0.0 for name, n in hits.items()})
        return found

    return _named(scoring.score_toxicity(_raw(t), "text", scorer), "toxicity")


@query("i4_column_translation", f"""
    SELECT id, {STRIP.format('text')} AS same, string_agg({STRIP.format("replace(part, 'e', 'E')")}, chr(10) ORDER BY i) AS shouted
    FROM (SELECT id, text, i, substr({STRIP.format('text')}, i * 4000 + 1, 4000) AS part
      FROM raw, unnest(range((length({STRIP.format('text')}) - 1) // 4000 + 1)) AS u(i))
    GROUP BY id, text""", RAW)
def i4(t: Tables):
    """Built-in identity, and a translator function over distinct texts."""
    same = scoring.translate_column(_raw(t), "text", "same")
    return scoring.translate_column(same, "text", "shouted", lambda texts: [x.replace("e", "E") for x in texts]).drop("text")


@query("i5_text_embeddings")
def i5(t: Tables):
    rows = topics.embed(t.texts().select("doc_id", "text"), "text", "embedding", stop_words=STOP_WORDS)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("doc_id", F.size("embedding").alias("dims"), F.round(F.sqrt(squares), 4).alias("norm"))


@query("i6_narrative_clustering")
def i6(t: Tables):
    return topics.cluster(t.embeddings, "embedding").select("vec_id", "narrative_cluster_id")


@query("i6_cluster_count", """
    SELECT source, count(*) AS n, CAST(least(count(*), 50, greatest(5, count(*) // 1000)) AS INTEGER) AS k FROM documents GROUP BY source
    UNION ALL SELECT 'events', count(*), CAST(least(count(*), 50, greatest(5, count(*) // 1000)) AS INTEGER) FROM events""")
def i6_count(t: Tables):
    sizes = t.documents.groupBy("source").agg(F.count("*").alias("n")).unionByName(
        t.events.agg(F.lit("events").alias("source"), F.count("*").alias("n"))
    )
    return sizes.withColumn("k", topics.cluster_count_column(F.col("n")))


@query("i7_term_counts", f"""
    SELECT term, count(*) AS n FROM (
      SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents)
    WHERE NOT list_contains({SQL_STOPS}, term) GROUP BY term ORDER BY n DESC, term LIMIT 2000""")
def i7(t: Tables):
    return topics.term_counts(t.texts(), "text", STOP_WORDS)


def _topics(t: Tables):
    return topics.model_topics(t.texts().select("doc_id", "text", F.col("source").alias("keyword")), "text", STOP_WORDS)


@query("i8_topic_model")
def i8(t: Tables):
    return topics.with_topic_keywords(_topics(t)).select("doc_id", "dominant_topic_id", "topic_keywords")


@query("i9_topic_words")
def i9(t: Tables):
    return _topics(t).words


@query("i10_dominant_topic")
def i10(t: Tables):
    return _topics(t).rows.groupBy("dominant_topic_id").agg(F.count("*").alias("n"))


@query("i11_degenerate_topics", """
    SELECT doc_id, 'short' AS input, 0 AS dominant_topic_id, 'no_topic_detected' AS topic_keywords FROM documents
    UNION ALL SELECT doc_id, 'stop words', 0, 'empty_topic' FROM documents""")
def i11(t: Tables):
    out = None
    for name, text in (("short", F.col("lang")), ("stop words", F.concat(F.lit("the of and in "), F.lit("the")))):
        rows = t.documents.select("doc_id", F.lit(name).alias("input"), text.alias("text"))
        found = topics.with_topic_keywords(topics.model_topics(rows, "text", STOP_WORDS))
        found = found.select("doc_id", "input", "dominant_topic_id", "topic_keywords")
        out = found if out is None else out.unionByName(found)
    return out


def _topic_score(phrases) -> str:
    return " + ".join(f"CAST(bool_or(contains(lower(text), {p!r})) AS INTEGER)" for p in phrases)


@query("i12_cluster_naming_by_lexicon", f"""
    SELECT source, CASE {' '.join(f"WHEN s{i} = best THEN '{name}'" for i, name in enumerate(TOPICS))} END AS cluster_topic_name
    FROM (SELECT *, greatest({', '.join(f's{i}' for i in range(len(TOPICS)))}) AS best FROM (
      SELECT source, {', '.join(f'{_topic_score(p)} AS s{i}' for i, p in enumerate(TOPICS.values()))} FROM documents GROUP BY source))
    WHERE best > 0""")
def i12(t: Tables):
    return narratives.lexicon_names(t.texts(), TOPICS, "source", "text")


@query("i12_modal_topic_names", """
    SELECT narrative_cluster_id, topic_keywords AS cluster_topic_name FROM (
      SELECT narrative_cluster_id, topic_keywords, count(*) AS n FROM v_scored GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY narrative_cluster_id ORDER BY n DESC, topic_keywords) = 1""", V_SCORED)
def i12_modal(t: Tables):
    rows = t.scored().withColumnRenamed("topic_keywords", "dominant_topic_id")
    words = rows.select("dominant_topic_id").distinct().withColumn("topic_keywords", F.col("dominant_topic_id"))
    return modal_names(rows, words)


@query("i13_cluster_naming_fallback", f"""
    SELECT cluster, string_agg(list_aggregate(list_transform(string_split(term, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' '), ' ' ORDER BY rn)
      AS cluster_topic_name
    FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, term DESC) AS rn FROM grams GROUP BY cluster, term)
    WHERE rn <= 3 GROUP BY cluster""", f"""words AS (
      SELECT doc_id, source AS cluster, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
        lambda w: NOT list_contains({SQL_STOPS}, w)) AS w FROM documents)""", """grams AS (
      SELECT cluster, unnest(w) AS term FROM words
      UNION ALL SELECT cluster, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words)""")
def i13(t: Tables):
    rows = t.texts().select(F.col("source").alias("cluster"), "text")
    return narratives.term_names(rows, STOP_WORDS, "cluster", "text")


@query("i14_feature_selection", """
    SELECT video_id, round(growth_acceleration, 6) AS growth_acceleration, round(trend_score, 6) AS trend_score,
      round(toxicity_score, 6) AS toxicity_score, round(pharma_risk_score, 6) AS pharma_risk_score, cluster_volume,
      round(narrative_trend_score, 6) AS narrative_trend_score, sentiment_label, pharma_risk_label, emerging_narrative
    FROM v_scored""", V_SCORED)
def i14(t: Tables):
    rows = t.scored()
    return rounded(rows.select("video_id", *virality.select_features(rows).all))


@query("i15_preprocess", """
    SELECT video_id, round((coalesce(trend, (SELECT quantile_cont(trend, 0.5) FROM holes)) - m) / s, 6) AS trend01,
      CAST(mood = 'negative' AS INTEGER) AS is_negative, CAST(mood = 'neutral' AS INTEGER) AS is_neutral
    FROM (SELECT video_id, trend, coalesce(mood, (SELECT mood FROM holes WHERE mood IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS mood FROM holes),
      (SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT coalesce(trend, (SELECT quantile_cont(trend, 0.5) FROM holes)) AS x FROM holes))""",
       V_SCORED, """holes AS (
      SELECT video_id, CASE WHEN ord % 6 > 0 THEN trend_score END AS trend, CASE WHEN ord % 7 > 0 THEN sentiment_label END AS mood FROM v_scored)""")
def i15(t: Tables):
    rows = t.scored().selectExpr(
        "video_id", "CASE WHEN ord % 6 > 0 THEN trend_score END AS trend_score", "CASE WHEN ord % 7 > 0 THEN sentiment_label END AS sentiment_label"
    )
    stages = virality.preprocessing(rows, virality.Features(("trend_score",), ("sentiment_label",)))
    model = Pipeline(stages=stages).fit(rows)
    names = model.stages[1].labelsArray[0]
    v = vector_to_array("features")
    return model.transform(rows).select(
        "video_id", F.round(v[0], 6).alias("trend01"),
        *[v[1 + names.index(x)].cast("int").alias(f"is_{x}") for x in ("negative", "neutral")],
    )


@query("i16_stratified_split", """
    SELECT viral_label, count(*) AS n, true AS near_share FROM v_scored GROUP BY 1""", V_SCORED)
def i16(t: Tables):
    """Row counts of both sides together, and whether each label keeps its 80 % within one row."""
    fit, held = virality.split(t.scored(), "video_id", "viral_label")
    sides = fit.select("viral_label", F.lit(1).alias("fit")).unionByName(held.select("viral_label", F.lit(0).alias("fit")))
    counted = sides.groupBy("viral_label").agg(F.count("*").alias("n"), F.sum("fit").alias("fit"))
    near = F.abs(F.col("fit") - F.col("n") * 0.8) <= 1.0
    return counted.select("viral_label", "n", near.alias("near_share"))


_TRAINED: dict[tuple[str, str], virality.Training] = {}


def trained(t: Tables) -> virality.Training:
    """The full training (200 trees, depth 6) of these tables, done once in a session, as a stored model would be."""
    key = (t.spark.sparkContext.applicationId, t.dir)
    if key not in _TRAINED:
        _TRAINED[key] = virality.run_training(t.scored())
    return _TRAINED[key]


@query("i17_train_boosted_trees")
def i17(t: Tables):
    return trained(t).metrics


@query("i18_score")
def i18(t: Tables):
    done = trained(t)
    return virality.predict_with_ranges(done.model, t.scored(), done.features).select(
        "video_id", "viral_probability", "predicted_viral", "viral_probability_range"
    )


@query("i19_held_out_predictions")
def i19(t: Tables):
    return trained(t).heldout.select("video_id", "viral_label", "viral_probability", "predicted_viral")


@query("i20_feature_importance")
def i20(t: Tables):
    return trained(t).importance


@query("f4_rank_feature_importance")
def f4(t: Tables):
    return virality.top_importance(trained(t).importance)
