"""Text scoring and translation through pluggable functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.labels import SENTIMENT_CLASSES, decode_label, top_label
from tidewatch.functions.text import chunks, hits, strip

Scorer = Callable[[list[str]], list[Mapping[str, float]]]
Translator = Callable[[list[str]], list[str]]

# Words of the built-in scorers, used where no model function is given.
SENTIMENT_WORDS = {
    "negative": ["bad", "worse", "pain", "awful", "terrible", "fail", "angry", "risk"],
    "neutral": [],
    "positive": ["good", "great", "better", "love", "excellent", "happy", "relief", "thank"],
}
EMOTION_WORDS = {
    "anger": ["angry", "furious", "outrage"], "disgust": ["disgust", "gross"],
    "fear": ["afraid", "scared", "worried"], "joy": ["happy", "joy", "love"], "neutral": [],
    "sadness": ["sad", "cry", "grief"], "surprise": ["surprise", "sudden", "unexpected"],
}
TOXICITY_WORDS = {
    "toxicity": ["stupid", "hate", "trash"], "severe_toxicity": ["die in"], "obscene": ["damn"],
    "threat": ["kill", "hurt you"], "insult": ["idiot", "moron"], "identity_attack": ["vermin"],
}
NON_TOXIC_BELOW = 0.5


def score_lexicon(df: DataFrame, text: str, prefix: str, lexicon: Mapping[str, Sequence[str]], resting: str | None = None, floor: float | None = None, floor_label: str = "", max_chars: int | None = None) -> DataFrame:
    """Add ``<prefix>_label`` and ``<prefix>_score``: each label's share of the found phrases.

    With nothing found the ``resting`` label has score 1. The text is lowered once and each
    phrase looked for once; only the hit counts are used after that.
    """
    names = list(lexicon)
    counted = df.withColumn("_low", F.lower(_input(text, max_chars))).withColumn(
        "_hits", F.array(*[hits(F.col("_low"), lexicon[n]) for n in names])
    )
    total = F.aggregate("_hits", F.lit(0), lambda a, x: a + x)
    shared = counted.withColumn("_total", total)
    idle = F.create_map(*[F.lit(x) for n in names for x in (n, 1.0 if n == resting else 0.0)])
    share = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.transform("_hits", lambda h: F.try_divide(h.cast("double"), F.col("_total")))
    )
    scores = F.when(F.col("_total") > 0, share).otherwise(idle)
    return score_text(shared, prefix, scores, names, floor, floor_label).drop("_low", "_hits", "_total")


def scorer_udf(scorer: Scorer):
    """Arrow-batched column function around ``scorer``; a text it cannot score gives NULL.

    A batch that raises is retried text by text, so one bad text costs only itself.
    """
    @F.pandas_udf("map<string,double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str):
            try:
                return dict(scorer([text])[0])
            except Exception:
                return None

        for texts in batches:
            values = texts.fillna("").tolist()
            try:
                found = [dict(x) for x in scorer(values)]
            except Exception:
                found = [one(t) for t in values]
            yield pd.Series(found, dtype="object")

    return apply


def score_text(df: DataFrame, prefix: str, scores: Column, order: Sequence[str], floor: float | None = None, floor_label: str = "", decode: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``<prefix>_label`` and ``<prefix>_score`` from a label -> score map column."""
    best = df.withColumn("_m", scores).withColumn("_b", top_label(F.col("_m"), order, floor, floor_label))
    label = decode_label(F.col("_b.label"), dict(decode)) if decode else F.col("_b.label")
    return best.withColumns({f"{prefix}_label": label, f"{prefix}_score": F.col("_b.score")}).drop("_m", "_b")


def _input(text: str, max_chars: int | None) -> Column:
    """The text given to a scorer: whole, unless the model takes only its first characters."""
    c = F.coalesce(F.col(text), F.lit(""))
    return c if max_chars is None else F.substring(c, 1, max_chars)


def score_sentiment(df: DataFrame, text: str, scorer: Scorer | None = None, max_chars: int | None = None) -> DataFrame:
    if scorer is None:
        return score_lexicon(df, text, "sentiment", SENTIMENT_WORDS, "neutral", max_chars=max_chars)
    raw = scorer_udf(scorer)(_input(text, max_chars))
    order = list(SENTIMENT_CLASSES) + list(SENTIMENT_CLASSES.values())
    return score_text(df, "sentiment", raw, order, decode=SENTIMENT_CLASSES)


def score_emotion(df: DataFrame, text: str, scorer: Scorer | None = None, max_chars: int | None = None) -> DataFrame:
    if scorer is None:
        return score_lexicon(df, text, "emotion", EMOTION_WORDS, "neutral", max_chars=max_chars)
    return score_text(df, "emotion", scorer_udf(scorer)(_input(text, max_chars)), list(EMOTION_WORDS))


def score_toxicity(df: DataFrame, text: str, scorer: Scorer | None = None, max_chars: int | None = None) -> DataFrame:
    below = (NON_TOXIC_BELOW, "non_toxic")
    if scorer is None:
        return score_lexicon(df, text, "toxicity", TOXICITY_WORDS, None, *below, max_chars)
    return score_text(df, "toxicity", scorer_udf(scorer)(_input(text, max_chars)), list(TOXICITY_WORDS), *below)


def translate_column(df: DataFrame, column: str, out: str, translator: Translator | None = None) -> DataFrame:
    """``out`` is the translation of the trimmed ``column``; blanks give "".

    Each distinct text is translated once, in chunks joined by line breaks; a chunk the
    translator cannot handle keeps its original. Texts are matched by digest, so the text
    itself is shuffled once.
    """
    source = strip(F.coalesce(F.col(column), F.lit("")))
    if translator is None:
        return df.withColumn(out, source)

    # Blank rows get keys that match nothing and differ between rows, so they do not meet in one task.
    blank = F.concat(F.lit("-"), F.xxhash64(*df.columns).cast("string"))
    keyed = df.withColumn("_src", source).withColumn(
        "_key", F.when(F.col("_src") != "", F.sha2("_src", 256)).otherwise(blank)
    )
    texts = keyed.where("_src <> ''").groupBy("_key").agg(F.any_value("_src").alias("_src"))
    pieces = texts.select("_key", F.posexplode(chunks(F.col("_src"))).alias("_i", "_part"))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str) -> str:
            try:
                done = translator([text])[0]
                return done.strip() if isinstance(done, str) and done.strip() else text
            except Exception:
                return text

        for parts in batches:
            values = parts.tolist()
            try:
                found = list(translator(values))
                if len(found) != len(values):
                    raise ValueError("one translation per text is needed")
                yield pd.Series([d.strip() if isinstance(d, str) and d.strip() else v for d, v in zip(found, values)], dtype="object")
            except Exception:  # the translator's own faults: only the texts it cannot handle keep their original
                yield pd.Series([one(v) for v in values], dtype="object")

    done = pieces.select("_key", "_i", run("_part").alias("_part"))
    whole = done.groupBy("_key").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_part"))), lambda x: x["_part"]), "\n"
    ).alias("_out"))
    joined = keyed.join(whole, "_key", "left")
    return joined.withColumn(out, F.coalesce("_out", F.lit(""))).drop("_src", "_key", "_out")
