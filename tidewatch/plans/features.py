"""Clean items to feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.constants import RISK_PHRASES
from tidewatch.functions import temporal, text
from tidewatch.functions.numeric import flag, number
from tidewatch.functions.scores import VIRALITY_WEIGHTS, engagement, weighted
from tidewatch.operators.lexicon import phrase_hits
from tidewatch.operators.lookups import new_rows
from tidewatch.operators.quantiles import quantiles_once
from tidewatch.operators.scoring import Scorer, score_emotion, score_sentiment, score_toxicity
from tidewatch.operators.shaping import ensure_columns
from tidewatch.session import stage


def with_publish_features(df: DataFrame, as_of: Column) -> DataFrame:
    df = ensure_columns(df, {"published_at": as_of})
    df = df.withColumn("published_at", temporal.utc(F.col("published_at")))
    return df.withColumns(temporal.publish_features(F.col("published_at"), as_of))


def with_engagement(df: DataFrame) -> DataFrame:
    """Totals and rates; subscribers come from the channel count where there is one."""
    counts = ["view_count", "like_count", "comment_count"]
    df = df.withColumns({c: number(c) if c in df.columns else F.lit(0.0) for c in counts})
    subs = [number(c, None) for c in ("channel_subscriber_count", "subscriber_count") if c in df.columns]
    df = df.withColumn("subscriber_count", F.coalesce(*subs, F.lit(0.0)))
    return df.withColumns(engagement(*[F.col(c) for c in counts], F.col("hours_since_publish")))


def with_content(df: DataFrame) -> DataFrame:
    df = ensure_columns(df, {"analysis_text_en": F.lit("")})
    df = df.withColumn("analysis_text_en", F.coalesce("analysis_text_en", F.lit("")))
    df = df.withColumn("analysis_text_clean", text.normalise(F.col("analysis_text_en")))
    clean = F.col("analysis_text_clean")
    return df.withColumns({
        "text_length": F.length(clean),
        "word_count": text.word_count(clean),
        "emoji_count": text.emoji_runs(clean),
        "question_mark_count": text.occurrences(clean, "?"),
        "exclamation_count": text.occurrences(clean, "!"),
    })


def with_risk(df: DataFrame, source: str = "analysis_text_clean", fold_lexicon: bool = True, lexicon: DataFrame | None = None) -> DataFrame:
    """Risk phrases found in a text column that is in lower case already.

    ``lexicon`` is a table of phrases (column ``phrase``) in place of the built-in ones, of any size.
    """
    if lexicon is None:
        needles = [p.lower() if fold_lexicon else p for p in RISK_PHRASES]
        scored = df.withColumn("pharma_risk_score", text.hits(F.coalesce(source, F.lit("")), needles))
    else:
        phrase = F.lower("phrase") if fold_lexicon else F.col("phrase")
        scored = phrase_hits(df, source, lexicon.select(phrase.alias("phrase")), "pharma_risk_score")
    return scored.withColumn("pharma_risk_label", text.risk_label(F.col("pharma_risk_score")))


def with_virality(df: DataFrame) -> DataFrame:
    return df.withColumn("virality_score", weighted(VIRALITY_WEIGHTS, df.columns))


def with_viral_label(df: DataFrame, q: float = 0.95, scope: DataFrame | None = None) -> DataFrame:
    """1 at or above the quantile of this batch, or of ``scope`` (the whole table) where given."""
    found = quantiles_once(df if scope is None else scope, {"t": (F.col("virality_score"), q)})["t"]
    hit = F.lit(False) if found is None else F.col("virality_score") >= F.lit(found)
    return df.withColumn("viral_label", flag(hit, 1, 0))


def build_features(clean: DataFrame, as_of: Column, done: DataFrame | None = None, sentiment: Scorer | None = None, emotion: Scorer | None = None, toxicity: Scorer | None = None, fold_lexicon: bool = True, max_chars: int | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """All feature columns of the new clean items.

    The scored batch is written once: its label threshold then reads one column, and no text is
    normalised or scored twice.
    ``max_chars`` limits what a scorer sees, for models that take no longer input. ``lexicon`` is a table
    of risk phrases in place of the built-in ones.
    """
    rows = clean if done is None else new_rows(clean, done)
    rows = with_content(with_engagement(with_publish_features(rows, as_of)))
    scorers = ((score_sentiment, sentiment), (score_emotion, emotion), (score_toxicity, toxicity))
    for score, model in scorers:
        rows = score(rows, "analysis_text_clean", model, max_chars)
    rows = with_virality(with_risk(rows, fold_lexicon=fold_lexicon, lexicon=lexicon))
    return with_viral_label(stage(rows, "scored"))
