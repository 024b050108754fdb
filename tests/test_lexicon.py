"""Phrase tables beside ``in``, phrase by phrase."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.operators import lexicon
from tidewatch.operators.lexicon import Trie, phrase_hits, with_phrases
from tidewatch.plans import features

SMALL = st.text(alphabet="ab\0é😀", max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(SMALL.filter(bool), max_size=12, unique=True), st.lists(SMALL, max_size=6))
def test_trie_finds_what_in_finds(phrases, texts):
    padded = pa.array(["left out", *texts], pa.string()).slice(1)
    expected = [sorted(p for p in phrases if p in t) for t in texts]
    assert Trie.of(phrases).found(padded).to_pylist() == expected
    assert Trie.of(phrases).counts(padded).to_pylist() == [len(e) for e in expected]
    with pytest.MonkeyPatch.context() as patch:  # small blocks; only the root in the table
        patch.setattr(lexicon, "_STARTS", 3)
        patch.setattr(lexicon, "_TABLE", 1)
        assert Trie.of(phrases).found(padded).to_pylist() == expected


def test_no_phrase_runs_over_into_the_next_text():
    texts = pa.array(["xxabcd", "efgh", "", "zz", "z", "abcdefgh"])
    assert Trie.of(["abcdefgh", "h", "zz", "zzz"]).found(texts).to_pylist() == [[], ["h"], [], ["zz"], [], ["abcdefgh", "h"]]


@pytest.fixture(scope="module")
def table(spark):
    texts = ["Alarm bells", "bells, alarm; ALARM", "", None, "a", "ünï cödé 😀 bells", "alarm bells" * 2000]
    return spark.createDataFrame(list(enumerate(texts * 3)), "id int, text string").repartition(4)


@pytest.mark.parametrize("most_bytes", [lexicon.MOST_BYTES, 0])
def test_both_forms(spark, table, most_bytes):
    """Sent as a trie or joined: nulls, blanks, repeated texts and phrases, phrases inside phrases."""
    phrases = ["alarm", "al", "bells", "bells", "", None, "😀", "cödé 😀", "m bellsalarm", "nowhere", "alarm bells, then"]
    found = with_phrases(table, "text", spark.createDataFrame([(p,) for p in phrases], "phrase string"), most_bytes=most_bytes)
    assert found.columns == ["id", "text", "phrases"]
    rows = found.collect()
    assert len(rows) == table.count()
    for r in rows:
        assert r["phrases"] == sorted({p for p in phrases if p and p in (r["text"] or "")})


@pytest.mark.parametrize("most_bytes", [lexicon.MOST_BYTES, 0])
def test_empty_lexicon_and_empty_table(spark, table, most_bytes):
    none = spark.createDataFrame([], "phrase string")
    assert {r["hits"] for r in phrase_hits(table, "text", none, most_bytes=most_bytes).collect()} == {0}
    one = spark.createDataFrame([("a",)], "phrase string")
    assert phrase_hits(table.limit(0), "text", one, most_bytes=most_bytes).count() == 0


def test_ten_thousand_phrases_in_one_pass(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    phrases = list({" ".join(rng.choices(words, k=rng.randint(2, 3))) for _ in range(12000)})
    assert len(phrases) > 10_000
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = phrase_hits(df, "text", spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    assert {r["id"]: r["hits"] for r in found.collect()} == {i: sum(p in t for p in phrases) for i, t in enumerate(texts)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(plan) < 5000


def test_risk_lexicon_of_the_feature_stage(spark):
    rows = spark.createDataFrame([("v1", "Fire drill, FIRE!"), ("v2", "calm")], "video_id string, analysis_text_en string")
    phrases = spark.createDataFrame([("Fire",), ("drill",), ("storm",)], "phrase string")
    built = features.build_features(rows, F.lit("2025-01-01").cast("timestamp"), lexicon=phrases)
    assert {r["video_id"]: (r["pharma_risk_score"], r["pharma_risk_label"]) for r in built.collect()} == {
        "v1": (2, "high_risk"), "v2": (0, "low_risk")}
    written = features.build_features(rows, F.lit("2025-01-01").cast("timestamp"), lexicon=phrases, fold_lexicon=False)
    assert {r["video_id"]: r["pharma_risk_score"] for r in written.collect()} == {"v1": 1, "v2": 0}


def test_texts_are_searched_in_slices_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr(lexicon, "_TEXT_BYTES", 10)
    texts = pa.array(["left out", "ab" * 3, "é", "", "ab" * 30, "ab", None, "b", ""], pa.string()).slice(1)
    slices = list(lexicon._slices(texts))
    assert [x for s in slices for x in s.to_pylist()] == texts.to_pylist() and len(slices) > 2
    assert all(len(s) == 1 or sum(len((x or "").encode()) for x in s.to_pylist()) <= 10 for s in slices)
    assert list(lexicon._slices(texts.slice(0, 0))) == []


def test_slices_give_every_text_its_phrases(spark, table):
    """A batch that is searched in several slices: as many rows, in the same places."""
    many = table.select("id", F.repeat(F.coalesce("text", F.lit("")), 40).alias("text")).crossJoin(spark.range(20)).coalesce(1)
    assert many.agg(F.sum(F.octet_length("text"))).first()[0] > 4 * lexicon._TEXT_BYTES
    rows = with_phrases(many, "text", spark.createDataFrame([("alarm",), ("bells",), ("😀",)], "phrase string")).collect()
    assert len(rows) == 420 and all(r["phrases"] == [p for p in ("alarm", "bells", "😀") if p in r["text"]] for r in rows)
