"""The pipeline beside a plain Python version of its stages, and the registered queries."""

import sys
from pathlib import Path

import pytest
from test_decontamination import brute as contaminated
from test_packing import check
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm import exact, packing, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, difference  # noqa: E402


def test_stages_on_the_table(spark, table, sf):
    docs = table("documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    steps = {}
    current = docs
    for name, function in corpus_pipeline.STAGES:
        current = function(spark, current, sf)
        steps[name] = current
        if name != "packing":
            assert current.columns == docs.columns
    kept = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in steps.items()}
    # language ID keeps clean documents
    assert len(kept["language_id"]) >= 0.99 * len(texts)
    # exact copies
    groups = {}
    for d in kept["language_id"]:
        groups.setdefault(exact.normalised(texts[d]), []).append(d)
    one = {min(g, key=lambda d: (-len(texts[d]), d)) for g in groups.values()}
    assert kept["exact_dedup"] == one
    # near copies
    order = sorted(one)
    root = plain_components([plain_fingerprint(texts[d]) for d in order])
    near = {order[i] for i in root}
    assert kept["simhash_dedup"] == near
    # benchmark
    items = {r.item_id: r.text for r in table("benchmark").collect()}
    clean = {d for d in near if not contaminated(texts[d], items)}
    assert kept["decontamination"] == clean
    # packing
    rows = steps["packing"].collect()
    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    check(rows, {d: texts[d] for d in clean}, tokenizer, packing.CAPACITY)
    assert {r.doc_id for r in rows} == clean


def test_run_is_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns[:3] == ["doc_id", "piece", "start"] and rows.count() > 0


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, sf):
    rows = [(1, "the house of the man", "en", None, 3), (1, "the house of the man", "en", None, 3), (None, None, None, None, None),
            (2, "", "fr", "a", 0), (None, "the man and the house of the sea", "en", "b", None), (3, "the sea " * 30_000, None, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, sf)
    assert {r.doc_id for r in docs.collect()} >= {1, None}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_beside_its_sql(spark, sf, name):
    with connect(sf) as con:
        assert difference(queries.QUERIES[name](spark, sf), con, queries.SQL[name]) == ""


@pytest.mark.parametrize("name, columns", [
    ("op1_language_id", "doc_id held_out lang_pred score"), ("op3_pseudo_likelihood", "doc_id n_tokens log_prob"),
    ("op5_pii", "doc_id n_email n_ip n_card n_phone base_sha256 spans"), ("op6_html_text", "page_id url text n_chars"),
    ("op7_simhash_dedup", "doc_id fingerprint component_id"), ("op8_best_fit_packing", "doc_id piece start length ids_crc32 sequence_id offset"),
    ("op9_decontamination", "doc_id item_id similarity"), ("op10_quality", "doc_id held_out score predicted"),
])
def test_query_columns(spark, sf, name, columns):
    wanted = columns.split()
    df = queries.QUERIES[name](spark, sf)
    assert df.columns[:len(wanted)] == wanted and df.count() > 0


def test_registered_in_the_entry():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())
