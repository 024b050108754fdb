"""The registered queries of the training-data operators and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import alignment, decontamination, divergence, exact, html, language, packing, pii, pseudo_lm, quality, secrets, simhash, suffixes
from tidewatch.llm.common import crc_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null id are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(True))
    model = language.fit(docs, ~held_out)
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classify(table(spark, sf_dir, "documents"))


SQL["op2_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST)
"""


@query
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classify(table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null id are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(True))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.classify(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it; clean documents have no row."""
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("__key")


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


SQL["op4_suffix_dedup"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(array_slice(b, p, p + 49)) AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS p FROM d WHERE n >= 50)),
first AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT doc_id, p FROM w JOIN first USING (s) WHERE doc_id > least),
edge AS (SELECT doc_id, p, coalesce(p > lag(p) OVER o + 50, true) AS opens FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
run AS (SELECT doc_id, p, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM run GROUP BY doc_id, k),
total AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM span GROUP BY doc_id),
gap AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS z FROM span
  UNION ALL SELECT d.doc_id, coalesce(max(z), 1), max(n) + 1 FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN z > a THEN hex(array_slice(b, a, z - 1)) ELSE '' END, '' ORDER BY a, z) AS h
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) JOIN kept USING (doc_id)
"""


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.summary(pii.detect(docs, pii.fit(docs)))


@query
def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score(table(spark, sf_dir, "documents"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op11_source_divergence"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item FROM d),
kept AS MATERIALIZED (SELECT lang, item, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, item HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) + sum(n) AS total FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT w.lang, source, item, CAST(count(*) AS HUGEINT) AS n FROM w JOIN kept USING (lang, item) GROUP BY w.lang, source, item),
gt AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(s.n, 0) + coalesce(k.v, 0) AS total FROM g
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k ON k.lang = g.lang),
p AS MATERIALIZED (
  SELECT gt.lang, gt.source, kept.item, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1) // total AS HUGEINT) AS p
  FROM gt JOIN kept ON kept.lang = gt.lang LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.item = kept.item),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
term AS (
  SELECT p.lang, source, p.item, (p - q) * (p - q) // q AS value FROM p
  JOIN (SELECT kept.lang, item, CAST(1 + 1000000000 * (n + 1) // total AS HUGEINT) AS q FROM kept JOIN v ON v.lang = kept.lang) l
    ON l.lang = p.lang AND l.item = p.item WHERE p.n > 0 AND p > q),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a
  JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 200
"""


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.summary(secrets.detect(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.compare(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
