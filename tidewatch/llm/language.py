"""Language ID by nearest centroid.

A text becomes the L2-normalised TF-IDF vector of its hashed character n-grams (letters in lower
case, everything else one blank). Each language has several centroids, found by spherical k-means;
a text gets the language of the centroid with the largest cosine. A text whose cosine stays under
the rejection limit of that language at the text's length is rejected: cosines grow with the length, so
limits are learnt from random pieces of the training texts, of each length in ``LENGTHS``.

Document frequencies are counted over all training texts. Centroids are fitted on at most
``per_language`` texts of each language, those with the smallest hash of their id (the documented
bound of the sample).

Null texts and texts without a letter get ``und``, score 0, rejected. Ties go to the language first
in order. An empty training set gives ``und`` for every row. Repeated rows are each predicted; other
columns of the input are never read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks, first_schema

DIMS = 1 << 13
ORDERS = (1, 2, 3, 4)
BLOCK_BYTES = 1 << 18
BLOCK_ROWS = 64  # a row takes DIMS numbers
UNDETERMINED = "und"
LENGTHS = (1, *(1 << k for k in range(3, 14)))  # limits lie on a line (in the logarithm) between these
PIECES = 200


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    owners: np.ndarray  # language of each centroid
    centroids: np.ndarray  # centroid x dimension, unit length
    limits: np.ndarray  # language x length, rejection limit
    idf: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a blank."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    points = [p for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p))[0] == "L"]
    table[points] = points
    return table


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts (document x dimension) and whether each text has a letter."""
    # A blank between words and two between texts, so that no n-gram of interest crosses texts.
    points = [np.frombuffer(f"  {(t or '').lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    lengths = np.array([len(p) for p in points])
    owner = np.repeat(np.arange(len(texts)), lengths)
    chars = _letters()[np.concatenate(points)]
    blank = chars == 32
    has_letter = np.bincount(owner[~blank], minlength=len(texts)) > 0
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank after a word
    chars, owner = chars[keep].astype(np.uint64), owner[keep]
    out = np.zeros(len(texts) * DIMS, np.float32)
    key = np.zeros(len(chars), np.uint64)
    for order in ORDERS:
        size = len(chars) - order + 1
        if size <= 0:
            break
        key = key[:size] * np.uint64(0x9E3779B97F4A7C15) + chars[order - 1:] + np.uint64(1)
        slot = ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 13)).astype(np.int64)
        same = owner[:size] == owner[order - 1:]
        out += np.bincount((owner[:size] * DIMS + slot)[same], minlength=len(out))
    return out.reshape(len(texts), DIMS), has_letter


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts each dimension occurs; dimension -1 counts the texts."""
    seen, n = np.zeros(DIMS, np.int64), 0
    for block in blocks(batches, "text", BLOCK_BYTES, BLOCK_ROWS):
        tf, letters = counts(block.column("text").to_pylist())
        seen += (tf > 0).sum(axis=0)
        n += int(letters.sum())
    dims = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"dim": np.append(dims, -1).astype(np.int32), "n": np.append(seen[dims], n)})


def _cluster(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest row, then the rows farthest from those chosen."""
    mean = v.mean(axis=0)
    chosen = [int(np.argmax(v @ mean))]
    nearest = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, v @ v[chosen[-1]])
    centroids = v[chosen]
    for _ in range(rounds):
        label = np.argmax(v @ centroids.T, axis=1)
        sums = np.stack([v[label == i].sum(axis=0) if (label == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def _size(tf: np.ndarray) -> np.ndarray:
    """About the number of characters that count."""
    return np.maximum(tf.sum(axis=1) / len(ORDERS), 1)


def _medians(texts: list[str], centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Median cosine by length, from random pieces of the texts; 0 at one character."""
    rng = np.random.default_rng(0)
    sizes, medians = [0.0], [0.0]
    for n in LENGTHS[1:]:
        long = [t for t in texts if len(t) >= n][:PIECES]
        if not long and len(medians) == 1:  # only texts shorter than the shortest piece
            long = texts[:PIECES]
        cut = [t[a:a + n] for t in long for a in rng.integers(0, max(len(t) - n, 0) + 1, 1)]
        found = [counts([t]) for t in cut]
        tf = np.concatenate([x for x, letter in found if letter[0]] or [np.zeros((0, DIMS), np.float32)])
        if len(tf):
            sizes.append(float(np.log2(np.median(_size(tf)))))
            medians.append(float(np.median((vectors(tf, idf) @ centroids.T).max(axis=1))))
    return np.interp(np.log2(LENGTHS), sizes, medians)


def fit(
    docs: DataFrame, use: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 600, clusters: int = 4, rounds: int = 8, fraction: float = 0.5,
) -> Model:
    """Learn from the rows where ``use`` holds and neither text nor language is null.

    The rejection limit of a language at a length is ``fraction`` times the median cosine of its sample's pieces of
    that length; the median, as samples hold junk. Beyond the longest pieces it stays.
    """
    spark = docs.sparkSession
    rows = docs if use is None else docs.where(use)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    found = rows.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    total = int(found.n[found.dim < 0].sum())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not total:
        return Model((), np.zeros(0, int), np.zeros((0, DIMS)), np.zeros((0, len(LENGTHS))), np.ones(DIMS, np.float32))
    df = np.zeros(DIMS)
    df[found.dim[found.dim >= 0]] = found.n[found.dim >= 0]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    rank = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.3 * (per_language + 20) / n)).otherwise(share)
    sample = rows.withColumn("rank", rank).where(F.shiftrightunsigned("rank", 11) / F.lit(2.0**53) < share)
    shared = spark.sparkContext.broadcast(idf)  # DIMS numbers

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "text"])[:per_language]
        tf, letters = zip(*(counts([t]) for t in part.text), strict=True)
        v = vectors(np.concatenate(tf), shared.value)[np.concatenate(letters)]
        if not len(v):
            return pd.DataFrame({"lang": [], "low": [], "vector": []}).astype({"lang": object, "low": object, "vector": object})
        c = _cluster(v, clusters, rounds)
        low = fraction * _medians([t for t, x in zip(part.text, letters, strict=True) if x[0]], c, shared.value)
        return pd.DataFrame({"lang": part.lang.iloc[0], "low": [low.tolist()] * len(c), "vector": [x.astype(float).tolist() for x in c]})

    fitted = sample.groupBy("lang").applyInPandas(centroids, "lang string, low array<double>, vector array<double>").collect()
    fitted.sort(key=lambda r: (r.lang, r.vector))  # at most `clusters` rows a language
    languages = tuple(sorted({r.lang for r in fitted}))
    owners = np.array([languages.index(r.lang) for r in fitted], int)
    low = np.array([next(r.low for r in fitted if r.lang == x) for x in languages]).reshape(-1, len(LENGTHS))
    return Model(languages, owners, np.array([r.vector for r in fitted], np.float32).reshape(-1, DIMS), low, idf)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of each text."""
    tf, letters = counts(texts)
    if not len(model.owners):
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    cosine = vectors(tf, model.idf) @ model.centroids.T
    best = np.argmax(cosine, axis=1)
    score = np.where(letters, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0).astype(float)
    owner = model.owners[best]
    size, limit = np.log2(_size(tf)), np.zeros(len(texts))
    for o in np.unique(owner):
        limit[owner == o] = np.interp(size[owner == o], np.log2(LENGTHS), model.limits[o])
    rejected = ~letters | (score < limit)
    return [model.languages[o] if x else UNDETERMINED for o, x in zip(owner, letters, strict=True)], score, rejected


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, ``keep`` columns, ``lang_pred``, ``score``, ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text", BLOCK_BYTES, BLOCK_ROWS):
            lang, score, rejected = predict(block.column("__text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [block.column(n) for n in names] + [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=[*names, "lang_pred", "score", "rejected"],
            )

    schema = first_schema(docs, *names) + ", lang_pred string, score double, rejected boolean"
    return docs.select(*[F.col(n) for n in names], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col, BLOCK_BYTES, BLOCK_ROWS):
            rejected = predict(block.column(text_col).to_pylist(), shared.value)[2]
            yield block.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
