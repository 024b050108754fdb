"""Quality classifier from supervised subword embeddings.

A document is a bag of its words, of pairs of near words and of the n-grams of its bytes, each hashed into a table of learned
vectors. Their average goes through a softmax layer. Table and layer are trained together by stochastic
gradient descent (numpy, Adagrad steps) on at most ``sample`` labelled documents, those with the smallest
hash of their id; that bound is the only one, and every document is scored over its whole text. Case and
marks stay in the features.

As the average is linear, scoring adds up per-feature logits. Null and empty texts have no features and
get the softmax of the biases. Labels that are null are skipped; an id labelled twice counts twice; without
any usable label all scores are 0.5. Repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks, first_schema

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
DIM = 8
ORDERS = (2, 3, 4)
WORD_GAPS = (1, 2)
STEPS = 1500
BLOCK_BYTES = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.uint64(0xD6E8FEB86659FD93) ** np.arange(1, 65, dtype=np.uint64)


@dataclass(frozen=True)
class Model:
    """Logit difference (class 1 against 0) of each feature, and of the biases."""

    weights: np.ndarray
    bias: float


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word and n-gram, repeats included."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    lengths = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), lengths)
    docs, slots = [], []

    def add(own: np.ndarray, key: np.ndarray, kind: int) -> None:
        docs.append(own)
        slots.append((((key ^ np.uint64(kind)) * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))

    wide = data.astype(np.uint64) + np.uint64(1)
    key = wide
    for order in range(2, max(ORDERS) + 1):
        if len(data) < order:
            break
        key = key[:-1] * np.uint64(257) + wide[order - 1:]
        if order in ORDERS:
            same = owner[:len(key)] == owner[order - 1:]
            add(owner[:len(key)][same], key[same], order)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(first)
    if len(starts):
        begin = np.zeros(len(data), np.int64)
        begin[starts] = starts
        place = np.arange(len(data)) - np.maximum.accumulate(begin)
        terms = np.where(inside, wide * _POWERS[place % 64], np.uint64(0))
        words, own = np.add.reduceat(terms, starts), owner[starts]
        add(own, words, 1)
        for gap in WORD_GAPS:  # exclusive or: a word met again gives one and the same key, whatever the word
            same = own[gap:] == own[:-gap]
            add(own[gap:][same], (words[gap:] ^ words[:-gap])[same], 16 + gap)
    return (np.concatenate(docs), np.concatenate(slots)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A document's buckets and their shares."""
    slots, n = np.unique(features([text])[1], return_counts=True)
    return slots, (n / max(n.sum(), 1)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, *, steps: int = STEPS, batch: int = 32, rate: float = 0.05, seed: int = 11) -> Model:
    """Feature vectors, layer and biases by SGD on the cross entropy."""
    bags = [_bag(t) for t in texts]
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.uniform(-1 / DIM, 1 / DIM, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    params = [table, layer, bias]
    memory = [np.full_like(p, 1e-6) for p in params]
    order = np.concatenate([rng.permutation(len(texts)) for _ in range(-(-steps * batch // len(texts)))])
    for at in range(0, steps * batch, batch):
        rows = order[at:at + batch]
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, row in enumerate(rows):
            x[i, bags[row][0]] = bags[row][1]
        hidden = x @ table
        logits = hidden @ layer + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), labels[rows]] -= 1
        p /= len(rows)
        grads = [x.T @ (p @ layer.T), hidden.T @ p, p.sum(axis=0)]
        for value, seen, g in zip(params, memory, grads, strict=True):
            seen += g * g
            value -= rate * g / np.sqrt(seen)
    difference = layer[:, 1] - layer[:, 0]
    return Model(table @ difference, float(bias[1] - bias[0]))


def fit(
    docs: DataFrame, labels: DataFrame, use: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample: int = 6000,
) -> Model:
    """Learn from the labels where ``use`` (over the label rows) holds."""
    known = labels if use is None else labels.where(use)
    known = known.select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("int").alias("__label")).dropna()
    rank = F.xxhash64(F.col("__id").cast("string"), F.lit("sample"))
    n = known.count()
    if not n:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    share = min(1.0, 1.2 * (sample + 50) / n)
    drawn = known.withColumn("__rank", rank).where(F.shiftrightunsigned("__rank", 11) / F.lit(2.0**53) < share)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "__id")  # the sample: at most about 1.2 x `sample` rows

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__rank", "text", "__label"])[:sample]
        model = train(part.text.tolist(), part["__label"].to_numpy(np.int64))
        return pd.DataFrame({"bias": [model.bias], "weights": [model.weights.astype(float).tolist()]})

    found = rows.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(learn, "bias double, weights array<double>").collect()
    if not found:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.array(found[0].weights, np.float32), found[0].bias)


def score(texts: list[str | None], model: Model) -> np.ndarray:
    docs, slots = features(texts)
    total = np.bincount(docs, weights=model.weights[slots], minlength=len(texts))
    n = np.bincount(docs, minlength=len(texts))
    return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + model.bias)))


def classify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, ``keep`` columns and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text", BLOCK_BYTES):
            values = score(block.column("__text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([block.column(n) for n in names] + [pa.array(values)], names=[*names, "score"])

    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, first_schema(docs, *names) + ", score double")
