"""Cluster names, nearest-neighbour scores and narrative trends."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.scores import NARRATIVE_WEIGHTS, weighted
from tidewatch.operators.lookups import with_group_size
from tidewatch.operators.quantiles import quantiles_once

NEIGHBOUR_ROWS = 1000
CELL_ROWS = 256
MOST_CELLS = 1 << 14
PROBES = 6
CELL_LIMIT = 4096
FAN_OUT = 256
SPLIT_PROBES = 3
LEVELS = 4
MOST_CROWDED = 1_000_000
ONE_FROM = 0.99996  # rounds to 1
NO_COSINE = -2.0
_MASK_BITS = 60
TOKEN = r"[\p{L}\p{N}_]{2,}"


def topic_table(spark: SparkSession, topics: Mapping[str, Sequence[str]]) -> DataFrame:
    """(topic, place, phrase) rows of an ordered topic -> phrases mapping."""
    rows = [(t, i, p) for i, (t, phrases) in enumerate(topics.items()) for p in phrases]
    return spark.createDataFrame(rows, "topic string, place int, phrase string")


def read_topics(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Topic mapping from a (topic, place, phrase) CSV or Parquet lexicon."""
    table = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    out: dict[str, list[str]] = {}
    for row in table.orderBy(F.col("place").cast("int"), "phrase").collect():
        out.setdefault(row["topic"], []).append(row["phrase"])
    return out


def _phrase_hit(text: Column, phrase: str, word_boundary: bool) -> Column:
    if word_boundary:
        return F.regexp_like(text, F.lit(rf"(?U)\b\Q{phrase}\E\b"))
    return F.contains(text, F.lit(phrase))


def lexicon_names(df: DataFrame, topics: Mapping[str, Sequence[str]], cluster: str = "narrative_cluster_id", text: str = "analysis_text_clean", word_boundary: bool = False) -> DataFrame:
    """(cluster, cluster_topic_name): the topic with most phrases found in the cluster's texts.

    Ties go to the topic listed first. Each row becomes one bit mask of found phrases per topic,
    and masks combine on the map side, so texts are never shuffled or joined together.
    """
    lowered = df.select(cluster, F.lower(F.coalesce(text, F.lit(""))).alias("_t"))
    masks, scores = {}, []
    for place, (topic, phrases) in enumerate(topics.items()):
        found = F.lit(0)
        for start in range(0, len(phrases), _MASK_BITS):
            bits = [
                F.when(_phrase_hit(F.col("_t"), p, word_boundary), F.lit(1 << i)).otherwise(F.lit(0))
                for i, p in enumerate(phrases[start:start + _MASK_BITS])
            ]
            name = f"_m{place}_{start}"
            masks[name] = sum(bits[1:], bits[0]).cast("bigint")
            found = found + F.bit_count(name)
        scores.append(F.struct(found.alias("score"), F.lit(-place).alias("rank"), F.lit(topic).alias("topic")))
    flagged = lowered.select(cluster, *[m.alias(n) for n, m in masks.items()])
    per_cluster = flagged.groupBy(cluster).agg(*[F.bit_or(n).alias(n) for n in masks])
    best = F.array_max(F.array(*scores))
    return per_cluster.select(cluster, best.alias("_b")).where("_b.score > 0").select(
        cluster, F.col("_b.topic").alias("cluster_topic_name")
    )


def tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-cased words of two or more characters, stop words removed, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def grams(words: Column) -> Column:
    """Single words, then neighbouring pairs."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def term_names(df: DataFrame, stop_words: Sequence[str], cluster: str = "narrative_cluster_id", text: str = "analysis_text_clean", n: int = 3) -> DataFrame:
    """(cluster, cluster_topic_name) from the ``n`` most frequent words and word pairs, title-cased.

    Equal counts put the later term first. Clusters without any term are called ``Cluster <id>``.
    """
    # A column of its own, as the pairs use the words several times and would look for them in the text each time.
    words = df.select(cluster, tokens(F.col(text), stop_words).alias("_w"))
    terms = words.select(cluster, F.explode_outer(grams(F.col("_w"))).alias("term"))
    counts = terms.groupBy(cluster, "term").agg(F.count("*").alias("n"))
    order = [F.col("term").isNull().asc(), F.desc("n"), F.desc("term")]
    w = Window.partitionBy(cluster).orderBy(*order)
    ranked = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    ranked = ranked.where("term is not null or _rn = 1")
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_rn", "term"))), lambda x: F.initcap(x["term"])
    ), " ")
    named = ranked.groupBy(cluster).agg(joined.alias("_name"))
    fallback = F.concat(F.lit("Cluster "), F.col(cluster).cast("string"))
    return named.select(
        cluster, F.when(F.col("_name") != "", F.col("_name")).otherwise(fallback).alias("cluster_topic_name")
    )


def cluster_names(df: DataFrame, topics: Mapping[str, Sequence[str]], stop_words: Sequence[str], cluster: str = "narrative_cluster_id", text: str = "analysis_text_clean") -> DataFrame:
    """Lexicon name where a topic matched, else the term name."""
    by_topic = lexicon_names(df, topics, cluster, text)
    unnamed = df.join(F.broadcast(by_topic.select(cluster)), cluster, "left_anti")
    return by_topic.unionByName(term_names(unnamed, stop_words, cluster, text))


def neighbour_scores(df: DataFrame, order: str, vector: str, rows: int = NEIGHBOUR_ROWS, out: str = "narrative_similarity_score", source: DataFrame | None = None) -> DataFrame:
    """Highest cosine of each of the first ``rows`` unit vectors to another of them.

    Later rows get 0: the parity form of the measure; ``all_neighbour_scores`` is the one for all rows. The comparison set is at most
    ``rows`` vectors whatever the table size: it goes to the tasks as one matrix, each
    Arrow batch is one matrix product, and only those rows pass through Python. ``source`` is
    the table to take the vectors from, where ``df`` has them only after further steps.
    """
    source = df if source is None else source
    first = source.select(order, vector).orderBy(order).limit(rows).collect()
    if len(first) < 2:
        return df.withColumn(out, F.lit(0.0))
    ids = [r[order] for r in first]
    matrix = np.array([r[vector] for r in first], dtype=np.float64)
    held = df.sparkSession.sparkContext.broadcast((ids, matrix))

    @F.pandas_udf("double")
    def nearest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, vectors = held.value
        place = {k: i for i, k in enumerate(known)}
        for keys, values in batches:
            if not len(keys):
                yield pd.Series([], dtype="float64")
                continue
            cosine = np.stack(values.to_numpy()).astype(np.float64) @ vectors.T
            cosine[np.arange(len(keys)), keys.map(place).to_numpy()] = -np.inf
            yield pd.Series(np.round(cosine.max(axis=1), 4))

    sampled = source.where(F.col(order) <= F.lit(ids[-1])).select(order, vector)
    scores = sampled.select(order, nearest(order, vector).alias(out))
    joined = df.join(F.broadcast(scores), order, "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(0.0)))


def _directions(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit directions of the centres as seen from their mean, and the mean's part in each.

    Vectors with much in common have centres that are near to all of them; from the mean they differ.
    """
    mean = centres.mean(axis=0)
    apart = centres - mean
    length = np.linalg.norm(apart, axis=1, keepdims=True)
    unit = apart / np.where(length == 0, 1, length)
    return unit, unit @ mean


def _nearest(vectors: np.ndarray, directions: tuple[np.ndarray, np.ndarray], probes: int) -> np.ndarray:
    """Places of the ``probes`` centres nearest in direction, one line per vector."""
    unit, offset = directions
    n = min(probes, len(unit))
    return np.argpartition(offset - vectors @ unit.T, n - 1, axis=1)[:, :n]


def _first_cells(distinct: DataFrame, total: int, probes: int) -> DataFrame:
    """Rows in the cells of their nearest centres; the centres are broadcast, at most ``MOST_CELLS``."""
    picked = distinct.orderBy("_vec").limit(max(1, min(MOST_CELLS, total // CELL_ROWS))).select("_v").collect()
    held = distinct.sparkSession.sparkContext.broadcast(_directions(np.array([r["_v"] for r in picked], dtype=np.float32)))

    @F.pandas_udf("array<long>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            near = _nearest(np.stack(values.to_numpy()).astype(np.float32), held.value, probes) if len(values) else []
            yield pd.Series(list(near), dtype="object")

    return distinct.select("_vec", "_v", F.explode(cells("_v")).alias("_cell"))


def _dealt_out(limit: int) -> Column:
    """Chunk of a row of a cell of ``_n`` rows: a hash, so a chunk holds about half of ``limit``."""
    return F.pmod("_vec", F.ceil(F.col("_n") * 2 / limit))


def _split_cells(crowded: DataFrame, level: int, probes: int, limit: int) -> DataFrame:
    """Rows of crowded cells in the smaller cells of up to ``FAN_OUT`` members each.

    A cell's members meet its new centres chunk by chunk, so a task holds one chunk and the centres
    whatever the size of the cell.
    """
    wide = 1 << 30
    chunks = F.ceil(F.col("_n") * 2 / limit)
    rate = F.least(F.lit(1 / CELL_ROWS), F.lit(FAN_OUT) / F.col("_n"))
    members = crowded.withColumn("_chunk", _dealt_out(limit)).select("_cell", "_chunk", "_vec", "_v")
    centres = crowded.where(F.pmod(F.xxhash64("_vec", F.lit(level)), F.lit(wide)) < rate * wide).select(
        F.col("_cell").alias("_of"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("_part"),
        F.col("_vec").alias("_id"), F.col("_v").alias("_c"))

    def assign(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"_vec": [], "_v": [], "_at": [], "_id": []})
        if not len(near):  # no member was drawn: the chunk is a cell
            return pd.DataFrame({"_vec": rows["_vec"], "_v": rows["_v"], "_at": rows["_cell"], "_id": rows["_chunk"]})
        directions = _directions(np.stack(near["_c"].to_numpy()).astype(np.float32))
        picked = _nearest(np.stack(rows["_v"].to_numpy()).astype(np.float32), directions, probes)
        again = np.repeat(np.arange(len(rows)), picked.shape[1])
        return pd.DataFrame({
            "_vec": rows["_vec"].to_numpy()[again], "_v": rows["_v"].to_numpy()[again],
            "_at": rows["_cell"].to_numpy()[again], "_id": near["_id"].to_numpy()[picked.ravel()],
        })

    kind = crowded.schema["_v"].dataType.simpleString()
    met = members.groupBy("_cell", "_chunk").cogroup(centres.groupBy("_of", "_part"))
    placed = met.applyInPandas(assign, f"_vec long, _v {kind}, _at long, _id long")
    return placed.select("_vec", "_v", F.xxhash64("_at", "_id", F.lit(level)).alias("_cell"))


def neighbour_cells(distinct: DataFrame, total: int, probes: int = PROBES, limit: int = CELL_LIMIT) -> DataFrame:
    """(_vec, _v, _cell) rows of distinct vectors, every cell of at most about ``limit`` rows.

    Cells above the limit are split by centres of their own, level by level. What ``LEVELS`` splits leave
    above it (vectors too much alike for centres to part) is dealt out by hash. Near vectors that share no
    cell are found by ``closer_in_blocks``.
    """
    from tidewatch.session import stage

    if total <= limit:
        return distinct.select("_vec", "_v", F.lit(0).cast("long").alias("_cell"))
    kept, rows = [], stage(_first_cells(distinct, total, probes), "cells")
    for level in range(1, LEVELS + 1):
        crowded = stage(rows.groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > limit), "crowded")
        n = crowded.count()
        if not n:
            return reduce(DataFrame.unionByName, kept, rows)
        found = F.broadcast(crowded) if n <= MOST_CROWDED else crowded
        kept.append(rows.join(found, "_cell", "left_anti").select("_vec", "_v", "_cell"))
        inside = rows.join(found, "_cell")
        if level < LEVELS:
            rows = stage(_split_cells(inside, level, SPLIT_PROBES, limit), "cells")
        else:
            rows = inside.select("_vec", "_v", F.xxhash64("_cell", _dealt_out(limit)).alias("_cell"))
    return reduce(DataFrame.unionByName, kept, rows)


def _packed(distinct: DataFrame, total: int, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors, a row each, with the best cosine known for each vector."""
    kind = np.float64 if "double" in distinct.schema["_v"].dataType.simpleString() else np.float32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            while len(batch):
                part, batch = batch.slice(0, rows - held), batch.slice(rows - held)
                waiting, held = [*waiting, part], held + len(part)
                if held == rows:
                    yield one(waiting)
                    waiting, held = [], 0
        if held:
            yield one(waiting)

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        vectors = table["_v"].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(kind)
        known = table["_best"].to_numpy().astype(np.float64)
        return pa.RecordBatch.from_pydict({"ids": [table["_vec"].to_numpy().astype(np.int64).tobytes()], "vectors": [vectors.tobytes()], "known": [known.tobytes()]})

    # A little more blocks than needed, as the rows are not dealt out quite evenly.
    dealt = distinct.select("_vec", "_v", "_best").repartition(1 + total * 11 // (rows * 10))
    return dealt.mapInArrow(pack, "ids binary, vectors binary, known binary").withColumn("block", F.monotonically_increasing_id())


def closer_in_blocks(distinct: DataFrame, total: int, rows: int = CELL_LIMIT) -> DataFrame:
    """(_vec, _best) of the unit vectors of (_vec, _v, _best) that have a higher cosine to another one than ``_best``, over all pairs.

    Every block of ``rows`` vectors meets every other one in a task that holds two of them, whatever the table size; blocks are read anew,
    never shuffled. A product in single precision tells which vectors may have a closer one there: those within its rounding of the
    cosine known or above. These are compared in double precision. Known cosines that round to 1 can't be raised.
    """
    from tidewatch.session import one_a_batch, stage

    blocks = stage(_packed(distinct, total, rows), "blocks")
    kind = np.float64 if "double" in distinct.schema["_v"].dataType.simpleString() else np.float32

    def closer(vectors: np.ndarray, known: np.ndarray, single: np.ndarray, others: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors that have a closer one among the others, and its cosine; ``single`` has the highest ones in single precision."""
        error = (vectors.shape[1] + 2) * 2.0 ** -23
        likely = np.flatnonzero((single > known - error) & (known < ONE_FROM))
        found, wide = np.empty(len(likely)), others.T.astype(np.float64) if len(likely) else others.T
        for at in range(0, len(likely), 1024):
            some = likely[at:at + 1024]
            cosine = vectors[some].astype(np.float64) @ wide
            if same:
                cosine[np.arange(len(some)), some] = NO_COSINE
            found[at:at + 1024] = cosine.max(axis=1)
        raised = found > known[likely]
        return likely[raised], found[raised]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            same = row["block"] == row["other_block"]
            ids, other_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["other_ids"], np.int64)
            left = np.frombuffer(row["vectors"], kind).reshape(len(ids), -1)
            right = np.frombuffer(row["other_vectors"], kind).reshape(len(other_ids), -1)
            first, second, narrow = np.empty(len(ids)), np.full(len(other_ids), NO_COSINE), right.T.astype(np.float32)
            for at in range(0, len(ids), 1024):
                cosine = left[at:at + 1024].astype(np.float32) @ narrow
                if same:
                    cosine[np.arange(len(cosine)), np.arange(at, at + len(cosine))] = NO_COSINE
                else:
                    second = np.maximum(second, cosine.max(axis=0))
                first[at:at + 1024] = cosine.max(axis=1)
            place, best = closer(left, np.frombuffer(row["known"]), first, right, same)
            place2, best2 = closer(right, np.frombuffer(row["other_known"]), second, left, False) if not same else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_pydict({"_vec": np.concatenate([ids[place], other_ids[place2]]), "_best": np.concatenate([best, best2])})

    others = blocks.select(*[F.col(c).alias(f"other_{c}") for c in blocks.columns])
    pairs = blocks.join(others, F.col("block") <= F.col("other_block"))
    with one_a_batch(distinct.sparkSession):
        return stage(pairs.mapInArrow(compare, "_vec long, _best double"), "closer")


def all_neighbour_scores(df: DataFrame, vector: str, out: str = "narrative_similarity_score", probes: int = PROBES, limit: int = CELL_LIMIT) -> DataFrame:
    """Highest cosine of each unit vector to any other row's, over all rows: exact.

    Vectors that occur more than once get 1 from a count. Up to ``limit`` distinct vectors are one cell and compared there.
    Beyond that the distinct ones go into the cells of their ``probes`` nearest centres (members with the smallest hash, one
    for ``CELL_ROWS`` vectors); cells above ``limit`` rows are split again (``neighbour_cells``). A cell compares its vectors
    in blocked matrix products and gives one maximum per vector, never pairs. Most of these maxima are those over all rows;
    ``closer_in_blocks`` then takes all pairs of blocks for what the cells missed, so time grows with the square of the
    distinct vectors, memory does not. Null and zero vectors, and those without any other, get 0.
    """
    from tidewatch.session import stage

    keyed = df.withColumn("_vec", F.xxhash64(vector))
    solid = F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)
    counted = keyed.where(solid).groupBy("_vec").agg(F.any_value(vector).alias("_v"), F.count("*").alias("_n"))
    distinct = stage(counted, "vectors")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return pd.DataFrame({"_vec": [], "_best": []})
        vectors = np.stack(rows["_v"].to_numpy()).astype(np.float64)
        best = np.full(len(rows), -1.0)
        for at in range(0, len(rows), 1024):
            cosine = vectors[at:at + 1024] @ vectors.T
            cosine[np.arange(len(cosine)), np.arange(at, at + len(cosine))] = -1.0
            best[at:at + 1024] = cosine.max(axis=1)
        return pd.DataFrame({"_vec": rows["_vec"], "_best": best})

    total = distinct.count()
    placed = neighbour_cells(distinct.select("_vec", "_v"), total, probes, limit)
    found = placed.groupBy("_cell").applyInPandas(compare, "_vec long, _best double")
    best = found.groupBy("_vec").agg(F.max("_best").alias("_best"))
    if total > limit:
        best = stage(best, "best")
        # Copies have their 1 and are met by the others only.
        known = distinct.join(best, "_vec", "left").withColumn("_best", F.when(F.col("_n") > 1, 1.0).otherwise(F.coalesce("_best", F.lit(NO_COSINE))))
        best = best.unionByName(closer_in_blocks(known, total, limit)).groupBy("_vec").agg(F.max("_best").alias("_best"))
    scores = distinct.select("_vec", "_n").join(best, "_vec", "left").select(
        "_vec", F.when(F.col("_n") > 1, 1.0).otherwise(F.coalesce(F.rint(F.col("_best") * 1e4) / 1e4, F.lit(0.0))).alias("_best"))
    joined = keyed.join(scores, "_vec", "left").withColumn(out, F.when(solid, F.coalesce("_best", F.lit(0.0))).otherwise(0.0))
    return joined.drop("_vec", "_best")


def with_narrative_trend(df: DataFrame, cluster: str = "narrative_cluster_id", sizes: DataFrame | None = None) -> DataFrame:
    sized = with_group_size(df.drop("cluster_volume"), cluster, "cluster_volume", sizes, bounded=True)
    return sized.withColumn("narrative_trend_score", weighted(NARRATIVE_WEIGHTS))


def with_emerging(df: DataFrame, q: float = 0.95, threshold: float | None = None) -> DataFrame:
    """``emerging`` at or above the quantile of the whole table."""
    if threshold is None:
        threshold = quantiles_once(df, {"t": (F.col("narrative_trend_score"), q)})["t"]
    hit = F.lit(False) if threshold is None else F.col("narrative_trend_score") >= F.lit(threshold)
    return df.withColumn(
        "emerging_narrative", F.when(F.coalesce(hit, F.lit(False)), "emerging").otherwise("normal")
    )
