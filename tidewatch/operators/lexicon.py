"""Phrase tables of any size: which phrases a text holds, found in one pass over the text.

A phrase is found as a substring, exactly as ``contains`` finds it. NULL and empty phrases are ignored, a
phrase listed twice counts once, and a NULL text holds none. Lower both sides first where case is not to matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of up to this many UTF-8 bytes in all are sent to the executors; larger tables are joined.
MOST_BYTES = 8 << 20
#: Starting places that are walked at a time, whatever the length of the texts.
_STARTS = 1 << 20
#: Steps of the uppermost nodes that are kept in a table; deeper ones are looked up among the edges.
_TABLE = 1 << 22
#: Bytes of text that are searched at a time; a longer text is searched alone.
_TEXT_BYTES = 1 << 20
_ANCHOR = 8


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text starts, with the end of the last."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    bounds = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[bounds[0]:bounds[-1]], bounds - bounds[0]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in a row, in slices of about ``_TEXT_BYTES`` each."""
    _, bounds = _bytes(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + _TEXT_BYTES, "right")) - 1)
        yield texts.slice(start, end - start)
        start = end


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted and each once. Sorting is faster here than the hash table of ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


@dataclass(frozen=True)
class Trie:
    """A trie over bytes, as numbers. Nodes are numbered level by level.

    Edge ``i`` leads to node ``i + 1`` and has the key ``node * width + letter``; keys ascend. ``table`` holds
    the same for the first nodes (0: no edge), ``levels`` the first node of each level, ``ends`` the phrase
    that ends at a node or -1.
    """

    letters: np.ndarray
    width: int
    levels: list[int]
    edges: np.ndarray
    table: np.ndarray
    ends: np.ndarray
    phrases: pa.Array

    @staticmethod
    def of(phrases: list[str]) -> Trie:
        """All phrases go down one level at a time; phrases that agree so far share a node."""
        listed = pa.array(sorted(phrases), pa.string())
        data, bounds = _bytes(listed)
        sizes, used = np.diff(bounds), np.unique(data)
        letters = np.full(256, -1, np.int32)
        letters[used] = np.arange(len(used))
        node, width = np.zeros(len(listed), np.int64), max(1, len(used))
        edges, ends, levels = [np.zeros(0, np.int64)], [np.array([-1])], [0, 1]
        for depth in range(int(sizes.max(initial=0))):
            going = np.flatnonzero(sizes > depth)
            keys, place = np.unique(node[going] * width + letters[data[bounds[going] + depth]], return_inverse=True)
            node[going] = levels[-1] + place
            end, done = np.full(len(keys), -1), sizes[going] == depth + 1
            end[place[done]] = going[done]
            edges.append(keys)
            ends.append(end)
            levels.append(levels[-1] + len(keys))
        keys = np.concatenate(edges)
        table = np.zeros(min(levels[-1], max(1, _TABLE // width)) * width, np.int32)
        shallow = np.searchsorted(keys, len(table))
        table[keys[:shallow]] = np.arange(1, shallow + 1)
        return Trie(letters, width, levels, keys, table, np.concatenate(ends), listed)

    def _step(self, depth: int, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node after each node of a level, 0 where there is none."""
        key = node.astype(np.int64) * self.width + letter
        if self.levels[depth + 1] * self.width <= len(self.table):
            return self.table[key]
        low, high = self.levels[depth + 1] - 1, self.levels[depth + 2] - 1
        level = self.edges[low:high]
        place = np.minimum(np.searchsorted(level, key), len(level) - 1)
        return np.where(level[place] == key, low + place + 1, 0)

    def _hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The distinct phrases of all texts in a row, in order, and where each text's begin, with the end.

        All starting places of a block walk down the trie together, and those without an edge drop out. A
        place may walk on into the next text: a phrase counts if it ends in the text it started in.
        """
        data, bounds = _bytes(texts)
        hits = [np.zeros(0, np.int64)]
        for start in range(0, len(data), _STARTS):
            place = np.arange(start, min(start + _STARTS, len(data)))
            node, of_block = np.zeros(len(place), np.int32), []
            for depth in range(len(self.levels) - 2):
                left = np.searchsorted(place, len(data) - depth)
                place, node = place[:left], node[:left]
                letter = self.letters[data[place + depth]]
                after = np.where(letter >= 0, self._step(depth, node, np.maximum(letter, 0)), 0)
                on = np.flatnonzero(after)
                place, node = place[on], after[on]
                if not len(place):
                    break
                end = self.ends[node]
                ended = np.flatnonzero(end >= 0)
                text = np.searchsorted(bounds, place[ended], "right") - 1
                inside = place[ended] + depth < bounds[text + 1]
                of_block.append(text[inside] * len(self.phrases) + end[ended][inside])
            if of_block:
                hits.append(_distinct(np.concatenate(of_block)))
        text, phrase = np.divmod(_distinct(np.concatenate(hits)), max(1, len(self.phrases)))
        return phrase, np.searchsorted(text, np.arange(len(texts) + 1))

    def found(self, texts: pa.Array) -> pa.Array:
        """The distinct phrases of each text, in order."""
        phrase, bounds = self._hits(texts)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.phrases.take(pa.array(phrase)))

    def counts(self, texts: pa.Array) -> pa.Array:
        """How many distinct phrases each text holds."""
        return pa.array(np.diff(self._hits(texts)[1]), pa.int32())


def _by_trie(df: DataFrame, text: Column, phrases: DataFrame, out: str, count: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Trie.of([r["phrase"] for r in phrases.collect()]))

    @F.arrow_udf("int" if count else "array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = shared.value
        for batch in batches:
            # What is found may be larger than the texts, so a batch's is never held whole.
            for texts in _slices(batch):
                yield trie.counts(texts) if count else trie.found(texts)

    return df.withColumn(out, find(text))


def _by_join(df: DataFrame, text: Column, phrases: DataFrame, shortest: int, out: str) -> DataFrame:
    """Each distinct text meets the phrases whose first letters it holds, and is then compared with them.

    Texts without any letters get keys that match nothing and differ between rows.
    """
    size = min(shortest, _ANCHOR)
    blank = F.concat(F.lit("-"), F.xxhash64(*df.columns).cast("string"))
    keyed = df.withColumn("_text", text).withColumn("_key", F.when(F.col("_text") != "", F.sha2("_text", 256)).otherwise(blank))
    texts = keyed.where("_text <> ''").groupBy("_key").agg(F.any_value("_text").alias("_text"))
    starts = F.when(F.length("_text") >= size, F.sequence(F.lit(1), F.length("_text") - (size - 1)))
    grams = texts.select("_key", F.explode(F.array_distinct(
        F.transform(starts, lambda i: F.substring(F.col("_text"), i, F.lit(size))))).alias("_gram"))
    anchored = phrases.withColumn("_gram", F.left("phrase", F.lit(size)))
    near = grams.join(anchored, "_gram").select("_key", "phrase").join(texts, "_key").where(F.contains("_text", "phrase"))
    found = near.groupBy("_key").agg(F.sort_array(F.collect_list("phrase")).alias(out))
    none = F.array().cast("array<string>")
    return keyed.join(found, "_key", "left").withColumn(out, F.coalesce(out, none)).drop("_key", "_text")


def _search(df: DataFrame, text: str, lexicon: DataFrame, out: str, count: bool, most_bytes: int) -> DataFrame:
    phrases = lexicon.select(F.col("phrase").cast("string").alias("phrase")).where("phrase <> ''").distinct()
    size = phrases.agg(F.sum(F.octet_length("phrase")).alias("bytes"), F.min(F.length("phrase")).alias("shortest")).first()
    source = F.coalesce(F.col(text), F.lit(""))
    if (size["bytes"] or 0) <= most_bytes:
        return _by_trie(df, source, phrases, out, count)
    found = _by_join(df, source, phrases, size["shortest"], out)
    return found.withColumn(out, F.size(out)) if count else found


def with_phrases(df: DataFrame, text: str, lexicon: DataFrame, out: str = "phrases", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Add ``out``: the distinct ``phrase`` values of ``lexicon`` that occur in ``text``, in order.

    The lexicon is measured first. Up to ``most_bytes`` it goes to the executors as a trie, which takes the
    whole lexicon through each text in one pass, so the plan does not grow with it; beyond that, texts and
    phrases meet in a join on the phrases' first letters.
    """
    return _search(df, text, lexicon, out, False, most_bytes)


def phrase_hits(df: DataFrame, text: str, lexicon: DataFrame, out: str = "hits", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Add ``out``: how many of the lexicon's phrases occur in ``text``."""
    return _search(df, text, lexicon, out, True, most_bytes)
