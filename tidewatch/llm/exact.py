"""Exact dedup by Patricia-trie owners.

Texts are compared as the UTF-8 bytes left after deleting the six ASCII white-space characters; null
counts as empty. A key is (byte length, content hash, bytes); the bytes are taken from the owner's text again where
they are compared, so a text is shuffled once. Each scan task inserts its whole texts
into a compressed radix trie whose terminal nodes hold the best row so far (most code points in the
original, then the smallest id; null ids last) and the group's size. When a trie holds more than
``budget`` bytes, its heaviest subtree is emitted as partial owners and freed. Partial owners are
partitioned by length and hash, sorted by Spark within the partition (which spills), and merged in a
second trie that lets go of a subtree as soon as the sorted stream has left its (length, hash). So a
group of copies reaches the merging task as one row per scan task, however many rows it has.

Defined results: an empty table gives an empty table. All null and blank texts are one group. Repeated
rows count as rows of their group; exactly one row per group is kept, also if ids repeat. Extra columns
are carried by ``deduplicate`` and ignored by ``classify``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import blocks, free_prefix, stage

PREFIX = "__dedup_"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
BATCH_BYTES = 1 << 21
HOT_GROUPS = 1000

#: Fields of a partial owner beside the row itself. ``ties`` counts the rows that tie for best.
OWNER = {"length": T.LongType(), "hash": T.LongType(), "sha": T.StringType(),
         "points": T.LongType(), "count": T.LongType(), "ties": T.LongType()}


class Trie:
    """A compressed radix trie over byte strings; values sit at terminal nodes."""

    __slots__ = ("root", "held")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # edge label, children by first byte, value
        self.held = 0

    def insert(self, key: bytes, value: Any, merge: Callable[[Any, Any], Any]) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node[2] = value if node[2] is None else merge(node[2], value)
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, value]
                self.held += len(key) - at
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _common(label, key, at)
            upper = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][key[at]] = upper
            node, at = upper, at + shared

    def pop(self, first: int | None = None) -> Iterator[tuple[bytes, Any]]:
        """Take out the subtree under byte ``first`` (None: everything)."""
        if first is None:
            todo = [(b"", self.root)]
            self.root = [b"", {}, None]
        else:
            todo = [(b"", self.root[1].pop(first))]
        while todo:
            prefix, (label, children, value) = todo.pop()
            prefix += label
            if not (first is None and not prefix):
                self.held -= len(label)
            if value is not None:
                yield prefix, value
            todo.extend((prefix, c) for c in children.values())

    def heaviest(self) -> int:
        return max(self.root[1], key=lambda b: _weight(self.root[1][b]))


def _weight(node: list) -> int:
    total, todo = 0, [node]
    while todo:
        label, children, _ = todo.pop()
        total += len(label) + 64
        todo.extend(children.values())
    return total


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


def _better(a: tuple, b: tuple) -> tuple:
    """Merge two owners (points, id, row, count, ties)."""
    order_a, order_b = (-a[0], a[1] is None, a[1]), (-b[0], b[1] is None, b[1])
    count = a[3] + b[3]
    if order_a == order_b:
        return (*a[:3], count, a[4] + b[4])
    win = a if order_a[:2] < order_b[:2] or order_a[:2] == order_b[:2] and a[1] < b[1] else b
    return (*win[:3], count, win[4])


class _Writer:
    """Collect owners into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, key: bytes, owner: tuple) -> None:
        points, _, row, count, ties = owner
        digest = hashlib.sha256(key)
        content = int.from_bytes(digest.digest()[:8], "big", signed=True)
        self.rows.append((*row, len(key), content, digest.hexdigest(), points, count, ties))
        self.size += 2 * len(key) + 100

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
            self.rows, self.size = [], 0


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True)


def owners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budget: int = 24 << 20) -> DataFrame:
    """One row per distinct text: the row that stays, all its columns, and the ``OWNER`` fields.

    The names of those fields start with ``free_prefix(docs, PREFIX)``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = docs.columns
    at_id, at_text, width = names.index(id_col), names.index(text_col), len(names)
    prefix = free_prefix(docs, PREFIX)
    schema = T.StructType(docs.schema.fields + [T.StructField(prefix + n, t) for n, t in OWNER.items()])
    arrow = to_arrow_schema(schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), _Writer(arrow)
        for batch in blocks(batches, text_col, BATCH_BYTES):
            for row in _rows(batch, width):
                key, points = normalised(row[at_text]), len(row[at_text] or "")
                if not key:
                    trie.root[2] = _better(trie.root[2], (points, row[at_id], row, 1, 1)) if trie.root[2] else (points, row[at_id], row, 1, 1)
                    continue
                trie.insert(key, (points, row[at_id], row, 1, 1), _better)
                while trie.held > budget:
                    for item in trie.pop(trie.heaviest()):
                        out.add(*item)
                        yield from out.flush(BATCH_BYTES)
        for item in trie.pop():
            out.add(*item)
            yield from out.flush(BATCH_BYTES)
        yield from out.flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, place = Trie(), _Writer(arrow), None
        for batch in blocks(batches, text_col, BATCH_BYTES):
            for row in _rows(batch, width + len(OWNER)):
                key = normalised(row[at_text])
                length, content, _, points, count, ties = row[width:]
                if (length, content) != place:
                    place = (length, content)
                    for item in trie.pop():
                        out.add(*item)
                        yield from out.flush(BATCH_BYTES)
                trie.insert(key, (points, row[at_id], row[:width], count, ties), _better)
        for item in trie.pop():
            out.add(*item)
            yield from out.flush(BATCH_BYTES)
        yield from out.flush()

    keys = [prefix + "length", prefix + "hash"]
    return docs.mapInArrow(local, schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return owners(docs, id_col=id_col, text_col=text_col).select(*docs.columns)


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Only ids, lengths and digests meet in the join. The digests of at most ``HOT_GROUPS`` groups (those
    with more than a thousandth of all rows) are broadcast, so that no task gets all rows of a hot
    group; the rest join by a shuffle.
    """
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # Staged: the counts of groups are read three times, the tries are built once.
    groups = stage(owners(narrow, id_col="__id", text_col="__text").select(
        F.col(f"{PREFIX}sha").alias("text_sha256"), F.col("__id").alias("keep_id"), F.col(f"{PREFIX}points").alias("__points"),
        F.col(f"{PREFIX}count").alias("group_size"), F.col(f"{PREFIX}ties").alias("__ties")), "dedup-groups")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__text", BATCH_BYTES):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([hashlib.sha256(normalised(t)).hexdigest() for t in texts], pa.string()),
                pa.array([len(t or "") for t in texts], pa.int64())], names=["__id", "text_sha256", "__n"])

    rows = narrow.mapInArrow(digest, f"__id {docs.schema[id_col].dataType.simpleString()}, text_sha256 string, __n long")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = groups.where(F.col("group_size") > total // HOT_GROUPS + 1000)
    rows = rows.join(F.broadcast(hot.select("text_sha256", F.struct("keep_id", "group_size", "__points", "__ties").alias("__hot"))), "text_sha256", "left")
    found = rows.where("__hot IS NOT NULL").select("text_sha256", "__id", "__n", "__hot.*").unionByName(
        rows.where("__hot IS NULL").drop("__hot").join(groups, "text_sha256"))
    best = F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__n") == F.col("__points"))
    # Of rows that tie in id and length, one is kept: those rows come from their group instead.
    tied = groups.where("__ties > 1").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "__ties")))
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    single = found.where(~(best & (F.col("__ties") > 1))).withColumn("kept", best).withColumnRenamed("__id", "doc_id")
    return single.select(*out).unionByName(
        tied.withColumn("kept", F.col("__i") == 1).withColumn("doc_id", F.col("keep_id")).select(*out))
