"""SimHash near-dedup over BK-trees.

Texts are lower-cased (A-Z), cut into words at the six ASCII white-space characters and hashed as
word shingles (XXH64, seed 42). A bit of the fingerprint is 1 if it is set in over half the hashes.
Fingerprints that differ in at most ``radius`` bits are linked; a component is what links reach.

Shards. A fingerprint has ``radius + free`` blocks of bits; two fingerprints within the radius agree
in at least ``free`` of them. So each choice of ``free`` blocks with their bits is a shard, and every
link lies within a shard. A shard's distinct fingerprints form a BK-tree (children keyed by their
Hamming distance to the parent), which the task holding the shard walks for each of them, following
only edges within the radius. Any ``free`` finds all links: with 2 (15 shards a fingerprint at radius 4) a
shard holds about a two-millionth of the distinct fingerprints; beyond 10^9 of them take 3 or 4. A shard gives one edge per linked fingerprint, never its pairs;
subtrees already known to be in the asker's component are not walked, so dense groups stay cheap.

Defined results: null text is empty; a text without words has fingerprint 0, which is linked like any
other. Fewer words than a shingle: the whole sequence is the one shingle. Repeated rows have equal
results. A component's id is its smallest id that is not null; null if all are null. An empty table
gives an empty table. Other columns are carried by ``deduplicate`` and ignored by ``classify``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks, first_schema, free_prefix, stage
from tidewatch.llm.graph import components

BITS = 64
HOT_GROUPS = 1000
SMALL_SHARD = 64
_CHUNK = 1 << 16
BATCH_BYTES = 1 << 21


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (np.append(0, ends[:-1] + 1)).tolist()
    last = ends[shingle - 1:].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(last)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:at + _CHUNK], last[at:at + _CHUNK], strict=False)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, __fp, __text_hash): the fingerprint of each row as a signed long, and a hash that tells rows of one id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text", BATCH_BYTES):
            values = [fingerprint(t, shingle) for t in block.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(values, pa.int64()), block.column("__text_hash")], names=[id_col, "__fp", "__text_hash"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__text_hash"))
    return rows.mapInArrow(run, first_schema(docs, id_col) + ", __fp long, __text_hash long")


class BKTree:
    """Nodes are [fingerprint, children by distance, index, component shared by the whole subtree or -1]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, fp: int, index: int) -> None:
        new = [fp, {}, index, -1]
        node = self.root
        if node is None:
            self.root = new
            return
        while True:
            distance = (fp ^ node[0]).bit_count()
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = new
                return
            node = child

    def mark(self, find) -> None:
        """Note for each subtree whether it lies within one component as known now."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(node[1].values())
        for node in reversed(order):
            own = find(node[2])
            node[3] = own if all(c[3] >= 0 and find(c[3]) == own for c in node[1].values()) else -1

    def near(self, fp: int, radius: int, skip=None) -> Iterator[int]:
        """Indexes within the radius; subtrees for whose component ``skip`` holds are passed over."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if skip is not None and node[3] >= 0 and skip(node[3]):
                continue
            distance = (fp ^ node[0]).bit_count()
            if distance <= radius:
                yield node[2]
            children = node[1]
            if len(children) > 2 * radius + 1:
                todo.extend(children[d] for d in range(distance - radius, distance + radius + 1) if d in children)
            else:
                todo.extend(c for d, c in children.items() if -radius <= d - distance <= radius)


def linked(fps: list[int], radius: int) -> list[int]:
    """For each of the distinct unsigned ``fps`` the index of its component's first one."""
    parent = list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)

    tree = BKTree()
    if len(fps) <= SMALL_SHARD:
        for i, fp in enumerate(fps):
            if i:
                for j in tree.near(fp, radius):
                    join(i, j)
            tree.insert(fp, i)
    else:
        place = {fp: i for i, fp in enumerate(fps)}
        for i, fp in enumerate(fps):  # next neighbours first: dense groups are then known as one
            for bit in range(BITS):
                j = place.get(fp ^ (1 << bit))
                if j is not None:
                    join(i, j)
        for i, fp in enumerate(fps):
            tree.insert(fp, i)
        again = 0
        for i, fp in enumerate(fps):
            if i >= again:
                tree.mark(find)
                again = 2 * i + 16
            for j in tree.near(fp, radius, lambda c, i=i: find(c) == find(i)):
                join(i, j)
    return [find(i) for i in range(len(fps))]


def block_masks(radius: int, free: int) -> list[int]:
    """A mask for each choice of ``free`` out of ``radius + free`` blocks of the fingerprint."""
    edges = [BITS * i // (radius + free) for i in range(radius + free + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, free)]


def _edges(fps: DataFrame, radius: int, free: int) -> DataFrame:
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in block_masks(radius, free)]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("__fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    shards = fps.select("__fp", F.explode(keys).alias("k")).select("__fp", "k.choice", "k.bits")
    shards = shards.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "__fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            fp, choice, bits = (np.concatenate(x) for x in zip(*held, strict=True))
            cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])) + 1
            if len(cuts):
                yield from shard_edges(fp[:cuts[-1]], [0, *cuts.tolist()])
                fp, choice, bits = fp[cuts[-1]:], choice[cuts[-1]:], bits[cuts[-1]:]
            held = [(fp, choice, bits)]
        if held:
            fp = held[0][0]
            yield from shard_edges(fp, [0, len(fp)])

    def shard_edges(fp: np.ndarray, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        unsigned = fp.view(np.uint64).tolist()
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if stop - start > 1:
                for i, root in enumerate(linked(unsigned[start:stop], radius)):
                    if root != i:
                        a.append(start + i)
                        b.append(start + root)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return shards.mapInArrow(run, "a long, b long")


def groups(rows: DataFrame, *, id_col: str = "doc_id", radius: int = 4, free: int = 2) -> DataFrame:
    """Per distinct fingerprint of ``rows`` (id, __fp): ``__n`` rows, ``__root`` and ``component_id``."""
    fps = stage(rows.groupBy("__fp").agg(F.min(id_col).alias("__least"), F.count("*").alias("__n")), "simhash-distinct")
    roots = components(_edges(fps, radius, free), "simhash-components")
    labelled = fps.join(roots.withColumnRenamed("node", "__fp"), "__fp", "left")
    labelled = labelled.select("__fp", "__n", "__least", F.coalesce("root", "__fp").alias("__root"))
    least = labelled.groupBy("__root").agg(F.min("__least").alias("component_id"))
    return labelled.join(least, "__root")


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, free: int = 2) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``.

    At most ``HOT_GROUPS`` fingerprints, those of more than a thousandth of all rows, are broadcast;
    the rest join by a shuffle.
    """
    rows = stage(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash-rows")
    found = stage(groups(rows, id_col=id_col, radius=radius, free=free).select("__fp", "__n", "component_id"), "simhash-groups")
    hot = found.where(F.col("__n") > rows.count() // HOT_GROUPS + 1000)
    marked = rows.join(F.broadcast(hot.select("__fp", F.col("component_id").alias("__c"), F.lit(True).alias("__hot"))), "__fp", "left")
    out = marked.where("__hot").select(id_col, "__fp", F.col("__c").alias("component_id")).unionByName(
        marked.where("__hot IS NULL").join(found, "__fp").select(id_col, "__fp", "component_id"))
    return out.select(id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, free: int = 2) -> DataFrame:
    """The rows whose id is their component's, all columns as they are.

    A component without any id keeps all its rows (nothing tells them apart); so do rows that repeat
    both id and text.
    """
    rows = stage(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash-rows")
    found = groups(rows, id_col=id_col, radius=radius, free=free).where(F.col("__least").eqNullSafe(F.col("component_id")))
    # Joined by fingerprint and id: the copies of one text, however many, are dealt out by their ids.
    kept = found.select(F.col("__fp").alias("__kept"), F.col("__least").alias("__stay"))
    staying = rows.join(kept, (F.col("__fp") == F.col("__kept")) & F.col(id_col).eqNullSafe(F.col("__stay")))
    staying = stage(staying.select("__stay", "__text_hash").distinct(), "simhash-stay").alias("k")
    own = free_prefix(docs, "__text_hash")
    marked = docs.withColumn(own, F.xxhash64(text_col)).alias("d")
    same = (F.col(f"d.{own}") == F.col("k.__text_hash")) & F.col(f"d.{id_col}").eqNullSafe(F.col("k.__stay"))
    return marked.join(staying, same, "left_semi").select(*docs.columns)
