"""Alignment of two tokenizers' tokens over whole texts, in Arrow.

Tokenizer A reads a space and the text, tokenizer B the text, before which it sets a space itself. A block of texts
becomes two list columns of ids; flattened, with the parent of each id, and with cumulative sums over the
ids' byte lengths they become two tables (document-end key, id). As the documents of a block stand one after
another, the running byte position is document and end in one key. An Acero hash join on that key gives the
links; the flags of linked tokens, summed up, give every token its group. The text of the groups is one ``take`` from an
array of prepared strings in the order of both sides merged. ``Table.group_by`` counts the linked id pairs of a block, by
document and in all; a task merges the latter and Spark sums them over the tasks.

The corpus-wide counts are joined back in a pass over the documents' own pair counts. The pairs that are most
frequent, at most ``SHARED_PAIRS`` of them (by powers of two of the count), are broadcast; what a document has of other pairs
is joined on Spark by pair, so that no count is left out whatever the number of pairs.

Defined results: null and empty texts, and those whose joined token bytes of either side differ from the space and the
text, have zeros and ''. Very long texts are a block of their own and are read whole. Repeated rows, and rows without an id, are documents of their own and count
each. A document's link counts as best if no pair of its B id has a higher count: ties all do. An empty table gives an
empty table. Other columns are ignored. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks, first_schema, stage

BLOCK_BYTES = 1 << 20
PENDING_PAIRS = 400_000
SHARED_PAIRS = 1 << 21
_SEPARATORS = (",", "|", ";", "")
# A run of white space this long is left to the tokenizer's own library: the pattern engine of the fast one recurses on it.
_LONG_BLANK = re.compile(r"\s{2000}")
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]

_READERS: dict[tuple[str, str], Reader] = {}


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of public byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Reader:
    """Both tokenizers, the bytes of their ids, and the prepared strings of all ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as file:
            stated = json.load(file)
        vocabulary, special = stated["model"]["vocab"], {t["content"] for t in stated["added_tokens"]}
        alphabet = byte_alphabet()
        bytes_a = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items() if token not in special}
        size = max([*vocabulary.values(), *(t["id"] for t in stated["added_tokens"])]) + 1
        self.bytes_a = pa.array([bytes_a.get(i, b"") for i in range(size)], pa.large_binary())
        self.whole = Tokenizer.from_file(path_a)
        self.whole.encode_special_tokens = True
        # Where each merge makes the next id, ranks are ids, and the fast library gives the same tokens.
        merges = [m if isinstance(m, list) else m.split(" ") for m in stated["model"]["merges"]]
        first = len(bytes_a) - len(merges)
        ranked = all(vocabulary.get(a + b) == first + k for k, (a, b) in enumerate(merges))
        plain = stated["normalizer"] is None and stated["pre_tokenizer"]["type"] == "ByteLevel" and not stated["pre_tokenizer"]["add_prefix_space"]
        self.fast = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in bytes_a.items()}, special_tokens={}) if ranked and plain else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n_b = self.pieces.get_piece_size()
        self.bytes_b = pa.array([
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.pieces.id_to_piece, range(n_b)))], pa.large_binary())
        self.lengths_a, self.lengths_b = (pc.binary_length(b).cast(pa.int64()) for b in (self.bytes_a, self.bytes_b))
        self.n_b = n_b
        self.strings = pa.array([f"{i}{s}" for i in range(max(size, n_b)) for s in _SEPARATORS], pa.large_binary())

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Reader:
        if (path_a, path_b) not in _READERS:
            _READERS[path_a, path_b] = cls(path_a, path_b)
        return _READERS[path_a, path_b]

    def ids_a(self, text: str) -> np.ndarray | list[int]:
        if self.fast is None or _LONG_BLANK.search(text):
            return self.whole.encode(" " + text, add_special_tokens=False).ids
        return self.fast.encode_to_numpy(" " + text, disallowed_special=())

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


def _lists(ids: list) -> pa.LargeListArray:
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    flat = np.concatenate([np.asarray(i, np.int32) for i in ids]) if ids else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def _bytes(array: pa.LargeBinaryArray) -> np.ndarray:
    """All bytes of an array that starts at its buffer's start."""
    data = array.buffers()[2]
    return np.frombuffer(data, np.uint8)[:np.frombuffer(array.buffers()[1], np.int64)[len(array)]] if data is not None else np.zeros(0, np.uint8)


def readable(texts: list[str], a: pa.LargeListArray, b: pa.LargeListArray, reader: Reader) -> np.ndarray:
    """Which texts both sides give back byte for byte after a space."""
    raw = [b" " + t.encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    good = size > 1
    for ids, lengths in ((a, reader.lengths_a), (b, reader.lengths_b)):
        ends = np.append(0, pc.cumulative_sum(lengths.take(pc.list_flatten(ids))).to_numpy())
        good &= np.diff(ends[ids.offsets.to_numpy()]) == size
    rows = np.flatnonzero(good)
    stated = np.frombuffer(b"".join(raw[i] for i in rows.tolist()), np.uint8)
    ends = np.cumsum(size[rows])
    for ids, values in ((a, reader.bytes_a), (b, reader.bytes_b)):
        joined = _bytes(values.take(pc.list_flatten(ids.take(pa.array(rows)))))
        off = np.flatnonzero(joined != stated)
        good[rows[np.unique(np.searchsorted(ends, off, "right"))]] = False
    return good


@dataclass
class Aligned:
    """Of a block's readable documents: four counts each, the digest of the groups, and the links (document, pair)."""

    counts: np.ndarray  # 4 x documents
    digests: list[str]
    links: pa.Table


def align(a: pa.LargeListArray, b: pa.LargeListArray, reader: Reader) -> Aligned:
    """Groups and links of documents whose sides have the same bytes."""
    n = len(a)
    sides = []
    for ids, lengths in ((a, reader.lengths_a), (b, reader.lengths_b)):
        flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
        key = pc.cumulative_sum(lengths.take(flat))
        sides.append((flat.to_numpy(), parent.to_numpy(), pa.table({"key": key, "id": flat, "at": np.arange(len(flat))})))
    (flat_a, doc_a, table_a), (flat_b, doc_b, table_b) = sides
    links = table_a.append_column("doc", pa.array(doc_a)).join(table_b, "key", join_type="inner", right_suffix="_b", use_threads=False)
    closes = [np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)]
    closes[0][links.column("at").to_numpy()] = True
    closes[1][links.column("at_b").to_numpy()] = True
    group = [np.cumsum(c) - c for c in closes]
    groups = int(closes[0].sum())
    size_a, size_b = (np.bincount(g, minlength=groups) for g in group)
    # Both sides in one row: a group's A tokens, then its B tokens.
    place_a = np.arange(len(flat_a)) + (np.cumsum(size_b) - size_b)[group[0]]
    place_b = np.arange(len(flat_b)) + np.cumsum(size_a)[group[1]]
    chosen = np.empty(len(flat_a) + len(flat_b), np.int64)
    chosen[place_a] = flat_a.astype(np.int64) * 4 + np.where(closes[0], 1, 0)
    last = np.append(doc_b[1:] != doc_b[:-1], True) if len(doc_b) else np.zeros(0, bool)
    chosen[place_b] = flat_b.astype(np.int64) * 4 + np.where(last, 3, np.where(closes[1], 2, 0))
    text = reader.strings.take(pa.array(chosen))
    ends = np.frombuffer(text.buffers()[1], np.int64)[:len(text) + 1][a.offsets.to_numpy() + b.offsets.to_numpy()]
    data = memoryview(_bytes(text))
    digests = [hashlib.sha256(data[x:z]).hexdigest() for x, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    doc = links.column("doc").to_numpy()
    counts = np.stack([np.bincount(d, minlength=n) for d in (doc_a, doc_b, doc_a[closes[0]], doc)])
    pair = links.column("id").to_numpy().astype(np.int64) * reader.n_b + links.column("id_b").to_numpy()
    return Aligned(counts, digests, pa.table({"doc": doc, "pair": pair}))


def _by_pair(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def tokens(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds: documents (``__row`` not null) with counts, digest and their own pairs, and the tasks' pair counts (pair, n)."""
    row_fields = [("__row", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, next_row = Reader.of(path_a, path_b), TaskContext.get().partitionId() << 40
        pending: list[pa.Table] = []
        waiting, id_type = 0, None

        def partial() -> pa.RecordBatch:
            table = _by_pair(pending)
            arrays = [pa.nulls(len(table), id_type), *(pa.nulls(len(table), t) for _, t in row_fields), *(table.column(c).combine_chunks() for c in ("pair", "n"))]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, *(f for f, _ in row_fields), "pair", "n"])

        for block in blocks(batches, "__text", BLOCK_BYTES):
            id_type = block.column(0).type
            texts = [t or "" for t in block.column("__text").to_pylist()]
            a, b = _lists([reader.ids_a(t) if t else [] for t in texts]), _lists(reader.ids_b(texts))
            rows = np.flatnonzero(readable(texts, a, b, reader))
            own = pa.array(rows)
            found = align(_packed(a.take(own)), _packed(b.take(own)), reader)
            counts = np.zeros((len(_COUNTS), len(texts)), np.int64)
            counts[:, rows] = found.counts
            digest = [""] * len(texts)
            for i, d in zip(rows.tolist(), found.digests, strict=True):
                digest[i] = d
            by_doc = found.links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
            distinct = np.zeros(len(texts), np.int64)
            distinct[rows] = np.bincount(by_doc.column("doc").to_numpy(), minlength=len(rows))
            offsets = pa.array(np.append(0, np.cumsum(distinct)), pa.int32())
            pair, times = by_doc.column("pair").combine_chunks(), by_doc.column("count_all").cast(pa.int32()).combine_chunks()
            none = [pa.nulls(len(texts), pa.int64())] * 2
            arrays = [block.column(0), pa.array(np.arange(next_row, next_row + len(texts))), *map(pa.array, counts), pa.array(digest),
                      pa.ListArray.from_arrays(offsets, pair), pa.ListArray.from_arrays(offsets, times), *none]
            next_row += len(texts)
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *(f for f, _ in row_fields), "pair", "n"])
            pending.append(pa.table({"pair": pair, "n": times.cast(pa.int64())}))
            waiting += len(pair)
            if waiting > PENDING_PAIRS:
                pending[:] = [_by_pair(pending)]
                waiting = len(pending[0])
                if waiting > PENDING_PAIRS // 2:
                    yield partial()
                    pending.clear()
                    waiting = 0
        if pending:
            yield partial()

    ddl = f"{first_schema(docs, id_col)}, __row long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, pairs array<long>, times array<int>, pair long, n long"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, ddl)


def _packed(lists: pa.LargeListArray) -> pa.LargeListArray:
    """The same lists with offsets from 0."""
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(lists.value_lengths().to_numpy()))), lists.flatten())


def pair_counts(parts: DataFrame, n_b: int) -> DataFrame:
    """Staged (pair, n, best): how often a pair is linked, and whether no pair of its B id is more often."""
    counts = stage(parts.where("__row IS NULL").groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")
    top = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("top"))  # one row a B id
    marked = counts.withColumn("b", F.col("pair") % n_b).join(F.broadcast(top), "b")
    return stage(marked.select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "alignment-pairs")


def _frequent(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs have this count or a higher one."""
    bits = {r.k: r.pairs for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("pairs")).collect()}  # 64 rows at most
    total = 0
    for k in sorted(bits, reverse=True):
        total += bits[k]
        if total > most:
            return 1 << (k + 1)
    return 1


def compare(
    docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", shared_pairs: int = SHARED_PAIRS,
) -> DataFrame:
    """One row per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    if id_col.startswith("__"):
        raise ValueError(f"{id_col}: names with two leading underscores are working columns")
    parts = stage(tokens(docs, path_a, path_b, id_col=id_col, text_col=text_col), "alignment-tokens")
    counts = pair_counts(parts, Reader.of(path_a, path_b).n_b)
    least = _frequent(counts, shared_pairs)
    known = counts.where(F.col("n") >= least).toArrow()  # `shared_pairs` rows at most
    pair, n, best = (known.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    shared = docs.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order]))
    del known, pair, n, best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            own, times, doc = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy()
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            found = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            sums = [np.zeros(len(batch), np.int64) for _ in range(2)]
            np.add.at(sums[0], doc[found], times[found] * best[at[found]])
            np.add.at(sums[1], doc[found], times[found] * n[at[found]])
            rest = ~found
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc[rest], minlength=len(batch)))), pa.int32())
            left = [pa.ListArray.from_arrays(offsets, pa.array(x[rest], pa.int64())) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, sums), *left], names=[*keep, "n_best", "count_sum", "pairs", "times"])

    keep = [id_col, "__row", *_COUNTS, "groups_sha256"]
    rows = parts.where("__row IS NOT NULL").select(*keep, "pairs", "times")
    summed = rows.mapInArrow(run, first_schema(rows, *keep) + ", n_best long, count_sum long, pairs array<long>, times array<long>")
    if least > 1:
        summed = stage(summed, "alignment-sums")
        rare = summed.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("__row", F.col("x.pairs").alias("pair"), "x.times")
        rare = rare.join(counts.where(F.col("n") < least), "pair").groupBy("__row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
        summed = summed.join(rare, "__row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("rare_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))})
    return summed.select(id_col, *_COUNTS, "n_best", "count_sum", "groups_sha256")
