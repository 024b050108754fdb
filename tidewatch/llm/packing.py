"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous sweeps.

Tokenising is a pass over the documents; ids never leave it unless ``with_ids`` asks for them. Pieces and
gaps are ordered by size. Sizes are whole numbers up to ``capacity``, so all pieces of one size are a
run of ranks, and so are all sequences with equal gaps. A superstep takes the largest size not yet
placed and sweeps the gaps upward from it: the successor gap (the smallest that fits) gives its
sequences to the pieces next in rank; pieces that find their gap taken go on to the next one, and
without any gap new sequences open. Then the gaps are updated. The steps work on counts by size, at
most ``capacity`` numbers whatever the input; they yield runs (size, first rank, count, first sequence,
offset), whose number is bounded by the sizes too. Ranks are given out on Spark: a scan task numbers
its pieces by size, and prefix sums over the tasks' counts make these numbers global. Every piece then
looks up its run.

Defined results: null text is empty, which gives the end token alone. Repeated rows, and rows without
an id, are documents of their own. An empty table gives no sequences. Other columns are ignored.
A special token's string in a text is that token's id, as the tokenizer reads it by default.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks, first_schema, stage

CAPACITY = 2048
BLOCK_BYTES = 1 << 22
CACHED_WORDS = 600_000
CLOSING = ".,;:!?%$#&*|"
#: Byte-level alphabet of public byte-pair vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_ENCODERS: dict[str, Encoder] = {}


class Encoder(dict):
    """Word -> its token ids as little-endian 32-bit bytes, filled as words are met.

    The tokenizer drops white space, and no token or normalisation step reaches across it, so a text's
    ids are those of its words in turn. A word of plain letters before closing marks is two units to
    the tokenizer; its letters go straight to the merges, all else through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = sys.byteorder == "little" and array("I").itemsize == 4 and self._splits_words()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, stem: str) -> bytes:
        """Ids of lower-case letters, written as the byte-level alphabet."""
        spelt = stem.encode().decode("latin-1").translate(_BYTE_ALPHABET)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def _splits_words(self) -> bool:
        """Whether this tokenizer treats letters and closing marks as assumed; else every word goes through it whole."""
        probes = ["of", "ndthough", "caf\u00e9", "stra\u00dfe", "a\u00f1os"]
        return all(
            self._whole(w + m) == self._letters(w) + self._whole(m) and self._whole(w.upper()) == self._whole(w.upper().lower())
            for w in probes for m in ("", ".", ",!!", "%%%"))

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        text = word.decode()
        stem = text.rstrip(CLOSING)
        low = stem.lower()
        # Letters up to U+024F in composed form: their lower case is the same with any rule.
        if self.plain and stem and low.isalpha() and max(low) < "\u0250" and min(low) != "\u0149" and "\u0130" not in stem:
            # The same letters in another case or before other marks are looked up, not merged again.
            own, marks = low.encode(), text[len(stem):]
            ids = self._letters(low) if own == word else self[own] + (self[marks.encode()] if marks else b"")
        else:
            ids = self._whole(text)
        self[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        get = self.__getitem__
        for text in texts:
            yield b"".join(map(get, (text or "").encode("utf-8", "replace").split()))


def tokenise(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``).

    ``__task`` is the scan task, ``__k`` the number of earlier pieces of equal length in it.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = Encoder.of(tokenizer), Counter(), TaskContext.get().partitionId()
        for block in blocks(batches, "__text", BLOCK_BYTES):
            rows = []
            for i, ids in enumerate(encoder.encode(block.column("__text").to_pylist())):
                ids = memoryview(ids + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((i, piece, at // 4, n, zlib.crc32(part), seen[n], np.frombuffer(part, "<u4") if with_ids else None))
                    seen[n] += 1
            at, piece, start, length, crc, k, ids = zip(*rows, strict=True)
            arrays = [block.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, k)), pa.array([task] * len(at), pa.int32())]
            names = [id_col, "piece", "start", "length", "ids_crc32", "__k", "__task"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = first_schema(docs, id_col) + ", piece int, start long, length long, ids_crc32 long, __k long, __task int" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset) that place all pieces, by length then rank."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    present, sequences, placed = 0, 0, []  # bit g of `present`: some sequence has gap g
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = present >> length
            if not fits:
                new = -(-left // (capacity // length))
                gaps[capacity] = [(sequences, new)]
                present |= 1 << capacity
                sequences += new
                continue
            gap = length + (fits & -fits).bit_length() - 1
            first, n = gaps[gap].pop()
            taken = min(n, left)
            placed.append((length, rank, taken, first, capacity - gap))
            if taken < n:
                gaps[gap].append((first + taken, n - taken))
            if not gaps[gap]:
                present &= ~(1 << gap)
            if gap > length:
                gaps.setdefault(gap - length, []).append((first, taken))
                present |= 1 << (gap - length)
            rank, left = rank + taken, left - taken
    return np.array(sorted(placed), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``)."""
    spark = docs.sparkSession
    # Written once: ranks must not change when a task runs again.
    pieces = stage(tokenise(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, with_ids=with_ids), "packing-pieces")
    sizes = stage(pieces.groupBy("length", "__task").agg(F.count("*").alias("n")), "packing-sizes")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    runs = spark.sparkContext.broadcast(best_fit(counts, capacity))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    ranked = pieces.join(base, ["length", "__task"]).withColumn("__rank", F.col("__base") + F.col("__k"))
    keep = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, sequence, offset = runs.value.T
        order = length << 45 | rank
        for batch in batches:
            own, r = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            at = np.searchsorted(order, own << 45 | r, "right") - 1
            arrays = [batch.column(c) for c in keep] + [pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "sequence_id", "offset"])

    ranked = ranked.select(*keep, "__rank")
    return ranked.mapInArrow(place, first_schema(ranked, *keep) + ", sequence_id long, offset long")
