"""Repeated byte strings across documents, by merging Burrows-Wheeler transforms of shards.

A byte goes if it is covered by a ``WIDTH``-byte string of its document that also starts in a document with
a smaller id. Strings are judged on the input; they never cross documents.

Shards are groups of documents of about ``group_bytes`` (by a hash of id and text). A window of ``WIDTH``
bytes is routed by its minimizer, the least hash of its ``SEED``-byte pieces: equal windows have equal
minimizers, and neighbouring windows mostly share one, so a shard's windows travel as runs, each with the
bytes it spans. Steps, in one plan, so that the exchange of texts by shard is made once and read three times:

1. Shards send the minimizers they hold; buckets of minimizers answer with one bit for each that another
   shard holds too.
2. Shards send the runs whose minimizer occurs in more than one document. Of equal runs of one shard only
   the smallest document's goes out; the others are repeats already (compared byte by byte).
3. A bucket holds the runs of many shards. Each shard's windows, read as five symbols of ten bytes from the
   back, give its transform, column by column: the symbols that precede its suffixes, in suffix order. The
   transforms are merged by refining an interleave of shard numbers: round k turns the order by k symbols
   into the order by k + 1 by sorting, stably, on the next unread symbol of each element's shard. After
   five rounds the blocks of the interleave are the intervals with a common prefix of ``WIDTH`` bytes; texts
   are not sorted again. Symbols are 16-bit hashes, so neighbours in a block are then compared byte by byte;
   a block that holds different strings is split by them.
4. Every window that is not from its interval's smallest document is a repeat; shards get these as spans.

A shard sends a run at most once, so a passage that a third of all documents share reaches its bucket
once per shard.

Defined results: null text is empty. Documents under ``WIDTH`` bytes keep everything. Rows that share an id
are one document and do not repeat each other; rows without an id count as one document after all others.
An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import whole_text

WIDTH = 50
SEED = 16
SYMBOL = 10
GROUP_BYTES = 4 << 20
CHUNK = 1 << 20
BATCH_WINDOWS = 60_000
LAST_ID = (1 << 63) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_RUN = np.dtype([("key", "<u4"), ("doc", "<u4"), ("start", "<u4"), ("length", "<u4"), ("id", "<i8")])
_SPAN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("length", "<u4")])


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as numbers (an unaligned view)."""
    n = max(len(data) - 7, 0)
    return np.ndarray((n,), "<u8", data.data if n else b"", strides=(1,))


def window_keys(data: np.ndarray) -> np.ndarray:
    """Minimizer of the window at every position of ``data``, over its SEED-byte pieces."""
    if len(data) < WIDTH:
        return np.zeros(0, np.uint64)
    w = _words(data)
    h = w[:-8] * _A
    h ^= w[8:] * _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    span, wanted = 1, WIDTH - SEED + 1
    while 2 * span <= wanted:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if wanted > span:
        h = np.minimum(h[:span - wanted], h[wanted - span:])
    return h


@dataclass
class Shard:
    """The documents of a group, in order of id, as one byte string."""

    ids: np.ndarray
    starts: np.ndarray  # of each document in ``data``; one more at the end
    data: np.ndarray
    table: pa.Table

    @classmethod
    def of(cls, table: pa.Table) -> Shard:
        table = table.sort_by([("__id", "ascending"), ("__hash", "ascending")]).combine_chunks()
        raw = [t.encode("utf-8", "surrogatepass") for t in table.column("__text").to_pylist()]
        starts = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=starts[1:])
        return cls(table.column("__id").to_numpy(), starts, np.frombuffer(b"".join(raw), np.uint8), table)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, document, first window, number of windows) of neighbouring windows with one minimizer."""
        found = []
        for at in range(0, len(self.data), CHUNK):
            keys = window_keys(self.data[at:at + CHUNK + WIDTH - 1])[:CHUNK]
            doc = np.repeat(np.arange(len(self.ids)), np.clip(self.starts[1:], at, at + len(keys)) - np.clip(self.starts[:-1], at, at + len(keys)))
            whole = np.arange(at, at + len(keys)) + WIDTH <= self.starts[doc + 1]
            cut = np.ones(len(keys), bool)
            cut[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(cut)
            count = np.diff(np.append(first, len(keys)))
            use = whole[first]
            found.append((keys[first[use]], doc[first[use]], first[use] + at, count[use]))
        if not found:
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _placed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit rest of each minimizer. A rest that is shared by chance only costs a comparison."""
    return (keys % np.uint64(buckets)).astype(np.int64), (keys // np.uint64(buckets) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _held(keys: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, rest), in order; whether several documents of the shard hold it; place of each run in it."""
    bucket, rest = _placed(keys, buckets)
    both = bucket.astype(np.uint64) << np.uint64(32) | rest
    distinct, place = np.unique(both, return_inverse=True)
    low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), -1)
    np.minimum.at(low, place, doc)
    np.maximum.at(high, place, doc)
    return (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32), high > low, place


def _table(**columns) -> pa.Table:
    kinds = {"bucket": pa.int32(), "shard": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})


def _send_keys(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = Shard.of(table)
        keys, doc, _, _ = shard.runs()
        bucket, rest, _, _ = _held(keys, doc, buckets)
        which = np.unique(bucket)
        blobs = [rest[a:b].tobytes() for a, b in zip(np.searchsorted(bucket, which), np.searchsorted(bucket, which, "right"), strict=True)]
        return _table(bucket=which, shard=[key[0].as_py()] * len(which), blob=blobs)

    return run


def _answer_keys(key: tuple, table: pa.Table) -> pa.Table:
    """One bit per key of each shard: another shard holds it."""
    held = [np.frombuffer(b, np.uint32) for b in table.column("blob").to_pylist()]
    ordered = np.sort(np.concatenate(held))
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    blobs = [np.packbits(np.isin(k, twice, assume_unique=True)).tobytes() for k in held]
    return _table(bucket=[key[0].as_py()] * len(held), shard=table.column("shard").to_pylist(), blob=blobs)


def _run_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes, from prefix sums; equal bytes have equal hashes."""
    out = np.zeros(len(start), np.uint64)
    base = np.cumprod(np.full(CHUNK, _A | np.uint64(1), np.uint64))
    todo = np.arange(len(start))
    # Runs are in order of start; each is hashed within a chunk that holds it whole, or directly.
    while len(todo):
        at = start[todo[0]]
        inside = todo[start[todo] + length[todo] <= at + CHUNK]
        inside = inside[:np.searchsorted(start[inside], at + CHUNK)]
        if not len(inside) or inside[0] != todo[0]:
            i = todo[0]
            out[i] = int.from_bytes(hashlib.blake2b(data[at:at + length[i]].tobytes(), digest_size=8).digest(), "little")
            todo = todo[1:]
            continue
        part = data[at:at + CHUNK].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * base[:len(part)], out=sums[1:])
        a = start[inside] - at
        # Shift every difference to the same power instead of dividing.
        out[inside] = (sums[a + length[inside]] - sums[a]) * base[CHUNK - 1 - a]
        todo = np.setdiff1d(todo, inside, assume_unique=True)
    return out


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... ``count`` numbers for each element."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a:a+length] equals data[b:b+length], for each pair."""
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 4096):
        s = slice(at, at + 4096)
        differ = data[_spread(a[s], length[s])] != data[_spread(b[s], length[s])]
        owner = np.repeat(np.arange(len(a[s])), length[s])
        out[s] = np.bincount(owner[differ], minlength=len(a[s])) == 0
    return out


def _send_runs(buckets: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(bucket=[], shard=[], kind=[], blob=[])
        number = key[0].as_py()
        shard = Shard.of(left)
        keys, doc, start, count = shard.runs()
        bucket, rest, several, place = _held(keys, doc, buckets)
        wanted = several.copy()
        for b, bits in zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True):
            a, z = np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right")
            wanted[a:z] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a).astype(bool)
        use = wanted[place]
        doc, start, count, place = doc[use], start[use], count[use], place[use]
        length = count + WIDTH - 1
        # Equal runs of the shard: the smallest document's stand for all, the others are repeats.
        ident = _run_hashes(shard.data, start, length)
        order = np.lexsort((start, doc, ident, length, place))
        doc, start, length, place, ident = doc[order], start[order], length[order], place[order], ident[order]
        new = np.ones(len(doc), bool)
        new[1:] = (place[1:] != place[:-1]) | (length[1:] != length[:-1]) | (ident[1:] != ident[:-1])
        owner = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        later = shard.ids[doc] > shard.ids[doc[owner]]
        later[later] = _same_bytes(shard.data, start[later], start[owner[later]], length[later])
        spans = np.zeros(int(later.sum()), _SPAN)
        spans["doc"], spans["length"] = doc[later], length[later]
        spans["start"] = start[later] - shard.starts[doc[later]]
        out = {"bucket": [number % buckets], "shard": [number], "kind": [1], "blob": [spans.tobytes()]}
        doc, start, length, place = doc[~later], start[~later], length[~later], place[~later]
        edges = np.flatnonzero(np.append(True, bucket[place[1:]] != bucket[place[:-1]])) if len(place) else np.zeros(0, np.int64)
        for a, z in zip(edges, np.append(edges[1:], len(place))[:len(edges)], strict=True):
            runs = np.zeros(z - a, _RUN)
            runs["key"], runs["doc"], runs["length"], runs["id"] = rest[place[a:z]], doc[a:z], length[a:z], shard.ids[doc[a:z]]
            runs["start"] = start[a:z] - shard.starts[doc[a:z]]
            columns = b"".join(runs[f].tobytes() for f in _RUN.names)
            body = columns + shard.data[_spread(start[a:z], length[a:z])].tobytes()
            packed = pa.compress(body, "zstd", asbytes=True)
            out["bucket"].append(int(bucket[place[a]]))
            out["shard"].append(number)
            out["kind"].append(0)
            out["blob"].append(np.array([z - a, len(body)], "<u8").tobytes() + packed)
        return _table(**out)

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = (int(x) for x in np.frombuffer(blob[:16], "<u8"))
    body = pa.decompress(blob[16:], decompressed_size=size, codec="zstd", asbytes=True)
    runs, at = np.zeros(n, _RUN), 0
    for f in _RUN.names:
        runs[f] = np.frombuffer(body, _RUN[f], n, at)
        at += n * _RUN[f].itemsize
    return runs, np.frombuffer(body, np.uint8, size - at, at)


def _codes(data: np.ndarray) -> np.ndarray:
    """16-bit hash of the SYMBOL bytes at every position."""
    w = _words(data)[:len(data) - SYMBOL + 1]
    tail = data[8:8 + len(w)].astype(np.uint64) << np.uint64(8) | data[9:9 + len(w)]
    h = (w ^ tail * _B) * _A
    h ^= h >> np.uint64(31)
    return (h * _C >> np.uint64(48)).astype(np.uint16)


def merged_intervals(data: np.ndarray, window: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows in merged order, and the number of the interval each is in.

    ``window`` holds the places of windows in ``data``, ordered by ``shard`` (numbered from 0).
    """
    n, rounds = len(window), WIDTH // SYMBOL
    codes = _codes(data)
    symbol = [codes[window + WIDTH - SYMBOL * (k + 1)] for k in range(rounds)]
    small = shard.astype(np.uint16 if n and shard[-1] < 1 << 16 else np.int64)
    # Each shard's transform, shard after shard: column k holds, in order of the last k symbols, the symbol before them.
    own, columns = np.arange(n), []
    for k in range(rounds):
        column = symbol[k][own]
        columns.append(column)
        own = own[np.argsort(column, kind="stable")]
        own = own[np.argsort(small[own], kind="stable")]
    # Merge: ``z`` is the interleave, ``block`` numbers the runs of equal suffixes in it.
    z, block = small, np.zeros(n, np.int64)
    unread = np.empty(n, np.int64)
    for column in columns:
        unread[np.argsort(z, kind="stable")] = np.arange(n)
        read = column[unread]
        step = np.argsort(read, kind="stable")
        z, read, before = z[step], read[step], block[step]
        block = np.zeros(n, np.int64)
        block[1:] = np.cumsum((read[1:] != read[:-1]) | (before[1:] != before[:-1]))
    unread[np.argsort(z, kind="stable")] = np.arange(n)
    return own[unread], block


def _equal_next(data: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Whether each window has the same bytes as the one after it."""
    w = _words(data)
    same = np.ones(max(len(window) - 1, 0), bool)
    for at in (*range(0, WIDTH - 8, 8), WIDTH - 8):
        value = w[window + at]
        same &= value[1:] == value[:-1]
    return same


def repeats(data: np.ndarray, window: np.ndarray, shard: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each window's bytes also start in a document with a smaller id."""
    order, block = merged_intervals(data, window, shard)
    out = np.zeros(len(window), bool)
    if not len(order):
        return out
    first = np.append(True, block[1:] != block[:-1])
    mixed = block[1:][(block[1:] == block[:-1]) & ~_equal_next(data, window[order])]
    if len(mixed):  # hashes agreed, bytes do not: order these blocks by their bytes
        inside = np.flatnonzero(np.isin(block, mixed))
        strings = np.array([data[p:p + WIDTH].tobytes().hex() for p in window[order[inside]]])
        order[inside] = order[inside[np.lexsort((strings, block[inside]))]]
        same = _equal_next(data, window[order])
        first[1:] |= ~same
    at = np.flatnonzero(first)
    least = np.minimum.reduceat(ids[order], at)
    out[order] = ids[order] > np.repeat(least, np.diff(np.append(at, len(order))))
    return out


def _merge_bucket(key: tuple, table: pa.Table) -> pa.Table:
    """Spans of repeats for each shard with runs in the bucket."""
    out: dict[str, list] = {"shard": [], "blob": []}
    runs, texts, owners = [], [], []
    rows = sorted(zip(table.column("shard").to_pylist(), table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True), key=lambda r: r[:2])
    shards: list[int] = []
    for number, kind, blob in rows:
        if kind == 1:  # repeats within the shard pass through
            if blob:
                out["shard"].append(number)
                out["blob"].append(blob)
            continue
        own, text = _unpack(blob)
        runs.append(own)
        texts.append(text)
        owners.append(np.full(len(own), len(shards)))
        shards.append(number)
    if not runs:
        return _table(**out)
    run, data, owner = np.concatenate(runs), np.concatenate(texts), np.concatenate(owners)
    place = np.cumsum(run["length"], dtype=np.int64) - run["length"]
    windows = run["length"].astype(np.int64) - WIDTH + 1
    order = np.argsort(run["key"], kind="stable")  # shards stay in order within a key
    total = np.cumsum(windows[order])
    last = np.flatnonzero(np.append(run["key"][order][1:] != run["key"][order][:-1], True))
    found: list[list[np.ndarray]] = [[] for _ in shards]
    at = 0
    while at < len(order):
        before = total[at - 1] if at else 0
        fits = last[(last >= at) & (total[last] <= before + BATCH_WINDOWS)]
        stop = (fits[-1] if len(fits) else last[last >= at][0]) + 1
        part = order[at:stop]
        part = part[np.argsort(owner[part], kind="stable")]
        at = stop
        _, shard = np.unique(owner[part], return_inverse=True)
        length = run["length"][part].astype(np.int64)
        text = data[_spread(place[part], length)]
        begin = np.cumsum(length) - length
        window = _spread(begin, windows[part])
        of = np.repeat(np.arange(len(part)), windows[part])
        repeated = repeats(text, window, shard[of], run["id"][part][of])
        if not repeated.any():
            continue
        edge = np.flatnonzero(repeated & ~np.append(False, repeated[:-1] & (of[1:] == of[:-1])))
        close = np.flatnonzero(repeated & ~np.append(repeated[1:] & (of[1:] == of[:-1]), False))
        spans = np.zeros(len(edge), _SPAN)
        spans["doc"] = run["doc"][part][of[edge]]
        spans["start"] = run["start"][part][of[edge]] + (window[edge] - begin[of[edge]])
        spans["length"] = close - edge + WIDTH
        to = owner[part][of[edge]]
        cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        for a, z in zip(cuts, [*cuts[1:], len(to)], strict=True):
            found[to[a]].append(spans[a:z])
    for number, spans in zip(shards, found, strict=True):
        if spans:
            out["shard"].append(number)
            out["blob"].append(np.concatenate(spans).tobytes())
    return _table(**out)


def _cut(id_name: str, id_type: pa.DataType, with_kept: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            shard = Shard.of(left)
            spans = np.frombuffer(b"".join(right.column("blob").to_pylist()), _SPAN)
            change = np.zeros(len(shard.data) + 1, np.int32)
            begin = shard.starts[spans["doc"]] + spans["start"]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + spans["length"], -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            edge[shard.starts[:-1][shard.starts[:-1] < len(gone)]] |= gone[shard.starts[:-1][shard.starts[:-1] < len(gone)]]
            ids = shard.table.column("__own")
        else:
            shard, ids = None, pa.array([], id_type)
        rows: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": [], "kept": []}
        for a, z in zip(shard.starts[:-1], shard.starts[1:], strict=True) if shard else []:
            kept = shard.data[a:z][~gone[a:z]].tobytes()
            starts = np.flatnonzero(edge[a:z])
            stops = np.flatnonzero(gone[a:z] & ~np.append(gone[a + 1:z], False))
            rows["n_bytes"].append(int(z - a))
            rows["n_removed"].append(int(z - a) - len(kept))
            rows["n_spans"].append(len(starts))
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["spans"].append(np.stack([starts, stops + 1 - starts], axis=1).ravel().tolist())
            rows["kept"].append(kept)
        kinds = {"kept_sha256": pa.string(), "spans": pa.list_(pa.int64()), "kept": pa.binary()}
        names = [n for n in rows if with_kept or n != "kept"]
        return pa.table({id_name: ids, **{n: pa.array(rows[n], kinds.get(n, pa.int64())) for n in names}})

    return run


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, with_kept: bool = False,
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` and, on request, ``kept``.

    A worker holds one shard (measured: 100 MB for 4 MB of text, most of it buffers of ``CHUNK``) or one bucket.
    Larger shards send fewer, longer messages: take 64 MB where a Python worker may hold 2 GB.
    ``spans`` lists start and length of the maximal removed runs in turn, in bytes; ``kept`` holds the remaining bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    own, text = F.col(id_col), whole_text(text_col)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(1, -(-size // group_bytes))
    # A bucket gets what 16 shards hold at most; with few shards it gets less, for more tasks.
    buckets = max(8, min(8192, shards), shards // 16)
    rows = docs.select(own.alias("__own"), F.coalesce(own.cast("long"), F.lit(LAST_ID)).alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("__id", "__hash"), F.lit(shards)).cast("int"))
    by_shard = rows.groupBy("shard")
    keys = by_shard.applyInArrow(_send_keys(buckets), "bucket int, shard int, blob binary")
    answers = keys.groupBy("bucket").applyInArrow(_answer_keys, "bucket int, shard int, blob binary")
    runs = by_shard.cogroup(answers.groupBy("shard")).applyInArrow(_send_runs(buckets), "bucket int, shard int, kind int, blob binary")
    spans = runs.groupBy("bucket").applyInArrow(_merge_bucket, "shard int, blob binary")
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    cut = _cut(id_col, to_arrow_type(docs.schema[id_col].dataType), with_kept)
    return by_shard.cogroup(spans.groupBy("shard")).applyInArrow(cut, schema + ", kept binary" * with_kept)
