"""Divergence of a source's words from the other sources of its language, with strings joined back late.

A scan task counts its terms by (lang, source) in numpy and gives each term a 64-bit digest. What is shuffled
for the counts is fixed in width: keys of language and group, digest, occurrences, documents. Beside the counts a
task writes each of its terms once; the least and the greatest string of each digest are combined over the
tasks. Where they differ, several terms share the digest, and a second pass over the texts counts the terms
of just these digests by their strings, so that the result is exact for any digest width (``bits``). All further
work (kept terms, probabilities, divergences, the 200 best values) is on digests; strings are joined to the rows
that are put out, and to those that tie with the last of them.

A pair of sources needs a value for every kept term. With p0 and q0 the values of terms that a group lacks,
the sum is one over distinct counts of either group (a histogram) against the other's p0 or q0, plus a
correction for the terms that both have. Those are expanded in numpy in chunks of bounded size, and leave a task as one
partial sum per pair of sources.

Defined results: null text, lang and source are read as ''. Every row counts as a document, repeated ones too, whatever its
id. A very long text is one document, read in full; a term may have any length. A group without kept terms has its pair rows, with the
values that counts of 0 give, and no term rows; a language without kept terms has 0 for all pairs. Ties go by the
UTF-8 bytes of the item. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks, stage, whole_text

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
BITS = 64
BLOCK_BYTES = 1 << 21
PENDING_ROWS = 700_000
EXPANDED = 1 << 20
_LETTERS = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c > 0x7F else 0 for c in range(256)], np.uint8)
_COUNTS = pa.schema([("lid", pa.int64()), ("gid", pa.int64()), ("digest", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_DDL = "lid long, gid long, digest long, term string, n long, docs long"


def block_terms(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the block's texts in turn, dictionary-coded, and the row of each."""
    text = text.cast(pa.large_binary())
    edges = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    low = _LETTERS[np.frombuffer(data, np.uint8)[edges[0]:edges[-1]]] if data is not None and edges[-1] > edges[0] else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    inside = low != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = edges[:-1][edges[:-1] < len(low)]
    opens[first] = inside[first]
    starts = np.flatnonzero(opens)
    letters = np.cumsum(inside, dtype=np.int64)
    at = np.append(letters[starts] - 1, letters[-1] if len(letters) else 0)
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(low[inside])])
    return terms.dictionary_encode(), np.searchsorted(edges, starts, "right") - 1


def block_counts(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(a row of the group, term code, occurrences, documents) for the block's groups and terms, and its terms."""
    coded, row = block_terms(block.column("__text"))
    code, width = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    in_doc, n = np.unique(row * width + code, return_counts=True)
    _, first, group = np.unique(block.column("gid").to_numpy(), return_index=True, return_inverse=True)
    key, inverse = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, inverse, n)
    return first[key // width], key % width, total, np.bincount(inverse, minlength=len(key)), coded.dictionary


def digests(terms: pa.Array, bits: int) -> np.ndarray:
    """The lowest ``bits`` of each term's XXH64, signed."""
    full = np.array([xxhash.xxh64_intdigest(t) for t in terms.cast(pa.large_binary()).to_pylist()], np.uint64)
    return (full if bits == 64 else full & np.uint64((1 << bits) - 1)).view(np.int64)


class _Pending:
    """Partial counts of a task by ``keys``, merged when there are many and let go when merging does not help."""

    def __init__(self, keys: list[str], sums: list[str]) -> None:
        self.keys, self.sums, self.parts, self.rows = keys, sums, [], 0

    def add(self, part: pa.Table) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.rows += part.num_rows
        if self.rows > PENDING_ROWS:
            self.parts = [self._merged()]
            self.rows = self.parts[0].num_rows
            if self.rows > PENDING_ROWS // 2:
                yield from self.out()

    def _merged(self) -> pa.Table:
        table = pa.concat_tables(self.parts).group_by(self.keys).aggregate([(c, "sum") for c in self.sums])
        return table.rename_columns([*self.keys, *self.sums])

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            table = self._merged()
            full = pa.Table.from_arrays([table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in _COUNTS], schema=_COUNTS)
            self.parts, self.rows = [], 0
            yield from full.to_batches(max_chunksize=100_000)


def _counted(docs: DataFrame, bits: int, *, strings: bool) -> DataFrame:
    """Partial counts of every task. With ``strings`` each count row holds its term; else terms are rows of their own, once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Pending(["lid", "gid", "digest"] + ["term"] * strings, ["n", "docs"])
        names = _Pending(["digest", "term"], [])
        for block in blocks(batches, "__text", BLOCK_BYTES):
            at, code, n, seen, terms = block_counts(block)
            if not len(at):
                continue
            digest = digests(terms, bits)
            own = {"lid": block.column("lid").take(pa.array(at)), "gid": block.column("gid").take(pa.array(at)), "digest": digest[code], "n": n, "docs": seen}
            if strings:
                own["term"] = terms.take(pa.array(code)).cast(pa.string())
            else:
                yield from names.add(pa.table({"digest": digest, "term": terms.cast(pa.string())}))
            yield from counts.add(pa.table(own))
        yield from names.out()
        yield from counts.out()

    return docs.select("lid", "gid", "__text").mapInArrow(run, _DDL)


def _keyed(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(lid, gid, __text) and the staged groups (lid, gid, lang, source); a seed is taken under which no two keys meet."""
    for seed in range(100):
        lid, gid = F.xxhash64(F.lit(seed), F.col("lang")), F.xxhash64(F.lit(seed), F.col("lang"), F.lit("/"), F.col("source"))
        named = docs.select(whole_text(lang_col).alias("lang"), whole_text(source_col).alias("source"), whole_text(text_col).alias("__text"))
        groups = stage(named.select("lang", "source").distinct().select("lang", "source", lid.alias("lid"), gid.alias("gid")), "divergence-groups")
        seen = groups.agg(F.count("*").alias("n"), F.countDistinct("gid").alias("g"), F.countDistinct("lang").alias("langs"), F.countDistinct("lid").alias("l")).first()
        if seen.n == seen.g and seen.langs == seen.l:
            return named.select(lid.alias("lid"), gid.alias("gid"), "__text"), groups
    raise RuntimeError("no seed keeps all groups apart")


def _probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact; ``total`` is the count's sum plus the number of kept terms."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), F.greatest(total, F.lit(1)).cast("decimal(20,0)"))


def _divergence(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def kept_terms(docs: DataFrame, bits: int = BITS, *, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Staged counts (lid, gid, digest, split, n, lang_n, opens) of kept terms, and the staged strings (digest, lo, hi).

    ``split`` is '' unless several terms have the digest, then the term. ``opens`` marks one row of each (lid, term).
    """
    parts = stage(_counted(docs, bits, strings=False), "divergence-counts")
    strings = stage(parts.where(F.col("term").isNotNull()).groupBy("digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi")), "divergence-strings")
    shared = strings.where("lo != hi").select("digest")
    counts = parts.where(F.col("term").isNull()).select("lid", "gid", "digest", "n", "docs")
    term = ["lid", "digest"]
    if not shared.isEmpty():
        split = _counted(docs, bits, strings=True).join(shared, "digest", "left_semi").select("lid", "gid", "digest", "n", "docs", F.col("term").alias("split"))
        counts = counts.join(shared, "digest", "left_anti").withColumn("split", F.lit("")).unionByName(split)
        term.append("split")
    # Dealt by term: the sums by group and the sums by language need no other shuffle.
    by_group = counts.repartition(*term).groupBy(*term, "gid").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy(*term)
    kept = by_group.select(*term, "gid", "n", F.sum("n").over(over).alias("lang_n"), F.sum("docs").over(over).alias("lang_docs"), (F.col("gid") == F.min("gid").over(over)).alias("opens"))
    if "split" not in term:
        kept = kept.withColumn("split", F.lit(""))
    return stage(kept.where(F.col("lang_docs") >= least_docs).drop("lang_docs"), "divergence-kept"), strings


def _statistics(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Staged, one row per group: names, ``total`` and ``lang_total`` (counts plus kept terms), ``lacks`` (p of a term not there), ``v``, ``has``."""
    by_lang = kept.groupBy("lid").agg(F.sum(F.col("opens").cast("long")).alias("v"), F.sum("n").alias("lang_n"))
    by_group = kept.groupBy("gid").agg(F.sum("n").alias("n"), F.count("*").alias("has"))
    found = groups.join(by_lang, "lid", "left").join(by_group, "gid", "left").fillna(0, ["v", "lang_n", "n", "has"])
    found = found.select("lid", "gid", "lang", "source", "v", "has", (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"))
    return stage(found.withColumn("lacks", _probability(F.lit(0), F.col("total"))), "divergence-groups")


def expand(lists: pa.ListArray, most: int = EXPANDED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) in the flattened values of all pairs of different entries of a list, at most ``most`` a time unless one entry has more."""
    length = lists.value_lengths().to_numpy().astype(np.int64)
    first = np.cumsum(length) - length
    per, start = np.repeat(length, length), np.repeat(first, length)
    done = np.cumsum(per)
    at = 0
    while at < len(per):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, "right")))
        left = np.repeat(np.arange(at, stop), per[at:stop])
        right = np.arange(len(left)) - np.repeat(np.cumsum(per[at:stop]) - per[at:stop], per[at:stop]) + start[left]
        yield left[left != right], right[left != right]
        at = stop


def _shared_terms(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """(gid, other, both): over the terms that both groups have, what their values add to those of terms that one lacks."""
    valued = kept.join(stats.select("gid", "total", "lacks"), "gid").select(
        "lid", "digest", "split", "gid", _probability(F.col("n"), F.col("total")).alias("p"), "lacks")
    by_term = valued.groupBy("lid", "digest", "split").agg(F.collect_list(F.struct("gid", "p", "lacks")).alias("g")).where(F.size("g") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}

        def out() -> pa.RecordBatch:
            a, b = zip(*sums, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sums.values(), pa.int64())], names=["gid", "other", "both"])

        for batch in batches:
            values = batch.column("g").flatten()
            if not len(values):
                continue
            gid, p, lacks = (values.field(i).to_numpy() for i in range(3))
            names, code = np.unique(gid, return_inverse=True)
            for left, right in expand(batch.column("g")):
                def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                    return (a - b) * (a - b) // b

                value = f(p[left], p[right]) - f(p[left], lacks[right]) - f(lacks[left], p[right]) + f(lacks[left], lacks[right])
                key = code[left] * len(names) + code[right]
                order = np.argsort(key, kind="stable")
                key, opens = np.unique(key[order], return_index=True)
                for k, v in zip(key.tolist(), np.add.reduceat(value[order], opens).tolist() if len(opens) else (), strict=True):
                    pair = (int(names[k // len(names)]), int(names[k % len(names)]))
                    sums[pair] = sums.get(pair, 0) + v
            if len(sums) > PENDING_ROWS:
                yield out()
                sums.clear()
        if sums:
            yield out()

    return by_term.select("g").mapInArrow(run, "gid long, other long, both long").groupBy("gid", "other").agg(F.sum("both").alias("both"))


def pair_values(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """(gid, other, lang, source, item, value) of every ordered pair of a language's sources."""
    other = stats.select("lid", F.col("gid").alias("other"), F.col("lacks").alias("other_lacks"), F.col("has").alias("other_has"), F.col("source").alias("item"))
    counted = kept.groupBy("lid", "gid", "n").agg(F.count("*").alias("k")).join(stats.select("gid", "total"), "gid")
    counted = counted.select("lid", "gid", "k", _probability(F.col("n"), F.col("total")).alias("p"))
    own = counted.join(other, "lid").where("gid != other").groupBy("gid", "other").agg(F.sum(F.expr(f"k * {_divergence('p', 'other_lacks')}")).alias("own"))
    lacking = stats.select("lid", F.col("gid").alias("base"), "lacks")
    against = counted.join(lacking, "lid").where("gid != base").groupBy(F.col("base").alias("gid"), F.col("gid").alias("other")).agg(
        F.sum(F.expr(f"k * {_divergence('lacks', 'p')}")).alias("against"))
    pairs = stats.join(other, "lid").where("gid != other")
    for part in (own, against, _shared_terms(kept, stats)):
        pairs = pairs.join(part, ["gid", "other"], "left")
    neither = f"(v - has - other_has) * {_divergence('lacks', 'other_lacks')}"
    value = F.expr(f"CASE WHEN v = 0 THEN 0L ELSE coalesce(own, 0L) + coalesce(against, 0L) + coalesce(both, 0L) + {neither} END")
    return pairs.select("gid", "other", "lang", "source", "item", value.alias("value"))


def term_values(kept: DataFrame, stats: DataFrame, strings: DataFrame, top: int) -> DataFrame:
    """(gid, lang, source, item, value) of each group's ``top`` values and those equal to the last of them."""
    valued = kept.join(stats.select("gid", "total", "lang_total"), "gid").select(
        "gid", "digest", "split", _probability(F.col("n"), F.col("total")).alias("p"), _probability(F.col("lang_n"), F.col("lang_total")).alias("q"))
    valued = valued.where("p > q").select("gid", "digest", "split", F.expr(_divergence("p", "q")).alias("value"))
    # Spark keeps `top` rows of a group on each partition before the shuffle.
    best = valued.select("gid", "value").withColumn("__k", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("__k") <= top)
    least = best.groupBy("gid").agg(F.min("value").alias("least"))
    chosen = valued.join(least, "gid").where("value >= least").join(strings, "digest")
    return chosen.select("gid", F.when(F.col("split") == "", F.col("lo")).otherwise(F.col("split")).alias("item"), "value").join(stats.select("gid", "lang", "source"), "gid")


def audit(
    docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int = TOP,
    least_docs: int = LEAST_DOCS, bits: int = BITS,
) -> DataFrame:
    """``lang``, ``source``, ``part`` ('pair' or 'term'), ``item``, ``value``, ``rank``."""
    keyed, groups = _keyed(docs, lang_col, source_col, text_col)
    kept, strings = kept_terms(keyed, bits, least_docs=least_docs)
    stats = _statistics(kept, groups)
    order = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item"))
    pairs = pair_values(kept, stats).select("lang", "source", F.lit("pair").alias("part"), "item", "value", order.alias("rank"))
    terms = term_values(kept, stats, strings, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", order.alias("rank"))
    return pairs.unionByName(terms.where(F.col("rank") <= top))
