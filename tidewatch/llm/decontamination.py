"""Benchmark decontamination in DataFrame operations only.

Words are the runs of letters and digits in lower case; shingles are ``WORDS`` of them in a row, hashed
to 64 bits. An item of n words is compared with every window of n words of a document (with the whole
document if that is shorter) by the weighted Jaccard similarity of their shingles, repeats counted.

1. Region filter. Two bags of m shingles are ``threshold`` similar only if they share at least
   2 t m / (1 + t). Positions whose shingle occurs in some item of n words are found by one join
   against the items' shingles; a window of n words with fewer such positions cannot match any item
   of that size, and no other window is left out. This says where to look, not which item.
2. Every remaining window gets a 64-bit SimHash of its shingles. Window and items of its size meet if they
   agree in one of ``radius + 1`` blocks of bits, which holds for all pairs within the radius.
3. Pairs within the radius are verified by the exact weighted similarity.

Defined results: null texts and items, and items without a word, match nothing. Items with fewer than
``WORDS`` words are one shingle of all their words. Of windows that tie, the first is reported. Repeated
rows each count; a document found twice for an item is reported once per (id, text). Other columns are
ignored by ``matches`` and carried by ``decontaminate``, whatever their names.
An empty table on either side gives no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import free_prefix, stage

WORDS = 5
THRESHOLD = 0.8
#: Similarity 0.8 differs by 10 bits on average (standard deviation 3).
RADIUS = 18
BITS = 64
#: Rows of 8 to 40 bytes, and 8-byte numbers of items with their shingles; beyond that the joins shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_NUMBERS = 4_000_000

SIMHASH = (
    "aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(cast(2 * aggregate({h}, 0, (a, x) -> a + cast(getbit(x, b) AS int))"
    " > size({h}) AS bigint), b))"
)
#: Shared shingles of two bags, repeats counted.
SHARED = "aggregate(array_distinct({a}), 0, (n, v) -> n + least(size(filter({a}, y -> y = v)), size(filter({b}, y -> y = v))))"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hashes(words: str, size: int) -> Column:
    """Hash of each run of ``size`` words, in order."""
    parts = ", ".join(f"get({words}, i + {k})" for k in range(size))
    return F.expr(f"IF(size({words}) < {size}, array(), transform(sequence(0, size({words}) - {size}), i -> xxhash64({parts})))")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a staged table if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _blocks(fp: str, radius: int) -> Column:
    """(block, its bits) for each of the ``radius + 1`` blocks."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.col(fp).bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(_masks(radius))])


def _masks(radius: int) -> list[int]:
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _first_block(difference: Column, radius: int) -> Column:
    return F.coalesce(*[F.when(difference.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(_masks(radius))])


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    words = benchmark.select(F.col(item_col).alias("item_id"), _words(F.col(text_col)).alias("__w"))
    sized = words.withColumn("n", F.size("__w")).where("n > 0").withColumn("size", F.least("n", F.lit(WORDS)))
    cases = F.coalesce(*[F.when(F.col("size") == s, _hashes("__w", s)) for s in range(1, WORDS + 1)])
    hashed = sized.select("item_id", "n", "size", cases.alias("item_hashes"))
    return stage(hashed.withColumn("item_fp", F.expr(SIMHASH.format(h="item_hashes"))), "decon-items")


def matches(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS,
) -> DataFrame:
    """One row per document and item: id, ``item_id``, ``similarity``, ``distance`` (bits), ``start_word``, ``n_words``, ``__key``."""
    items = _items(benchmark, item_col, item_text_col)
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most WORDS values
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), F.xxhash64(id_col, text_col).alias("__key"))
    texts = texts.where("__text IS NOT NULL")
    seeds = stage(items.select("n", "size", F.explode("item_hashes").alias("__h")).distinct(), "decon-seeds")
    found = None
    for size in sizes or [WORDS]:
        # Only the key and a hash are exploded; the words stay behind. The outer form keeps the optimizer from
        # testing the array's size in a filter below, where it would split the text again for every word.
        words = texts.select("__key", _words(F.col("__text")).alias("__w"))
        hashes = words.select("__key", F.size("__w").alias("__n_words"), _hashes("__w", size).alias("__hs"))
        rows = hashes.select("__key", "__n_words", F.posexplode_outer("__hs").alias("__at", "__h"))
        hits = rows.join(_small(seeds.where(F.col("size") == size)), "__h").select("__key", "__n_words", "n", "size", "__at")
        found = hits if found is None else found.unionByName(hits)
    regions = stage(_regions(found, threshold), "decon-regions")
    keys = stage(regions.select("__key").distinct(), "decon-keys")
    near = texts.join(_small(keys), "__key", "left_semi").select("doc_id", "__key", _words(F.col("__text")).alias("__w"))
    windows = None
    for size in sizes or [WORDS]:
        hashes = near.select("doc_id", "__key", _hashes("__w", size).alias("__hs"))
        own = hashes.join(regions.where(F.col("size") == size), "__key")
        own = own.select("doc_id", "__key", "n", "size", "__hs", F.explode("__starts").alias("start_word"))
        own = own.select("doc_id", "__key", "n", "start_word", F.expr("slice(__hs, start_word + 1, n - size + 1)").alias("__wh"))
        windows = own if windows is None else windows.unionByName(own)
    windows = windows.where("size(__wh) > 0").withColumn("__fp", F.expr(SIMHASH.format(h="__wh")))
    parts = windows.select("*", F.explode_outer(_blocks("__fp", radius)).alias("__b")).select(*windows.columns, "__b.block", "__b.bits")
    targets = items.select("item_id", "n", "item_hashes", "item_fp", F.explode(_blocks("item_fp", radius)).alias("__b"))
    targets = targets.select("item_id", "n", "item_hashes", "item_fp", "__b.block", "__b.bits")
    held = items.agg(F.coalesce(F.sum(F.size("item_hashes") + 8), F.lit(0))).first()[0]
    if held * (radius + 1) <= BROADCAST_NUMBERS:
        targets = F.broadcast(targets)
    difference = F.col("__fp").bitwiseXOR(F.col("item_fp"))
    pairs = parts.join(targets, ["n", "block", "bits"])
    pairs = pairs.where((F.bit_count(difference) <= radius) & (F.col("block") == _first_block(difference, radius)))
    pairs = pairs.withColumn("__shared", F.expr(SHARED.format(a="item_hashes", b="__wh")))
    scored = pairs.withColumn("similarity", F.col("__shared") / (F.size("item_hashes") + F.size("__wh") - F.col("__shared")))
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("__s"), F.bit_count(difference).alias("distance"), F.col("n").alias("n_words")))
    out = scored.where(F.col("similarity") >= threshold).groupBy("doc_id", "__key", "item_id").agg(best.alias("__m"))
    return out.select("doc_id", "item_id", "__m.similarity", "__m.distance", (-F.col("__m.__s")).alias("start_word"), "__m.n_words", "__key")


def _regions(hits: DataFrame, threshold: float) -> DataFrame:
    """Per document and item size: the starts of windows that hold enough shingles of items of that size."""
    by = hits.groupBy("__key", "n", "size").agg(F.array_sort(F.collect_set("__at")).alias("__p"), F.max("__n_words").alias("__n_words"))
    by = by.withColumn("__m", F.col("n") - F.col("size") + 1)
    least = 2 * threshold / (1 + threshold)
    # The small allowance keeps rounding from raising a whole bound by one.
    by = by.withColumn("__x", F.greatest(F.lit(1), F.ceil(F.col("__m") * least - 1e-9).cast("int")))
    starts = F.expr("""
        CASE WHEN __n_words < n THEN IF(size(__p) >= {t}D * __m - 1e-9D, array(0), array())
             WHEN size(__p) < __x THEN array()
             ELSE array_distinct(flatten(transform(sequence(0, size(__p) - __x), k ->
               IF(get(__p, k + __x - 1) - get(__p, k) < __m
                  AND greatest(get(__p, k + __x - 1) - __m + 1, 0) <= least(get(__p, k), __n_words - n),
                  sequence(greatest(get(__p, k + __x - 1) - __m + 1, 0), least(get(__p, k), __n_words - n)),
                  array()))))
        END""".format(t=threshold))
    return by.select("__key", "n", "size", starts.alias("__starts")).where("size(__starts) > 0")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows without a match, all columns as they are. Null texts stay."""
    found = matches(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    bad = stage(found.select(F.col("doc_id").alias("__bad"), F.col("__key").alias("__bad_key")).distinct(), "decon-found")
    key = free_prefix(docs, "__key")
    marked = docs.withColumn(key, F.xxhash64(id_col, text_col)).alias("d")
    same = (F.col(f"d.{key}") == F.col("b.__bad_key")) & F.col(f"d.{id_col}").eqNullSafe(F.col("b.__bad"))
    return marked.join(_small(bad).alias("b"), same, "left_anti").select(*docs.columns)
