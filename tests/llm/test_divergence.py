import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain(rows, top=200):
    """The contract word for word, over (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, Counter(TERM.findall(text.translate(FOLD)))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        seen = Counter(t for x, _, c in found if x == lang for t in c)
        kept = {t for t, n in seen.items() if n >= 3}
        groups = {s: Counter() for x, s, _ in rows if x == lang}
        whole = Counter()
        for x, s, c in found:
            if x == lang:
                for t in kept & set(c):
                    groups[s][t] += c[t]
                    whole[t] += c[t]

        total = {id(c): sum(c.values()) + len(kept) for c in (whole, *groups.values())}

        def p(counts, t, total=total):
            return 1 + 10**9 * (counts[t] + 1) // total[id(counts)]

        for s, counts in groups.items():
            pairs = [(o, sum((p(counts, t) - p(c, t)) ** 2 // p(c, t) for t in kept)) for o, c in groups.items() if o != s]
            terms = [(t, (p(counts, t) - p(whole, t)) ** 2 // p(whole, t)) for t in kept if counts[t] and p(counts, t) > p(whole, t)]
            for part, found_values, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found_values, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


def audited(df, **options):
    rows = [tuple(r) for r in divergence.audit(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_documents_match_brute_force(table):
    docs = table("documents")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert audited(docs) == plain(rows)


@pytest.mark.parametrize("bits", [1, 5, 9])
def test_shared_digests_are_split(spark, bits):
    """With digests this narrow most terms share one; the result is the same."""
    rng = np.random.default_rng(2)
    words = ["Straße", "été", "x", "AB", "ab", "日本語", "a" * 300, *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(str(rng.choice(["en", "de"])), f"s{rng.integers(4)}", " ".join(rng.choice(words, 30))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert audited(df, bits=bits) == audited(df) == plain(rows)


def test_ties_at_the_last_rank(spark):
    """Terms with equal values go by their bytes, whatever their digests."""
    words = [f"t{a}{b}" for a in "éazÿ" for b in "pqrstuvwxy"]
    rows = [("en", "one", " ".join(words))] * 3 + [("en", "two", "other words here")] * 4
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audited(df, top=7) == plain(rows, top=7)


def test_odd_rows(spark, odd):
    rows = [(r.lang, None, r.text) for r in odd.collect()]
    df = odd.withColumn("source", odd.kept.substr(9, 1)).drop("kept").withColumnRenamed("shard", "gid")
    assert audited(df) == plain(rows)
    assert audited(df.limit(0)) == set()
    # a language without kept terms, a group without terms, null everywhere
    rows = [("en", "a", "x y"), ("en", "b", None), ("en", None, "1 2 3"), (None, None, None), (None, "q", "z"), ("en", "a", "x y"), ("en", "a", "x"), ("fr", "a", "")]
    assert audited(spark.createDataFrame(rows, "lang string, source string, text string")) == plain(rows)


def test_terms_of_a_block():
    texts = ["Ab1cd", None, "", "éÉ-x", "zz", "q" * 5000, "Z"]
    coded, row = divergence.block_terms(pa.array(texts).slice(1))
    assert list(zip(coded.to_pylist(), row.tolist(), strict=True)) == [("éÉ", 2), ("x", 2), ("zz", 3), ("q" * 5000, 4), ("z", 5)]


def test_expansion_is_cut_without_loss():
    lists = pa.array([[0] * k for k in (0, 3, 1, 12, 2)])
    ends = np.cumsum([0, 3, 1, 12, 2])
    expected = {(a, b) for lo, hi in zip([0, *ends[:-1]], ends, strict=True) for a in range(lo, hi) for b in range(lo, hi) if a != b}
    for most in (1, 5, 30, 10_000):
        found = [(int(a), int(b)) for left, right in divergence.expand(lists, most) for a, b in zip(left, right, strict=True)]
        assert len(found) == len(expected) and set(found) == expected


def test_counts_are_shuffled_without_strings(table):
    """The exchange of the counts carries digests; terms are strings only where they are combined or joined back."""
    keyed, _ = divergence._keyed(table("documents"), "lang", "source", "text")
    kept, strings = divergence.kept_terms(keyed)
    assert dict(kept.dtypes)["digest"] == "bigint" and kept.where("split != ''").isEmpty()
    assert strings.where("lo != hi").isEmpty()
