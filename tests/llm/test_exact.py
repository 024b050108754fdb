import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import exact


def brute(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault("".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for members in groups.values():
        best = min(members)
        keep = None if best[1] else best[2]
        for m in members:
            out.append((None if m[1] else m[2], keep, len(members), m[3] == best[3]))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.classify(df).collect()], key=str)


def test_against_brute_force(spark):
    random.seed(3)
    rows = [(random.choice([None, i, i, i // 2]), random.choice([None, "", " ", "ab", "a b", "abc", "ab\nc", "é", "x" * 500, "x" * 499 + "y"])) for i in range(200)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute(rows)


def test_small_budget_gives_the_same(spark, table):
    docs = table("documents").select("doc_id", "text")
    usual = {r.doc_id for r in exact.owners(docs).collect()}
    assert {r.doc_id for r in exact.owners(docs, budget=1000).collect()} == usual


def test_a_text_is_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, None)], "doc_id long, text string")
    found = exact.owners(docs)
    assert [f.name for f in found.schema if f.dataType.simpleString() in ("string", "binary")] == ["text", "__dedup_sha"]
    assert sorted((r.doc_id, r["__dedup_count"]) for r in found.collect()) == [(1, 2), (3, 1)]


def test_odd_rows(odd):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    kept = exact.deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({exact.normalised(r.text) for r in odd.collect()})
    assert exact.classify(odd.limit(0)).count() == 0 and exact.deduplicate(odd.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=6), max_size=40))
def test_trie_is_a_map(keys):
    trie, expected = exact.Trie(), {}
    for k in keys:
        trie.insert(k, 1, lambda a, b: a + b)
        expected[k] = expected.get(k, 0) + 1
    assert dict(trie.pop()) == expected
    assert trie.held == 0


def test_heaviest_subtree_leaves_alone():
    trie = exact.Trie()
    for k in (b"aaaa", b"aabb", b"b"):
        trie.insert(k, k, None)
    assert dict(trie.pop(trie.heaviest())) == {b"aaaa": b"aaaa", b"aabb": b"aabb"}
    assert dict(trie.pop()) == {b"b": b"b"}
