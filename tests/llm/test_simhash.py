import random

import pytest
import xxhash

from tidewatch.llm import simhash
from tidewatch.llm.graph import components


def plain_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, radius=4):
    """id of the smallest reachable item, by comparing all pairs."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i] ^ items[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


@pytest.mark.parametrize("text", [None, "", " ", "One", "a b c", "a b c d", "É A b\x0bC d e f", "x " * 200])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("free", [1, 2, 3])
def test_components_of_all_rows(spark, table, free):
    docs = table("documents")
    rows = sorted(simhash.classify(docs, free=free).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = [int(r.fingerprint, 16) for r in rows]
    assert prints == [plain_fingerprint(texts[r.doc_id]) for r in rows]
    root = plain_components(prints)
    assert [r.component_id for r in rows] == [rows[i].doc_id for i in root]


@pytest.mark.parametrize("size", [5, 60, 400])
def test_tree_links(size):
    random.seed(size)
    base = [random.getrandbits(64) for _ in range(4)]
    fps = list({random.choice(base) ^ sum({1 << random.randrange(64) for _ in range(random.randint(0, 7))}) for _ in range(size)})
    assert simhash.linked(fps, 4) == plain_components(fps)


def test_masks_cover_every_pair_in_the_radius():
    random.seed(1)
    for free in (1, 2, 4):
        masks = simhash.block_masks(4, free)
        for _ in range(300):
            difference = sum({1 << random.randrange(64) for _ in range(4)})
            assert any(not difference & m for m in masks)


def test_odd_rows(odd):
    rows = simhash.classify(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if int(r.fingerprint, 16) == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {3}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    # one document of each group; the group without any id keeps its rows
    assert [r.text for r in kept.where("doc_id IS NULL").collect()] == ["der mann und das haus"] * 2
    assert kept.where("__fp != 'a'").count() == 0
    assert simhash.classify(odd.limit(0)).count() == 0 and simhash.deduplicate(odd.limit(0)).count() == 0


def test_chain_and_hub_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1000 + i) for i in range(1, 60)]
    edges = spark.createDataFrame(chain + hub + [(5, 5)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)}
    assert components(edges.limit(0)).count() == 0
