import hashlib
import random

import numpy as np
import pytest

from tidewatch.llm import suffixes


def brute(rows):
    first = {}
    for doc, text in rows:
        b, doc = (text or "").encode(), suffixes.LAST_ID if doc is None else doc
        for p in range(len(b) - 49):
            first[b[p:p + 50]] = min(first.get(b[p:p + 50], suffixes.LAST_ID), doc)
    out = []
    for doc, text in rows:
        b, own = (text or "").encode(), suffixes.LAST_ID if doc is None else doc
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < own:
                gone[p:p + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, **options).collect()], key=str)


@pytest.mark.parametrize("group_bytes", [300, 5000, 1 << 20])
def test_against_brute_force(spark, group_bytes):
    random.seed(9)
    passages = ["".join(random.choice("abcdé ") for _ in range(random.randint(40, 140))) for _ in range(6)]
    made = ["".join(random.choice(passages)[random.randint(0, 20):] + random.choice(["", "zz", "q" * 60]) for _ in range(4)) for _ in range(12)]
    rows = [(random.choice([i, i, i // 2, None]), random.choice([None, "", "ab" * 80, "x" * i, *passages, *made])) for i in range(70)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=group_bytes) == brute(rows)


def test_spans_and_kept_bytes(spark):
    passage = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(40))
    rows = [(1, "start " + passage), (2, passage + " middle é " + passage)]
    found = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()}
    n = len(passage)
    assert found[1].spans == [] and bytes(found[1].kept).decode() == rows[0][1]
    # " middle " borders the second passage with the same blank that "start " ends in
    assert found[2].n_spans == 2 and found[2].spans[:2] == [0, n]
    assert bytes(found[2].kept).decode() == " middle é"


def test_odd_rows(odd):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert suffixes.remove_repeats(odd.limit(0)).count() == 0


def test_merge_splits_blocks_whose_hashes_agree(monkeypatch):
    """With a hash that never tells symbols apart all windows meet in one block; bytes decide."""
    monkeypatch.setattr(suffixes, "_codes", lambda data: np.zeros(len(data) - suffixes.SYMBOL + 1, np.uint16))
    a, b = b"a" * 49 + b"b", b"c" * 50
    data = np.frombuffer(a + b + a + b, np.uint8)
    window, shard, ids = np.array([0, 50, 100, 150]), np.array([0, 0, 1, 1]), np.array([1, 2, 3, 1])
    assert suffixes.repeats(data, window, shard, ids).tolist() == [False, True, True, False]


def test_merged_order_is_by_symbols():
    rng = np.random.default_rng(4)
    strings = [rng.integers(97, 99, 50).astype(np.uint8) for _ in range(6)]
    picks = rng.integers(0, 6, 200)
    data = np.concatenate([strings[p] for p in picks])
    window, shard = np.arange(200) * 50, np.sort(rng.integers(0, 9, 200))
    shard = np.unique(shard, return_inverse=True)[1]
    order, block = suffixes.merged_intervals(data, window, shard)
    assert sorted(order.tolist()) == list(range(200))
    assert len(set(block.tolist())) == len(set(picks.tolist()))
    assert all(len({picks[o] for o in order[block == k]}) == 1 for k in set(block.tolist()))
