import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, texts, tokenizer, capacity):
    """Every piece holds its document's ids, and every sequence is gapless within its capacity."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected = [(k, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc]) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_table(table, tokenizer):
    docs = table("documents")
    rows = packing.pack(docs, PATH).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()}, tokenizer, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


def test_odd_rows(odd, tokenizer):
    rows = packing.pack(odd, PATH, capacity=64, with_ids=True).collect()
    check(rows, {}, tokenizer, 64)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert packing.pack(odd.limit(0), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=20))
def test_best_fit_places_everything(counts):
    placed = packing.best_fit(counts, 32)
    fill, ranks = {}, {}
    for length, rank, n, first, offset in placed.tolist():
        assert rank == ranks.get(length, 0)
        ranks[length] = rank + n
        for s in range(first, first + n):
            fill.setdefault(s, []).append((offset, length))
    assert ranks == counts
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    total = sum(k * n for k, n in counts.items())
    least = max(-(-total // 32), sum(n for k, n in counts.items() if k > 16))
    assert len(fill) <= 3 * least / 2 + 1


@pytest.mark.parametrize("text", [
    "a b", "x́ ́y", "İI Σας ΣΑΣ b", "<|endoftext|> q", "it's 12٣ ½ don't", "ﬁ\x1cx\x85y z", "👍🏽 à la​x", "", "Straße, ÉTÉ!! ét.",
    "ŉa ʼn ǅx Ǆ", "a». ªº1 Ωx. ⅷ %%%a", "ſt. İx don't.",
])
def test_words_give_the_ids_of_the_text(tokenizer, text):
    found = np.frombuffer(next(packing.Encoder.of(PATH).encode([text])), "<u4").tolist()
    assert found == tokenizer.encode(text, add_special_tokens=False).ids
    assert "<|endoftext|>" not in text or 49407 in found


def test_a_full_memory_is_cleared(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    text = "one two, three four five! six"
    assert np.frombuffer(next(packing.Encoder(PATH).encode([text])), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
