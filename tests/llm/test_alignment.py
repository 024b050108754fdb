import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewatch.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """The contract token by token, over a list of texts."""
    whole, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    whole.encode_special_tokens = True
    with open(A, encoding="utf-8") as file:
        names = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    alphabet = alignment.byte_alphabet()

    def bytes_b(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def run(texts):
        docs, pairs = [], Counter()
        for text in texts:
            text = text or ""
            a, b = whole.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            at, bt = [bytes(alphabet[c] for c in names[i]) for i in a], [bytes_b(i) for i in b]
            if not text or b"".join(at) != (" " + text).encode() or b"".join(bt) != (" " + text).encode():
                docs.append(None)
                continue
            ends = []
            for tokens in (at, bt):
                n, own = 0, []
                for t in tokens:
                    n += len(t)
                    own.append(n)
                ends.append(own)
            both = set(ends[0]) & set(ends[1])
            sides = []
            for ids, own in ((a, ends[0]), (b, ends[1])):
                cut = [[]]
                for i, e in zip(ids, own):
                    cut[-1].append(str(i))
                    if e in both:
                        cut.append([])
                sides.append(cut[:-1])
            groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True)]
            at_b = dict(zip(ends[1], b, strict=True))  # no token is empty, so that one token ends at a place
            links = [(x, at_b[e]) for x, e in zip(a, ends[0], strict=True) if e in at_b]
            pairs.update(links)
            docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        top = Counter()
        for (_, y), n in pairs.items():
            top[y] = max(top[y], n)
        return [(0,) * 6 + ("",) if d is None else (*d[:3], len(d[3]), sum(pairs[p] == top[p[1]] for p in d[3]), sum(pairs[p] for p in d[3]), d[4]) for d in docs]

    return run


def compared(df, **options):
    return sorted(tuple(str(r[c]) for c in COLUMNS) for r in alignment.compare(df, A, B, **options).collect())


def expected(rows):
    return sorted(tuple(map(str, r)) for r in rows)


ODD = [
    None, "", " ", "a", "  two  blanks ", "▁x", "<0x0A>", "a\x00b\tc\r\n", "<|endoftext|> and <s> </s> <unk>", "é é ﬁ Ω   　",
    "日本語のテキスト 🙂👩‍👩‍👧 ok", "cafés naïve", "x" * 3000, " " * 5000 + "end", "the same text", "the same text", "the same text", "a▁b", "1234567890 3.14",
]


@pytest.mark.parametrize("shared", [alignment.SHARED_PAIRS, 10, 0])
def test_odd_texts_match_brute_force(spark, plain, shared):
    """Also where only a few pairs, or none, are broadcast and the others are joined on Spark."""
    df = spark.createDataFrame([(i % 3 or None, t, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, pairs string, n int").repartition(3)
    assert compared(df, shared_pairs=shared) == expected(plain(ODD))
    assert compared(df.limit(0), shared_pairs=shared) == []


def test_documents_match_brute_force(spark, table, plain):
    docs = table("documents")
    texts = [r.text for r in docs.collect()]
    wanted = plain(texts)
    assert sum(r[0] > 0 for r in wanted) > 150
    assert compared(docs) == expected(wanted)


def test_odd_rows(odd, plain):
    assert compared(odd) == expected(plain([r.text for r in odd.collect()]))


def test_fast_library_gives_the_same_ids():
    reader = alignment.Reader.of(A, B)
    assert reader.fast is not None
    for t in ODD:
        if t:
            assert list(reader.ids_a(t)) == reader.whole.encode(" " + t, add_special_tokens=False).ids
