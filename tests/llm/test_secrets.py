import base64
import hashlib
import random
import re
import string
import time
import uuid

import public_tokenizers
import pytest

from tidewatch.llm import secrets

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
# The base patterns as they are stated, with the least length of what must be long.
PLAIN = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}
ALPHABET = string.ascii_letters + string.digits


def plain(text):
    found = [(m.start(), m.end(), kind) for kind, (p, g, least) in PLAIN.items() for m in p.finditer(text or "") if len(m[g]) >= least]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def drawn(rng, n, alphabet=ALPHABET):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def tokenizer():
    return secrets.encoding(PATH)


def test_base_spans_match_the_stated_patterns(table):
    rng = random.Random(3)
    pieces = ["password", "PassWD", "paſſword", "toKen", "api_key", "APIKEY", "secret", "'", '"', " ", "  ", ":", "=", "==", "AKIA", "AKIAAKIA", "ABC123", "0", "deadbeef", "é", "-", "/+", ".", "abcdef0123456789", "x", "\n"]
    texts = [r.text for r in table("documents").collect()] + ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(4000)]
    assert sum(bool(plain(t)) for t in texts) > 500
    for t in texts:
        assert secrets.base_spans(t or "") == plain(t), t


def test_planted_random_strings_are_found(tokenizer):
    """Forms that no base pattern covers; at least nine in ten of each."""
    rng = random.Random(5)
    forms = {
        "base62": lambda: drawn(rng, rng.randint(20, 48)),
        "base64": lambda: base64.b64encode(rng.randbytes(rng.randint(18, 40))).decode(),
        "url": lambda: base64.urlsafe_b64encode(rng.randbytes(33)).decode().strip("-_"),
        "upper": lambda: drawn(rng, 28, string.ascii_uppercase + string.digits),
        "HEX": lambda: drawn(rng, 44, "0123456789ABCDEF"),
        "prefixed": lambda: "gh" + rng.choice("pos") + "_" + drawn(rng, 36),
    }
    for name, form in forms.items():
        caught = 0
        for _ in range(200):
            value = form()
            base, added = secrets.find(f"see the value {value} in there, please", tokenizer)
            whole = (14, 14 + len(value), "random")
            caught += whole in added or any(a <= 14 + len(value) // 2 < z for a, z, _ in base)
        assert caught >= 180, (name, caught)


def test_ordinary_text_has_no_random_strings(tokenizer, table):
    rng = random.Random(7)
    clean = [
        "internationalization of the Geschwindigkeitsbegrenzungen, antidisestablishmentarianism", "getElementsByClassName setRequestProperty HTMLInputElement2",
        "https://example.org/2024/01/02/some-longer-article-name-in-the-news", "2024-01-02T10-11-12-000000", "+1-555-010-9999-1234-5678", "=" * 40, "-" * 60, "a" * 50,
        str(uuid.UUID(int=rng.getrandbits(128))), hashlib.sha256(b"x").hexdigest().upper(), hashlib.md5(b"x").hexdigest().upper(),
        "sha256-" + base64.b64encode(hashlib.sha256(b"x").digest()).decode(), "user_profile_settings_page_title_2", "/usr/local/share/python/site-packages",
    ]
    for text in clean:
        assert secrets.find(text, tokenizer)[1] == [], text
    for r in table("documents").collect():
        for a, z, _ in secrets.find(r.text, tokenizer)[1]:
            assert re.search("[0-9]", r.text[a:z])


def test_efficiency_decides(tokenizer):
    """Without the token test every plausible run would be added."""
    text = "release2024candidate and " + drawn(random.Random(1), 30)
    assert len(secrets.find(text, tokenizer)[1]) == 1
    assert len(secrets.find(text, tokenizer, ratio=99)[1]) == 2 and secrets.find(text, tokenizer, ratio=0.5)[1] == []


def test_long_texts_take_linear_time(tokenizer):
    for part in ("token" + " " * 50, "a", "0f", "AKIA", "=", "password=", "A1b2", "-/", "é"):
        text = part * (2_000_000 // len(part))
        start = time.time()
        base, _ = secrets.find(text, tokenizer)
        assert time.time() - start < 20, part
    assert secrets.find("ab" * 1_000_000, tokenizer)[0] == [(0, 2_000_000, "hex")]


def test_table_and_odd_rows(spark, odd, table):
    docs = table("documents")
    rows = {r.doc_id: r for r in secrets.summary(secrets.detect(docs, PATH)).collect()}
    tokenizer = secrets.encoding(PATH)
    for r in docs.collect():
        base, added = secrets.find(r.text, tokenizer)
        got, joined = rows[r.doc_id], lambda s: ",".join(f"{k}:{a}:{z}" for a, z, k in s)
        assert [got.n_assign, got.n_access, got.n_hex, got.n_random] == [sum(k == x for *_, k in base + added) for x in secrets.KINDS]
        assert got.base_sha256 == hashlib.sha256(joined(plain(r.text)).encode()).hexdigest()
        assert got.spans == joined(sorted(base + added, key=secrets._order))
    found = secrets.summary(secrets.detect(odd, PATH)).collect()
    assert len(found) == odd.count() and all(r.spans == "" and r.n_random == 0 for r in found)
    assert secrets.detect(odd.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(None, "token = abcdefghijkl"), (None, "token = abcdefghijkl"), (1, None)], "doc_id long, text string")
    assert sorted(r.spans for r in secrets.summary(secrets.detect(twice, PATH)).collect()) == ["", "assign:0:20", "assign:0:20"]
