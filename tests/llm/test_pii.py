import hashlib
import random
import re

import pytest

from tidewatch.llm import pii

# The patterns of the contract.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = pii.digits_of(m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.mark.parametrize("alphabet, size", [("a@..1234 -+()", 60), ("0123456789" * 3 + " -.+", 200), ("é@a.b-1 ", 30), ("+1(). -", 40)])
def test_base_spans_are_those_of_the_patterns(alphabet, size):
    random.seed(size)
    for _ in range(4000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, size)))
        assert pii.base_spans(text) == brute(text), text


def test_hard_texts_take_linear_time():
    for text in ("a" * 300_000, "a@" * 50_000, "1." * 50_000, "1" * 100_000, "+1(" * 50_000, "1 " * 50_000):
        pii.base_spans(text)


def test_regions_hold_every_sign():
    random.seed(7)
    for _ in range(3000):
        text = "".join(random.choice(["ab", "1", "@", " ", "\n", ".", "x" * 70, "tel: ", "\u00a0", "9 "]) for _ in range(random.randint(0, 25)))
        found, at = list(pii.regions(text)), 0
        inside = set()
        for a, region in found:
            assert a >= at and text[a:a + len(region)] == region
            at = a + len(region)
            inside |= set(range(a, at))
        assert {i for i, c in enumerate(text) if c in "0123456789@"} <= inside


def test_luhn():
    assert pii.luhn("4041894974608795") and not pii.luhn("4041894974608794")


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_base_spans_stay_and_variants_are_found(table, model):
    docs = table("documents")
    rows = pii.summary(pii.detect(docs, model)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.digest(base).encode()).hexdigest()
        assert [getattr(r, f"n_{k}") for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert {pii.digest([s]) for s in base} <= set(r.spans.split(",")) | {""}
    for text, kind in (("call (988) 555-2485 now", "phone"), ("ip 42[.]144[.]35[.]254 x", "ip"), ("card 4041.8949.7460.8795 ok", "card")):
        base, added = pii.find(text, model)
        assert not base and [s[2] for s in added] == [kind]
    for text in ("in 2020-2021 and 10,000", "1234567890", "a@b", "at 12:13:14", "300.1.1.1", "no digits"):
        assert pii.find(text, model) == ([], [])


def test_dynamic_programme_against_all_segmentations():
    """The best segmentation, the partition sum and the marginals, by listing all of them."""
    import numpy as np

    rng = np.random.default_rng(2)
    region = pii.Region.of("tel 988-555-2485 or 1.2.3.4")
    cands = pii.candidates(region)
    assert cands
    cands = cands[:9]
    score = rng.normal(size=(len(cands), len(pii.KINDS)))
    n = len(region.tokens)

    def all_from(at):
        if at == n:
            yield ()
            return
        yield from all_from(at + 1)
        for c, (i, j, _) in enumerate(cands):
            if i == at:
                for k in range(len(pii.KINDS)):
                    for rest in all_from(j):
                        yield ((c, k), *rest)

    ways = list(all_from(0))
    weight = np.exp([sum(score[c, k] for c, k in w) for w in ways])
    expected = np.zeros_like(score)
    for w, x in zip(ways, weight / weight.sum(), strict=True):
        for c, k in w:
            expected[c, k] += x
    assert np.allclose(pii._marginals(n, cands, score), expected)


def test_odd_rows(odd, model):
    rows = pii.summary(pii.detect(odd, model)).collect()
    assert len(rows) == odd.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" for r in rows if r.doc_id in (3, 4, 5))
    assert pii.detect(odd.limit(0), model).count() == 0
    assert pii.find("call 5", pii.fit(odd.limit(0))) == ([], [])


def test_spans_anywhere_in_a_long_region_are_found(model):
    """A line of many numbers is one region: no span is lost at a cut, none is the end of a longer number."""
    for shift in range(125, 140):
        text = " ".join(["x1"] * shift + ["(988) 555-2485"] + ["x1"] * 200)
        base, added = pii.find(text, model)
        assert not base and (text.index("("), text.index("(") + 14, "phone") in added, shift
    number = "7" * 388 + "4041894974608795"
    assert pii.find(f"{number} 1", model) == ([], [])


def test_leads_against_all_segmentations(model):
    import numpy as np

    text = "tel (988) 555-2485 or 42[.]144[.]35[.]254 4041.8949.7460.8795"
    region = pii.Region.of(text)
    cands = pii.candidates(region)
    best = np.array([model.weights[:, f].sum(axis=1) for _, _, f in cands]).max(axis=1)
    edges = [*region.starts, len(text)]

    def top(banned=None):
        value = [0.0]
        for j in range(1, len(region.tokens) + 1):
            value.append(max([value[-1], *(value[a] + best[c] for c, (a, z, _) in enumerate(cands) if z == j and c != banned)]))
        return value[-1]

    found = pii.decode(text, model)
    assert len(found) >= 3
    for a, z, _, lead in found:
        c = next(c for c, (i, j, _) in enumerate(cands) if (edges[i], edges[j]) == (a, z))
        assert abs(lead - (top() - top(c))) < 1e-9
