"""Personal data: exact base patterns, and spans found by a semi-Markov conditional random field.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping per kind; matches
that fail their check are dropped. The field then looks at regions: words with digits or @ that stand next
to each other, with the word before them. A region is cut into tokens; a segment of at most ``LONGEST``
tokens may be an entity of one kind, all else is single tokens outside. Features describe the whole span
(digits, grouping, separators, check sums, neighbours). Dynamic programming over segment ends chooses
boundaries and kinds together, over the whole region however long; weights are those of the conditional likelihood, by gradient steps in numpy.

The field learns from at most ``sample`` regions of the corpus (those with the smallest hash): base spans are
its entities, and rewritten ones (other separators, no country code, defanged dots) teach it the
variants that the patterns miss; spoilt ones (check sum, octets) are outside. A span is added if it overlaps
no base span, passes its kind's check and beats the best reading without it by ``MARGIN``.

Defined results: null text is empty and has no spans; repeated rows have equal results; an empty table gives an
empty table. Other columns are ignored. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks, first_schema, stage

KINDS = ("email", "ip", "card", "phone")
LONGEST = 20
MOST_GROUPS = 6
MARGIN = 2.0
SAMPLE = 600
LONGEST_LESSON = 160
MOST_CHARS = 400  # of a span
SCORED = 4096
BATCH_BYTES = 1 << 22

Span = tuple[int, int, str]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile("[0-9@]")
_BLANK = re.compile(r"\s")
_CHAIN = re.compile(r"\S*(?:[ \t][^\s0-9@]*[0-9@]\S*)*")
_WORD_BEFORE = re.compile(r"[^\W\d_]{1,30}[:=]?[ \t]$")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\[\.\]|.", re.S)
_HINTS = {  # fixed values: words that announce a kind
    "email": ("email", "mail", "contact"), "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "mastercard"), "phone": ("phone", "tel", "call", "fax", "mobile"),
}


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind as listed. Time is linear in the text."""
    out: list[Span] = []
    at = text.find("@")
    after = 0
    while at >= 0:  # every match holds one @: the longest run of local signs before it, the domain behind
        local = len(text[after:at]) - len(text[after:at].rstrip(_LOCAL)) if at > after else 0
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            out.append((at - local, domain.end(), "email"))
            after = domain.end()
        else:
            after = max(after, at + 1)
        at = text.find("@", at + 1)
    for run in _DOTTED.finditer(text):  # four numbers at a time, from the left
        parts = list(_NUMBER.finditer(text, run.start(), run.end()))
        for i in range(0, len(parts) - 3, 4):
            if _octets([p.group() for p in parts[i:i + 4]]):
                out.append((parts[i].start(), parts[i + 3].end(), "ip"))
    for m in _CARD.finditer(text):
        digits = digits_of(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(digits_of(m.group())) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=_order))


@dataclass(frozen=True)
class Region:
    text: str
    tokens: list[str]
    starts: list[int]

    @classmethod
    def of(cls, text: str) -> Region:
        found = list(_TOKEN.finditer(text))
        return cls(text, [m.group() for m in found], [m.start() for m in found])


def regions(text: str) -> Iterator[tuple[int, str]]:
    """(start, region), in order and apart from each other."""
    done = 0
    sign = _SIGN.search(text)
    while sign:
        at = sign.start()
        # Back to the start of the word, a stretch at a time.
        while at > done and not _BLANK.match(text, at - 1):
            step = max(done, at - 64)
            part = text[step:at]
            at = step + len(part) - len(part.rsplit(None, 1)[-1]) if _BLANK.search(part) and not part[-1].isspace() else step
        end = _CHAIN.match(text, at).end()
        before = _WORD_BEFORE.search(text[max(done, at - 40):at])
        if before:
            at -= len(before.group())
        done = end
        yield at, text[at:end]
        sign = _SIGN.search(text, done)


_NAMES = [
    "bias", "digits<7", "digits=7", "digits8-9", "digits=10", "digits=11", "digits12-13", "digits14-19", "digits>19", "plus", "paren",
    "one@", "dots>=1", "tail", "ip_shape", "octets", "luhn", "one_separator", "mixed_separators", "no_separator", "groups_phone", "groups_card",
    "letters", "glued_left", "glued_right", "hint_email", "hint_ip", "hint_card", "hint_phone", "blank", "odd_sign", "groups_other",
]
_INDEX = {n: i for i, n in enumerate(_NAMES)}
_PHONE_GROUPS = {(3, 3, 4), (1, 3, 3, 4), (2, 3, 3, 4), (3, 4), (2, 4, 4), (2, 3, 4, 4)}
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (16,), (15,), (4, 4, 4, 4, 3)}


def span_features(region: Region, i: int, j: int) -> list[int] | None:
    """Features of tokens i..j as one span; None if it can be no entity."""
    tokens = region.tokens
    head, tail = tokens[i], tokens[j - 1]
    if not (head[0].isalnum() or head in "+(") or not tail[-1].isalnum():
        return None
    span = "".join(tokens[i:j])
    groups = tuple(len(g) for g in re.findall("[0-9]+", span))
    n, at = sum(groups), span.count("@")
    if n < 7 and at != 1 and len(groups) != 4:
        return None
    names = ["bias"]
    if at != 1:
        names.append("digits<7" if n < 7 else "digits=7" if n == 7 else "digits8-9" if n < 10 else "digits=10" if n == 10 else "digits=11" if n == 11
                     else "digits12-13" if n < 14 else "digits14-19" if n < 20 else "digits>19")
        if re.search(r"[^\W\d_]", span):
            names.append("letters")
    separators = {c for c in span if not c.isalnum()}
    if head == "+":
        names.append("plus")
    if "(" in separators:
        names.append("paren")
    if at == 1:
        names.append("one@")
        host = span.split("@")[1]
        if "." in host:
            names.append("dots>=1")
        if re.search(r"\.[A-Za-z]{2,6}$", host):
            names.append("tail")
    elif len(groups) == 4 and re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}", span):
        names.append("ip_shape")
        if _octets(re.findall("[0-9]+", span)):
            names.append("octets")
    if n >= 12 and at != 1 and luhn(digits_of(span)):
        names.append("luhn")
    if at != 1:
        names.append("no_separator" if not separators else "one_separator" if len(separators) == 1 else "mixed_separators")
        names.append("groups_phone" if groups in _PHONE_GROUPS else "groups_card" if groups in _CARD_GROUPS else "groups_other")
    if any(c in " \t" for c in span):
        names.append("blank")
    if separators - set("+(). -@_%[]"):
        names.append("odd_sign")
    if i and (tokens[i - 1][-1].isalnum() or tokens[i - 1] in "@_+"):
        names.append("glued_left")
    if j < len(tokens) and (tokens[j][0].isalnum() or tokens[j] in "@_" or tokens[j] in ".-[.]" and j + 1 < len(tokens) and tokens[j + 1][0].isalnum()):
        names.append("glued_right")
    before = "".join(tokens[max(0, i - 3):i]).lower()
    names += [f"hint_{k}" for k in KINDS if any(h in before for h in _HINTS[k])]
    return [_INDEX[n] for n in names]


def candidates(region: Region) -> list[tuple[int, int, list[int]]]:
    """(first token, end, features) of every segment of bounded length that may be an entity."""
    return list(each_candidate(region))


def each_candidate(region: Region) -> Iterator[tuple[int, int, list[int]]]:
    n = len(region.tokens)
    edges = [*region.starts, len(region.text)]
    numbers = [t[0] in "0123456789" for t in region.tokens]
    sizes = [len(t) if d else 0 for t, d in zip(region.tokens, numbers, strict=True)]
    for i in range(n):
        if region.tokens[i].isspace():
            continue
        groups = digits = ats = 0
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            if edges[j] - edges[i] > MOST_CHARS:
                break
            groups += numbers[j - 1]
            digits += sizes[j - 1]
            ats += region.tokens[j - 1] == "@"
            if ats > 1 or not ats and groups > MOST_GROUPS:
                break
            if ats or digits >= 7 or groups == 4:
                found = span_features(region, i, j)
                if found is not None:
                    yield i, j, found


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # kind x feature


def _scores(cands: list, weights: np.ndarray) -> np.ndarray:
    """candidate x kind."""
    return np.array([weights[:, f].sum(axis=1) for _, _, f in cands]).reshape(-1, len(KINDS))


def _marginals(n: int, cands: list, score: np.ndarray) -> np.ndarray:
    """Probability of each (candidate, kind); tokens outside score 0."""
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    heads: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (i, j, _) in enumerate(cands):
        ends[j].append(c)
        heads[i].append(c)
    total = np.logaddexp.reduce(score, axis=1) if len(cands) else np.zeros(0)
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[cands[c][0]] + total[c] for c in ends[j])])
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[cands[c][1]] + total[c] for c in heads[i])])
    edge = np.array([alpha[i] + beta[j] for i, j, _ in cands]) - alpha[n]
    return np.exp(np.minimum(edge[:, None] + score, 0.0)) if len(cands) else np.zeros((0, len(KINDS)))


def train(lessons: list[tuple[str, list[Span]]], *, rounds: int = 12, rate: float = 0.3, decay: float = 2e-3) -> Model:
    """Adagrad steps on the conditional log-likelihood of the lessons' segmentations."""
    weights = np.zeros((len(KINDS), len(_NAMES)))
    weights[:, 0] = -2.0
    seen = np.full_like(weights, 1e-3)
    data = []
    for text, spans in lessons:
        region = Region.of(text)
        cands = candidates(region)
        if not cands:
            continue
        end_of = {a: k for k, a in enumerate([*region.starts, len(text)])}
        gold = {(end_of.get(a), end_of.get(z)): KINDS.index(k) for a, z, k in spans}
        data.append((len(region.tokens), cands, [(c, gold[i, j]) for c, (i, j, _) in enumerate(cands) if (i, j) in gold]))
    for _ in range(rounds):
        for at in range(0, len(data), 16):
            grad = -decay * weights
            for n, cands, gold in data[at:at + 16]:
                p = _marginals(n, cands, _scores(cands, weights))
                for c, k in gold:
                    grad[k, cands[c][2]] += 1
                for c in np.flatnonzero(p.max(axis=1) > 1e-4):
                    grad[:, cands[c][2]] -= p[c][:, None]
            seen += grad * grad
            weights += rate * grad / np.sqrt(seen)
    return Model(weights)


def _valid(kind: str, text: str) -> bool:
    digits = digits_of(text)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}", text)) and _octets(re.findall("[0-9]+", text))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", text)


def decode(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """Entities of a region's best segmentation, each with its lead over the best one without it.

    Only candidates that score above 0, the score of tokens outside, are kept: no other is in a best
    segmentation. Time and memory are linear in the region, as segments are bounded.
    """
    region = Region.of(text)
    n = len(region.tokens)
    cands: list[tuple[int, int, float, int]] = []
    every = each_candidate(region)
    while part := list(islice(every, SCORED)):
        score = _scores(part, model.weights)
        kind, best = score.argmax(axis=1), score.max(axis=1)
        cands += [(part[c][0], part[c][1], float(best[c]), int(kind[c])) for c in np.flatnonzero(best > 0)]
    if not cands:
        return []
    ends: dict[int, list[int]] = {}
    heads: dict[int, list[int]] = {}
    for c, (i, j, _, _) in enumerate(cands):
        ends.setdefault(j, []).append(c)
        heads.setdefault(i, []).append(c)
    value, back, rest = [0.0] * (n + 1), [-1] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):  # the best up to j
        value[j] = value[j - 1]
        for c in ends.get(j, ()):
            if value[cands[c][0]] + cands[c][2] > value[j]:
                value[j], back[j] = value[cands[c][0]] + cands[c][2], c
    for i in range(n - 1, -1, -1):  # the best from i on
        rest[i] = max([rest[i + 1], *(cands[c][2] + rest[cands[c][1]] for c in heads.get(i, ()))])

    def without(chosen: int) -> float:
        """Each segmentation has one segment over the chosen one's first token; the best with another there."""
        at = cands[chosen][0]
        best = value[at] + rest[at + 1]
        for i in range(max(0, at - LONGEST + 1), at + 1):
            for c in heads.get(i, ()):
                if c != chosen and cands[c][1] > at:
                    best = max(best, value[i] + cands[c][2] + rest[cands[c][1]])
        return best

    out, j, top = [], n, value[n]
    edges = [*region.starts, len(text)]
    while j:
        c = back[j]
        if c >= 0:
            i, j, _, kind = cands[c]
            out.append((edges[i], edges[j], KINDS[kind], top - without(c)))
            j = i
        else:
            j -= 1
    return out[::-1]


def find(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, spans added by the field)."""
    text = text or ""
    base = base_spans(text)
    covered: list[list[int]] = []  # base spans as disjoint intervals
    for a, z, _ in base:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], z)
        else:
            covered.append([a, z])
    starts = [a for a, _ in covered]
    added: list[Span] = []
    for at, region in regions(text):
        if len(digits_of(region)) < 4 and "@" not in region:
            continue
        for a, z, kind, lead in decode(region, model):
            a, z = a + at, z + at
            k = bisect_left(starts, z) - 1  # the last interval that starts before the span ends
            if lead >= MARGIN and _valid(kind, text[a:z]) and (k < 0 or covered[k][1] <= a):
                added.append((a, z, kind))
    return base, added


def lessons_of(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """The region itself, its variants with rewritten entities, and spoilt ones without."""
    out = [(text, spans)]
    for a, z, kind in spans[:1]:
        own = text[a:z]
        digits = digits_of(own)
        new: list[tuple[str, bool]] = []
        if kind == "phone":
            d = digits[-10:]
            new = [(f"({d[:3]}) {d[3:6]}-{d[6:]}", True), (f"{d[:3]}-{d[3:6]}-{d[6:]}", True), (f"{d[:3]}.{d[3:6]}.{d[6:]}", True), (d[:9], False), (f"{d[:4]}-{d[4:6]}-{d[6:8]}", False)]
        elif kind == "ip":
            new = [(own.replace(".", "[.]"), True), (own.replace(".", ".9", 1).replace(".9", ".9999", 1), False), (own.rsplit(".", 1)[0], False)]
        elif kind == "card":
            wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
            new = [(".".join(re.findall(".{1,4}", digits)), True), ("  ".join(re.findall(".{1,4}", digits)), True), (wrong, False), ("-".join(re.findall(".{1,4}", wrong)), False)]
        elif kind == "email":
            new = [(own.split("@")[0], False), (own.replace("@", "@@"), False)]
        others = [s for s in spans if s != (a, z, kind)]
        if not any(x < z and a < y for x, y, _ in others):
            for value, entity in new:
                shift = len(value) - (z - a)
                moved = [(x + shift, y + shift, k) if x >= z else (x, y, k) for x, y, k in others]
                out.append((text[:a] + value + text[z:], moved + ([(a, a + len(value), kind)] if entity else [])))
    return out


def fit(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from the ``sample`` distinct regions with the smallest hash, half with and half without base spans."""
    each = sample // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's regions of either kind that can be among the sample."""
        best: dict[bool, dict[str, int]] = {True: {}, False: {}}
        limit = {True: 1 << 63, False: 1 << 63}
        for block in blocks(batches, "__text", BATCH_BYTES):
            for text in block.column("__text").to_pylist():
                for _, region in regions(text or ""):
                    rank = xxhash.xxh64_intdigest(region.encode("utf-8", "replace")) >> 1
                    if len(region) > LONGEST_LESSON or rank >= max(limit.values()):
                        continue
                    has = bool(base_spans(region))
                    best[has][region] = rank
                    if len(best[has]) >= 4 * each + 4:
                        best[has] = dict(sorted(best[has].items(), key=lambda x: x[1])[:each])
                        limit[has] = max(best[has].values(), default=limit[has])
        for has, found in best.items():
            rows = sorted(found.items(), key=lambda x: x[1])[:each]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.int64()), pa.array([has] * len(rows))], names=["region", "rank", "has"])

    found = stage(docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "region string, rank long, has boolean"), "pii-lessons")
    lessons: list[tuple[str, list[Span]]] = []
    for has in (True, False):
        for r in found.where(F.col("has") == has).distinct().orderBy("rank", "region").limit(each).collect():
            lessons += lessons_of(r.region, _one_kind_each(base_spans(r.region)))
    return train(lessons)


def _one_kind_each(spans: list[Span]) -> list[Span]:
    """Spans for the field, which may not overlap: the first of those that do."""
    out: list[Span] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def detect(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``base`` and ``added``, each an array of (kind, start, end) in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text", BATCH_BYTES):
            found = [find(t, shared.value) for t in block.column("__text").to_pylist()]
            sides = [pa.array([[{"kind": k, "start": a, "end": z} for a, z, k in sorted(x[i], key=_order)] for x in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([block.column(0), *sides], names=[id_col, "base", "added"])

    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"{first_schema(docs, id_col)}, base {one}, added {one}")


def summary(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as one string."""
    # The order of kinds at one start.
    place = "CASE s.kind WHEN 'email' THEN 0 WHEN 'ip' THEN 1 WHEN 'card' THEN 2 ELSE 3 END"

    def joined(column: str) -> str:
        return f"concat_ws(',', transform(array_sort(transform({column}, s -> struct(s.start, {place} AS o, s.end, s.kind))), s -> concat_ws(':', s.kind, s.start, s.end)))"

    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(id_col), *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("concat(base, added)")).alias("spans"))
