"""Secrets: fixed base patterns, and random strings found by how poorly a tokenizer packs them.

A byte-pair vocabulary learnt from ordinary text spends one token on several characters of a word, a name or a path, but
hardly more than one and a half on a key drawn at random. Runs of ``LEAST`` or more characters of the usual key alphabets
(Base62, Base64, hex, with ``=`` padding at the end) that hold letters and digits, or change case often, are
encoded; those with fewer than ``ratio`` characters a token are added as kind ``random``. Known digests
and identifiers are left out first: hex of the length of a common digest in either case, ``sha256-`` style integrity values, UUIDs,
and numbers with separators. A span is added only if it overlaps no base span.

Base spans (assign, access, hex) are leftmost and non-overlapping per kind, and matches that fail their length are dropped.

Defined results: null text is empty and has no spans; repeated rows have equal results; an empty table gives an
empty table; texts of any length are read whole, in time linear in their length. Rows without an id keep their null id. Ties: spans of one
start go by kind as listed in ``KINDS``. Other columns are ignored. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks, first_schema

KINDS = ("assign", "access", "hex", "random")
LEAST = 16
RATIO = 2.0
CASE_CHANGES = 4
FEWEST_LETTERS = 3  # dates, times and numbers with units have fewer
BATCH_BYTES = 1 << 22

Span = tuple[int, int, str]

_ASSIGN = re.compile(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
# Words that open an assignment, in lower case; hex lengths of common digests (CRC-64 to SHA-512).
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_DIGEST_LENGTHS = frozenset((16, 32, 40, 48, 56, 64, 96, 128))
_HEX_ANY = re.compile(r"[0-9A-F]+|[0-9a-f]+")
_UUID = re.compile(r"(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")
_INTEGRITY = re.compile(r"(?i:(?:md5|sha(?:1|224|256|384|512))[-_/].*)", re.S)
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
_CASE_CHANGE = re.compile("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")

_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def _order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind as listed."""
    out: list[Span] = []
    low = text.encode("utf-8", "replace").lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A stretch of sixteen hex digits lies within a run of the wider alphabet.
    for a, z in key_runs(text) if runs is None else runs:
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, a, z) if m.end() - m.start() >= 16]
    return sorted(out, key=_order)


def key_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of the key alphabets with ``LEAST`` characters or more, in order."""
    return [m.span() for m in _RUN.finditer(text)]


def known(value: str) -> bool:
    """Digests and identifiers that are random by nature but no secrets."""
    if _HEX_ANY.fullmatch(value):
        return len(value) in _DIGEST_LENGTHS or not _LETTER.search(value)
    return bool(_UUID.fullmatch(value) or _INTEGRITY.fullmatch(value))


def plausible(value: str) -> bool:
    """Letters and digits together, or frequent changes of case: words of prose have neither."""
    if len(_LETTER.findall(value)) < FEWEST_LETTERS:
        return False
    return bool(_DIGIT.search(value)) or sum(1 for _ in _CASE_CHANGE.finditer(value)) >= CASE_CHANGES


def efficiency(value: str, tokenizer) -> float:
    """Characters a token."""
    return len(value) / max(len(tokenizer.encode_ordinary(value)), 1)


def find(text: str | None, tokenizer, *, ratio: float = RATIO) -> tuple[list[Span], list[Span]]:
    """(base spans, random strings that overlap none of them)."""
    text = text or ""
    runs = key_runs(text)
    base = base_spans(text, runs)
    # Of base spans up to a start, how far the farthest reaches.
    starts, reach = [], []
    for a, z, _ in base:
        starts.append(a)
        reach.append(max(z, reach[-1]) if reach else z)
    added: list[Span] = []
    for a, z in runs:
        # Separators at the ends are none of the value, but padding is.
        while a < z and text[a] in "+/_-":
            a += 1
        while z > a and text[z - 1] in "+/_-":
            z -= 1
        value = text[a:z]
        if z - a < LEAST or not plausible(value) or known(value):
            continue
        k = bisect_left(starts, z) - 1
        if (k < 0 or reach[k] <= a) and efficiency(value, tokenizer) < ratio:
            added.append((a, z, "random"))
    return base, added


def detect(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """One row per document: id, ``base`` and ``added``, each an array of (kind, start, end) in order.

    ``vocabulary`` is the path of a tiktoken rank file, the same on every executor.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(vocabulary)
        for block in blocks(batches, "__text", BATCH_BYTES):
            found = [find(t, tokenizer, ratio=ratio) for t in block.column("__text").to_pylist()]
            sides = [pa.array([[{"kind": k, "start": a, "end": z} for a, z, k in x[i]] for x in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([block.column(0), *sides], names=[id_col, "base", "added"])

    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"{first_schema(docs, id_col)}, base {one}, added {one}")


def summary(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as one string."""
    place = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))

    def joined(column: str) -> str:
        ordered = f"array_sort(transform({column}, s -> struct(s.start, CASE s.kind {place} END AS o, s.end, s.kind)))"
        return f"concat_ws(',', transform({ordered}, s -> concat_ws(':', s.kind, s.start, s.end)))"

    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        F.col(id_col), *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("concat(base, added)")).alias("spans"),
        F.size("added").cast("long").alias("n_random"))
