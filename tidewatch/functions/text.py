"""Text cleaning, counting and phrase matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.constants import ANALYSIS_ORDER, CHUNK_CHARS, EMOJI_RUN, RISK_PHRASES, SCORER_CHARS

# Whitespace as Unicode defines it, plus the four ASCII separators Java leaves out.
_SPACE = r"[\s\x1c-\x1f]"
_SOLID = r"[^\s\x1c-\x1f]"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def normalise(c: Column) -> Column:
    """Lower case; drop links, mentions and hash signs; single spaces; trimmed."""
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, rf"(?U)http{_SOLID}+", "")
    t = F.regexp_replace(t, rf"(?U)www{_SOLID}+", "")
    t = F.regexp_replace(t, r"@[\p{L}\p{N}_]+", "")
    t = F.replace(t, F.lit("#"), F.lit(""))
    return F.trim(F.regexp_replace(t, rf"(?U){_SPACE}+", " "))


def word_count(clean: Column) -> Column:
    """Words of text that ``normalise`` already reduced to single spaces."""
    return F.when(clean == "", 0).otherwise(occurrences(clean, " ") + 1).cast("int")


def emoji_runs(c: Column) -> Column:
    """Runs of emoji. Every counted code point starts with the bytes F0 9F, so other texts skip the pattern."""
    possible = F.contains(c.cast("binary"), F.lit(bytes((0xF0, 0x9F))))
    return F.when(possible, F.regexp_count(c, F.lit(EMOJI_RUN))).otherwise(F.lit(0))


def occurrences(c: Column, char: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))).cast("int")


def hits(lowered: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur in text already in lower case, as substrings."""
    return sum((F.contains(lowered, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def phrase_score(c: Column, phrases: Sequence[str] = RISK_PHRASES, fold_lexicon: bool = True) -> Column:
    """How many of the phrases occur in the lower-cased text; the text is lowered once.

    ``fold_lexicon=False`` leaves phrases as written, so those with capitals never match.
    """
    needles = [p.lower() if fold_lexicon else p for p in phrases]
    one = F.array(F.lower(F.coalesce(c, F.lit(""))))
    return F.element_at(F.transform(one, lambda t: hits(t, needles)), 1)


def any_phrase(c: Column, phrases: Sequence[str]) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def risk_label(score: Column) -> Column:
    return F.when(score > 0, "high_risk").otherwise("low_risk")


def analysis_text(columns: Sequence[str], suffix: str = "_en") -> Column:
    """Newline join of the non-empty text columns, in their fixed order."""
    parts = [
        F.when(F.col(c + suffix) != "", F.col(c + suffix))
        for c in ANALYSIS_ORDER
        if c + suffix in columns
    ]
    return strip(F.concat_ws("\n", *parts)) if parts else F.lit("")


def chunks(c: Column, size: int = CHUNK_CHARS) -> Column:
    """Consecutive slices of ``size`` characters; empty text has none."""
    last = F.floor((F.length(c) - 1) / size).cast("int")
    slices = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(c, i * size + 1, F.lit(size))
    )
    return F.when(F.length(c) > 0, slices).otherwise(F.array().cast("array<string>"))


def scorer_input(c: Column) -> Column:
    """What a scorer sees: the reference length limit of one model call."""
    return F.substring(F.coalesce(c, F.lit("")), 1, SCORER_CHARS)


def ellipsis(c: Column, width: int = 88) -> Column:
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("…"))).otherwise(c)
