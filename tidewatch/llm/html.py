"""Main text of HTML pages by two passes of block rules.

A page is read as blocks: runs of text between block-level tags, in page order. Text in scripts, styles,
forms, menus, footers, sidebars and the like, and in elements whose class, id or role names such a part,
is left out with its element. Where a page marks its main part (article, main), blocks outside it are
boilerplate and blocks inside it belong to the text unless they are mostly links.

Elsewhere the first pass decides by density: blocks with many linked characters are boilerplate, long
blocks with enough stop words are text, and the rest stay open. In the second pass an open block takes
the label of the nearest decided neighbour; at equal distance, that of the neighbour in the same element,
then, for headings, that of the one below, else boilerplate. Without any decided block open ones are text.

White space (after decoding character references) becomes one space; blocks are joined by two line feeds.
Null and empty pages give an empty text; so do pages without text. Broken markup never fails: unclosed
elements end with their parents, comments and scripts that are not closed run to the end. Repeated rows
are each extracted; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import blocks as cut_batches
from tidewatch.llm.common import first_schema

LONG_BLOCK = 80
STOP_DENSITY = 0.10
LINK_DENSITY = 0.4
BATCH_BYTES = 1 << 22

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be at by this have from or not but what all were we when "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er "
    "le la les de des et un une du en est que qui dans pour par sur pas au avec ce il se ne sont plus "
    "el los las del y que en un una por con no para su al lo como más se es son".split()
)
# Elements by their part in a page.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes")
LEFT_OUT = frozenset({"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "object", "canvas", "audio", "video", "map", "fieldset", "label", "input"})
MAIN = frozenset({"article", "main"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
INLINE = frozenset({
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
})
SPACED = frozenset({"br", "td", "th"})
# Names in class, id and role that mark other parts of a page.
OTHER_PARTS = re.compile(
    r"^(ads?|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|sidebar|sidebox|widgets?|menus?|nav\w*|topnav|topbar|breadcrumbs?|footer|masthead|comments?|commentlist|repl(y|ies)|respond|"
    r"discuss\w*|disqus|share|sharing|social|related|recommend\w*|login|signup|signin|register|search\w*|pagination|pager|toolbar|"
    r"copyright|disclaimer|navigation|contentinfo|complementary|dialog|skip|teasers?|trending|outbrain|taboola)$"
)
OWN_PARTS = re.compile(r"^(article|post|entry|story|content|main|body)$")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORD_EDGE = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"""[^"'>]*(?:"[^"]*"|'[^']*')?""")
_WORDS = re.compile(r"[^\W\d_]+")
_NOTE = re.compile(r"©|all rights reserved", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    left_out: bool
    main: bool
    heading: bool
    parent: int  # number of the element that holds it
    label: int = 0  # 1 text, -1 boilerplate, 0 open


def _tag_end(html: str, at: int) -> int:
    """Where the tag starting before ``at`` closes, quotes respected; -1 if it never does."""
    start = at
    while True:
        at = _QUOTED.match(html, at).end()
        if at >= len(html):
            return -1
        if html[at] == ">":
            return at
        if html[at] in "\"'":  # a quote that is never closed is an ordinary sign
            return html.find(">", start)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order."""
    at, low = 0, None
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            yield "text", html[at:], ""
            return
        if start > at:
            yield "text", html[at:start], ""
        follows = html[start + 1:start + 2]
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
        elif follows in ("!", "?"):
            end = html.find(">", start)
            at = len(html) if end < 0 else end + 1
        elif follows == "/" or follows.isalpha():
            closing = follows == "/"
            name = _TAG_NAME.match(html, start + 1 + closing)
            if name is None:  # "</" before anything else is a comment of a kind
                end = html.find(">", start)
                at = len(html) if end < 0 else end + 1
                continue
            end = _tag_end(html, name.end())
            if end < 0:
                return
            tag = name.group().lower()
            yield ("close", tag, "") if closing else ("open", tag, html[name.end():end])
            at = end + 1
            if not closing and tag in RAW and html[end - 1] != "/":
                low = html.lower() if low is None or len(low) != len(html) else low
                if len(low) == len(html):
                    found = low.find(f"</{tag}", at)
                else:  # lower case changed the length
                    hit = re.compile(f"</{tag}", re.I).search(html, at)
                    found = hit.start() if hit else -1
                at = len(html) if found < 0 else found
        else:
            yield "text", "<", ""
            at = start + 1


def _other_part(attributes: str) -> bool:
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    for names in _NAMES.findall(attributes):
        for name in names.strip("\"'").split():
            parts = [p.lower() for p in _WORD_EDGE.split(name) if p]
            if any(OTHER_PARTS.match(p) for p in parts) and not (len(parts) > 1 and OWN_PARTS.match(parts[-1])):
                return True
            if parts and parts[-1] == "header" and not any(OWN_PARTS.match(p) for p in parts):
                return True
    return False


def read_blocks(html: str) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # name, left out, in main part, number
    parts: list[str] = []
    linked = links = number = breaks = 0
    heading = False

    def flush() -> None:
        nonlocal parts, linked, breaks
        text = " ".join("".join(parts).split())
        if text:
            _, left_out, main, holder = next(x for x in reversed(stack) if x[0] not in INLINE and x[0] != "p")
            out.append(Block(text, min(linked, len(text)), stack[-1][1] or left_out, main, heading, holder))
        parts, linked, breaks = [], 0, 0

    for kind, name, attributes in tokens(html):
        if kind == "text":
            text = unescape(name)
            if stack[-1][1] and not parts:
                continue  # left out with its element
            if not text.isspace():
                breaks = 0
            parts.append(text)
            if links:
                linked += len(" ".join(text.split()))
            continue
        if name in SPACED:
            parts.append(" ")
            breaks += name == "br"
            if breaks > 1:
                flush()
            if name == "br":
                continue
        if name in INLINE and not (kind == "open" and _other_part(attributes)):
            if name == "a":
                links = max(0, links + (1 if kind == "open" else -1))
            if kind == "close":
                for i in range(len(stack) - 1, 0, -1):  # an inline element that was left out
                    if stack[i][0] not in INLINE:
                        break
                    if stack[i][0] == name:
                        flush()
                        del stack[i:]
                        break
            continue
        if name not in SPACED:
            flush()
        if kind == "open":
            links = 0 if name not in INLINE else links
            heading = name in HEADINGS
            if name in VOID:
                continue
            if name in MAIN:  # a menu or page header that was not closed ends here
                while len(stack) > 1 and stack[-1][0] in ("nav", "header", "ul", "li", "p", "menu"):
                    stack.pop()
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == name:
                stack.pop()
            _, left_out, main, _ = stack[-1]
            number += 1
            own = name in LEFT_OUT or name in RAW or _other_part(attributes) or (name == "header" and not main)
            if name not in ("html", "body"):
                left_out = left_out or own
            stack.append((name, left_out, main or name in MAIN or bool(re.search(r"""role\s*=\s*["']?main|itemprop\s*=\s*["']?articleBody""", attributes)), number))
        else:
            heading = False
            links = 0 if name not in INLINE else links
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
    flush()
    return out


def classify(page: list[Block]) -> None:
    """Set the labels: densities first, then neighbours."""
    marked = any(b.main and not b.left_out for b in page)
    for b in page:
        density = b.linked / len(b.text)
        if b.left_out or (marked and not b.main) or density > LINK_DENSITY:
            b.label = -1
        elif marked:
            b.label = 1
        elif len(b.text) < LONG_BLOCK:
            b.label = -1 if _NOTE.search(b.text) else 0
        else:
            words = _WORDS.findall(b.text.lower())
            stops = sum(w in STOP_WORDS for w in words)
            b.label = 1 if words and stops >= STOP_DENSITY * len(words) and not (_NOTE.search(b.text) and len(b.text) < 2 * LONG_BLOCK) else 0
    decided = [i for i, b in enumerate(page) if b.label]
    above, below = _nearest(page, decided)
    given = []
    for i, b in enumerate(page):
        if b.label:
            continue
        a, z = above[i], below[i]
        if a is None and z is None:
            given.append((b, 1))
        elif a is None or z is None or page[a].label == page[z].label:
            given.append((b, page[z if a is None else a].label))
        elif i - a != z - i:
            given.append((b, page[a if i - a < z - i else z].label))
        else:
            same = [page[k].label for k in (a, z) if page[k].parent == b.parent]
            given.append((b, same[0] if len(same) == 1 else page[z].label if b.heading else max(same, default=-1)))
    for b, label in given:
        b.label = label


def _nearest(page: list[Block], decided: list[int]) -> tuple[list[int | None], list[int | None]]:
    above: list[int | None] = []
    last = None
    for i, b in enumerate(page):
        above.append(last)
        last = i if b.label else last
    below: list[int | None] = [None] * len(page)
    last = None
    for i in range(len(page) - 1, -1, -1):
        below[i] = last
        last = i if page[i].label else last
    return above, below


def main_text(html: str | None) -> str:
    page = read_blocks(html or "")
    classify(page)
    return "\n\n".join(b.text for b in page if b.label > 0)


def extract(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per page: the ``keep`` columns, ``text`` and ``n_chars`` (code points)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in cut_batches(batches, "__html", BATCH_BYTES):
            texts = [main_text(h) for h in block.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column(n) for n in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, first_schema(pages, *keep) + ", text string, n_chars long")
