import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import html

LONG = "This is one of the paragraphs of the text and it is long enough to be taken as such by the rules."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\n\nb"), ('<p title="a>b">c</p', "c"), ("<scr", ""),
    ("<div>x</div><!-- never closed", "x"), ("<script>x", ""), ("a < b &amp; c&nbsp;&lt;d&gt;", "a < b & c <d>"),
    ("<article><h1>T</h1><p>one<br>two</p></article><footer>f</footer>", "T\n\none two"),
    ("<nav><ul><li><a href=x>m</a></nav><article><p><b>Head.<br><p>Body <i>bo</i>ld.</p></article>", "Head.\n\nBody bold."),
    ("<main><p>Kept</p><aside>gone</aside><form>gone</form></main><div>gone</div>", "Kept"),
    (f"<div><a href=a>Home</a> <a href=b>News</a></div><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div class='sidebar'>{LONG}</div>",
     f"Title\n\n{LONG}\n\nShort.\n\n{LONG}"),
    (f"<div class='cookie-notice'>{LONG}</div><div id=post><p>{LONG}</p></div><section id='comments'><p>{LONG}</p></section><p>© 2020 All rights reserved</p>", LONG),
    (f"<div class='article-header'><h1>Name</h1></div><p>{LONG}</p><div hidden>{LONG}</div><div style='display: none'>{LONG}</div>", f"Name\n\n{LONG}"),
    ("<style>p{}</style><title>t</title><noscript>n</noscript><textarea>q</textarea><p>only</p>", "only"),
    ("<nav><p>menu<article><p>in</p></article>", "in"),
])
def test_pages(page, text):
    assert html.main_text(page) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "<p>", "</p>", "<a href='", "'", '"', "<!--", "-->", "<script>", "</script>", "&amp;", "&#x", "text ", "<nav>", "</nav>", "<article>", "<br>"]), max_size=30))
def test_broken_markup_never_fails(parts):
    text = html.main_text("".join(parts))
    assert text == text.strip() and "  " not in text


def test_time_is_linear_in_broken_pages():
    for page in ("<" * 100_000, '<a "' * 20_000, "<div>" * 20_000 + "x", "<p>x" * 20_000, "<b>x</div>" * 20_000, "<div><script>" * 10_000):
        html.main_text(page)


def test_table(table, spark):
    pages = table("pages")
    rows = html.extract(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    assert all(r.text and "<" not in r.text and "track(" not in r.text and "http" not in r.text for r in rows)
    odd = spark.createDataFrame([(1, "u", None, "x", 3), (1, "u", None, "x", 3), (None, None, "", None, None), (2, "v", "<p>" + LONG * 5000, "y", 1)],
                                "page_id long, url string, html string, text string, n_chars int")
    found = html.extract(odd).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in found] == [(1, "u", 0), (1, "u", 0), (None, None, 0), (2, "v", len(LONG) * 5000)]
    assert html.extract(odd.limit(0)).count() == 0
