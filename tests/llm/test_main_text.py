import re
from html import unescape

import pytest

from quorumbook.llm.main_text import extract_main_text, main_text
from quorumbook.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
LONG = "A paragraph that is long enough to be the text of an article, with a second clause and a third one after it."


def by_hand(html):
    """What stands in the one article element of a test page; any block is a space, other markup is nothing."""
    inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    return " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))).split())


def test_query_equals_brute_force(spark):
    rows = QUERIES["op11_line_blocks"](spark, SMALL).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages) == len({r.page_id for r in rows})
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, by_hand(pages[r.page_id].html), len(r.text))


def surrounded(inside):
    return f"""<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style></head><body class="has-sidebar">
    <header><h1>Site</h1><p>{LONG}</p></header><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>
    <div class="cookie-notice">We use cookies. {LONG}</div><form><label>Name</label><input><p>{LONG}</p></form>
    {inside}
    <aside><p>{LONG}</p></aside><div id="comments"><article><p>First! {LONG}</p></article></div>
    <div data-class=x class="adBanner">{LONG}</div><script>var t = "<article><p>{LONG}</p></article>";</script>
    <footer>&copy; 2020</footer></body></html>"""


HEADLINE = "<h1>Head &amp; line</h1>"
BODY = f"{HEADLINE}<p data-class='ad'>{LONG}<p>Short.<ul><li>one<li><a href=x>two</a></ul><pre>a\n  b</pre>"
SEEN = f"Head & line {LONG} Short. one two a b"


@pytest.mark.parametrize("page", [
    surrounded(f"<article>{BODY}</article>"),
    surrounded(f"<main><div class='share'>Share</div>{BODY}</main>"),
    surrounded(f"<div role=main><nav>Up</nav>{BODY}</div>"),
    surrounded(f"<article><header>{HEADLINE}<p>by somebody</p></header>{BODY.removeprefix(HEADLINE)}<footer>x</footer></article>"),
    surrounded(f"<form action=x><div class=banner><article>{BODY}</article></div></form>"),
    surrounded(f"<article>{BODY}<div hidden>no</div><p style='display: none'>no<div class='comments'>No!</div></article>"),
])
def test_article_without_its_surroundings(page):
    assert main_text(page)[0] == SEEN


def test_surge_and_dive_without_named_article():
    links = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(30))
    page = f"<div><p>Site</p><ul>{links}</ul></div><div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><div><ul>{links}</ul>x</div>"
    text, n_lines, first, last = main_text(page)
    assert text == f"Head {LONG} {LONG}" and (n_lines, first, last) == (65, 31, 33)
    # Without any element around them the threshold alone decides: a heading beside the text belongs to it.
    flat = f"<ul>{links}</ul><h2>Head</h2><p>{LONG}<p>{LONG}<ul>{links}</ul>"
    assert main_text(flat)[0] == f"Head {LONG} {LONG}"


def test_markup_as_browsers_read_it():
    def inside(html):
        return main_text(f"<article>{html}</article>")[0]
    assert inside("<p>a<b>b</b>c<br>d<td>e") == "abc d e"
    assert inside("1 &lt; 2 &eacute; &#233; &#x1F600; &nbsp; &unknown; &notit; &amp;lt;") == "1 < 2 é é 😀 &unknown; ¬it; &lt;"
    assert inside("a<!-- <p>no --><!-->b<!DOCTYPE x><?php no ?>c</>d") == "abcd"
    assert inside("<p title='>' class=\"a>b\" data=x>t</p><p title=\"open>u</p>") == "t u"
    assert inside("x < y and a<3 <script>no</scripty></script>z") == "x < y and a<3 z"
    assert main_text("<article>a<p>b<!-- open")[0] == "a b"
    assert main_text("<article>a<p class='x")[0] == "a"
    assert main_text("<article>a<script>no")[0] == "a"


@pytest.mark.parametrize("piece", ["<", "<a ", '="', "</p>", "<b>", "<!--", "<div>", "<td>", "&", "<p title='", "<li><p>", "<div>text of a line"])
def test_long_pages_take_time_in_proportion(piece):
    assert isinstance(main_text(piece * 100_000)[0], str)


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, None, ""), (None, "u", "text"), (2, "u", "<nav>menu</nav>"), (3, "u", "<form>only</form>"),
            (4, "u", "<article><p>" + "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'clash' as text", "1 as n_chars")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract_main_text(df).collect()), key=str)
    long = ("word " * 200_000).strip()
    assert got == sorted([(1, "u", "", 0), (1, None, "", 0), (0, "u", "text", 4), (2, "u", "", 0), (3, "u", "only", 4),
                          (4, "u", long, len(long))], key=str)
    assert extract_main_text(df.where("false")).collect() == []
