"""Main text of pages labelled by hand."""

import pytest

from phasegrid.llm.html_extract import blocks_of, extract_main_text, graph_of, main_text, min_cut

LONG = "A paragraph of the article that has a good number of words in it."
MORE = "Another paragraph of the article, long enough as well to stay where it is."
AD = "Buy the best shoes of the year now, and get the second pair for half the price."
PAGES = {
    "everyday word in a name": (f"<article><p class='share-price'>{LONG}</p><p>{MORE}</p></article>", [LONG, MORE]),
    "section named related work": (f"<article><h1>T</h1><p>{LONG}</p><section class='related-work'><h2 id='related-work'>Related work</h2><p>{MORE}</p></section></article>", ["T", LONG, "Related work", MORE]),
    "comments on the law": (f"<article><p>{LONG}</p><div id='comments-on-the-law'><p>{MORE}</p><p>Short.</p></div></article>", [LONG, MORE, "Short."]),
    "label inside a sentence": ("<article><p><label>Figure 1</label> shows the way of the water.</p></article>", ["Figure 1 shows the way of the water."]),
    "formula inside a sentence": ("<article><p>Let <math><mi>x</mi></math> be a number.</p></article>", ["Let x be a number."]),
    "only a list": ("<ul><li>One</li><li>Two</li></ul>", ["One", "Two"]),
    "linked advert in an unnamed box": (f"<article><p>{LONG}</p><div class='box-7'><a href=x>{AD}</a></div><p>{MORE}</p></article>", [LONG, MORE]),
    "cookie bar": (f"<div class='cmp-layer'><p>We and our partners use cookies to store data.</p></div><article><p>{LONG}</p></article>", [LONG]),
    "cookie bar without a name": (f"<div><p>We use cookies.</p></div><div><h1>T</h1><p>{LONG}</p><p>Ok.</p><p>{MORE}</p></div>", ["T", LONG, "Ok.", MORE]),
    "reactions in the article": (f"<article><p>{LONG}</p><div class='discussion'><p>{MORE}</p><p>{AD}</p></div></article>", [LONG]),
    "long comments beside a short article": (f"<article><p>Short one.</p></article><div id='comment-list'><p>{LONG}</p><p>{MORE}</p></div>", ["Short one."]),
    "wrapper named after its sidebar": (f"<div class='with-sidebar'><div id=content><p>{LONG}</p><p>Short one.</p></div><div class='sidebar'><p>{AD}</p></div></div>", [LONG, "Short one."]),
    "form around the page": (f"<form id=aspnet><div class='menu'><a href=a>Home</a></div><div><p>{LONG}</p><p>{MORE}</p></div></form>", [LONG, MORE]),
    "headers and footers": (f"<header><h1>Site</h1><p>{AD}</p></header><article><header><h1>Title</h1></header><p>Body.</p><footer>Posted by me</footer></article><footer><p>{AD}</p></footer>", ["Title", "Body."]),
    "advert between": (f"<nav><ul><li><a href=a>The</a></li><li><a href=b>and</a></li></ul></nav><div class='ad'>{AD}</div><article><h1>T</h1><p>{LONG}</p><p>Sh is.</p></article><footer>&copy; x &middot; {AD}</footer>", ["T", LONG, "Sh is."]),
    "aside, notice, form and sharing in the article": (f"<article><p>{LONG}</p><aside><p>{AD}</p></aside><div class='notice'><p>{AD}</p></div><form><p>{AD}</p><button>Go</button></form><div class='share-buttons'>Share this</div><p>{MORE}</p></article>", [LONG, MORE]),
    "no article element": (f"<body><h1>Title</h1><p>{LONG}</p><p>Ok.</p><p>{MORE}</p><div>Copyright © 2020 me</div></body>", ["Title", LONG, "Ok.", MORE]),
    "hidden": (f"<article><p>{LONG}</p><p style='display:none'>{AD}</p><div hidden><p>{AD}</p></div></article>", [LONG]),
    "menu only": ("<nav><a href=a>One</a></nav><footer>Two</footer>", []),
    "linked headings": (f"<article><h2><a href='#a'>Part one</a></h2><p>{LONG}</p></article>", ["Part one", LONG]),
    "table": (f"<article><p>{LONG}</p><table><tr><td>1</td><td>two</td></tr></table></article>", [LONG, "1", "two"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_labelled_pages(name):
    page, want = PAGES[name]
    assert main_text(page)[0].split("\n") == (want or [""])


def test_the_cut_overrules_the_score():
    """Blocks whose own score says otherwise: short paragraphs of an article come in, long text of an advert goes out."""
    blocks, nodes = blocks_of(PAGES["advert between"][0])
    gains, edges = graph_of(blocks, nodes)
    label = min_cut(gains, edges)
    overruled = {b.text: yes for b, g, yes in zip(blocks, gains, label) if (g > 0) != yes}
    assert overruled["Sh is."] and not overruled[AD]


def test_tables_of_pages(spark):
    """Empty tables, repeated rows, ties, very long blocks and pages, deep trees."""
    schema = "page_id long, url string, html string"
    assert extract_main_text(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 200_000
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>" + "</div>" * 20_000
    many = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", f"<article><p>{LONG}</p></article>")] * 3 + [(2, None, f"<article><p>{long}</p></article>"), (3, "u", deep), (4, "u", many), (None, "u", f"<p>{LONG}")]
    got = extract_main_text(spark.createDataFrame(rows, schema).selectExpr("*", "1 as n_chars", "'x' as text", "html as blocks")).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text) and r.blocks == r.html
    assert by == {1: [LONG] * 3, 2: [long.strip()], 3: [LONG], 4: ["\n".join([LONG] * 20_000)], None: [LONG]}
