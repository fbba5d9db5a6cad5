import html
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitloom.llm import html_extract as H

LONG = "Some running text that is long enough to be an article, with commas and more. "


def own(source):
    return H.extract(source, None)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        (f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}<br>b<p>two</article><footer>f</footer>", f"T\n{LONG}b\ntwo"),
        (f"<div class='sidebar'>s</div><div class=content><p>{LONG}</p><div class='comments'><p>c</p></div></div>", LONG.strip()),
        (f"<main><p>{LONG}<script>var a='</p>';</script></p><form>f</form><ul><li>x<li>y</ul></main>", f"{LONG.strip()}\nx\ny"),
        (f"<article><p>a&nbsp; b &#233; &lt;p&gt; {LONG}</p><!-- no --><p></p></article>", f"a b é <p> {LONG.strip()}"),
        (f"<article><table><tr><td>1<td>2<tr><td>3</table>{LONG}</article>", f"1 2\n3\n{LONG.strip()}"),
        (f'<article><p title="a > b">{LONG}</p><div hidden>h</div><div style="display: none">h</div><p>z</b></i></article>', f"{LONG.strip()}\nz"),
        (f'<header>top</header><article><header><h1>T</h1></header><p>{LONG}</p></article><div id="cookie-notice">c</div>', f"T\n{LONG.strip()}"),
        (f"<div class='entry-content'><div class='entry-header'><h2>T</h2></div><p>{LONG}</p><div class='post-navigation'>n</div><section id='reader-comments'><article>c</article></section></div>", f"T\n{LONG.strip()}"),
        (f"<div id='wrap'><div class='topBar'>t</div><ul class='main-menu'><li>m</ul><main><p>{LONG}</p><div class='newsletter-signup'>x</div></main><div class='page-footer'>f</div></div>", LONG.strip()),
    ],
)
def test_pages(source, text):
    assert own(source) == text


def test_consensus_wins(spark):
    """Pages with little article and much else follow the path that their host's other pages have voted for."""
    usual = "<body><div class='left'>{}</div><div class='right'>{}</div></body>"
    rows = [(i, "http://a.example/x", usual.format(f"<p>{LONG * 3}{i}</p>", "<p><a href=/p>pick</a></p>")) for i in range(8)]
    rows.append((50, "https://www.a.example:80/y", usual.format("<p>short</p>", f"<p>{LONG * 9}</p>")))
    rows += [(60, None, None), (61, "no url", ""), (62, "http://b.example", "<b>bold</b>"), (None, "http://c.example", "<p>x"), (63, "http://a.example", "<p>alone</p>"), (63, "http://a.example", "<p>alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("path", F.lit("x")).withColumn("host", F.lit("y"))
    got = {r.page_id: r.text for r in H.extract_pages(pages).collect()}
    assert got[50] == "short" and got[3].endswith("3")
    assert (got[60], got[61], got[62], got[None], got[63]) == ("", "", "bold", "x", "alone")
    assert H.extract_pages(pages).count() == len(rows) and H.extract_pages(pages.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    """Against a direct reading of these pages' one article element."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in H.op8_html_extraction(spark, sf_dir).collect():
        inner = re.search(r"<article[^>]*>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", inner))
        assert r.text == "\n".join(b for b in blocks if b), r.page_id
        assert r.n_chars == len(r.text)


@given(st.text("<>/pbdiv\"'= a!-&;", max_size=80))
def test_any_markup(source):
    path, size = H.vote(source)
    assert isinstance(H.extract(source, path), str) and size >= 0


def test_long_page():
    assert len(own("<div>" * 3000 + LONG * 20_000)) > 10**6
    assert own('<a "' * 30_000) == ""
    assert own("<b>" * 50_000 + "x") == "x"


def test_deep_markup_is_linear():
    page = "<div>" * 100_000 + f"<p>{LONG}</p>"
    path, size = H.vote(page)
    began = time.perf_counter()
    assert H.extract(page, path) == LONG.strip() and size > 0
    assert time.perf_counter() - began < 5


def test_path_with_odd_names():
    page = f"<body><div class='a>b x12'><p>{LONG}</p></div><div class='c'><a href=x>{LONG}</a></div></body>"
    path, _ = H.vote(page)
    assert path == "body>div.a#b.x#" and H.extract(page, path) == LONG.strip()
    assert H.extract("plain <document>text", "document") == "plain text"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        *((f"<body><div class='{name}'><article><p>{LONG}</p></article><div class='sidebar'><p>s</p></div></div></body>", LONG.strip()) for name in ("no-sidebar", "with-sidebar", "has-sidebar", "content-sidebar-wrap", "ad-free")),
        (f"<div class='has-sidebar'><div class='content-sidebar-wrap'><div class='left'><p>{LONG}</p></div><div class='sidebar'><p>s</p></div></div></div>", LONG.strip()),
        (f"<div class='sidebar'><article>teaser</article></div><div class='with-sidebar'><article><p>{LONG}</p></article></div>", LONG.strip()),
        (f"<div class='with-sidebar'><article><p>{LONG}</p></article><div class='sidebar'><p>{LONG * 3}</p></div></div>", LONG.strip()),
        (f"<div class='comments-open'><main><p>{LONG}</p></main><div id='comments'><article>{LONG * 2}</article></div></div>", LONG.strip()),
        (f"<div class='ad'>{LONG}</div><article><h1>T</h1><p>short</article>", "T\nshort"),
        (f"<div class='post'><p>{LONG}</p></div><section id='comments'><article>{LONG * 9}</article></section>", LONG.strip()),
    ],
)
def test_layout_wrappers(source, text):
    assert own(source) == text


def test_nested_wrappers():
    assert own("<div class=has-sidebar>" * 20_000 + LONG) == LONG.strip()


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<p>The energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> ends</p>", "The energy E=m ends"),
        ("<p>See <svg><text>label</text></svg> here <x-note>and there</x-note></p>", "See label here and there"),
        ("<p>a<object>b</object> <video>c</video> <audio>d</audio> <canvas>e</canvas></p><noscript><p>f</p></noscript>", "ab c d e\nf"),
        (f"<p class='story links'>{LONG}</p>", LONG.strip()),
        (f"<section class='search-results-discussion'><p>{LONG}</p></section>", LONG.strip()),
        (f"<p class='article-story__share-price'>{LONG}</p>", LONG.strip()),
        (f"<p class='alert-levels'>{LONG}</p><p class='story-links'>{LONG} <a href=x>one</a></p>", f"{LONG.strip()}\n{LONG.strip()} one"),
        ("<p class='story links'><a href=a>one</a> <a href=b>two</a></p>", ""),
        ("<div class='search-results-page'><p>Find</p><input name=q></div>", ""),
        ("<div class='share-buttons'><a href=x>Share this</a></div><div class='ad-slot'>Buy</div><div class='cookie-notice'>We use</div>", ""),
        ("<div class='data-widget'><p>A table about rainfall is described here.</p></div>", "A table about rainfall is described here."),
        ("<section id='menu'><h2>The menu</h2><p>Soup, bread and fish were served at one long table.</p></section>", "The menu\nSoup, bread and fish were served at one long table."),
        ("<div id='breadcrumb-search'><p>Birds find crumbs by <a href=x>sight</a>, not by smell.</p></div>", "Birds find crumbs by sight, not by smell."),
        ("<div class='menu'>Home News Sport Weather Business Travel</div><div class='widget'><p>Read on.</p></div>", ""),
        ("<div class='banner'><a href=x>The ten best kettles of the year, tested.</a></div>", ""),
        ("<div class='ad'><p>This kettle is the best that money can buy.</p></div><div class='notice'><p>Our office is closed on Monday.</p></div>", ""),
        ("<div class='reader-comments'><p>I think so</p></div><div class='comment-list'><p>Me too</p></div>", ""),
    ],
)
def test_inside_an_article(inner, text):
    """Only what the contract names is left out of an article, whatever words its names contain."""
    parts = [LONG.strip(), text, LONG.strip()]
    assert own(f"<body><article><p>{LONG}</p>{inner}<p>{LONG}</p></article></body>") == "\n".join(p for p in parts if p)


def test_page_in_a_form():
    page = f"<body><form id='aspnetForm'><div class='nav'><a href=x>n</a></div><div class='content'><p>{LONG}</p></div><input><div class='login-form'><input>Name</div></form></body>"
    assert own(page) == LONG.strip()
    assert own(f"<body><form><p>Your name</p><input></form><div><p>{LONG}</p></div></body>") == LONG.strip()
