"""Main text against hand-made pages, and against a plain reading of the tables' own template."""

import html
import re

import pytest

from lumenfold.llm import site_tree as st
from lumenfold.llm.common import table


def plain(page):
    """Text of the one article of a generated page: paragraphs and headings, nothing else."""
    body = page.split("<article>", 1)[1].split("</article>")[0]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?p>|</?h1>", body)]
    return "\n\n".join(x for x in parts if x)


def test_query_equals_plain(spark, sf):
    pages = {r["page_id"]: r for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    got = st.site_tree_query(spark, table(spark, "/root/testdata/sf0.01", "pages")).collect()
    assert len(got) == len(pages)
    for r in got:
        p = pages[r["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (p["url"], plain(p["html"]), len(r["text"]))


RICH = """<!DOCTYPE html><HTML><head><title>No</title><style>p{}</style><script>if (a</b>) "</article>"</script></head><body class=home>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</ul></nav><div role="search"><input value="q">Find</div><div id='cookie-notice'>We use cookies</div>
<main><article itemscope><h2>A &lt;title&gt; &amp; more&nbsp;&#8212; x</h2><!-- <p>no</p> --><div class="share">Share it</div>
<p>First   line<br>goes
on <a href="/x">here</a>, <b>bold<p>Second &eacute;t&eacute; &zzz; 1 < 2 and a<3<ul><li>One<li>Two</ul><form><label>Mail</label><button>Send</button></form>
<table><tr><td>c1<td>c2</table><div class="ad-slot">Buy</div><script>document.write("<p>x</p>")</script><pre>  a   b </pre>tail text
<section class="comments"><h3>Comments</h3><article class="comment"><p>Nice</p></article></section></article><aside>Side</aside></main><footer>&copy; me</footer><noscript>on</noscript>"""
RICH_TEXT = ["A <title> & more — x", "First line goes on here, bold", "Second été &zzz; 1 < 2 and a<3", "One", "Two", "c1", "c2", "a b", "tail text"]


def test_rich_page():
    assert st.main_text(RICH).split("\n\n") == RICH_TEXT


@pytest.mark.parametrize("page", [None, "", " ", "<", "<<<>>>", "</p></div>", "<script>never closed", "<!-- never closed <p>x</p>", "<a href='x\"y", "&", "&#0;&#xfffffff;"])
def test_broken_markup(page):
    assert "\n" not in st.main_text(page)


def test_text_without_markup_and_deep_nesting():
    assert st.main_text("just\n words &amp;  more") == "just words & more"
    assert st.main_text("<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y") == "x\n\ny"
    assert st.main_text("<p>a" * 2000).count("a") == 2000
    assert st.main_text("<article>" + "<p>word word</p>\n" * 20_000 + "</article>").count("word word") == 20_000


def page(i, body):
    return f"<html><body><div class='top'><span>Our site</span></div><div class='text'><p>{body}</p><p>more of {i}</p></div><div class='low'>Call us on Mondays</div></body></html>"


def test_entropy_removes_what_a_host_repeats(spark):
    rows = [(i, f"http://h.example/{i}", page(i, f"own words {i}"), "x") for i in range(12)] + [(90 + i, f"http://one{i}.example/", page(i, "single"), "x") for i in range(2)]
    rows += [(200, None, None, "x"), (201, "x", "<p>no host", "x"), (202, "http://h.example/e", "", "x"), (3, "http://h.example/3", page(3, "own words 3"), "x")]
    got = {}
    for r in st.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert all(got[i] == [f"own words {i}\n\nmore of {i}"] * (2 if i == 3 else 1) for i in range(12))
    assert got[90][0].startswith("Our site") and got[200] == [""] and got[201] == ["no host"] and got[202] == [""]


def test_a_repeated_article_stays(spark):
    rows = [(i, f"http://h.example/{i}", "<body><article><p>the same on all</p></article></body>") for i in range(6)]
    got = st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"the same on all"}


def test_the_tree_removes_what_articles_share(spark):
    """Boilerplate inside of articles, in an element whose class says nothing: the tree alone knows it."""
    body = "<article><header><h1>Title {0}</h1></header><p>Words of {0} are its own and the longest block.</p><div class='x9'>Thanks for reading.</div><p>End {0}</p></article>"
    rows = [(i, f"http://h.example/{i}", body.format(i)) for i in range(20)] + [(50, "http://other.example/", body.format(50))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = lambda i, extra=(): "\n\n".join([f"Title {i}", f"Words of {i} are its own and the longest block.", *extra, f"End {i}"])
    got = {r["page_id"]: r["text"] for r in st.extract(pages).collect()}
    assert got == {i: want(i) for i in range(20)} | {50: want(50, ["Thanks for reading."])}
    off = {r["page_id"]: r["text"] for r in st.extract(pages, threshold=-1.0, marked=-1.0).collect()}
    assert off == {i: want(i, ["Thanks for reading."]) for i in [*range(20), 50]}


def test_copies_of_an_article_count_once(spark):
    """Near copies on pages that differ elsewhere: no headline goes because they share it."""
    rows = [(i, f"http://h.example/{i}", f"<nav>{i}</nav><article><h1>One title</h1><p>The same long paragraph on every page.</p><p>p{i}</p></article>") for i in range(30)]
    got = st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"One title\n\nThe same long paragraph on every page.\n\np{r['page_id']}" for r in got)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><header><h1>Head</h1></header><p>Body</p></article>", ["Head", "Body"]),
        ("<article><div class='article-header'>Head</div><p class='menu-item-desc'>Soup</p><div class='menu'>x</div></article>", ["Head", "Soup"]),
        ("<main><p>Main body</p></main><div><article><p>Teaser of another page</p></article></div>", ["Main body"]),
        ("<article><p>Long text of the article</p></article><div><article>c1</article><article>c2</article></div>", ["Long text of the article"]),
        ("<article><p>Text</p><div><article>a comment</article></div></article>", ["Text"]),
        ("<main><h1>T</h1><article>one</article><article>two</article></main>", ["T", "one", "two"]),
        ("<article><article>inner</article></article>", ["inner"]),
        ("<header>Site</header><p>no marks</p><div class='header'>x</div>", ["no marks"]),
        ("<div>" * 250 + "<nav>menu</nav><p>hello</p>", ["hello"]),
        ("<p title='a>b' data-x=\"it's\">quoted</p>", ["quoted"]),
        ("<p it's>apostrophe</p><p>next</p>", ["apostrophe", "next"]),
    ],
)
def test_roles(page, want):
    assert st.main_text(page).split("\n\n") == want


@pytest.mark.parametrize("piece", ["<div ", "<div '", "<a b=\"", "<b>", "</b>", "<b><td>", "<i></b>", "<!--", "<![CDATA[", "<", "<p", "<script>", "<title></title", "<div>", "<li>", "&", "<td></i>", "<article>"])
def test_long_broken_markup_takes_linear_time(piece):
    import time

    page = "<b>x" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    st.main_text(page)
    took = time.process_time() - began
    assert took < 15, took


def test_importance():
    nodes = [(0, 0, 1, 0.0, None, 0), (1, 0, 1, 0.0, 0.0, 0), (2, 0, 5, 0.7, None, 0), (3, 2, 1, 0.0, 1.0, 0), (4, 0, 1, 0.0, None, 2)]
    imp = st.importances(nodes)
    assert imp[1] == 0 and imp[3] == 1 and imp[4] == pytest.approx(0.9)
    assert imp[2] == pytest.approx((1 - 0.9**5) * 0.7 + 0.9**5)
    assert imp[0] == pytest.approx(0.9 * (imp[2] + imp[4] + 0) / 3)


def plain_tree(pages):
    """Importances of a host by the definition, from all nodes of its pages, those of one page included."""
    from collections import Counter, defaultdict
    from math import log2

    values, parent = defaultdict(Counter), {}
    for rows in {p: r for p, r in sorted(map(st.page_rows, pages), key=str)}.values():
        for r in rows:
            values[r["node"], r["kind"]][r["value"]] += 1
            parent[r["node"]] = r["parent"]

    def entropy(c):
        m = sum(c.values())
        return 1.0 if m <= 1 else sum(-n / m * log2(n / m) for n in c.values()) / log2(m)

    def imp(n):
        kids = [imp(k) for k, p in parent.items() if p == n and k != n]
        styles = values[n, "s"]
        leaf = entropy(values[n, "c"]) if values[n, "c"] else None
        w = 0.9 ** len(styles)
        inner = (1 - w) * entropy(styles) + w * sum(kids) / len(kids) if kids else None
        return max(x for x in (inner, leaf, 0.0 if kids or leaf is not None else entropy(styles)) if x is not None)

    return {n: imp(n) for n in parent if sum(values[n, "s"].values()) > 1}


def test_statistics_equal_the_definition(spark):
    pages = [page(i, f"own {i}") + "<div class='k%d'>x</div>" % i * (i % 3) for i in range(9)] + [page(1, "own 1")]
    stats = st.node_statistics(spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(3)).collect()
    got = st.importances([(r["node"], r["parent"], r["styles"], r["own"], r["leaf"], r["single"]) for r in stats])
    assert got == pytest.approx(plain_tree(pages))


def test_no_rows(spark):
    assert st.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_equal_pages_of_a_host_count_once(spark):
    page = "<html><body><div class=a><p>one {}</p></div><div class=b><p>two {}</p></div></body></html>"
    once = [("h", page.format(i, i)) for i in range(3)] + [("g", page.format(9, 9))]
    twice = once + [once[0]] * 6 + [once[3]]
    stats = lambda rows: sorted(map(tuple, st.node_statistics(spark.createDataFrame(rows, "host string, html string").repartition(3)).collect()))
    assert stats(twice) == stats(once)
    rows = [(i, "http://g/x", html) for i, (_, html) in enumerate([once[3]] * 2)]
    assert [r["text"] for r in st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == ["one 9\n\ntwo 9"] * 2
