"""Selectors on nested and broken pages."""

import random
import time

import pytest

from ledgerlark.sources import dom

PAGE = """<body><div id=block class="content main"><ul class='list'><li><a href="/a">First entry<li><b>x</b> <a href='b.html'>Second <i>one</i></a>
<ul><li class=deep>inner</ul><li>third</ul><p>one<p class="lead big">two</div><table><tr><td>c1<td>c2<tr><td data-x="y-z">c3</table>
<a HREF=/news/1>News &amp; more</a><br/><img src=x><script>var a="<li>";</script></body>"""


def texts(selectors, page=PAGE):
    p = dom.Page(page)
    return [p.text(i) for i in dom.matched(p, selectors)]


@pytest.mark.parametrize(
    "selectors,want",
    [
        ("li > a", ["First entry", "Second one"]),
        ("#block li.deep", ["inner"]),
        ("ul > li", ["First entry", "x Second one inner", "inner", "third"]),
        ("ul ul li, p.lead.big", ["inner", "two"]),
        ("p", ["one", "two"]),
        ("tr > td", ["c1", "c2", "c3"]),
        ("td[data-x]", ["c3"]),
        ("td[data-x|=y], td[data-x='q']", ["c3"]),
        ("a[href*='/news/']", ["News & more"]),
        ("a[href^=/], a[href$='.html']", ["First entry", "Second one", "News & more"]),
        ("div.content.main > p", ["one", "two"]),
        (".content[class~=main] * > i", ["one"]),
        ("section li", []),
    ],
)
def test_selectors(selectors, want):
    assert texts(selectors) == want


@pytest.mark.parametrize("bad", ["", ">a", "a >", "li:first-child", "a[", "a,,b"])
def test_what_is_no_selector(bad):
    with pytest.raises(ValueError, match="selector"):
        dom.compiled(bad)


def test_matcher_equals_looking_up_from_each_element():
    r = random.Random(4)
    for _ in range(200):
        page = dom.Page("".join(r.choice(["<div>", "<b>", "<div class=x>", "</div>", "</b>", "t"]) for _ in range(30)))
        steps = [r.choice(["div", "b", ".x", "*"]) for _ in range(3)]
        joints = [r.choice([" ", " > "]) for _ in range(2)]
        selector = steps[0] + joints[0] + steps[1] + joints[1] + steps[2]
        one = dom.compiled(selector)[0]

        def up(i, k, page=page, one=one):
            if not one[k].fits(page.elements[i]):
                return False
            if k == 0:
                return True
            j = page.elements[i].parent
            while j > 0:
                if up(j, k - 1):
                    return True
                if one[k].child:
                    return False
                j = page.elements[j].parent
            return False

        assert dom.matched(page, selector) == [i for i in range(1, len(page.elements)) if up(i, 2)]


NEWS = dom.Listing((".views-row", "main a[href*='/news/']"), ("h2 a", "a"), ("time", "[class*=date]"), (".body", "p"), most=3)


def test_listing_reads_rows_and_falls_back():
    row = '<div class="views-row"><a href="/skip">skipped</a><h2><a href="n/{0}">Title {0}</a></h2><time datetime="2024-01-0{0}">x</time><p>Told {0}</div>'
    found = NEWS.read("".join(row.format(i) for i in range(1, 6)))
    assert found[0] == {"title": "Title 1", "href": "n/1", "date": "2024-01-01", "summary": "Told 1"} and len(found) == 3
    found = NEWS.read("<main><a href='/news/1'>One more</a><a href='/x'>Nothing</a><a href=/news/2>ab</a></main>")
    assert found == [{"title": "One more", "href": "/news/1", "date": None, "summary": ""}]
    assert NEWS.read("") == NEWS.read("<p>none") == []
    assert NEWS.read("<div class=views-row><span class=pub-date>May 2</span><a>Without address</a>")[0]["href"] == ""


def test_frame(spark):
    pages = spark.createDataFrame([(1, "http://h/d/p", "<p class=views-row><a href=q>A title</a>"), (2, None, None)], "k int, u string, html string")
    rows = dom.listed(pages, "k", "u", "html", NEWS).collect()
    assert [(r.k, r.place, r.title, r.url) for r in rows] == [(1, 0, "A title", "http://h/d/q")]


@pytest.mark.parametrize("part", ["<div>", "<li>", "<a href='", "<p><b>", "</i>", "<td>"])
def test_broken_pages_end(part):
    began = time.process_time()
    NEWS.read(part * (100_000 // len(part)))
    assert time.process_time() - began < 20
