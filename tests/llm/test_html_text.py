import html
import math
import random
import time

import pytest

from ledgerlark.llm import html_text as H

ARTICLE = "<h1>A &amp; B</h1><p>First   para\n of the page, long enough to be prose, with words.<p>Second &eacute;tude,<br>also of some length, <b>bold</b>ly so.</p>"
WANT = "A & B\n\nFirst para of the page, long enough to be prose, with words.\n\nSecond étude, also of some length, boldly so."
CLUTTER = {
    "menu": "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>",
    "header": "<header><a href=/>Home</a><p>Site name</p></header>",
    "footer": "<footer>&copy; us, all rights reserved by the owners of this page</footer>",
    "sidebar": "<aside><p>Read more of this on the side of the page</p></aside>",
    "named sidebar": '<div class="left-sidebar"><p>Read more of this on the side of the page</p></div>',
    "notice": '<div id="cookie-notice"><p>We use cookies on this page, as all pages do.</p></div>',
    "advert": '<!-- ad --><div class="ad">Buy this now, it is cheap and you need it today.</div>',
    "form": "<form action=/s><label>Your name please</label><input name=q><button>Go</button></form>",
    "script": '<script>var a = "</p><p>not text";</script><style>p{color:red}</style><noscript>Enable it</noscript>',
    "comments": '<section class="comments"><article class="comment"><p>I read this and it is a very good page, thanks to the author for writing all of it.</p></article></section>',
}


@pytest.mark.parametrize("kind", CLUTTER)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"])
def test_clutter_is_left_out(kind, wrap):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{CLUTTER[kind]}{wrap.format(ARTICLE)}{CLUTTER[kind]}</body></html>"
    assert H.main_text(page) == WANT


def test_clutter_inside_the_article():
    page = f"<body><article>{ARTICLE}{''.join(CLUTTER[k] for k in ('menu', 'advert', 'form', 'script', 'comments', 'notice'))}</article></body>"
    assert H.main_text(page) == WANT


def test_all_clutter_at_once_in_plain_divisions():
    page = f"<body>{''.join(CLUTTER.values())}<div><div>{ARTICLE}</div></div></body>"
    assert H.main_text(page) == WANT


def test_menu_beside_a_bare_article():
    menu = "<div><a href=/>Home</a><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div>"
    assert H.main_text(f"<body>{menu}{ARTICLE}{menu}</body>") == WANT


def test_broken_markup():
    assert H.main_text("<article><h1>T</h1><p><b>T and.<br><p>More text</article><footer>f") == "T\n\nT and.\n\nMore text"
    assert H.main_text("<p>one<p>two") == "one\n\ntwo"
    assert H.main_text("a < b and &lt;p&gt; &amp;amp;") == "a < b and <p> &amp;"
    assert H.main_text("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>") == "x\n\ny\n\n1 2\n\n3"
    assert H.main_text("<p title='a > b'>t</p><!-- <p>no</p> -->") == "t"
    assert H.main_text("<p>no end <!-- open") == "no end"


def test_frame(spark):
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "u", f"<article>{ARTICLE}</article>", 5), (3, "u", "<div>" * 5000 + "deep", 5), (3, "u", "<p>x</p>" * 20000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = H.extract(pages).collect()
    assert H.extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in found) == sorted([0, 0, len(WANT), 4, 3 * 20000 - 2])
    assert all(r.n_chars == len(r.text) for r in found)
    assert H.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["div", "span", "font"])
def test_deep_pages_are_extracted_like_others(spark, tag):
    for inner in (f"<article>{ARTICLE}</article>", f"<div>{ARTICLE}</div>"):
        page = f"<body>{CLUTTER['script']}{CLUTTER['menu']}{f'<{tag}>' * 5000}{CLUTTER['header']}{inner}{CLUTTER['footer']}"
        pages = spark.createDataFrame([(page,)], "html string")
        assert H.extract(pages).first().text == WANT


PROSE = "<p>A sentence of prose that goes on for a while, with commas and words, as articles do.</p>"


def test_names_lower_densities_but_do_not_delete():
    found = H.main_text(f'<body><div class="social"><h2>Social policy</h2>{PROSE * 3}</div><div>x</div></body>')
    assert found.startswith("Social policy\n\nA sentence") and found.count("A sentence") == 3 and not found.endswith("x")
    inside = f'<article><h1>T</h1>{PROSE}<div class="search-results-summary"><p>Results, in short.</p></div>{PROSE}</article>'
    assert "Results, in short." in H.main_text(inside)
    assert H.main_text('<div class="cookie-notice"><p>We use cookies.</p><p>Accept</p></div>') == ""
    promo = f'<article><h1>T</h1>{PROSE}<div class="promo"><p>Buy this.</p></div></article>'
    assert "Buy" not in H.main_text(promo)
    beside = f'<body><div class="ad">{PROSE}</div><div>{PROSE * 2}</div></body>'
    assert H.main_text(beside).count("A sentence") == 2


def test_lists_of_links_inside_the_article():
    more = "<ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>Three</a></ul>"
    assert "Two" not in H.main_text(f"<article><h1>T</h1>{PROSE}{more}</article>")
    with_words = "<ul><li>First see <a href=/a>one</a><li>then also <a href=/b>two</a><li>and <a href=/c>three</a></ul>"
    assert "then also two" in H.main_text(f"<article><h1>T</h1>{PROSE}{with_words}</article>")


def test_densities_against_their_definition():
    r = random.Random(4)

    def page(depth):
        tag = r.choice(["div", "p", "a", "b", "section", "span"])
        inner = "".join(page(depth - 1) if depth and r.random() < 0.6 else r.choice(["some words ", "&amp; x", ""]) for _ in range(r.randint(0, 4)))
        return f"<{tag}>{inner}</{tag}>"

    def below(node, in_link):
        in_link = in_link or node.tag == "a"
        for x in node.items:
            if isinstance(x, H.Node):
                yield "tag", 1, x.tag == "a"
                yield from below(x, in_link)
            else:
                yield "char", len("".join(html.unescape(x).split())), in_link

    for _ in range(60):
        root = H.parse("<body>" + "".join(page(4) for _ in range(3)))
        nodes = list(H._walk(root))
        H._weigh(nodes)
        total_chars = [n for k, n, _ in below(root, False) if k == "char"]
        link_share = sum(n for k, n, linked in below(root, False) if k == "char" and linked) / max(sum(total_chars), 1)
        H._rate(nodes, link_share)
        in_link = {root: False}
        for node in nodes:
            in_link[node] = node.parent is not None and (in_link[node.parent] or node.parent.tag == "a")
            found = list(below(node, in_link[node]))
            c = sum(n for k, n, _ in found if k == "char")
            t = max(sum(1 for k, _, _ in found if k == "tag"), 1)
            lc = sum(n for k, n, linked in found if k == "char" and linked)
            lt = max(sum(1 for k, _, a in found if k == "tag" and a), 1)
            if not c:
                assert node.density == 0
                continue
            base = max(math.log(max(math.log(c / max(c - lc, 1) * lc + link_share * c + math.e), 1 + 1e-9)), 1.0)
            assert abs(node.density - c / t * max(math.log(c / max(lc, 1) * t / lt), 0) / base) < 1e-9
            assert abs(node.total - sum(x.density for x in node.children)) < 1e-9
        best = max(nodes, key=lambda n: n.total)
        assert best.total == max(sum(x.density for x in n.children) for n in nodes)


def test_a_page_of_fifty_thousand_levels():
    page = f"<body>{CLUTTER['script']}{CLUTTER['menu']}{'<div>' * 50_000}<article>{ARTICLE}</article>{'</div>' * 50_000}{CLUTTER['footer']}"
    assert H.main_text(page) == WANT


BROKEN = ['<div class="', "<a ", '<a "<b>"', "<!x", "</script ", "<div '\"", '<p>x<a "> ', "<a b='<", "<!--", "<![CDATA[", "<script>", "'\"<a>"]


@pytest.mark.parametrize("part", BROKEN)
@pytest.mark.parametrize("head,tail", [("", ""), ("<script>", ">"), ("<p>text", ">")])
def test_time_is_linear_on_broken_pages(part, head, tail):
    began = time.process_time()
    H.main_text(head + part * (1_000_000 // len(part)) + tail)
    assert time.process_time() - began < 20


def test_five_megabytes_of_open_tags():
    began = time.process_time()
    H.main_text('<div class="' * 420_000)
    assert time.process_time() - began < 5


SAID = "<p>" + "Some words of an article that goes on for a while, and then for some more. " * 5 + "</p>"


def test_a_page_inside_one_form_keeps_its_text():
    page = f"<body><form method=post><input type=hidden><ul><li><a href=/>Home</a></ul><div><h1>Title</h1>{SAID * 4}</div></form></body>"
    assert H.main_text(page).count("Some words") == 20 and "Home" not in H.main_text(page)
    page = f"<body><form><nav>menu</nav><article><h1>Title</h1>{SAID * 4}</article></form></body>"
    assert H.main_text(page).startswith("Title") and H.main_text(page).count("Some words") == 20


def test_a_form_in_a_page_is_left_out():
    page = f"<body><article><h1>T</h1>{SAID * 4}</article><form><p>{'Your mail here. ' * 20}</p><input></form></body>"
    assert "mail" not in H.main_text(page)


@pytest.mark.parametrize("around", ["main", "div"])
def test_further_articles_are_kept(around):
    page = f"<body><nav>menu</nav><{around}><article><h2>One</h2>{SAID * 4}</article><article><h2>Two</h2>{SAID * 3}</article></{around}><footer>f</footer></body>"
    text = H.main_text(page)
    assert text.count("Some words") == 35 and "One" in text and "Two" in text and "menu" not in text


def test_teasers_beside_an_article_are_left_out():
    teaser = "<article class=related><a href=/x>Read this other story of ours, it is good</a></article>"
    page = f"<body><main><article><h2>One</h2>{SAID * 4}</article>{teaser * 3}</main></body>"
    assert "other story" not in H.main_text(page)
