"""HTML extraction by composite text density.

A page becomes a tree of elements; elements that are furniture by their tag (menus, headers, footers, sidebars, forms,
scripts) and hidden ones are cut off first. Every element then has a composite density, its characters for each
tag, weighed by how few of characters and tags belong to links. Names of classes, ids and roles that speak
of furniture (adverts, notices, reader comments) lower the densities of all that is below them; they don't
delete, so an article under such a name is found if nothing on the page is denser. The element with the largest sum of
its children's densities is the article; the smallest density on its path to the body is the threshold above
which other parts of the page belong to it as well, and below which named parts and lists of links in it don't.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.sources.tags import Tags

from .common import clear, small_batches

_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SLASH = re.compile(r"(?:^|[\s\"'])/$")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# fixed values of the HTML standard
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody tfoot thead tr ul".split()
)
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CLOSES |= {"thead": "tr td th tbody tfoot", "tbody": "tr td th thead tfoot", "tfoot": "tr td th tbody thead"}
LIST_ENDS = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table"}
LIST_ENDS = {tag: set(LIST_ENDS.get(tag, "table select").split()) for tag in CLOSES}
CLOSES = {tag: set(names.split()) for tag, names in CLOSES.items()}
P_ENDS = set("table td th button".split())

# what pages call their furniture
FURNITURE = set(
    "script style noscript template iframe object svg canvas head nav footer aside form button select textarea "
    "dialog menu search audio video map title".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Names that are hardly ever those of an article, and names that may be its topic.
SURE = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription paywall signup login sidebar sidebars "
    "widget widgets nav navbar navigation navigator breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager "
    "comment comments commentlist disqus replies respond".split()
)
PERHAPS = set(
    "promo promos promotion notice notices alert alerts rail menu menus share sharing social related recommended "
    "recommendations skip disclaimer copyright banner banners form search discussion feedback".split()
)
#: What is left of a density under such a name.
SURELY, MAYBE = 0.02, 0.3
#: An article under such a name has so many characters outside links at least, times what is left.
LEAST_CHARS = 40
#: What a form has in paragraphs at least if it holds a page.
FORM_CHARS = 200
#: Further articles beside the chosen one have this share of its text outside links at least.
FURTHER = 0.2
#: A block of these with at least so many links that hold four fifths of its text is a list of links.
LISTS, LINKS = set("ul ol dl div section table".split()), 3


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "named", "left")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        self.named = self.left = 1.0  # what the own name leaves of densities, and all names down to here

    @property
    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def parse(page: str) -> Node:
    """The tree of a page; tags that are missing or crossed are mended as browsers do in the common cases."""
    root = Node("html", "", None)
    top, at, n = root, 0, len(page)
    # how many elements of a tag are open, so that none is looked for in vain
    opened: Counter[str] = Counter()

    def back_to(node: Node) -> Node:
        inner = top
        while inner is not node:
            opened[inner.tag] -= 1
            inner = inner.parent
        return node

    tags = Tags(page)
    while at < n:
        tag = tags.next(at)
        if tag is None:
            top.items.append(page[at:])
            break
        begin, end, name, attrs, closes = tag
        if begin > at:
            top.items.append(page[at:begin])
        at = end
        if name is None:
            continue
        name = name.lower()
        if closes:
            top = back_to(_close(top, name)) if opened[name] else top
            continue
        if name in ("html", "body"):
            if name == "body":
                top = back_to(root)
            root.attrs = root.attrs or attrs
            continue
        if name in BLOCK and opened["p"]:
            top = back_to(_close_open(top, {"p"}, P_ENDS))
        if name in CLOSES and any(opened[tag] for tag in CLOSES[name]):
            top = back_to(_close_open(top, CLOSES[name], LIST_ENDS[name]))
        node = Node(name, attrs, top)
        top.items.append(node)
        if name in RAW:
            inner, after = tags.raw_end(name, at)
            node.items.append(page[at:inner])
            at = after
        elif name not in VOID and (name in BLOCK or not _SLASH.search(attrs)):
            top = node  # a slash doesn't close a block, nor as the end of an attribute's value
            opened[name] += 1
    return root


def _close(top: Node, name: str) -> Node:
    """The open element after the end tag ``name``: nothing happens if none is open in reach."""
    if name in ("html", "body"):
        return top
    node = top
    while node.parent is not None:
        if node.tag == name:
            return node.parent
        if name not in BLOCK and node.tag in BLOCK:
            return top
        if node.tag in ("td", "th") and name not in ("tr", "tbody", "thead", "tfoot", "table"):
            return top
        node = node.parent
    return top


def _close_open(top: Node, wanted: set[str], stops: set[str]) -> Node:
    """Close an open element of ``wanted`` unless one of ``stops`` is in between."""
    node, found = top, None
    while node.parent is not None and node.tag not in stops:
        if node.tag in wanted:
            found = node
            if "p" in wanted:
                break
        node = node.parent
    return found.parent if found else top


def _named(attrs: str) -> tuple[list[set[str]], str, bool]:
    """The lower-cased words of each class and id, the role, and whether the element is hidden."""
    if "=" not in attrs and "hidden" not in attrs:
        return [], "", False
    names, role, hidden = [], "", False
    for key, value in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), html.unescape(value.strip("\"'"))
        if key in ("class", "id"):
            names += [{w.lower() for w in _PART.findall(name)} for name in value.split()]
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
    return names, role, hidden


def _walk(node: Node) -> Iterator[Node]:
    """The elements from ``node`` on in page order; backwards, each comes after all below it."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.children))


def _holders(root: Node) -> set[Node]:
    """The elements that have an article below them: one by its tag, or, for a form, the page's paragraphs.

    Some servers put the whole page into one form. One that has half of all text in paragraphs outside
    furniture is such a page, if that is as much as an article's.
    """
    nodes, found, told = list(_walk(root)), set(), Counter()
    for node in reversed(nodes):
        if node.parent is not None and (node.tag in ("article", "main") or node in found):
            found.add(node.parent)
        if node.tag == "p":
            told[node] += sum(len("".join(x.split())) for x in node.items if not isinstance(x, Node))
        if node.parent is not None and (node.tag == "form" or node.tag not in FURNITURE):
            told[node.parent] += told[node]
    return found | {x for x in nodes if x.tag == "form" and told[x] >= FORM_CHARS and 2 * told[x] >= told[root]}


def _evidence(node: Node, in_article: bool, holders: set[Node]) -> float:
    """What an element's tag and names leave of the densities below it; 0 for what isn't shown or never an article."""
    if node.tag in FURNITURE and (node.tag != "form" or node not in holders):
        return 0.0
    if node.tag == "header":
        return 1.0 if in_article or node in holders else 0.0
    names, role, hidden = _named(node.attrs)
    if hidden:
        return 0.0
    if node in holders:
        return 1.0
    if role in ROLES:
        return SURELY
    left = 1.0
    for words in names:
        if node.tag in ("main", "article"):
            words = words & (SURE | {"related", "promo"})
        sure, maybe = len(words & SURE), len(words & PERHAPS)
        # a name of which most words are of other things is that of another thing
        if 2 * (sure + maybe) >= len(words) > 0:
            left = min(left, SURELY if sure else MAYBE)
        elif "header" in words and not in_article:
            left = min(left, SURELY)
    return left


def _prune(root: Node) -> None:
    """Cut off what is never an article, and note what names leave of densities."""
    holders, stack = _holders(root), [(root, False)]
    while stack:
        node, in_article = stack.pop()
        kept = []
        for x in node.items:
            if isinstance(x, Node):
                x.named = _evidence(x, in_article, holders)
                x.left = min(node.left, x.named)
                if not x.named:
                    # what stood on both sides stays apart
                    kept.append(Node("hr", "", node) if x.tag in BLOCK else "")
                    continue
                stack.append((x, in_article or x.tag in ("article", "main")))
            kept.append(x)
        node.items = kept


def _weigh(nodes: list[Node]) -> None:
    """Characters and tags below each of the elements in page order, all and in links."""
    linked = set()
    for node in nodes:
        if node.tag == "a" or node.parent in linked:
            linked.add(node)
    for node in reversed(nodes):
        chars, tags, link_chars, link_tags = 0, 0, 0, 0
        for x in node.items:
            if isinstance(x, Node):
                chars, tags = chars + x.chars, tags + x.tags + 1
                link_chars, link_tags = link_chars + x.link_chars, link_tags + x.link_tags + (x.tag == "a")
            else:
                size = len("".join(html.unescape(x).split()))
                chars += size
                link_chars += size if node in linked else 0
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags


def _rate(nodes: list[Node], page_links: float) -> None:
    """Composite density of each element, as far as names leave it, and the sum of its children's densities."""
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + page_links * c + math.e)
            node.density = c / t * max(math.log(c / lc * t / lt), 0.0) / max(math.log(max(base, 1.0 + 1e-9)), 1.0)
        node.density *= node.left
        node.total = sum(child.density for child in node.children)


def _chosen(root: Node) -> list[Node]:
    """The elements whose texts are the article, in page order; what isn't part of it is taken out of them."""
    nodes = list(_walk(root))
    _weigh(nodes)
    _rate(nodes, root.link_chars / max(root.chars, 1))
    best = max(nodes, key=lambda node: node.total)
    if best.left < 1.0 and (best.chars - best.link_chars) * best.left < LEAST_CHARS:
        best = root
    path, node = {best}, best
    while node.parent is not None:
        node = node.parent
        path.add(node)
    threshold = min(node.density for node in path)
    if best is root or best.total == 0.0:
        # nothing parts the article from the page
        _leave_out(root, path, threshold)
        return [root]
    marked = [node for node in nodes if node in path and node.tag in ("article", "main")]
    if marked:
        first = next((node for node in marked if node.tag == "article"), marked[0])
        chosen = [node for node in first.parent.children if node is first or _further(node, first, threshold)]
    else:
        chosen, stack = [], [root]
        while stack:
            node = stack.pop()
            if node is best:
                chosen.append(node)
            elif node in path:
                stack.extend(reversed(node.children))
            elif node.tag == "h1" or (node.density >= threshold > 0.0 and node.chars > 2 * node.link_chars):
                chosen.append(max(_walk(node), key=lambda x: (x.total, x is node)) if node.tag != "h1" and node.total else node)
    for node in chosen:
        _leave_out(node, path, threshold)
    return chosen


def _further(node: Node, first: Node, threshold: float) -> bool:
    """Whether an element beside the chosen article is another one: dense enough, of some length and no list of links."""
    own, other = node.chars - node.link_chars, first.chars - first.link_chars
    return node.tag == first.tag == "article" and node.named == 1.0 and node.density >= threshold > 0.0 and own > node.link_chars and own >= FURTHER * other


def _leave_out(top: Node, path: set[Node], threshold: float) -> None:
    """Take out of an element the named parts under the threshold and the lists of links."""
    stack = [top]
    while stack:
        node = stack.pop()
        gone = set()
        for x in node.children:
            if x in path:
                continue
            named = x.named < 1.0 and (x.named == SURELY or x.density < threshold or not threshold)
            links = x.tag in LISTS and x.link_tags >= LINKS and 5 * x.link_chars > 4 * x.chars
            if named or links:
                gone.add(x)
        if gone:
            # what stood on both sides stays apart
            node.items = [Node("hr", "", node) if x in gone and x.tag in BLOCK else "" if x in gone else x for x in node.items]
        stack.extend(x for x in node.children if x not in gone)


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Append the texts of each block to ``out``, whose last entry is the open block."""
    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        x, ends = stack.pop()
        if not isinstance(x, Node):
            out[-1].append(html.unescape(x))
        elif ends:
            if x.tag in BLOCK:
                out.append([])
            elif x.tag in ("td", "th"):
                out[-1].append(" ")
        else:
            if x.tag in BLOCK:
                out.append([])
            elif x.tag in ("br", "td", "th", "img", "wbr"):
                out[-1].append(" " if x.tag != "wbr" else "")
            stack.append((x, True))
            stack.extend((y, False) for y in reversed(x.items))


def main_text(page: str) -> str:
    """The main text of a page: its blocks, each with single spaces, joined by an empty line."""
    root = parse(page)
    _prune(root)
    found: list[str] = []
    for node in _chosen(root):
        out: list[list[str]] = [[]]
        _blocks(node, out)
        found += filter(None, (" ".join("".join(block).split()) for block in out))
    return "\n\n".join(found)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (html and any others) without html, with text (the main text) and n_chars (its code points).

    Null or empty html, and a page without main text, have the empty text. Nesting and length have no limit
    but memory for one page. Columns of pages named as a result are replaced; no rows give none.
    """
    pages = clear(pages, "text", "n_chars")
    others = [c for c in pages.columns if c != "html"]
    source = pages.select(*others, "html")
    schema = source.select(*others, F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "") for page in batch.column(len(others)).to_pylist()]
            columns = [batch.column(i) for i in range(len(others))]
            columns += [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    small_batches(pages.sparkSession)
    return source.mapInArrow(run, schema)
