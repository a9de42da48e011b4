"""Main text of web pages by tree scoring.

The page becomes a tree (a forgiving parse: unclosed paragraphs and list items end where the next
begins). Elements that are no article by their tag, their role or because they are hidden are left
out. Each other text block is a paragraph: it passes points, one and more for its length and its
commas, to its parent, half of them to the grandparent and ever less upwards, over LEVELS ancestors;
a container's points are discounted by the share of its text that is links. Points from inside an
element whose class or id names a menu, a notice, comments and the like count for a tenth (for half
where such a word only occurs in a name, fully where the name states something, as in "has-sidebar").
The container with most points is the article, or the <article> around it; its siblings are kept
where their own points or text look like article text too. Elements with such names inside it go, but
never one with most of the points there: names lower a score, they do not decide alone.

All steps are linear in the page, however deep it nests.

Defined results: null or empty html, and a page without text, give an empty text of 0 characters.
Character references are decoded, white space in a block becomes one space, blocks are joined by one
newline in page order. Ties go to the container that comes first. Repeated rows get the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.text import blocks
from navloom.session import ready

# Names of HTML elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CUT = frozenset("nav footer aside script style noscript template iframe object embed svg math canvas button select option textarea dialog menu head title audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPH = frozenset("p pre li td th dd dt blockquote figcaption caption h1 h2 h3 h4 h5 h6 address summary".split())
WHOLE = frozenset("html body article main".split())
ARTICLE_TEXT = PARAGRAPH | WHOLE
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
CLASSES = frozenset(
    "nav navbar navigation menu sidebar footer header masthead banner ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice alert announcement popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager comment comments disqus reply replies respond widget toolbar topbar sidenav subnav login search form hidden".split()
)
#: a name with one of these states something about an element that is no menu, notice and so on itself
STATES = frozenset("has have with without no not non is on off in for open opened closed close collapsed collapsible expanded fixed sticky none enabled disabled enable disable active inactive page ready true false layout print".split())
#: words that, beside one of CLASSES, leave its meaning as it is
PLAIN = frozenset(
    "site main global page top bottom left right upper lower primary secondary wrapper wrap container inner outer list section area box block content group item items row col column bar panel button buttons link links "
    "icon icons post posts article articles entry user reader form slot unit text title body thread tree box message the my js id".split()
)
STRONG, WEAK = 0.1, 0.5
LEVELS = 8
#: a class "header" with one of these is the article's own
OWN_HEADER = frozenset("article entry post story content title".split())
#: what an opening tag ends, besides itself
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: where the search for what to end stops
P_SCOPE = ("table", "button", "object", "td", "th", "article", "section", "aside", "main")
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_COMMA = re.compile(r"[,،、，]")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "factor", "score", "points", "size", "links", "order")

    def __init__(self, tag: str, parent: Node | None, cut: bool, factor: float, order: int):
        self.tag, self.parent, self.cut, self.factor, self.order = tag, parent, cut, factor, order
        self.children: list[Node | str] = []
        self.score, self.points, self.size, self.links = 0.0, 0.0, 0, 0


def name_factor(value: str, in_article: bool) -> float:
    """What the points from inside an element with this class or id count: 1, WEAK or STRONG."""
    factor = 1.0
    own = False
    names = []
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        single = [w if w in CLASSES else w[:-1] if w.endswith("s") and w[:-1] in CLASSES else w for w in words]
        own = own or bool(OWN_HEADER.intersection(words))
        if not STATES.intersection(words) and CLASSES.intersection(single):
            names.append((words, single))
    for words, single in names:
        if CLASSES.intersection(single) == {"header"} and (own or in_article):
            continue  # the article's own header
        named = single[-1] in CLASSES or all(w in CLASSES or w in PLAIN or x in PLAIN for w, x in zip(single, words, strict=True))
        factor = min(factor, STRONG if named else WEAK)
    return factor


def _grade(tag: str, attributes: str, in_article: bool) -> tuple[bool, float]:
    """(whether the element is left out, what the points from inside it count)."""
    if tag in CUT or (tag == "header" and not in_article):
        return True, 1.0
    factor = STRONG if tag == "form" else 1.0
    if not attributes or attributes.isspace():
        return False, factor
    named = tag not in WHOLE or (tag == "article" and in_article)
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if named:
                factor = min(factor, name_factor(value, in_article))
        elif tag in WHOLE:
            continue
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES):
            return True, factor
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, factor
    return False, factor


def parse(html: str) -> list[Node]:
    """The nodes of a page's tree in page order, its root first."""
    root = Node("#root", None, False, 1.0, 0)
    nodes, opened = [root], [root]
    places: dict[str, list[int]] = {}  # of each tag's open elements in `opened`
    whole = ("article", "main")

    def end(tag: str, scope: frozenset | set | tuple) -> None:
        """Close the innermost open `tag`, unless an element of `scope` lies within it."""
        own = places.get(tag)
        if not own:
            return
        for other in scope:
            if places.get(other) and places[other][-1] > own[-1]:
                return
        for x in opened[own[-1] :][::-1]:
            places[x.tag].pop()
            opened.pop()

    n, at = len(html), 0
    while at < n:
        node = opened[-1]
        m = _TAG.search(html, at)
        if m is None:
            node.children.append(unescape(html[at:]))
            break
        if m.start() > at:
            node.children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            end(tag, ("table",) if tag in ("p", "li") else ())
            continue
        if tag not in INLINE:
            end("p", P_SCOPE)
            for other in ENDS.get(tag, ()):
                end(other, SCOPE[tag])
            node = opened[-1]
        child = Node(tag, node, *_grade(tag, m[3], any(places.get(x) for x in whole)), len(nodes))
        nodes.append(child)
        node.children.append(child)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else n
            continue
        places.setdefault(tag, []).append(len(opened))
        opened.append(child)
    return nodes


def text_blocks(root: Node) -> list[tuple[str, int, Node, float]]:
    """(text, characters in links, innermost block element, what its points count) of every text block that is not left out, in page order."""
    out: list[tuple[str, int, Node, float]] = []
    parts: list[str] = []
    linked = 0

    def flush(holder: Node) -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, min(linked, len(text)), holder, factors[holder]))
            parts.clear()
            linked = 0

    holder = root
    factors = {root: 1.0}
    stack: list[tuple[Node, Iterator, bool, Node]] = [(root, iter(root.children), False, root)]
    while stack:
        node, children, in_link, above = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if node.tag not in INLINE:
                flush(holder)
                holder = above
            continue
        if isinstance(child, str):
            parts.append(child)
            if in_link:
                linked += len(child.strip())
        elif child.cut:
            if child.tag not in INLINE:
                flush(holder)
        elif child.tag in ("br", "wbr", "img"):
            parts.append(" " if child.tag != "wbr" else "")
        elif child.tag in INLINE:
            stack.append((child, iter(child.children), in_link or child.tag == "a", above))
        else:
            flush(holder)
            factors[child] = min(factors[holder], child.factor)
            stack.append((child, iter(child.children), in_link, holder))
            holder = child
    return out


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by newlines."""
    nodes = parse(html or "")
    found = text_blocks(nodes[0])
    if not found:
        return ""
    for text, linked, holder, factor in found:
        holder.size += len(text)
        holder.links += linked
        points = factor * (min(1.0, len(text) / 25) + len(_COMMA.findall(text)) + min(len(text) / 100, 3))
        holder.points += points
        if holder.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            points *= 0.25
        node, level = holder.parent if holder.tag in PARAGRAPH and holder.parent is not None else holder, 0
        while node is not None and level < LEVELS and (node.tag != "#root" or level == 0):
            node.score += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            node, level = node.parent, level + 1
    for x in reversed(nodes):  # children come after their parents
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.links += x.links
            x.parent.points += x.points
    scored = [x for x in nodes if x.score]
    worth = lambda x: x.score * (1 - x.links / x.size) if x.size else 0.0
    best = max(scored, key=lambda x: (worth(x), -x.order))
    node = best
    while node is not None:
        if node.tag == "article":
            best = node
            break
        node = node.parent
    kept = {best}
    if best.parent is not None:
        least = max(10.0, 0.2 * worth(best))
        for x in best.parent.children:
            if isinstance(x, Node) and x is not best and not x.cut and x.size and x.factor == 1:
                density = x.links / x.size
                if worth(x) >= least or (x.tag == "p" and (x.size > 80 and density < 0.25)):
                    kept.add(x)
    out, inside = [], {}
    for text, _, holder, _ in found:
        # Lists and boxes inside the article that are mostly links are menus of their own; so are elements named so,
        # unless they hold most of the article's points.
        node, keep, path = holder, None, []
        while keep is None:
            keep = inside.get(node)
            if keep is None:
                path.append(node)
                if node in kept:
                    keep = True
                elif node.parent is None or (node.tag not in ARTICLE_TEXT and node.links > 0.6 * node.size) or (node.factor < 1 and node.points <= best.points - node.points):
                    keep = False
                else:
                    node = node.parent
        for x in path:
            inside[x] = keep
        if keep:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` (any columns, with html) and text, n_chars; columns of pages with these names are replaced."""
    ready(pages.sparkSession)
    pages = pages.drop("text", "n_chars")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html"):
            texts = [main_text(x) for x in block.column(block.schema.get_field_index("html")).to_pylist()]
            yield pa.record_batch([*block.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*block.schema.names, "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in pages.schema.fields), "text string", "n_chars long"])
    return pages.mapInArrow(work, schema)


def op1_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract(pages).select("page_id", "url", "text", "n_chars")
