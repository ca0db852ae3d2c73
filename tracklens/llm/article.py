"""Main text of web pages by tree scoring.

A page becomes a tree. What is no reading matter goes first: scripts, styles, menus,
footers, forms by their elements, adverts, notices, sidebars and reader comments by what
their classes, ids and roles say. Every paragraph then passes points for its length and
commas to its ancestors, whole to the nearest, half to the next and less to those above,
discounted by the share of its text that is links. The container with most points, again
discounted by its links, is kept with those siblings that score or read like it.

A page is one row and its tree one task's; pages are never shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, with raw text, that end an open paragraph, and that stand in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Fixed values of HTML: the elements that a start tag ends, and those it looks no further than.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements and roles that hold no reading matter.
DROPPED = frozenset("script style noscript template textarea title iframe noembed noframes head nav footer aside form button select option dialog menu object svg canvas audio video search".split())
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of classes and ids that tell of something else than the article, those that tell of readers' comments, and those that say what a page has or hasn't.
UNLIKELY = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promoted promotion promotions nav navbar navigation menu menubar topbar breadcrumb breadcrumbs
    crumbs masthead header footer foot sidebar aside notice notices notification alert cookie cookies consent gdpr privacy popup popover modal newsletter subscribe subscription signup signin login
    register share sharing social related recommended recommendations outbrain taboola adsbygoogle pagination pager paging toolbar search searchbox copyright disclaimer hidden toc""".split()
)
#: Words that tell so unless another word names the article.
DOUBTFUL = frozenset("widget widgets skip tags overlay follow rail legal".split())
COMMENTS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
STATES = frozenset("has with without no is not".split())
LIKELY = frozenset("article articlebody body content entry main page post story text blog prose".split())
#: Points: of a paragraph for its length, and of an element and its names before any paragraph.
LONG, LENGTH_STEP, LENGTH_MOST = 25, 100, 3
TAG_POINTS = {"article": 25, "main": 10, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
NAME_POINTS = 25
#: Open elements at most, as browsers have it: what is nested deeper counts to the last of them.
DEEPEST = 512
#: Ancestors that a paragraph passes points to; a sibling's least share of the points that the best container gets from paragraphs, and its least points; links of which a list is a menu.
REACH, SIBLING_SHARE, SIBLING_LEAST, MENU_LINKS, MENU_DENSITY = 5, 0.2, 1, 3, 0.5

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|!--|[!?/])")
_PLAIN_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|!--|[!?/])")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+(?=[\s/\"']|$)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_COMMAS = re.compile("[,،、，;]")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: its place in the tree, what its names say, and what it has gathered."""

    __slots__ = ("tag", "parent", "order", "names", "heading", "out", "gone", "muted", "base", "points", "chars", "links", "anchors")

    def __init__(self, tag: str, parent: Node | None, order: int, names: str):
        self.tag, self.parent, self.order, self.names = tag, parent, order, names
        self.heading, self.out, self.gone = tag in ("h1", "main"), False, ""
        self.points: float | None = None
        self.muted = False
        self.base = self.chars = self.links = self.anchors = 0


def said_by_names(names: str) -> str:
    """What an element's classes and id tell: 'comments', 'unlikely', 'likely' or nothing."""
    likely = doubtful = False
    for name in names.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if not STATES.isdisjoint(words):
            continue
        if not COMMENTS.isdisjoint(words):
            return "comments"
        if not UNLIKELY.isdisjoint(words):
            return "unlikely"
        likely = likely or not LIKELY.isdisjoint(words)
        doubtful = doubtful or not DOUBTFUL.isdisjoint(words)
    return "likely" if likely else "unlikely" if doubtful else ""


def _attributes(source: str) -> tuple[str, bool]:
    """(classes and id, whether role or visibility rules the element out)."""
    names, out = "", False
    for key, a, b, c in _ATTRIBUTE.findall(source):
        key, value = key.lower(), entities.unescape(a or b or c)
        if key in ("class", "id"):
            names += " " + value
        elif key == "role":
            out = out or value.strip().lower() in DROPPED_ROLES
            names += " main" if value.strip().lower() == "main" else ""
        elif key == "itemprop":
            names += " articlebody" if value == "articleBody" else ""
        elif key == "hidden":
            out = True
        elif key == "aria-hidden":
            out = out or value.strip().lower() == "true"
        else:
            out = out or bool(_INVISIBLE.search(value))
    return names, out


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements of a page in order, and its blocks: (element that holds it, text, characters in links).

    A block is the text of a line of inline elements within one block element. Open
    elements end as HTML has it: a paragraph at the next block, an item at the next item,
    all at the end. Time is linear in the page however it is nested or cut.
    """
    root = Node("html", None, 0, "")
    nodes, blocks = [root], []
    stack: list[Node] = [root]
    pieces: list[str] = []
    linked: list[str] = []
    depth: dict[str, int] = {"html": 1}
    lowered: str | None = None
    muted = 0
    at, end, tag_form = 0, len(page), _TAG

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                holder = next(n for n in reversed(stack) if n.tag in BLOCK)
                blocks.append((holder, text, len(" ".join(entities.unescape("".join(linked)).split()))))
            pieces.clear()
            linked.clear()

    def pop(k: int) -> None:
        nonlocal muted
        for n in stack[k:]:
            depth[n.tag] -= 1
            muted -= n.muted
        del stack[k:]

    def close(tags: set[str], scope: set[str]) -> None:
        """End the nearest of tags, unless one of scope stands between."""
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in tags:
                pop(k)
                return
            if tag in scope:
                return

    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            begin = end
        if begin > at and not muted:
            pieces.append(page[at:begin])
            if depth.get("a"):
                linked.append(page[at:begin])
        if begin == end:
            break
        found = tag_form.match(page, begin)
        if found is None and tag_form is _TAG and page[begin + 1 : begin + 2].isalpha() | (page[begin + 1 : begin + 2] == "/"):
            tag_form = _PLAIN_TAG  # a quote that nothing closes: from here quotes aren't heeded
            found = tag_form.match(page, begin)
        if found is None:
            if page[begin + 1 : begin + 2].isalpha():  # a tag that the end of the page cuts
                break
            if not muted:
                pieces.append("<")
            at = begin + 1
            continue
        if found[2] is None:
            if found[0] == "<!--":
                close_at = page.find("-->", begin + 2)
                at = end if close_at < 0 else close_at + 3
            else:
                close_at = page.find(">", begin)
                at = end if close_at < 0 else close_at + 1
            continue
        at, tag = found.end(), found[2].lower()
        if found[1]:
            if depth.get(tag) and tag != "html":
                if tag in BLOCK:
                    flush()
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                #: An inline end tag doesn't end the block it stands in.
                if tag in BLOCK or all(n.tag not in BLOCK for n in stack[k:]):
                    pop(k)
            elif tag in ("br", "p"):
                flush()
            continue
        if tag in RAW:
            if lowered is None:
                lowered = page.lower()
                lowered = lowered if len(lowered) == end else re.sub("[A-Z]+", lambda m: m[0].lower(), page)
            close_at = lowered.find(f"</{tag}", at)
            close_at = end if close_at < 0 else page.find(">", close_at)
            at = end if close_at < 0 else close_at + 1
            continue
        if tag in ("br", "hr"):
            flush()
            continue
        if tag in VOID:
            continue
        if depth.get("head"):
            flush()
            close({"head"}, set())
        if tag in BLOCK:
            flush()
            if depth.get("p") and tag != "body":
                close({"p"}, {"table", "td", "th", "button", "object"})
            if tag in ENDED_BY:
                close(ENDED_BY[tag], SCOPE[tag])
        elif tag == "a" and depth.get("a"):
            close({"a"}, {"table", "td", "th"})
        elif tag == "option" and depth.get("option"):
            close({"option"}, {"select"})
        if tag in ("html", "body") and depth.get(tag):
            continue
        names, out = _attributes(found[3]) if found[3] else ("", False)
        node = Node(tag, stack[-1], len(nodes), names)
        node.heading = node.heading or " main" in names
        node.out = (out and tag not in ("html", "body")) or tag in DROPPED
        nodes.append(node)
        if (not found[3].endswith("/") or tag in BLOCK) and len(stack) < DEEPEST:
            stack.append(node)
            depth[tag] = depth.get(tag, 0) + 1
            #: What rules out an inline element rules out its words in the line.
            if tag not in BLOCK and (node.out or (names and said_by_names(names) in ("comments", "unlikely"))):
                node.muted = True
                muted += 1
    flush()
    return nodes, blocks


def _drop(nodes: list[Node], by_names: bool) -> None:
    """Mark what goes: by element, role and place, and by_names by classes and ids, unless the article's heading is inside."""
    for node in reversed(nodes):
        if node.heading and node.parent is not None:
            node.parent.heading = True
    for node in nodes:
        parent = node.parent
        if parent is None:
            continue
        node.gone = parent.gone or ("out" if node.out else "")
        if node.gone:
            continue
        if node.tag == "header":
            inside = parent
            while inside is not None and inside.tag not in ("article", "main"):
                inside = inside.parent
            node.gone = "header" if inside is None else ""
        elif node.tag not in ("html", "body", "main") and node.names:
            said = said_by_names(node.names)
            if said == "comments" or (by_names and said == "unlikely" and not node.heading):
                node.gone = said


def _ancestors(node: Node | None, most: int) -> Iterator[tuple[int, Node]]:
    level = 0
    while node is not None and level < most:
        yield level, node
        node, level = node.parent, level + 1


def _score(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    for holder, text, links in blocks:
        holder.chars += len(text)
        holder.links += links
        holder.anchors += links > 0
        points = (len(text) >= LONG) + len(_COMMAS.findall(text)) + min(len(text) / LENGTH_STEP, LENGTH_MOST)
        points *= 1 - min(links / len(text), 1.0)
        #: A paragraph passes its points on; text that stands in a container itself counts there.
        takes = holder if holder.tag in ("html", "body", "div", "section", "article", "main", "td") else holder.parent
        for level, node in _ancestors(takes, REACH):
            if node.points is None:
                said = said_by_names(node.names) if node.names else ""
                node.base = TAG_POINTS.get(node.tag, 0) + NAME_POINTS * ((said == "likely") - (said in ("unlikely", "comments")))
                node.points = 0.0
            node.points += points / (1, 2, 6, 9, 12)[level]
    for node in reversed(nodes):
        if node.parent is not None and not node.gone:
            node.parent.chars += node.chars
            node.parent.links += node.links
            node.parent.anchors += node.anchors


def _density(node: Node) -> float:
    return min(node.links / node.chars, 1.0) if node.chars else 0.0


def _earned(node: Node) -> float:
    """Points from paragraphs alone."""
    return (node.points or 0.0) * (1 - _density(node))


def _worth(node: Node) -> float:
    return node.base * (1 - _density(node)) + _earned(node)


def _within(node: Node, tops: set[int], known: dict[int, bool]) -> bool:
    """Whether node is one of tops or inside one; known keeps what was found on the way."""
    path = []
    at: Node | None = node
    while at is not None and at.order not in known and at.order not in tops:
        path.append(at.order)
        at = at.parent
    answer = at is not None and (at.order in tops or known[at.order])
    for order in path:
        known[order] = answer
    return answer


def _attempt(nodes: list[Node], blocks: list[tuple[Node, str, int]], by_names: bool) -> str:
    for node in nodes:
        node.points, node.base, node.chars, node.links, node.anchors = None, 0, 0, 0, 0
    _drop(nodes, by_names)
    left = [b for b in blocks if not b[0].gone]
    _score(nodes, left)
    scored = [n for n in nodes if n.points is not None and not n.gone]
    if not scored:
        return ""
    best = max(scored, key=lambda n: (_worth(n), -n.order))
    #: An article or main element around the best container is the container.
    for wanted in ("article", "main"):
        holders = [n for _, n in _ancestors(best, len(nodes)) if n.tag == wanted]
        if holders:
            best = holders[-1]
            break
    tops = {best.order}
    if best.parent is not None and best.tag not in ("html", "body"):
        least = max(SIBLING_LEAST, SIBLING_SHARE * _earned(best))
        for node in nodes:
            if node.parent is not best.parent or node.gone or node is best:
                continue
            density = _density(node)
            reads = node.tag == "p" and node.chars and (density < 0.25 if node.chars > 80 else density == 0)
            title = node.tag in ("h1", "h2") and node.order < best.order and density == 0
            if reads or title or _earned(node) >= least:
                tops.add(node.order)
    #: Within the container lists of links are menus too.
    for node in nodes:
        if node.tag in ("ul", "ol", "dl", "table") and not node.gone and node.anchors >= MENU_LINKS and _density(node) > MENU_DENSITY:
            node.gone = "menu"
        elif not node.gone and node.parent is not None and node.parent.gone == "menu":
            node.gone = "menu"
    known: dict[int, bool] = {}
    return " ".join(text for holder, text, _ in left if not holder.gone and _within(holder, tops, known))


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order with one space between; empty if there is none."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    #: Where names leave nothing, they misled; elements alone decide then.
    return _attempt(nodes, blocks, True) or _attempt(nodes, blocks, False)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(0).to_pylist()]
        columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(1)]
        yield pa.RecordBatch.from_arrays(columns, ["text", "n_chars", "row"])


def extract_articles(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text, the main text of each page, and n_chars, its code points, in place of columns of these names.

    A page that is null, empty or has no text between its tags has an empty text. Pages
    are taken whole, each in one task's memory; cut and badly nested ones are read as
    browsers read them. Repeated rows are extracted each. All other columns pass through.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    own = [c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")]
    rows = pages.select(F.col(f"`{html}`").alias("page"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)]).alias("row"))
    schema = StructType([StructField("text", StringType()), StructField("n_chars", LongType()), StructField("row", rows.schema["row"].dataType)])
    found = rows.mapInArrow(_extract, schema)
    return found.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(own)], "text", "n_chars")
