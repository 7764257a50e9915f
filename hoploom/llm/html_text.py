"""HTML extraction by composite text density.

A page becomes a tree of elements. Elements that are never article text
(scripts, navigation, headers, footers, asides) are cut off by their tag. Forms
and elements whose class, id or role names a sidebar, notice, advert, comment or
the like only weigh less: their densities and those of all that is in them are
multiplied by ``PENALTY``, unless the article is inside (see ``_spare_wrappers``).
For every remaining node the composite density is
link-adjusted characters per tag,

    C/T * log_b((C/LC) * (T/LT)),  b = ln(C/(C-LC) * LC + LCb/Cb * C + e)

with characters C, tags T, characters LC and tags LT inside links, and the
body's LCb and Cb. A node's density sum adds its children's densities; the node
of maximal sum is where the article is looked for, and the least density on its
path to the body is the threshold. As the density grows with the size of a node,
a subtree also reaches the threshold if its characters outside links per tag are
no fewer than the least on that path. The article is the highest ancestor of
that node beside whose path another subtree reaches the threshold, so that a
text in several sections stays whole; what stands between its sections stays, lists of
links below the threshold do not. An enclosing article element is left only for
other article elements that reach the threshold, an enclosing main element
never. If the article has no h1, the nearest h1 before it is its title, and what
stands between the two stays as well. What is marked inside of the
chosen subtree is left out, but sections of an ambiguous name ("related work") that
are about as dense as the article are part of it.

Defined results: null and empty pages give an empty text; broken markup is
closed as browsers do; a page of bare text is its own article; very long pages are
extracted whole; of nodes of equal sums the outermost is taken; repeated pages are
extracted alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
NOISE_TAGS = frozenset("head title script style noscript template nav header footer aside button select textarea input iframe svg object canvas dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or an id that mark an element as no article text.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promos promotion sponsor sponsored sponsors sidebar sidebars aside rail cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies discussion related recommended recommendations breadcrumb breadcrumbs pagination pager menu menus nav navbar navigation topnav footer foot header masthead widget widgets toolbar search".split()
)
KEPT_TAGS = frozenset("html body article main".split())
#: What these words mark may be longer than the article it belongs to.
REPLY_WORDS = frozenset("comment comments commentlist disqus reply replies discussion".split())
#: Running text with one of these words is still text: a paragraph of class "notice" belongs to its article.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table caption tbody thead tr td th dl dt dd figure figcaption span em strong b i u mark code q cite small sub sup".split())
TEXT_WORDS = frozenset("notice notices related discussion social comment comments reply header search promotion recommended rail modal overlay toolbar share sharing aside".split())
#: What follows one of these words in a class or an id says how the page is laid out.
LAYOUT_WORDS = frozenset("has no with without".split())
#: Sections whose marks are all of these may be the article's: their density decides.
AMBIGUOUS_WORDS = frozenset("related social search rail promotion".split())
#: Factor of the densities in marked elements, and the share of the article's characters per tag that an ambiguous section needs.
PENALTY, AMBIGUOUS_SHARE = 0.05, 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the right side is closed by a start tag of the left side.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What may stand in a head; anything else, and text, ends it.
HEAD_TAGS = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
SCOPES = frozenset("table td th ul ol dl button object article section div body html".split())


class Node:
    __slots__ = ("tag", "kind", "noise", "weak", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "own", "reaches", "titled")

    def __init__(self, tag: str, parent: Node | None, kind: str = ""):
        self.tag, self.parent, self.kind, self.noise, self.weak = tag, parent, kind, kind == "cut", False
        self.children: list[Node | str] = []


def _class_words(value: str) -> set[str]:
    """Words of a class or an id, without those that only describe the layout (``has-sidebar``, ``layout-with-header``)."""
    out: set[str] = set()
    for name in re.sub(r"([a-z])([A-Z])", r"\1 \2", value.replace(" ", "\n")).lower().split("\n"):
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if "layout" not in words:
            end = next((k for k, w in enumerate(words) if w in LAYOUT_WORDS), len(words))
            out.update(words[:end])
    return out


def _noise_of(tag: str, attributes: list[tuple[str, str | None]]) -> str:
    """"cut", or a mark: "soft", "ambiguous", "reply" (may be longer than the article); or ""."""
    if tag in NOISE_TAGS:
        return "cut"
    kind = "soft" if tag == "form" else ""
    if tag in KEPT_TAGS:
        return kind
    for name, value in attributes:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "cut"
        if name == "role" and value.lower() in NOISE_ROLES:
            kind = "reply" if kind == "reply" else "soft"
        if name in ("class", "id"):
            found = NOISE_WORDS & _class_words(value)
            if tag in TEXT_TAGS:
                found -= TEXT_WORDS
            if found:
                kind = "reply" if kind == "reply" or found & REPLY_WORDS else "soft" if kind == "soft" or found - AMBIGUOUS_WORDS else "ambiguous"
    return kind


class TreeBuilder(HTMLParser):
    """Builds the element tree; unclosed paragraphs, items and cells end where the next one starts, an open head where what cannot stand in it does.

    Open elements are kept with their depth, in all and by tag, so a tag takes no longer however deep it stands.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.body: Node | None = None
        self._start_at([self.root])

    def _start_at(self, path: list[Node]) -> None:
        self.path = path
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        for depth, node in enumerate(path):
            self._opened(node, depth)

    @property
    def at(self) -> Node:
        return self.path[-1]

    def _opened(self, node: Node, depth: int) -> None:
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCKS:
            self.blocks.append(depth)

    def _close_from(self, depth: int) -> None:
        """Closes the element at this depth and all in it."""
        while len(self.path) > depth:
            node = self.path.pop()
            self.depths[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()

    def _deepest(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def _leave_head(self) -> None:
        if self.at.tag == "head":
            self._close_from(len(self.path) - 1)

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag == "body":
            if self.body is None:
                self.body = Node("body", self.root)
                self.root.children.append(self.body)
                self._start_at([self.root, self.body])
            return
        if tag not in HEAD_TAGS:
            self._leave_head()
        if tag in BLOCKS:
            self._close_up_to({"p"}, SCOPES)
        if tag in IMPLIED_END:
            self._close_up_to(IMPLIED_END[tag], SCOPES - IMPLIED_END[tag])
        node = Node(tag, self.at, _noise_of(tag, attrs))
        self.at.children.append(node)
        if tag not in VOID:
            self._opened(node, len(self.path))
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML has no self-closing elements but the void ones

    def _close_up_to(self, tags, scopes) -> None:
        """Closes the innermost open element of ``tags``, if no scope is open in it."""
        depth = self._deepest(tags)
        if depth >= 0 and depth >= self._deepest(scopes):
            self._close_from(depth)

    def handle_endtag(self, tag):
        depth = self._deepest((tag,))
        if tag in ("html", "body") or tag in VOID or depth < 0:
            return
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > depth:
            return  # an inline end tag does not close a block
        self._close_from(depth)

    def handle_data(self, data):
        if data.strip():
            self._leave_head()
        self.at.children.append(data)


def parse_tree(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    top = builder.body or builder.root
    _spare_wrappers(top)
    return top


class _Share:
    """What an element holds: characters, those of articles without their headings, main elements, titles, and the wrappers in it."""

    __slots__ = ("chars", "article", "mains", "titles", "wrappers")

    def __init__(self) -> None:
        self.chars = self.article = self.mains = self.titles = 0
        self.wrappers: list[tuple[Node, _Share, _Share]] = []

    def add(self, other: _Share) -> None:
        self.chars += other.chars
        self.article += other.article
        self.mains += other.mains
        self.titles += other.titles


def _spare_wrappers(top: Node) -> None:
    """Takes the mark off elements of class words, roles and forms that hold what the rest of the page lacks.

    Such an element loses its mark if it holds a main element, at least as much article text
    as the rest, the only h1, or more than half of the body's text (an advert beside
    an article with text does not count as that); one of reader comments has to
    hold the page's only article text. The rest of the page is what
    no such element holds, and what the ones without mark hold themselves. The longest
    are asked first, those inside one that lost its mark after it.
    """
    order: list[tuple[Node, bool, bool]] = []
    todo: list[tuple[Node, bool, bool]] = [(top, top.tag in ("article", "main"), False)]
    while todo:
        node, inside, heading = todo.pop()
        order.append((node, inside, heading))
        for x in node.children:
            if isinstance(x, Node) and x.kind != "cut":
                todo.append((x, inside or x.tag in ("article", "main"), heading or x.tag in HEADINGS))
    if not any(node.kind for node, _, _ in order):
        return
    every: dict[int, _Share] = {}  # all but what is cut off by its tag
    own: dict[int, _Share] = {}  # without the wrappers inside
    for node, inside, heading in reversed(order):
        a, o = every[id(node)], own[id(node)] = _Share(), _Share()
        for x in node.children:
            if isinstance(x, str):
                n = len(" ".join(x.split()))
                for share in (a, o):
                    share.chars += n
                    share.article += n if inside and not heading else 0
            elif x.kind != "cut":
                a.add(every[id(x)])
                if x.kind:
                    o.wrappers.append((x, every[id(x)], own[id(x)]))
                else:
                    o.add(own[id(x)])
                    o.wrappers.extend(own[id(x)].wrappers)
                    own[id(x)].wrappers = []
        for share in (a, o):
            share.mains += node.tag == "main"
            share.titles += node.tag == "h1" and a.chars > 0
    total, rest = every[id(top)].chars, own[id(top)]
    heap = [(-a.chars, k, x, a, o) for k, (x, a, o) in enumerate(rest.wrappers)]
    heapq.heapify(heap)
    seen = len(heap)
    while heap:
        _, _, node, a, o = heapq.heappop(heap)
        if node.kind == "reply":
            stays = a.mains > 0 or rest.article == 0 and (a.article > 0 or 2 * a.chars > total)
        else:
            stays = a.mains > 0 or 0 < a.article >= rest.article or a.titles > 0 and rest.titles == 0 or 2 * a.chars > total and (rest.article == 0 or a.article > 0)
        if stays:
            node.kind = ""
            rest.add(o)
            for x, inner, its in o.wrappers:
                heapq.heappush(heap, (-inner.chars, seen, x, inner, its))
                seen += 1


def _bottom_up(top: Node) -> list[Node]:
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        order.append(node)
        for x in node.children:
            if isinstance(x, Node) and not x.noise:
                x.weak = node.weak or bool(x.kind)
                todo.append(x)
    return order[::-1]


def _measure(top: Node) -> list[Node]:
    nodes = _bottom_up(top)
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(" ".join(x.split()))
            elif not x.noise:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    body_share = top.link_chars / max(1, top.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            node.density = 0.0
        else:
            base = math.log(math.log(c / max(1, c - node.link_chars) * lc + body_share * c + math.e))
            # Below 0 only for a link itself, which counts for more link tags than it has inside: no text density either.
            node.density = c / t * max(0.0, math.log(c / lc * t / lt)) / base * (PENALTY if node.weak else 1)
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.noise)
    return nodes


def _plain(node: Node) -> float:
    return (node.chars - node.link_chars) / max(1, node.tags)


def _drop_links(nodes: list[Node | str]) -> None:
    """Marks lists of links as noise, but not the subtrees that reach the threshold."""
    todo = [x for x in nodes if isinstance(x, Node) and not x.noise]
    while todo:
        x = todo.pop()
        if x.own:
            continue
        if x.reaches or x.titled:
            todo.extend(c for c in x.children if isinstance(c, Node) and not c.noise)
        elif x.link_tags > 1 and 2 * x.link_chars > x.chars:
            x.noise = True


def _drop_marked(top: Node) -> Node:
    """Marks what is left of marked elements as noise; ambiguous ones of several paragraphs stay if they are about as dense as ``top``."""
    todo = [top]
    while todo:
        for x in todo.pop().children:
            if isinstance(x, Node) and not x.noise:
                dense = x.kind == "ambiguous" and sum(isinstance(c, Node) and c.tag == "p" for c in x.children) > 1 and _plain(x) >= AMBIGUOUS_SHARE * _plain(top)
                if x.kind and not dense:
                    x.noise = True
                else:
                    todo.append(x)
    return top


def main_node(top: Node) -> Node:
    """The article's subtree; what does not belong to it is taken out of the tree: lists of links, marked elements and what stands before a title."""
    return _drop_marked(_densest(top))


def _densest(top: Node) -> Node:
    nodes = _measure(top)
    best = max((n for n in reversed(nodes) if not n.weak), key=lambda n: n.total)  # the outermost wins a tie
    if best.total <= 0:
        return top
    path, node = [best], best
    while node is not top and node.parent is not None:
        node = node.parent
        path.append(node)
    threshold, plain = min(n.density for n in path), min(map(_plain, path))
    marked = [k for k, n in enumerate(path) if n.tag in ("article", "main")]
    start = marked[-1] if marked else 0
    for node in nodes:
        inner = [x for x in node.children if isinstance(x, Node) and not x.noise]
        node.titled = not node.weak and node.tag == "h1" and node.chars > 0 or any(x.titled for x in inner)
        node.own = not node.weak and node.density > 0 and (node.density >= threshold or _plain(node) >= plain)
        node.reaches = node.own and (not marked or node.tag == "article") or any(x.reaches for x in inner)

    def beside(k: int) -> list[Node | str]:
        return [x for x in path[k].children if x is not path[k - 1]]

    at = start
    if not any(path[k].tag == "main" for k in marked):
        at = max((k for k in range(start + 1, len(path)) if any(isinstance(x, Node) and not x.noise and x.reaches for x in beside(k))), default=start)
    for k in range(start + 1, at + 1):
        _drop_links(beside(k))
    if path[at].titled:
        return path[at]
    for k in range(at + 1, len(path)):
        before = path[k].children[: path[k].children.index(path[k - 1])]
        titles = [i for i, x in enumerate(before) if isinstance(x, Node) and not x.noise and x.titled]
        if titles:
            for m in range(at + 1, k + 1):
                head = path[m].children[: path[m].children.index(path[m - 1])]
                if m == k:
                    head = head[titles[-1] :]
                _drop_links(head)
                path[m].children = [*head, path[m - 1]]
            return path[k]
    return path[at]


def blocks_of(top: Node) -> list[str]:
    """Texts of the blocks under a node, in page order, white space collapsed; empty ones dropped."""
    out: list[str] = []
    parts: list[str] = []

    def end_block() -> None:
        if text := " ".join("".join(parts).split()):
            out.append(text)
        parts.clear()

    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            end_block()
        elif isinstance(x, str):
            parts.append(x)
        elif x.noise:
            continue
        else:
            if x.tag in BLOCKS:
                end_block()
                todo.append(None)
            elif x.tag in ("br", "td", "th"):
                parts.append(" ")
            todo.extend(reversed(x.children))
    end_block()
    return out


def extract(html: str | None) -> str:
    return "\n\n".join(blocks_of(main_node(parse_tree(html)))) if html else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. One pass, no shuffle."""

    def run(batches):
        import pyarrow as pa

        for part in arrow_slices(batches, 500):
            texts = [extract(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
