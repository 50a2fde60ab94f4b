"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks.  A logistic classifier gives each block the costs of
calling it content or boilerplate; these are the capacities to the two terminals of a
graph.  Neighbouring blocks, and blocks under one parent element, are joined by smoothness
edges, so a doubtful block takes the label of its surroundings.  The minimum cut is the
labelling of least total cost, found by maximum flow after fixing the blocks whose own cost
outweighs all their edges (which any minimum cut labels that way).

Pages have no labels to learn from, so the weights of the classifier are set by hand; they are
the parameters below.  What a name such as ``sidebar`` says is held against the text that the element
holds: an element around the main part of a page, or around most of its text, is a wrapper, whatever it is
called, and counts neither way.  Each page is worked on where it is read; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import deque
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_slices

# Elements whose text is never shown, elements without content, elements that end a
# block, those that an element of the same kind closes, and those that may stand in a head (any other ends it).
DROPPED = frozenset("head title script style noscript template iframe svg select option textarea audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
_SCOPES = frozenset("table ul ol dl div section article main body td th blockquote".split())

#: What an element around a block adds to its log odds of being content.
TAG_WEIGHT = {"article": 4.5, "main": 3.0, "blockquote": 0.5, "figcaption": 0.0, "details": -0.5}
#: The same for elements that are boilerplate by kind or by name, and for names that only begin like one.
STRONG, WEAK, POSITIVE = -9.0, -2.5, 2.0
HEADER_IN_ARTICLE = -4.0
# Elements that are boilerplate by kind; words of classes, ids and roles that name boilerplate, readers'
# comments and content; words that say where or what shape an element is, and those that turn a name's sense around.
BOILERPLATE_TAGS = frozenset("nav footer aside form button menu dialog search fieldset header".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation footer header masthead "
    "cookie cookies consent gdpr notice notices alert share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs newsletter subscribe signup login popup modal overlay pagination pager copyright widget toolbar topbar contentinfo complementary skip outbrain taboola".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
CONTENT = frozenset("article content post entry story main articlebody".split())
SHAPES = frozenset(
    "area box section container wrapper wrap block bar list links link item items inner outer group row col column slot unit form button buttons btn icons icon "
    "left right top bottom fixed sticky small large posts articles stories news".split()
)
TURNS = frozenset("no not has have with without hide show is".split())
#: A wrapper holds at least this share of the page's, or of its main part's, text outside links.
WRAPPER = 0.5
COMMENT_WRAPPER = 0.95
#: The main part of a page: the marked element with most text outside links, if it has this share of it.
MAIN_SHARE = 0.3
#: What blocks gain where nothing on a page came out as content.
SECOND_LOOK = 3.0
#: What a block of links only adds, and where a block starts from.
_LINKS = -5.0
_BIAS = -1.2
#: Smoothness: between neighbours, by their distance in the tree, and between blocks of one parent.
ADJACENT = 1.5
SIBLING = 0.5
SCALE = 1000

_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?…:;,。][\s)\"'”»]*$")


def name_says(name: str) -> str:
    """What a class, an id or a role calls its element: "boilerplate", "comments", "content", "weak" or nothing.

    The last word that is no shape decides: ``site-footer``, ``comment-list``.  A boilerplate word elsewhere
    only makes a weak case (``related-work``), and none after a word such as ``has`` or ``no``.
    """
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    if not parts or TURNS.intersection(parts):
        return ""
    core = list(parts)
    while len(core) > 1 and core[-1] in SHAPES:
        core.pop()
    if core[-1] in COMMENTS or core[0] in COMMENTS:
        return "comments"
    if core[-1] in BOILERPLATE or (core[0] in BOILERPLATE and core[-1] in CONTENT):
        return "boilerplate"
    if BOILERPLATE.intersection(parts):
        return "weak"
    return "content" if CONTENT.intersection(parts) else ""


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    says: frozenset[str]
    depth: int
    dropped: bool
    in_article: bool
    number: int
    text: int = 0
    plain: int = 0
    weight: float = 0.0

    @property
    def rejected(self) -> bool:
        """Whether its kind or a name calls it boilerplate."""
        return self.tag in BOILERPLATE_TAGS or "comments" in self.says or ("boilerplate" in self.says and self.tag not in ("article", "main"))


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    element: Element
    heading: bool
    own: float = field(default=0.0)


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.number = 0
        self.here = Element("", None, frozenset(), 0, False, False, 0)
        self.elements = [self.here]
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.owner: Element | None = None
        self.past_head = False

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head(tag)
        elif tag == "head" and (self.past_head or self.here.tag == "head"):
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        if tag in BLOCKS and tag not in ("tr", "tbody", "tfoot", "thead", "li", "dt", "dd"):
            self._close(("p",))
        if tag in CLOSES:
            self._close(CLOSES[tag])
        up = self.here
        says = frozenset() if tag in ("html", "body") else frozenset(
            name_says(one) for name, value in attrs if name in ("class", "id", "role") and value for one in value.split()
        )
        self.number += 1
        self.links += tag == "a"
        self.here = Element(
            tag, up, says, up.depth + 1, up.dropped or tag in DROPPED, up.in_article or tag in ("article", "main"), self.number
        )
        self.elements.append(self.here)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        at = self.here
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self._leave(at.parent)

    def _leave(self, to: Element) -> None:
        while self.here is not to:
            self.links -= self.here.tag == "a"
            self.here = self.here.parent

    def _close(self, tags: tuple[str, ...]) -> None:
        at = self.here
        while at.parent is not None:
            if at.tag in tags:
                self.flush()
                self._leave(at.parent)
                return
            if at.tag in _SCOPES and at.tag not in ("td", "th"):
                return
            at = at.parent

    def _end_head(self, tag: str = "") -> None:
        """Leave an open head before what may not stand in it; a body also ends what was left open in the head."""
        at = self.here
        while tag == "body" and at.parent is not None and at.tag not in ("head", "template"):
            at = at.parent
        if at.tag == "head":
            self._leave(at.parent)
        self.past_head = self.past_head or not self.here.dropped

    def handle_data(self, data):
        if not self.past_head and data.strip(" \t\n\r\f"):
            self._end_head()
        if self.here.dropped:
            return
        if not self.parts or self.owner is None:
            self.owner = self.here
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = self.owner or self.here
                while at.parent is not None and at.tag not in BLOCKS:
                    at = at.parent
                self.blocks.append(Block(text, self.linked, at, at.tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
                at.text += len(text)
                at.plain += max(0, len(text) - self.linked)
            self.parts, self.linked, self.owner = [], 0, None


def blocks_of(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    _weigh(parser.elements)
    return parser.blocks


def _weigh(elements: list[Element]) -> None:
    """Give every element what it and those around it add to the log odds; parents stand before their children."""
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.text += e.text
            e.parent.plain += e.plain
    page = elements[0]
    marked = [e for e in elements if (e.tag in ("article", "main") or "content" in e.says) and not e.rejected]
    main = max(marked, key=lambda e: e.plain, default=None)
    small = main is not None and 0 < main.plain < MAIN_SHARE * page.plain
    if main is not None and main.plain < MAIN_SHARE * page.plain:
        main = None
    around, at = set(), main
    while at is not None:
        around.add(at.number)
        at = at.parent
    inside = set()
    for e in elements[1:]:
        if main is not None and (e.parent.number == main.number or e.parent.number in inside):
            inside.add(e.number)
        own = TAG_WEIGHT.get(e.tag, 0.0)
        if e.rejected:
            comments = "comments" in e.says
            # beside a short article only what holds next to everything is a wrapper
            share = COMMENT_WRAPPER if comments or small else WRAPPER
            held = e.plain >= share * page.plain if main is None else e.number in inside and e.plain >= share * main.plain
            wrapper = e.number in around or (held and e.tag not in ("footer", "nav", "aside"))
            # an empty page has no wrappers
            if not (wrapper and e.plain):
                own = HEADER_IN_ARTICLE if e.tag == "header" and e.in_article and not e.says else STRONG
        elif e.tag not in ("article", "main"):
            own += WEAK if "weak" in e.says else POSITIVE if "content" in e.says else 0.0
        e.weight = e.parent.weight + own


def log_odds(b: Block) -> float:
    """The classifier: positive for content."""
    n = len(b.text)
    x = _BIAS + max(-12.0, min(6.0, b.element.weight))
    x += min(2.0, n / 60)
    x += 1.0 if _SENTENCE.search(b.text) else 0.0
    x += _LINKS * max(0.0, b.linked / n - 0.2)
    if b.heading:
        x += 4.0 if b.element.in_article else 0.8
    elif b.element.tag in ("p", "pre", "blockquote"):
        x += 0.7
    return x


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(block, later block, capacity) of the smoothness edges."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, int(SCALE * ADJACENT / (1 + _distance(blocks[i - 1].element, b.element)))))
        parent = b.element.parent
        if parent is not None:
            if parent.number in last and last[parent.number] != i:
                out.append((last[parent.number], i, int(SCALE * SIBLING)))
            last[parent.number] = i
    return out


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(own: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the blocks on the content side of a minimum cut.

    ``own[i]`` is what calling block ``i`` boilerplate costs more than calling it content.
    """
    n = len(own)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    label: list[bool | None] = [None] * n
    open_ = [sum(c for _, c in near[i]) for i in range(n)]
    net = list(own)
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(net[i]) > open_[i]:
            label[i] = net[i] > 0
            for j, c in near[i]:
                if label[j] is None:
                    net[j] += c if label[i] else -c
                    open_[j] -= c
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        inner = [(at[a], at[b], c) for a, b, c in edges if a in at and b in at]
        for i, side in zip(rest, _source_side([net[i] for i in rest], inner), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _source_side(net: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The source side of a maximum flow (shortest augmenting paths in layers)."""
    n = len(net)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def join(a: int, b: int, forward: int, backward: int) -> None:
        for x, y, c in ((a, b, forward), (b, a, backward)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)

    for i, v in enumerate(net):
        if v > 0:
            join(source, i, v, 0)
        elif v < 0:
            join(i, sink, -v, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if not room[e])
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while following[u] < len(graph[u]):
                e = graph[u][following[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                following[u] += 1
            if following[u] < len(graph[u]):
                path.append(graph[u][following[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                following[u] += 1
            else:
                break


def main_text(html: str | None) -> str:
    """The content blocks of a page in their order, one to a line; empty for NULL and for pages without any."""
    if not html:
        return ""
    blocks = blocks_of(html)
    odds, edges = [log_odds(b) for b in blocks], edges_of(blocks)
    keep = minimum_cut([_capacity(x) for x in odds], edges)
    if not any(keep):
        # a few short lines and no marks: what neither links nor stands in boilerplate is the text
        odds = [x + SECOND_LOOK if b.element.weight > STRONG / 2 else x for x, b in zip(odds, blocks, strict=True)]
        keep = minimum_cut([_capacity(x) for x in odds], edges)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def _capacity(odds: float) -> int:
    """What calling a block boilerplate costs more than calling it content: the difference of the costs -log p and -log (1 - p)."""
    p = 1 / (1 + math.exp(-odds))
    return int(SCALE * (math.log(p) - math.log1p(-p)))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: (id, url, text, n_chars).

    NULL and empty pages have empty text.  Repeated rows are read one by one; other columns are
    not read.  A page that is one very long block costs time in proportion to its length.
    """

    def work(idents, urls, pages_):
        texts = [main_text(h) for h in pages_]
        return idents, urls, texts, [len(t) for t in texts]

    return map_slices(pages.select(F.col(id_col).cast("bigint"), url_col, html_col), work, "id bigint, url string, text string, n_chars bigint")
