"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into text blocks that hang in the element tree. The graph has a node for every block and for every
element that says something or holds several others. A classifier over a block's words, links, punctuation and
phrases gives its cost for either label, elements add what their tag and names say, once for each block they hold:
these are the capacities to the two terminals. Smoothness edges join a block to the element around it, an element to
the one around that, and neighbours in page order, the more weakly the further apart they are in the tree. The
minimum cut separates content from boilerplate: a short paragraph follows the article around it, a link list in that
article doesn't, nor do long comments under an element that names itself so, and a heading named related-work stays.
No tag or name fixes a label. Nodes whose own capacity outweighs all their edges are settled first, which keeps the
cut as it is; the rest goes through Dinic's flow.

Defined results: null or empty html gives empty text; broken markup is read as far as it goes (an
unclosed script or comment runs to the end); character references are decoded; scripts, styles, buttons and what
stands in for media (svg, object, canvas, noscript) hold no text; repeated rows give equal results; other columns pass
through, and the operator's own columns (text, n_chars, n_blocks, n_content) replace any of the same name.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from phasegrid.llm.store import extended
from phasegrid.llm.tokens import slices

TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|!\[CDATA\[(.*?)\]\]>|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)""", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TOKEN = re.compile(r"[a-z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select canvas audio video button".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes if it is open, and how far out it looks.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
MAIN_TAGS = frozenset({"article", "main"})
UNNAMED = frozenset({"html", "body", "article", "main"} | HEADINGS)
#: Elements that are hardly ever main text; header is one outside the article.
BESIDE = frozenset("nav footer aside form menu dialog head".split())
#: Names (words of class, id and role) of what isn't main text, wherever they stand in a name.
NAMED = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo complementary sidebar widget widgets ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo cookie cookies cmp gdpr popup modal newsletter signup login disqus pager pagination masthead".split())
#: Names that also are everyday words: these count in full alone or beside PLAIN words.
EVERYDAY = frozenset("aside banner header consent notice notices alert dialog promotion subscribe search share sharing social related recommended recommendations comment comments reply replies respond discussion reactions responses feedback".split())
PLAIN = frozenset("list box bar button buttons link links post posts article articles section form area block wrapper container inner outer site page user users reader readers left right top bottom item items thread body text content icons tools media main new latest more wrap row col column panel group count title the and for id".split())
WITHOUT = frozenset("no not has with without hide".split())
CONTENT_NAMES = frozenset("article content entry post story text prose main".split())
PHRASES = re.compile(r"\bcookies?\b|\bnewsletter\b|\bsubscribe\b|\bsponsored\b|\badvertisement\b|all rights reserved|©|privacy policy|\bsign (?:in|up)\b|\blog ?in\b", re.I)
#: Capacities: of a block's tie to the element around it and of that to the next (an own cost of a block below it
#: gives way; MORE for each further block an element holds), of neighbours in page order, and what an element says for each block it holds (a sure one has
#: a TIE more, as much as the element around it can say).
TIE, MORE, BESIDE_TIE, ARTICLE, OUTSIDE, ALONE, AGAINST, HINT, FAVOUR = 3.0, 0.5, 0.8, 4.0, -4.0, 1.5, -4.0, -1.0, 0.8
#: A page is about its article and main elements if these hold so much of its text outside links and outside what speaks against itself.
MOST = 0.4


@dataclass(eq=False)
class Node:
    tag: str
    depth: int
    up: "Node | None"
    main: bool
    worth: float
    weak: bool = False
    fair: bool = True
    blocks: int = 0
    kids: int = 0
    chars: int = 0
    mains: int = 0
    place: int = -1


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def worth_of(tag: str, attrs: str, main: bool) -> tuple[float, bool]:
    """What an element says for each block it holds, and whether that is taken back where it holds most of the page."""
    worth, weak = (AGAINST, tag == "form") if tag in BESIDE or tag == "header" and not main else (0.0, False)
    if not attrs:
        return worth, weak
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return 2 * AGAINST, False
        if key not in ("class", "id", "role") or tag in UNNAMED:
            continue
        for name in value.split():
            words = TOKEN.findall(name)
            if WITHOUT.intersection(words):
                continue
            alone = len([w for w in words if not w.isdigit()]) == 1
            if NAMED.intersection(words):
                worth, weak = min(worth, AGAINST), weak or not alone
            elif EVERYDAY.intersection(words) and not (main and "header" in words):
                sure = all(w in EVERYDAY or w in PLAIN or w.isdigit() for w in words)
                worth, weak = min(worth, AGAINST if sure else HINT), weak or not sure
            elif CONTENT_NAMES.intersection(words) and not worth:
                worth = FAVOUR
    return worth, weak


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """The text blocks of a page, in order, and its elements, each behind the one around it."""
    root = Node("", 0, None, False, 0.0)
    at, links, out, nodes = root, 0, [], [root]
    block = Block(root)
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                out.append(block)
        block = Block(at)

    def add(raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if links:
            block.linked += len(text)

    def close(node: Node) -> None:
        """Leaves the node and all inside it."""
        nonlocal at, links
        blocky = False
        while True:
            top, at = at, at.up
            opened[top.tag] -= 1
            links -= top.tag == "a"
            blocky |= top.tag in BLOCKS
            if top is node:
                break
        if blocky:
            flush()
        elif block.parts == []:
            block.node = at

    def find(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> Node | None:
        if not any(opened[t] for t in tags):
            return None
        n = at
        while n is not root and n.tag not in stop:
            if n.tag in tags:
                return n
            n = n.up
        return None

    pos, last = 0, page.rfind(">") + 1  # no tag ends behind it
    while True:
        m = TAG.search(page, pos, last)
        if m is None and 0 <= (at_comment := page.find("<!--", max(pos, last))):
            add(page[pos:at_comment])  # never closed
            break
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        if page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
            break  # never closed
        if m[1] is not None:
            add(m[1])
            continue
        name, shut, attrs = (m[3], m[2], m[4]) if m[3] else (m[6], m[5], m[7])
        if not name:
            continue
        name = name.lower()
        if shut:
            if (n := find({name}, frozenset())) is not None:
                close(n)
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            if name in CLOSES and (n := find(*CLOSES[name])) is not None:
                close(n)
            if (n := find({"p"}, {"td", "th", "div", "article", "body"})) is not None:
                close(n)
            if name in HEADINGS and (n := find(HEADINGS, BLOCKS - HEADINGS)) is not None:
                close(n)
        if name == "a" and links and (n := find({"a"}, BLOCKS)) is not None:
            close(n)
        worth, weak = worth_of(name, attrs, at.main)
        at = Node(name, at.depth + 1, at, at.main or name in MAIN_TAGS, worth, weak, at.fair and (worth >= 0 or weak))
        nodes.append(at)
        opened[name] += 1
        links += name == "a"
        if name in BLOCKS:
            flush()
        elif not block.parts:
            block.node = at
    flush()
    return out, nodes


def score(b: Block, article: bool) -> float:
    """The classifier of a block's own text: above zero for content, less than TIE, so that it alone decides nothing against
    its element. Phrases of notices weigh less on pages that say where their article is: articles quote them."""
    words, holder = b.text.count(" ") + 1, b.node
    while holder.up is not None and holder.tag not in BLOCKS:
        holder = holder.up
    heading = holder.tag in HEADINGS
    s = -1.2 + 0.07 * min(words, 40) - (1.5 if heading else 4.5) * b.linked / max(1, len(b.text))
    s += 0.5 * (b.text[-1] in ".!?:;\"'”»)") + {"p": 0.5, "blockquote": 0.5, "pre": 0.8, "li": -0.2, "td": -0.2}.get(holder.tag, 0.3 * heading)
    if words < 40 and PHRASES.search(b.text):
        s -= 1.5 if article else 3.6
    return max(-5.0, min(2.8, s))


def distance(a: Node, b: Node) -> int:
    """Steps between two nodes of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def graph_of(blocks: list[Block], nodes: list[Node]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The terminal capacities (above zero: towards content) of the blocks and then of the elements that count, and the edges."""
    for b in blocks:
        n = b.node
        n.blocks, n.kids, n.chars = n.blocks + 1, n.kids + 1, n.chars + len(b.text) - min(len(b.text), b.linked)
    for n in reversed(nodes[1:]):
        up = n.up
        n.mains += n.tag in MAIN_TAGS
        if n.blocks:
            up.blocks, up.kids, up.chars, up.mains = up.blocks + n.blocks, up.kids + 1, up.chars + n.chars, up.mains + n.mains
    root, fair, inside = nodes[0], 0, 0
    for b in blocks:
        if b.node.fair:
            fair += max(0, len(b.text) - b.linked)
            inside += b.node.main * max(0, len(b.text) - b.linked)
    article = inside > 0 and inside >= MOST * fair
    gains, edges = [score(b, article) for b in blocks], []
    for n in nodes:
        if not n.blocks:
            continue
        if n is root:
            worth = OUTSIDE if article else ALONE
        elif n.tag in MAIN_TAGS and article:
            worth = ARTICLE
        elif n.worth < 0 and n.weak and (n.mains and article and not n.main or n.chars > 0.6 * root.chars):
            worth = 0.0
        else:
            worth = n.worth
        if worth or n.kids > 1 or n is root:
            n.place = len(gains)
            gains.append(worth * n.blocks + (math.copysign(TIE, worth) if abs(worth) >= -AGAINST else 0.0))
            if n is not root:
                edges.append((n.up.place, n.place, TIE + MORE * (n.blocks - 1)))
        else:
            n.place = n.up.place
    edges += [(b.node.place, i, TIE) for i, b in enumerate(blocks)]
    edges += [(i, i + 1, BESIDE_TIE / (1 + distance(blocks[i].node, blocks[i + 1].node))) for i in range(len(blocks) - 1)]
    return gains, edges


def settle(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool | None]:
    """Labels of the nodes whose terminal capacity outweighs all their edges, one after the other: any minimum cut has them."""
    at: list[list[tuple[int, float]]] = [[] for _ in gains]
    for a, b, w in edges:
        at[a].append((b, w))
        at[b].append((a, w))
    gain, tied, label = list(gains), [sum(w for _, w in x) for x in at], [None] * len(gains)
    todo = list(range(len(gains)))
    while todo:
        i = todo.pop()
        if label[i] is not None or abs(gain[i]) <= tied[i]:
            continue
        label[i] = gain[i] > 0
        for k, w in at[i]:
            if label[k] is None:
                gain[k] += w if label[i] else -w
                tied[k] -= w
                todo.append(k)
    return label


def min_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the content side of the minimum cut, by Dinic's maximum flow."""
    label = settle(gains, edges)
    free = [i for i, x in enumerate(label) if x is None]
    place = {b: k for k, b in enumerate(free)}
    gain = [gains[i] for i in free]
    inner = []
    for a, b, w in edges:
        pa_, pb = place.get(a), place.get(b)
        if pa_ is not None and pb is not None:
            inner.append((pa_, pb, w))
        elif pa_ is not None or pb is not None:  # the other end is settled: w pulls towards it
            k, other = (pa_, b) if pa_ is not None else (pb, a)
            gain[k] += w if label[other] else -w
    n = len(free)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for k, g in enumerate(gain):
        link(source, k, g, 0.0) if g > 0 else link(k, sink, -g, 0.0)
    for a, b, w in inner:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            x = todo.popleft()
            for e in out[x]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            break
        nxt = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                x = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[x] < len(out[x]):
                e = out[x][nxt[x]]
                if room[e] > 1e-12 and level[to[e]] == level[x] + 1:
                    break
                nxt[x] += 1
            else:
                if x == source:
                    break
                e = path.pop()
                x = to[e ^ 1]
                nxt[x] += 1
                continue
            path.append(e)
            x = to[e]
    for k, b in enumerate(free):
        label[b] = level[k] >= 0
    return label


def main_text(page: str) -> tuple[str, int, int]:
    """The main text, how many blocks there are, and how many of them it holds."""
    blocks, nodes = blocks_of(page)
    if not blocks:
        return "", 0, 0
    chosen = [b.text for b, yes in zip(blocks, min_cut(*graph_of(blocks, nodes))) if yes]
    return "\n".join(chosen), len(blocks), len(chosen)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages (html, ...) plus text, n_chars (code points), n_blocks and n_content."""
    own = ("text", "n_chars", "n_blocks", "n_content")
    pages = pages.drop(*own)
    names = pages.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                made = [main_text(h or "") for h in part.column("html").to_pylist()]
                texts = [m[0] for m in made]
                cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int32())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *cols], [*names, *own])

    return pages.mapInArrow(work, extended(pages.schema, "text string, n_chars long, n_blocks int, n_content int"))
