"""Main-content extraction by minimum-cut labelling.

A page is cut into blocks at block-level tags. A linear classifier of a block
(words, links, sentence ends, kind of element, and what the tags and class words above
it say of boilerplate) gives it a cost for being called content and a cost for being
called boilerplate; these become the capacities of its edges to the two terminals.
Much text weighs more than one word of a class. Elements that speak for content are
nodes held by the source, with an edge to each of their blocks that is weaker than
a short line's own cost; only the first block is tied firmly. Smoothness edges tie each
block to the block that follows and to the next block of its parent element, stronger
the closer they stand in the DOM. A maximum flow from source to sink gives the labelling
of least total cost; the blocks of the source side are the main text, and where both
labels cost the same a block is boilerplate. So a lone word of an article stays because
its neighbours do, whatever the classifier says of it alone.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import small_batches

#: Elements that end a block where they begin and end.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content, and elements whose content is no text.
VOID_TAGS = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW_TAGS = frozenset("title script style noscript template svg math iframe object canvas textarea noframes xmp".split())
#: Elements that an opening tag of the same kind closes, up to the listed containers.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table menu select article section div aside nav main body blockquote form footer header".split())

#: Elements that speak for content or for boilerplate by their tag, their role, or words of their class and id.
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_TAGS = frozenset("nav footer aside form button select menu dialog fieldset".split())
CONTENT_ROLES = frozenset(("main", "article"))
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
CONTENT_WORDS = frozenset("article content entry post story main body text prose".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner promo promoted promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar side aside widget related recommended popular trending comment comments reply replies discussion disqus share sharing social follow cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login toolbar pagination pager tags tagcloud copyright legal disclaimer search masthead skip hidden feedback rating".split()
)
#: Of these, what readers write: it reads like an article, so that only the word tells it.
READER_WORDS = frozenset("comment comments reply replies discussion disqus".split())
#: Classifier weights of an element above that speaks for boilerplate: by tag, role, attribute or reader's word, and by other class words.
BY_TAG, BY_CLASS = 4.0, 2.2
#: Capacity of a block's edge to the element above it that speaks for content: the first block's, the others', and what is
#: added to these where all of its blocks are short lines (in proportion where some are): then short lines tell nothing.
FIRST, TIE, LINES = 2.0, 0.4, 1.0
#: Classifier weights of a block's own statistics in favour of content, and the bound of their sum: bias, log words, share
#: of characters in links, sentence ends, and the element that holds it.
BIAS, LOG_WORDS, LINKED, SENTENCE, BOUND = -1.5, 0.6, -2.5, 0.3, 4.0
HOLDERS = {"p": 0.6, "h1": 1.5, "h2": 0.6, "h3": 0.6, "blockquote": 0.6, "pre": 0.6}
#: Smoothness: neighbours in page order, each step apart in the tree dividing it, and neighbours below one parent; between
#: blocks that stand under different speaking elements so much of it is left.
NEXT, SIBLING, BORDER = 0.4, 1.0, 0.25

_SPLIT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
#: Words that speak of a neighbour, such as with-sidebar; on main and article those of a side too, such as sidebar-right.
_LAYOUT = re.compile(r"(?<![a-z])(?:with|without|has|have|no)[-_]+[\w-]+")
_SIDE = re.compile(r"(?<![a-z])(?:sidebar|aside|nav|header|footer)[-_]+(?:left|right|top|bottom|open|closed|enabled|disabled|fixed|sticky|layout)(?![a-z])")


class Place:
    """A block-level element: the one above it, and how deep it stands."""

    __slots__ = ("above", "depth")

    def __init__(self, above: Place | None):
        self.above, self.depth = above, above.depth + 1 if above else 0


def steps(a: Place, b: Place) -> int:
    """Edges of the tree between two elements. Of blocks that follow each other, all elements on the way end or begin between them."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
        n += 1
    return n


@dataclass(slots=True)
class Block:
    text: str
    place: Place  # the innermost block element
    holder: str  # its tag
    spoken: tuple[int, float] | None  # nearest element that speaks: its number, and how much, negative for boilerplate
    linked: float  # share of characters inside links


def _speaks(tag: str, attributes: str, above: tuple[int, float] | None) -> float:
    """What an element says of its content: positive for content, negative for boilerplate, 0 for nothing.

    Boilerplate is not redeemed by what stands inside it, and the header of an article is part of it.
    """
    says = []
    if tag in BOILERPLATE_TAGS:
        says.append(-BY_TAG)
    elif tag in CONTENT_TAGS:
        says.append(BY_TAG)
    elif tag == "label" or (tag == "header" and not (above and above[1] > 0)):
        says.append(-BY_CLASS)
    if attributes.strip(" /\n\t"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            value, name = "".join(values).lower(), name.lower()
            if name == "role":
                role = value.strip()
                says.append(-BY_TAG if role in BOILERPLATE_ROLES else BY_TAG if role in CONTENT_ROLES else 0.0)
            elif name in ("class", "id"):
                value = _LAYOUT.sub(" ", value)
                words = set(_WORDS.findall(_SIDE.sub(" ", value) if tag in CONTENT_TAGS else value))
                if words & BOILERPLATE_WORDS and tag not in ("html", "body"):  # the whole page is no boilerplate of itself
                    says.append(-BY_TAG if words & READER_WORDS else -BY_CLASS)
                elif words & CONTENT_WORDS:
                    says.append(BY_CLASS)
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                says.append(-BY_TAG)
    least, most = min(says, default=0.0), max(says, default=0.0)
    return least if least < 0 else 0.0 if above and above[1] < 0 else most


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; raw elements and comments hold none."""
    out: list[Block] = []
    root = Place(None)
    # (tag, innermost block element, its tag, nearest element that speaks, whether inside a link)
    stack: list[tuple[str, Place, str, tuple[int, float] | None, bool]] = [("", root, "", None, False)]
    open_: Counter[str] = Counter()  # tags on the stack, so that none is looked for in vain
    parts: list[str] = []
    linked, number, at, raw = 0, 0, 0, ""

    def close_block():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, place, holder, spoken, _ = stack[-1]
                out.append(Block(text, place, holder, spoken, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def cut(k: int):
        for e in stack[k:]:
            open_[e[0]] -= 1
        del stack[k:]

    for m in _SPLIT.finditer(page):
        if raw:  # nothing counts but the end tag of the raw element
            if m[1] and m[2].lower() == raw:
                raw, at = "", m.end()
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if stack[-1][4]:
                linked += len(piece)
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in RAW_TAGS:
                if not m[0].endswith("/>"):
                    raw = tag
                continue
            if tag in BLOCK_TAGS:
                close_block()
            if tag in VOID_TAGS:
                continue
            shut = CLOSES.get(tag) or (("p",) if tag in BLOCK_TAGS else ())
            if any(open_[x] > 0 for x in shut):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in shut:
                        cut(k)
                        break
                    if stack[k][0] in SCOPES:
                        break
            number += 1
            _, place, holder, spoken, link = stack[-1]
            says = _speaks(tag, m[3], spoken)
            if tag in BLOCK_TAGS:
                place, holder = Place(place), tag
            stack.append((tag, place, holder, (number, says) if says else spoken, link or tag == "a"))
            open_[tag] += 1
        else:
            if tag in BLOCK_TAGS:
                close_block()
            if open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        cut(k)
                        break
    if not raw and at < len(page):
        rest = page[at:]
        # A tag that the page breaks off is markup, a lone sign is text.
        broken = re.search(r"<[a-zA-Z/!?]", rest)
        parts.append(rest[: broken.start()] if broken else rest)
    close_block()
    return out


def costs(block: Block) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content) by its own statistics: negative log probabilities."""
    z = BIAS + LOG_WORDS * math.log(block.text.count(" ") + 1) + LINKED * block.linked + HOLDERS.get(block.holder, 0.0)
    z = max(-BOUND, min(BOUND, z + (SENTENCE if block.text[-1] in ".!?…。\"”»" else 0.0)))
    return max(z, 0.0) + math.log1p(math.exp(-abs(z))), max(-z, 0.0) + math.log1p(math.exp(-abs(z)))


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page and between neighbouring blocks of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            edges[i - 1, i] = NEXT / (1 + steps(found[i - 1].place, block.place))
        parent = id(block.place.above)
        if parent in last_of:
            j = last_of[parent]
            edges[j, i] = edges.get((j, i), 0.0) + SIBLING / (1 + math.log1p(i - j - 1))
        last_of[parent] = i
    return [(i, j, c if found[i].spoken == found[j].spoken else c * BORDER) for (i, j), c in edges.items()]


def graph(found: list[Block]) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """Capacities from the source, to the sink, and between nodes: the blocks, then the elements that speak for content."""
    pairs, edges = [costs(b) for b in found], smoothness(found)
    source, sink = [a for a, _ in pairs], [b for _, b in pairs]
    under: dict[tuple[int, float], list[int]] = {}
    for i, block in enumerate(found):
        if block.spoken and block.spoken[1] > 0:
            under.setdefault(block.spoken, []).append(i)
        elif block.spoken:
            sink[i] -= block.spoken[1]
    for own in under.values():
        node = len(source)
        tie = TIE + LINES * sum(source[i] < sink[i] for i in own) / len(own)
        edges += [(i, node, tie) for i in own[1:]] + [(own[0], node, FIRST)]
        source.append(FIRST + tie * len(own) + 1)  # more than all its edges: the element stays with its terminal
        sink.append(0.0)
    return source, sink, edges


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stands on the source side of a minimum cut.

    A node whose terminals differ by more than all its edges together takes its
    side in every minimum cut; such nodes are settled first and their edges become
    terminal capacities of their neighbours. What remains goes through a maximum
    flow by blocking flows in layers (Dinic).
    """
    n = len(source)
    lean = [a - b for a, b in zip(source, sink)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(lean[i]) > sum(near[i].values()):
            side[i] = lean[i] > 0
            for j, c in near[i].items():
                lean[j] += c if side[i] else -c
                del near[j][i]
                queue.append(j)
            near[i].clear()
    open_ = [i for i in range(n) if side[i] is None]
    if open_:
        reached = _flow({i: near[i] for i in open_}, lean)
        for i in open_:
            side[i] = i in reached
    return [bool(x) for x in side]


def _flow(near: dict[int, dict[int, float]], lean: list[float]) -> dict[int, int]:
    """The nodes that the source still reaches once a maximum flow runs."""
    s, t = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(c) for i, c in near.items()} | {s: {}, t: {}}
    for i in near:
        room[s][i], room[i][s] = max(lean[i], 0.0), 0.0
        room[i][t], room[t][i] = max(-lean[i], 0.0), 0.0
    while True:
        layer, queue = {s: 0}, deque([s])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-12 and j not in layer:
                    layer[j] = layer[i] + 1
                    queue.append(j)
        if t not in layer:
            return layer
        arcs = {i: iter(list(room[i])) for i in layer}
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                flow = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= 1e-12)
                del path[cut + 1 :]  # back to where the path is now blocked
                continue
            for j in arcs[i]:
                if room[i][j] > 1e-12 and layer.get(j) == layer[i] + 1:
                    path.append(j)
                    break
            else:
                layer.pop(i)  # a dead end
                path.pop()


def extract(page: str | None) -> str:
    """The main text: content blocks in page order, joined by a space; empty for null, empty and text-free pages."""
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, min_cut(*graph(found))) if keep)


_SCHEMA = "page_id long, url string, text string, n_chars long"


def _run(batches):
    for batch in batches:
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars. Pages are read one by one and nothing is shuffled.

    Null and empty pages give an empty text, repeated rows equal results, an
    empty table an empty result; other columns are not carried.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_run, _SCHEMA)
