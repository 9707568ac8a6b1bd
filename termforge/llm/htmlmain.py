"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text with their chain of enclosing elements. A linear classifier gives
each block a cost for either label; the costs become capacities to the two terminals, and blocks
that are neighbours in reading order or in the tree are tied by smoothness edges. The minimum cut
(maximum flow) separates content from boilerplate.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm import common

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*+)(>|\Z)",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Element kinds of HTML and words of class names, in alphabetical order.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("audio canvas head iframe noscript object script select style svg template textarea title video button".split())
RAW = frozenset("iframe noscript script style template textarea title".split())
#: Elements that a new start tag of the given name closes, up to the nearest container.
CLOSED_BY = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CONTAINERS = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table tbody ul".split())
ELEMENT_WEIGHT = {
    "article": 3.0, "aside": -6.0, "blockquote": 0.5, "body": 0.0, "dialog": -6.0, "figcaption": -0.5, "footer": -6.0,
    "form": -7.0, "header": -4.0, "legend": -2.0, "main": 3.0, "menu": -5.0, "nav": -7.0, "summary": -0.5,
}
LEAF_WEIGHT = {"dd": 0.0, "h1": 1.5, "h2": 0.5, "h3": 0.5, "h4": 0.3, "h5": 0.0, "h6": 0.0, "li": -0.7, "p": 1.0, "pre": 1.0, "td": -0.3, "th": -0.5}
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adv|adbox|alert|banner\w*|breadcrumbs?|byline|comment\w*|consent|cookies?\w*|copyright|disclaimer|disqus\w*|"
    r"feedback|foot|footer\w*|form|head|header\w*|legal|login|masthead|menu\w*|meta|modal|nav\w*|newsletter|notice\w*|notification\w*|outbrain|overlay|"
    r"pager|pagination|popup|privacy|promo\w*|recommend\w*|related\w*|replies|reply|respond|search|share\w*|sharing|sidebar\w*|signup|skip|social\w*|"
    r"sponsor\w*|subscri\w*|tags?|teaser\w*|toolbar|tracking|warning|widgets?)(?:$|[\s_-])",
    re.I,
)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
BAD_NAME_WEIGHT, GOOD_NAME_WEIGHT = -5.0, 1.5
BIAS, LENGTH_WEIGHT, LINK_WEIGHT, SENTENCE_WEIGHT = -1.0, 0.6, -4.0, 0.5
#: Smoothness: neighbours in reading order (less with tree distance, and less between unlike elements),
#: and the block before of the same kind in the same container.
NEIGHBOUR, UNLIKE, SIBLING = 1.0, 0.25, 0.8
#: Costs are rounded to this fraction.
UNIT = 1 << 30


class Element:
    """An open element: its kind and what the chain of elements down to it says about a block in it."""

    __slots__ = ("serial", "tag", "parent", "depth", "leaning", "inside", "leaf")

    def __init__(self, serial: int, tag: str, names: str, parent: Element | None):
        self.serial, self.tag, self.parent = serial, tag, parent
        self.depth = parent.depth + 1 if parent else 1
        above = parent.leaning if parent else 0.0
        self.inside = parent.inside if parent else False
        w = ELEMENT_WEIGHT.get(tag, 0.0)
        if tag in ("article", "main"):
            w, self.inside = (0.0 if self.inside else w), True
        elif tag == "header" and self.inside:
            w = -0.5
        if names and tag not in ("body", "html"):
            if BAD_NAMES.search(names):
                w += BAD_NAME_WEIGHT
            elif GOOD_NAMES.search(names):
                w += GOOD_NAME_WEIGHT
        self.leaning = above + w
        self.leaf = LEAF_WEIGHT.get(tag, parent.leaf if parent else 0.0)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    element: Element | None

    @property
    def kind(self) -> tuple[int, str]:
        """The enclosing element's own kind, and the element around it."""
        e = self.element
        return (e.parent.serial if e.parent else 0, e.tag) if e else (0, "")


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks in page order. Unclosed and cut-off markup is tolerated; cut-off tags are dropped."""
    page = page or ""
    out: list[Block] = []
    stack: list[Element] = []
    #: open elements by name: of the page, and of each container up to the next one
    opened: Counter[str] = Counter()
    scopes: list[Counter[str]] = [Counter()]
    texts: list[str] = []
    linked = serial = hidden = links = 0
    at = 0
    size = len(page)

    def flush() -> None:
        nonlocal linked
        if texts:
            joined = " ".join("".join(texts).split())
            if joined:
                out.append(Block(joined, linked, stack[-1] if stack else None))
            texts.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            t = entities.unescape(raw) if "&" in raw else raw
            texts.append(t)
            if links:
                linked += len(t.strip())

    def pop() -> None:
        nonlocal hidden, links
        tag = stack.pop().tag
        opened[tag] -= 1
        if tag in CONTAINERS:
            scopes.pop()
        else:
            scopes[-1][tag] -= 1
        hidden -= tag in UNSEEN
        links -= tag == "a"

    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None or (m.group(5) and not m.group(7)):
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        tag = name.lower()
        closing = m.group(1) or m.group(4)
        if tag in BLOCKS:
            flush()
        elif tag == "br" and not hidden:
            texts.append(" ")
        if closing:
            # an inline end tag closes nothing beyond its container; nothing open is looked for in vain
            if (opened if tag in BLOCKS else scopes[-1])[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        for ended in CLOSED_BY.get(tag, ()):
            while scopes[-1][ended]:
                pop()
        attributes = m.group(3) or m.group(6) or ""
        if attributes.endswith("/") and tag in ("svg", "iframe"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                break
            close = page.find(">", end.end())
            at = size if close < 0 else close + 1
            continue
        if tag == "body":
            stack.clear()
            opened.clear()
            scopes = [Counter()]
            hidden = links = 0
        serial += 1
        label = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)) if attributes else ""
        stack.append(Element(serial, tag, label, stack[-1] if stack else None))
        opened[tag] += 1
        if tag in CONTAINERS:
            scopes.append(Counter())
        else:
            scopes[-1][tag] += 1
        hidden += tag in UNSEEN
        links += tag == "a"
    flush()
    return out


def leaning(block: Block) -> float:
    """Log-odds of being content by the block alone: fixed weights, as no labelled pages exist to learn from."""
    size = len(block.text)
    z = BIAS + LENGTH_WEIGHT * math.log1p(size / 40) + LINK_WEIGHT * min(1.0, block.linked / size)
    if block.text[-1] in ".!?…":
        z += SENTENCE_WEIGHT
    return z + (block.element.leaning + block.element.leaf if block.element else 0.0)


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: |score| for going against it, the weight for each cut edge.

    Of equal cuts the one with the least content. Blocks whose own score outweighs all their edges are
    settled first, and their edges become scores of their neighbours; the rest is a maximum flow by
    push-relabel, where the excess of boilerplate scores is sent to the content terminal. Costs are
    integers of UNIT, so that sums are exact.
    """
    n = len(scores)
    z = [round(x * UNIT) for x in scores]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        w = round(w * UNIT)
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    tied = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    todo = [i for i in range(n) if z[i] > tied[i] or -z[i] >= tied[i]]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = z[i] > tied[i]
        for j, w in near[i].items():
            if label[j] is None:
                z[j] += w if label[i] else -w
                tied[j] -= w
                if z[j] > tied[j] or -z[j] >= tied[j]:
                    todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        open_near = {i: {j: w for j, w in near[i].items() if label[j] is None} for i in left}
        reach = _reaching(left, {i: z[i] for i in left}, open_near)
        for i in left:
            label[i] = i in reach
    return [bool(x) for x in label]


def _reaching(nodes: list[int], z: dict[int, int], near: dict[int, dict[int, int]]) -> set[int]:
    """Nodes from which the content terminal can still be reached after a maximum flow to it.

    ``near`` holds the capacities in both directions and becomes the residual ones. First-in, first-out
    push-relabel; heights are set anew, as exact distances to the terminal, after every so much work.
    """
    room = {i: z[i] for i in nodes if z[i] > 0}
    excess = {i: -z[i] for i in nodes if z[i] < 0}
    far = len(nodes) + 2

    def distances() -> dict[int, int]:
        height = {i: 1 for i, c in room.items() if c > 0}
        queue = deque(height)
        while queue:
            j = queue.popleft()
            for i in near[j]:
                if i not in height and near[i][j] > 0:
                    height[i] = height[j] + 1
                    queue.append(i)
        return height

    while True:
        height = distances()
        queue = deque(sorted((i for i, e in excess.items() if e > 0 and i in height), key=lambda i: -height[i]))
        if not queue:
            return set(height)
        waiting, work = set(queue), 0
        while queue and work <= 4 * far:
            i = queue.popleft()
            waiting.discard(i)
            e = excess[i]
            while e > 0:
                level = height.get(i, far)
                if level >= far:
                    break  # cannot reach the terminal any more: its excess stays
                if level == 1 and room.get(i, 0) > 0:
                    sent = min(e, room[i])
                    room[i] -= sent
                    e -= sent
                mine, lowest = near[i], far
                for j, c in mine.items():
                    if c <= 0:
                        continue
                    hj = height.get(j, far)
                    if e > 0 and hj == level - 1:
                        sent = e if e < c else c
                        mine[j] = c = c - sent
                        near[j][i] += sent
                        e -= sent
                        excess[j] = excess.get(j, 0) + sent
                        if j not in waiting:
                            waiting.add(j)
                            queue.append(j)
                    if c > 0 and hj < lowest:
                        lowest = hj
                work += len(mine) + 1
                if e > 0:
                    height[i] = 1 if room.get(i, 0) > 0 else min(far, lowest + 1)
            excess[i] = e


def _apart(a: Element | None, b: Element | None) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        steps += 1
        if b is None or (a is not None and a.depth >= b.depth):
            a = a.parent
        else:
            b = b.parent
    return steps


def main_text(page: str | None) -> str:
    """Content blocks of a page, one a line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    edges, last_in = [], {}
    for i, b in enumerate(blocks):
        kind = b.kind
        if i:
            apart = _apart(blocks[i - 1].element, b.element)
            edges.append((i - 1, i, (NEIGHBOUR if last_in.get(kind) == i - 1 else UNLIKE) / (1 + apart)))
        if kind in last_in:
            edges.append((last_in[kind], i, SIBLING))
        last_in[kind] = i
    keep = minimum_cut([leaning(b) for b in blocks], edges)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html gives an empty text. Rows are judged one by one: repeated rows, null ids and
    null urls are ordinary. Ids are whole numbers, or text of whole numbers. Other columns, whatever
    their names, are ignored. Long pages and deep nesting take time in proportion to the page; only the
    flow among blocks that their neighbours could outweigh may take more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = common.spread(pages.select(F.col("page_id").cast("long"), "url", "html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
