"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks.  A linear classifier over tags, names, length,
links and wording gives each block a cost for being content and one for being
boilerplate; these are its capacities to the two terminals.  Neighbours in the page and
near relatives in the document tree are tied by smoothness edges.  The minimum cut
separates content from boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import fresh, small_batches

# elements whose insides are not text of the page; of these, what is not markup inside
RAW = frozenset("script style noscript template svg iframe object title textarea select button canvas audio video map datalist".split())
RAW_TEXT = frozenset("script style iframe title textarea".split())
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"']")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$|=)", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+")
_CUE = re.compile(
    r"^(?:©|\(c\) ?\d|copyright\b|advert|sponsored|subscribe|sign up|log ?in\b|share (?:this|on)|follow us|related|read (?:more|also|next)|"
    r"by using this (?:site|website)|we use cookies|this (?:site|website) uses cookies|skip to)|all rights reserved|privacy policy|terms of (?:use|service)|cookie", re.I,
)
_SENTENCE = re.compile(r"[.!?…。！？]['\"”’»)]*$")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu sidebar footer header masthead ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist disqus reply replies respond discussion breadcrumb breadcrumbs pagination pager copyright widget toolbar "
    "search skip tags toc form complementary contentinfo paywall disclaimer announcement outbrain taboola adsense adslot".split()
)
CONTENT_NAMES = frozenset("article main content post entry story maincontent articlebody articlecontent postcontent".split())
# words before a name that deny it (has-sidebar, no-header), and after it (comments-open)
DENIED_BEFORE, DENIED_AFTER = frozenset("has with no without hide".split()), frozenset("open closed enabled disabled".split())
# what opening a tag ends: an open one of the same kind, up to a container
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}


# names that say something only alone, at the end of a name, or before a word for a part of a page
AMBIGUOUS = frozenset("share search social related notice alert skip tags form reply replies login signup banner popup widget discussion".split())
PARTS = frozenset(
    "area bar block body bottom box btn button buttons container content footer form group header heading holder icons inner inline item items left link links list menu "
    "module nav outer panel posts right section stories title tool toolbar tools top widget widgets wrap wrapper".split()
)


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    # nearest telling ancestor: 1 content, -1 boilerplate, 0 none; and which one
    kind: int
    teller: Element | None
    heading: bool
    linked: bool
    depth: int
    # nearest element that is not inline, and the open inline tags within that
    block: Element | None = None
    inside: dict | None = None


@dataclass(slots=True)
class Block:
    element: Element
    text: str
    start: int  # where its markup begins in the page
    links: int
    score: float = 0.0
    content: bool = False
    edges: list = field(default_factory=list)


def _said(value: str) -> tuple[bool, bool]:
    """Whether the names in an attribute mean content, and whether boilerplate."""
    good = bad = False
    for name in value.split():
        words = _NAME.findall(name)
        if not words or words[-1] in DENIED_AFTER:
            continue
        known = [
            w for k, w in enumerate(words)
            if not (k and words[k - 1] in DENIED_BEFORE) and not (w in AMBIGUOUS and k + 1 < len(words) and words[k + 1] not in PARTS)
        ]
        fine = any(w in CONTENT_NAMES for w in known)
        # a compound such as post-comments or sidebar-content is boilerplate; post-header holds the title
        poor = any(w in BOILERPLATE_NAMES and not (fine and w in ("header", "heading")) for w in known)
        bad = bad or poor
        good = good or (fine and not poor and "header" not in known)
    return good, bad


def _kind(tag: str, attributes: str, inside: int) -> int:
    """What a tag and its names say: content, boilerplate, or nothing (also if they
    contradict each other); ``inside`` is what the nearest telling ancestor said."""
    if tag in BOILERPLATE_TAGS:
        return -1
    good = bad = False
    if "=" in attributes or "hidden" in attributes.lower():
        if _HIDDEN.search(_QUOTED.sub("", attributes)):
            return -1
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id", "role", "itemprop"):
                fine, poor = _said(value)
                good, bad = good or fine, bad or poor
            elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return -1
    if tag == "header":
        # an article's own header holds its title
        return 0 if inside > 0 and not (bad and not good) else -1
    if tag in CONTENT_TAGS:
        return -1 if bad else 1
    return int(good) - int(bad)


def _markup(page: str, resume: list[int]):
    """``(start, end, closing, tag, attributes)`` of all markup in order; comments and
    declarations have no tag.  What never ends is text.  Every part of the page is looked at a
    bounded number of times, however broken it is.  The caller may skip ahead by ``resume``."""
    last = page.rfind(">")
    dead: set[int] = set()  # places outside quotes from which no tag ends
    at = 0
    while found := _OPEN.search(page, max(at, resume[0])):
        start, at = found.span()
        comment, declared, closing, tag = found.groups()
        if comment:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, False, None, ""
        elif start > last:
            continue
        elif declared:
            at = page.find(">", at) + 1
            yield start, at, False, None, ""
        else:
            place, seen = at, []
            while place not in dead:
                seen.append(place)
                stop = _STOP.search(page, place)
                if stop is None or stop.group() == ">":
                    break
                quote = page.find(stop.group(), stop.end())
                if quote < 0:
                    stop = None
                    break
                place = quote + 1
            else:
                stop = None
            if stop is None:
                # a quote that is never closed does not keep a tag open
                dead.update(seen)
                end = page.find(">", at)
            else:
                end = stop.start()
            attributes, at = page[at:end], end + 1
            yield start, at, bool(closing), tag.lower(), attributes


def parse(page: str) -> list[Block]:
    """Text blocks of a page in order; markup that is not closed ends with its parent."""
    root = Element("", None, 0, None, False, False, 0)
    root.block, root.inside = root, {}
    node, blocks = root, []
    pieces: list[str] = []
    links = breaks = 0
    start = at = 0
    resume = [0]
    opened: Counter = Counter()  # open elements that are not inline, by tag
    unclosed: set[str] = set()  # raw tags that are not closed any more

    def flush():
        nonlocal pieces, links, breaks
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(node.block, text, start, min(links, len(text))))
        pieces, links, breaks = [], 0, 0

    def add(text: str, where: int):
        nonlocal links, breaks, start
        if text and not text.isspace():
            if not pieces:
                start = where
            breaks = 0
            if node.linked:
                links += len(text)
        if text:
            pieces.append(text)

    def leave(to: Element):
        """Closes all up to and without ``to``."""
        nonlocal node
        while node is not to:
            if node.tag in INLINE:
                node.inside[node.tag] -= 1
            else:
                opened[node.tag] -= 1
            node = node.parent

    for begin, end, closing, tag, attributes in _markup(page, resume):
        add(page[at:begin], at)
        at = end
        if tag in RAW and not closing:
            pieces.append(" ")
            if tag == "svg" and attributes.endswith("/"):
                continue
            close = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, end)
            if close:
                at = resume[0] = close.end()
            elif tag in RAW_TEXT:
                at = resume[0] = len(page)
            else:
                # not closed: it ends with its parent, and its text with it
                unclosed.add(tag)
            continue
        tag = tag or ""
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            breaks += 1
            if breaks > 1:  # an empty line parts blocks
                flush()
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if closing:
            # a closing inline tag does not reach out of its block
            if (node.inside if inline else opened).get(tag, 0) > 0:
                seek = node
                while seek.tag != tag:
                    seek = seek.parent
                leave(seek.parent)
            continue
        if not inline:
            # a block ends an open paragraph, and some tags end their like
            if node.block.tag == "p":
                leave(node.block.parent)
            like, holders = ENDS.get(tag, ((), ()))
            if any(opened[t] for t in like):
                seek = node.block
                while seek.parent is not None and seek.tag not in holders:
                    if seek.tag in like:
                        leave(seek.parent)
                        break
                    seek = seek.parent.block
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div", "a", "span"):
            continue
        said = 0 if tag in ("html", "body") else _kind(tag, attributes, node.kind)
        child = Element(tag, node, said or node.kind, None, node.heading or tag in HEADINGS, node.linked or tag == "a", node.depth + 1)
        child.teller = child if said else node.teller
        if inline:
            child.block, child.inside = node.block, node.inside
            child.inside[tag] = child.inside.get(tag, 0) + 1
        else:
            child.block, child.inside = child, {}
            opened[tag] += 1
        node = child
    add(page[at:], at)
    flush()
    return blocks


def classify(blocks: list[Block]) -> None:
    """Log odds of being content, by fixed weights."""
    marked = sum(len(b.text) for b in blocks if b.element.kind > 0)
    plain = sum(len(b.text) for b in blocks if b.element.kind == 0)
    for b in blocks:
        size, element = len(b.text), b.element
        density = b.links / size
        score = 0.9 * math.log1p(size / 25) - 4.0 * density
        score += 0.8 if _SENTENCE.search(b.text) else -0.6
        if element.tag == "p":
            score += 0.8
        elif element.heading:
            score += 0.5
        elif element.tag in ("li", "td", "th", "dt", "dd", "figcaption"):
            score -= 0.4
        if size < 200 and _CUE.search(b.text):
            score -= 1.5
        if element.kind > 0:
            score += 3.5
        elif element.kind < 0:
            score -= 7.0 + 0.9 * math.log1p(size / 25)
        elif 2 * marked >= plain:
            score -= 3.5 + 0.9 * math.log1p(size / 25)  # the page says where its content is
        else:
            score -= 1.5 if marked else 0.7
        b.score = score


def connect(blocks: list[Block]) -> None:
    """Smoothness edges ``[other, weight]``: between blocks that follow each other, and
    between a block and the one before it under the same parent or grandparent.  Blocks
    under different telling ancestors are tied loosely."""
    last: dict[int, int] = {}

    def tie(i: int, j: int, weight: float):
        a, b = blocks[i].element, blocks[j].element
        if a.teller is not b.teller:
            weight *= 0.15
        blocks[i].edges.append((j, weight))
        blocks[j].edges.append((i, weight))

    for i, b in enumerate(blocks):
        if i:
            before = blocks[i - 1].element
            same = before.parent is b.element.parent
            tie(i - 1, i, 1.0 if same else 0.6 if before.depth == b.element.depth else 0.3)
        holders = [h for h in (b.element.parent, b.element.parent.parent if b.element.parent else None) if h is not None and h.depth]
        for rank, holder in enumerate(holders):
            j = last.get(id(holder))
            if j is not None and j != i - 1:
                tie(j, i, (0.6, 0.3)[rank])
            last[id(holder)] = i


def cut(scores: list[float], edges: list[list[tuple[int, float]]]) -> list[bool]:
    """Source side of a minimum cut: node i has capacity ``scores[i]`` from the source
    if positive, else ``-scores[i]`` to the sink, and ``edges[i]`` lists ``(j, weight)`` both ways.

    A node whose terminal outweighs all its edges is on that side in every minimum cut;
    such nodes are settled first, and their edges added to their neighbours' terminals.
    What is left is solved by maximum flow (Dinic)."""
    n, score = len(scores), list(scores)
    tied = [sum(w for _, w in e) for e in edges]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(score[i]) >= tied[i]:
            side[i] = score[i] > 0
            for j, w in edges[i]:
                if side[j] is None:
                    score[j] += w if side[i] else -w
                    tied[j] -= w
                    queue.append(j)
    left = [i for i in range(n) if side[i] is None]
    if not left:
        return side
    place = {i: k for k, i in enumerate(left)}
    source, sink = len(left), len(left) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(left) + 2)]

    def arc(a: int, b: int, there: float, back: float):
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in left:
        if score[i] > 0:
            arc(source, place[i], score[i], 0.0)
        elif score[i] < 0:
            arc(place[i], sink, -score[i], 0.0)
        for j, w in edges[i]:
            if j > i and j in place:
                arc(place[i], place[j], w, w)
    small = 1e-12
    while True:
        level = [-1] * len(out)
        level[source] = 0
        waiting = deque([source])
        while waiting:
            a = waiting.popleft()
            for e in out[a]:
                if room[e] > small and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    waiting.append(to[e])
        if level[sink] < 0:
            for i in left:
                side[i] = level[place[i]] >= 0
            return side
        turn = [0] * len(out)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if room[e] <= small)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > small and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break


def label(page: str) -> list[Block]:
    """Blocks of a page with their scores, edges and labels."""
    blocks = parse(page)
    classify(blocks)
    connect(blocks)
    for block, content in zip(blocks, cut([b.score for b in blocks], [b.edges for b in blocks]), strict=True):
        block.content = content
    return blocks


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in label(page) if b.content) if page else ""


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` plus ``text``, the main text of the whole page, blocks joined by a
    line feed, and ``n_chars``, its code points (new names are lengthened where a kept
    column has them).  Null and empty pages, and pages without content, give empty text."""
    keep = [c for c in pages.columns if c != page] if keep is None else keep
    text, n, inner = fresh(keep, "text"), fresh(keep, "n_chars"), fresh(keep, "_page")
    schema = pages.select(*keep, F.lit("").alias(text), F.lit(0).cast("long").alias(n)).schema

    def run(batches):
        for batch in small_batches(batches):
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(*keep, F.col(page).alias(inner)).mapInArrow(run, schema)
