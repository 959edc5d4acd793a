"""Main text of web pages by minimum-cut labelling of their text blocks.

A page becomes a list of blocks, the texts between block-level tags, with what stands around them. A classifier turns
each block's surroundings, links and length into a cost of calling it content and a cost of calling it boilerplate;
these are its edges to the two terminals of a network. Neighbours in page order and blocks of one parent are joined by
smoothness edges. The minimum cut is the labelling of least total cost. Blocks whose own cost outweighs all their
neighbours are settled first, which folds their edges into the neighbours' costs and leaves a small core for max-flow.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import blocks

#: Elements by what they mean for text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes svg math object xmp canvas".split())
ENDS_P = BLOCK - {"body", "head", "html", "option", "optgroup"}
ENDS_ITSELF = frozenset("li dt dd tr td th option p".split())
#: Elements that never hold the article, and names in class, id or role that say the same.
AWAY = frozenset("head title nav footer aside form button select option fieldset dialog menu legend datalist search".split())
AWAY_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner sidebar "
    "complementary rail comment comments commentlist respond reply replies disqus discussion related recommended recommendations "
    "share sharing social newsletter subscribe subscription signup login popup modal overlay cookie cookies consent gdpr notice "
    "notices alert dialog widget widgets pagination pager breadcrumb breadcrumbs copyright legal disclaimer contentinfo".split())
SITE_NAMES = frozenset("nav navbar navigation navi menu menubar footer masthead topbar toolbar search skip".split())
HERE = frozenset(["article", "main"])
HERE_NAMES = frozenset("article articlebody content post entry story main maincontent".split())

_AWAY, _HERE, _HIDDEN, _LINK, _SITE = 1, 2, 4, 8, 16
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+'|["'])*+)>|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)[^<>]*+\Z""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDES = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("parts", "flags", "parent", "linked", "tag", "text")

    def __init__(self, flags: int, parent: int, tag: str):
        self.parts, self.flags, self.parent, self.linked, self.tag, self.text = [], flags, parent, 0, tag, ""


def _meaning(tag: str, attributes: str, around: int) -> int:
    """Flags of an element from its tag, names and surroundings."""
    flags = around
    if tag == "a":
        flags |= _LINK
    elif tag == "main":
        flags = flags & ~(_AWAY | _SITE) | _HERE
    elif tag == "article":
        flags = flags & ~_SITE | _HERE
    elif tag in AWAY:
        flags |= _AWAY
    elif tag == "header" and not around & _HERE:
        flags |= _SITE
    if attributes and tag not in ("html", "body"):
        if _HIDES.search(attributes):
            flags |= _HIDDEN
        for _, value in _NAMES.findall(attributes):
            names = {n.lower() for n in _PIECES.findall(value)} | {n.lower() for n in re.split(r"[^a-zA-Z]+", value)}
            if names & AWAY_NAMES and not (tag in HERE and names & HERE_NAMES):
                flags |= _AWAY
            elif names & SITE_NAMES:
                flags |= _SITE
            elif names & HERE_NAMES and tag not in ("a", "li", "span", "p"):
                flags |= _HERE
    return flags


def page_blocks(html: str) -> list[Block]:
    """Text blocks of a page in order. Comments, scripts, styles and markup leave nothing; a cut page ends where it ends."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, flags, number of the element
    places: dict[str, list[int]] = {}  # where each tag is open
    blocks_open = [0]  # where a block is open
    count, at, now = 0, 0, None

    def close(k: int):
        for tag, _, _ in stack[k:]:
            places[tag].pop()
        while blocks_open[-1] >= k:
            blocks_open.pop()
        del stack[k:]

    def add(raw: str):
        nonlocal now
        if not raw:
            return
        if now is None:
            if raw.isspace():
                return
            flags, k = stack[-1][1], blocks_open[-1]
            now = Block(flags & ~_LINK, stack[k][2], stack[k][0])
            out.append(now)
        now.parts.append(raw)
        if stack[-1][1] & _LINK:
            now.linked += len(raw)

    while True:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if closing:
            if tag in BLOCK:
                now = None
            k = places[tag][-1] if places.get(tag) else 0
            if k and (tag in BLOCK or k > blocks_open[-1]):  # an inline end tag doesn't close a block
                close(k)
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in BLOCK:
            now = None
            if tag in ENDS_P or tag in ENDS_ITSELF:
                k = blocks_open[-1]
                if k and (stack[k][0] == "p" or stack[k][0] == tag and tag in ENDS_ITSELF):
                    close(k)  # a block ends an open paragraph, and an item ends the open item before it
        if tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        count += 1
        flags = _meaning(tag, m[3] or "", stack[-1][1])
        if now is not None and (flags ^ stack[-1][1]) & ~_LINK:
            now = None  # an inline element that means something else is a block of its own
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks_open.append(len(stack))
        stack.append((tag, flags, count))
    for b in out:
        b.text = " ".join(unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def costs(page: list[Block]) -> list[int]:
    """Cost of calling each block boilerplate less that of calling it content: positive for content."""
    framed = any(b.flags & _HERE and not b.flags & (_AWAY | _SITE | _HIDDEN) for b in page)
    out = []
    for b in page:
        words = b.text.count(" ") + 1
        if b.flags & (_AWAY | _HIDDEN):
            score = -100
        elif b.flags & _SITE:
            score = -60
        elif b.flags & _HERE:
            score = 24 + min(words, 16)
        else:
            score = (6 if words >= 20 else 2 if words >= 8 else -4) + (3 if b.text[-1] in ".!?…。" else 0) + (2 if b.tag in ("p", "pre") else 0)
            if b.tag in ("h1", "h2", "h3"):
                score += 4
            if framed:
                score -= 20
        if b.linked > 0.6 * len(b.text):
            score -= 16
        out.append(score)
    return out


def smoothness(page: list[Block]) -> list[tuple[int, int, int]]:
    """Edges between neighbours in page order (3, or 1 across parents) and between consecutive blocks of one parent (3)."""
    edges, last = [], {}
    for i, b in enumerate(page):
        if i:
            edges.append((i - 1, i, 3 if page[i - 1].parent == b.parent else 1))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, 3))
        last[b.parent] = i
    return edges


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: a block on the wrong side costs its score, a cut edge its weight. Ties go to boilerplate."""
    n = len(scores)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    score, label = list(scores), [None] * n
    queue = deque(range(n))
    while queue:  # settled blocks leave the network
        i = queue.popleft()
        pull = sum(near[i].values())
        if label[i] is not None or -pull < score[i] <= pull and not (score[i] == pull == 0):
            continue
        label[i] = score[i] > 0
        for j, w in near[i].items():
            score[j] += w if label[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    core = [i for i in range(n) if label[i] is None]
    if core:
        for i, side in zip(core, _source_side([score[i] for i in core], {i: k for k, i in enumerate(core)}, core, near)):
            label[i] = side
    return label


def _source_side(scores, number, core, near) -> list[bool]:
    """Max-flow by blocking flows; whether each block of the core can still be reached from the source."""
    n = len(core)
    source, sink = n, n + 1
    room: list[dict[int, int]] = [{} for _ in range(n + 2)]
    for k, i in enumerate(core):
        for j, w in near[i].items():
            room[k][number[j]] = w
        a, b = (source, k) if scores[k] > 0 else (k, sink)
        if scores[k]:
            room[a][b] = abs(scores[k])
            room[b].setdefault(a, 0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            x = queue.popleft()
            for y, r in room[x].items():
                if r and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if sink not in level:
            return [k in level for k in range(n)]
        turns = [iter(list(room[x])) for x in range(n + 2)]
        path = [source]
        while path:
            x = path[-1]
            if x == sink:
                amount = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= amount
                    room[b][a] = room[b].get(a, 0) + amount
                path = [source]
                turns = [iter([y for y in room[v]]) for v in range(n + 2)] if n < 50 else turns
                continue
            for y in turns[x]:
                if room[x].get(y, 0) and level.get(y, -1) == level[x] + 1:
                    path.append(y)
                    break
            else:
                path.pop()
                level[x] = -1


def main_text(html: str | None) -> str:
    """The blocks labelled content, joined by line breaks; empty for a null or blank page."""
    page = page_blocks(html or "")
    labels = minimum_cut(costs(page), smoothness(page))
    return "\n".join(b.text for b, content in zip(page, labels) if content)


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every row; equal rows have equal texts, an empty table gives no row."""
    rows = pages.select(*keep, F.col(html).alias("_html"))
    schema = rows.drop("_html").withColumn("text", F.lit("")).schema

    def extract(batches):
        for block in blocks(batches, "_html"):
            texts = pa.array([main_text(x) for x in block.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], texts], [*keep, "text"])

    return rows.mapInArrow(extract, schema).withColumn("n_chars", F.char_length("text").cast("long"))
