"""Main-text extraction by minimum cut.

A page becomes a row of text blocks. A linear classifier over tags, class names, link density and length prices either label of a
block; the prices are capacities from the source (main text) and to the sink (boilerplate). Neighbouring blocks, and blocks
that follow each other within one parent element, are tied by smoothness edges. The minimum cut is the cheapest labelling, and
what stays on the source's side is the main text. Pages are independent, so this is one map over the table.

An element is boilerplate by its tag or its names, with all that it holds, unless it is a wrapper of the page: one that holds the page's
main article, or more than half of its text. So a layout class around everything says nothing about the article in it. Names weigh less the closer
they are to text: headings have none, paragraphs, cells and items only classes that say nothing else, and inside an article a class has to be
made of such words entirely and an id has to be sure, since there ids are anchors. A section under a heading such as "12 responses" is readers' comments.

Short blocks tell nothing by themselves. One that isn't made of links counts against main text only where no main text stands around it: between two
blocks of main text, or in the same element as one, its neighbours decide. So dialogue, tables, lists and formulas stay with their text.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.S)
ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPACES = re.compile(r"\s+")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: HTML elements by their part in the page.
UNSEEN = frozenset("script style template noscript title svg annotation annotation-xml iframe object select option textarea button audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BREAKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_NEXT = frozenset("p li dt dd td th tr".split()) | HEADINGS
BOILERPLATE = frozenset("nav footer aside header form menu dialog fieldset".split())
BAD_NAMES = frozenset("ad ads adv advert advertisement advertising promo promotion sponsor sponsored banner nav navbar navigation menu sidebar aside footer header masthead breadcrumb breadcrumbs cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget comment comments disqus respond reply replies pagination pager toolbar copyright legal disclaimer".split())
GOOD_NAMES = frozenset("article content main post entry story body text prose".split())
#: Words that say nothing against a name's other words, and words that are sure also as an id inside an article.
PLAIN_NAMES = GOOD_NAMES | frozenset("area bar block bottom box button buttons center col column container count form grid group header heading icon icons id inner item items left link links list meta page panel posts right row section site slot thread title top unit wrap wrapper".split())
SURE_NAMES = frozenset("ads advert advertisement breadcrumb breadcrumbs comment comments cookie disqus footer header masthead modal nav navbar navigation newsletter pagination popup respond sidebar".split())
#: Elements that hold others and so can be a part of the page, and words of a heading above readers' comments.
CONTAINERS = frozenset("article aside body details dialog div dl fieldset footer form header html main menu nav ol section table ul".split())
COMMENT_HEADING = re.compile(r"(?:(?:\d+|no|reader|readers'?|user|leave|post|add|write|your|an?|all|the|latest|join|to|this|article|comments?|responses?|repl(?:y|ies)|discussion)\W*)+", re.I)
COMMENT_WORD = re.compile(r"\b(?:comments?|responses?|repl(?:y|ies))\b", re.I)
#: Words in front of a class name that make it tell of the page's layout and not of the element.
LAYOUT_WORDS = frozenset("has no with without not hide show is".split())
#: The classifier: fixed weights of a linear score, positive for main text.
BIAS, IN_ARTICLE, GOOD, BAD, LINKS, LENGTH, LONG, IN_LIST, HEADING = -0.6, 4.0, 1.5, -8.0, -3.0, 1.5, 120, -0.3, 0.5
#: Share of linked text from which a block is made of links, and what an unlinked block counts at least where main text stands around it.
MOSTLY, AMONG = 0.5, 0.1
#: Smoothness between neighbours, and between blocks that follow each other within one parent.
BESIDE, SIBLING = 0.15, 0.35


class Element(NamedTuple):
    parent: int
    name: str
    names: tuple[tuple[str, frozenset[str]], ...]


class Block(NamedTuple):
    text: str
    linked: int
    element: int


def class_words(attributes: str) -> tuple[tuple[str, frozenset[str]], ...]:
    """An element's classes, ids and roles: the attribute and the words of each name, but for classes that tell of the page's layout."""
    out = []
    for kind, *v in NAMED.findall(attributes):
        for name in "".join(v).split():
            words = [x.lower() for x in TOKEN.findall(name)]
            if words and words[0] not in LAYOUT_WORDS:
                out.append((kind.lower(), frozenset(words)))
    return tuple(out)


def named_bad(e: Element, within: bool) -> bool:
    """Whether an element is boilerplate by its names; within: it lies in an article or under a good name."""
    if e.name in HEADINGS or e.name in ("body", "html"):
        return False
    for kind, words in e.names:
        only = bool(words & BAD_NAMES) and words <= BAD_NAMES | PLAIN_NAMES
        if e.name not in CONTAINERS:
            bad = kind != "id" and only
        elif within:
            bad = only and (kind != "id" or bool(words & SURE_NAMES))
        else:
            bad = bool(words & BAD_NAMES)
        if bad:
            return True
    return False


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Block-level elements in page order, the first standing for the page, and the blocks of text in them."""
    elements, found = [Element(-1, "", ())], []
    stack, opened = [0], Counter()
    unclosed: set[str] = set()
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                found.append(Block(text, linked, stack[-1]))
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if s:
            parts.append(s)
            if links:
                linked += len(s)

    def pop() -> str:
        name = elements[stack.pop()].name
        opened[name] -= 1
        return name

    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        end = ATTRIBUTES.match(page, at)
        if end:
            attributes, at = page[at : end.end()], end.end()
        else:  # cut off or quotes that don't close
            close = page.find(">", at)
            attributes, at = (page[at:], size) if close < 0 else (page[at : close + 1], close + 1)
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BREAKS:
                flush()
                if opened[name] > 0:
                    while pop() != name:
                        pass
                    links = 0
            continue
        if name in UNSEEN:
            if not attributes.endswith("/>"):
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if close:
                    at = close.end()
                else:  # nothing closes this element up to the page's end, nor any later one of its name
                    unclosed.add(name)
                    at = size if name in ("script", "style", "title", "textarea") else at
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links += 1
        elif name in BREAKS and name not in VOID:
            flush()
            last = elements[stack[-1]].name
            if last == "p" or last == name and last in CLOSED_BY_NEXT:
                pop()
            elements.append(Element(stack[-1], name, class_words(attributes)))
            stack.append(len(elements) - 1)
            opened[name] += 1
        elif name == "hr":
            flush()
    flush()
    return elements, found


def regions(elements: list[Element], found: list[Block]) -> list[tuple[bool, bool, bool, bool]]:
    """(in boilerplate, under a good name, in an article, within any of these or the element with most of the text) of each element."""
    held = [0] * len(elements)
    for b in found:
        held[b.element] += len(b.text)
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
    under = [False] * len(elements)  # an article or a good name around it, or, on a page without article, the smallest element with most of the text
    if not any(e.name in ("article", "main") for e in elements):
        most = max((i for i, e in enumerate(elements) if e.name in CONTAINERS and 2 * held[i] > held[0]), default=0)
        under[most] = elements[most].name not in ("", "body", "html")
    bad, good = list(under), list(under)
    for i, e in enumerate(elements[1:], 1):
        around = under[e.parent]
        bad[i] = e.name in BOILERPLATE or named_bad(e, around)
        good[i] = not bad[i] and any(words & GOOD_NAMES for _, words in e.names)
        under[i] = under[i] or around or e.name in ("article", "main") or good[i]
    for i in commented(elements, found):
        bad[i] = True
    wrappers = {i for i, e in enumerate(elements) if bad[i] and (e.name == "form" or e.name not in BOILERPLATE) and 2 * held[i] > held[0]}
    inside = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        inside[i] = inside[e.parent] or e.name in BOILERPLATE and e.name != "form"
    top = next((i for i, e in enumerate(elements) if e.name in ("article", "main") and not bad[i] and not inside[i]), 0)
    while top > 0:
        top = elements[top].parent
        wrappers.add(top)
    out = [(False, False, False, False)]
    for i, e in enumerate(elements[1:], 1):
        b, g, article, _ = out[e.parent]
        out.append((b or bad[i] and i not in wrappers, g or good[i], article or e.name in ("article", "main"), under[i]))
    return out


def commented(elements: list[Element], found: list[Block]) -> list[int]:
    """Elements that hold readers' comments by their first heading: the element around a heading that says so and nothing else, if nothing stands in it before."""
    first: dict[int, int] = {}
    for n, b in enumerate(found):
        i = elements[b.element].parent if elements[b.element].name in HEADINGS else b.element
        while i > 0 and i not in first:
            first[i] = n
            i = elements[i].parent
    out = []
    for n, b in enumerate(found):
        e = elements[b.element]
        if e.name in HEADINGS and len(b.text) < 60 and COMMENT_WORD.search(b.text) and COMMENT_HEADING.fullmatch(b.text) and first.get(e.parent) == n and elements[e.parent].name in CONTAINERS:
            out.append(e.parent)
    return out


def blocks(page: str) -> list[tuple[str, float, int]]:
    """(text, score, parent) of each block in page order."""
    elements, found = parse(page)
    region = regions(elements, found)
    out, open_, held = [], [], []
    for b in found:
        bad, good, article, within = region[b.element]
        name, parent = elements[b.element].name, b.element
        share = min(1.0, b.linked / len(b.text))
        score = BIAS + IN_ARTICLE * article + GOOD * (good and not bad) + BAD * bad + LENGTH * min(1.0, len(b.text) / LONG) + LINKS * share
        score += IN_LIST * (name == "li") + HEADING * (name in HEADINGS)
        while parent > 0 and elements[parent].name not in CONTAINERS - LISTS:
            parent = elements[parent].parent
        out.append((b.text, score, parent))
        open_.append(not bad and share < MOSTLY)
        held.append(within)
    return supported(out, open_, held)


#: Containers whose parts belong to the text around them.
LISTS = frozenset("dl ol table ul".split())


def supported(rows: list[tuple[str, float, int]], open_: list[bool], held: list[bool]) -> list[tuple[str, float, int]]:
    """rows (text, score, parent) without what counts against an open block (no boilerplate, not made of links) with main text around it.

    Where no open block of a page counts for main text, each of them does, so short pages aren't empty.
    """
    sure = [o and s > 0 for (_, s, _), o in zip(rows, open_, strict=True)]
    if not any(sure):
        return [(t, -BIAS if o else s, p) for (t, s, p), o in zip(rows, open_, strict=True)]
    at = [i for i, x in enumerate(sure) if x]
    parents = {rows[i][2] for i in at}
    return [(t, max(s, AMONG) if o and (held[i] or at[0] < i < at[-1] or p in parents and p > 0) else s, p) for i, ((t, s, p), o) in enumerate(zip(rows, open_, strict=True))]


def cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the minimum cut: True on the source's side. Shortest augmenting paths, layer by layer."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    edges: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, there: float, back: float) -> None:
        edges[a].append(len(to))
        edges[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, s in enumerate(scores):
        if s > 0:
            tie(source, i, s, 0.0)
        elif s < 0:
            tie(i, sink, -s, 0.0)
    for a, b, w in ties:
        tie(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in edges[x]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, x = [], source
            while nxt[x] < len(edges[x]) and not (room[edges[x][nxt[x]]] > 1e-9 and level[to[edges[x][nxt[x]]]] == level[x] + 1):
                nxt[x] += 1
            if nxt[x] < len(edges[x]):
                path.append(edges[x][nxt[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                nxt[x] += 1
            else:
                break


def main_blocks(page: str) -> list[str]:
    found = blocks(page)
    if not found:
        return []
    ties = [(i, i + 1, BESIDE) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, (_, _, parent) in enumerate(found):
        if parent in last:
            ties.append((last[parent], i, SIBLING))
        last[parent] = i
    scores = [s for _, s, _ in found]
    if all(s > 0 for s in scores):
        return [t for t, _, _ in found]
    return [t for (t, _, _), keep in zip(found, cut(scores, ties), strict=True) if keep]


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row (page_id, url, text, n_chars) for each row of pages.

    text is the page's main text: character references decoded, white space inside a block turned into one space, blocks in
    page order joined by two line feeds; empty for null, empty and textless pages. n_chars counts code points. Repeated rows and null
    ids are rows like others. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = ["\n\n".join(main_blocks(x)) if x else "" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
