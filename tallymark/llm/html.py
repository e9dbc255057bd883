"""Main-text extraction from web pages.

Method: minimum-cut labelling.  A page is split into text blocks; a classifier gives each block a cost of being
called content and one of being called boilerplate, which become the capacities to the two terminals of a graph.
What a block's length, share of linked text, ending and paragraph tell is fitted on the pages themselves (``fit``): counts over all
blocks that lie in an article or a main part against those in marked boilerplate, so pages without such marks are judged by
what those with them teach.  Tags and names of elements are prior evidence.  A name counts by its last word, ("related-posts" and
"siteFooter" are boilerplate, "comment-on-budget" hardly), and an element that holds the page's title, or its
only article, and more running text than all unsuspected elements together is the article whatever it is called; so is, on a page
without a title, a form or a doubtful name around three quarters of the text.  Cells of a table of short cells are judged by the whole table.
Blocks next to each other on the page, and next to each other under one parent, are tied by smoothness edges that
weaken with their distance in the DOM.  A maximum flow separates content from boilerplate at the least total cost.
A block whose own preference outweighs all its edges has that label in every minimum cut, so such blocks are
settled first and only what is left goes through augmenting paths.

Tags are read by the grammar of HTML: a quote opens a value only directly after an equals sign, so an apostrophe elsewhere
in a tag or in prose hides nothing.  An inline element that its attributes hide or mark as an advert is a piece of its
own inside its block; the pieces of a block that stay are put together without a space.

Edge cases: a null or empty page gives an empty text; text outside any tag is a block like any other; unclosed
and stray tags are tolerated, and a "<" that opens no complete tag is text; character references are decoded; scripts, styles,
titles, templates and comments never make blocks; repeated rows and null ids pass through; other columns are ignored; an empty
table gives an empty result.  Parsing takes time in proportion to a page, however deep or broken its nesting.  Pages
are independent, so one task holds one batch of pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags by their part in a page, and words of class, id and role attributes.
RAW = "script style noscript iframe noembed noframes title textarea"
UNSEEN = "template svg"
BLOCK = "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary svg table tbody td template tfoot th thead tr ul"
VOID = "area base br col embed hr img input link meta param source track wbr"
SELF_ENDING = "li option dt dd tr td th"
TAG_COST = {"nav": -9, "menu": -9, "footer": -9, "aside": -9, "form": -9, "button": -9, "select": -9, "option": -9, "dialog": -9, "template": -99, "svg": -99, "fieldset": -6, "label": -6, "header": -6, "article": 5, "main": 4, "p": 1, "h1": 1.5, "h2": 1, "h3": 1, "blockquote": 1, "pre": 1, "figcaption": 0.5, "li": -0.3}
BAD_WORDS = "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations widget widgets popup modal overlay toolbar pagination pager search form copyright legal disclaimer tags toc skip hidden"
GOOD_WORDS = "article articles content contents post posts story stories entry entries body text main prose"
# Elements of running text, and items of lists and tables.
PROSE_TAGS = "p h1 h2 h3 h4 h5 h6 blockquote pre figcaption"
ITEM_TAGS = "li td th dt dd caption"
# Words of names that say where or how, not what; words after which a name tells what lies elsewhere; parts of a page that are never its article.
PLACE_WORDS = "site page list item items box block blocks container wrapper wrap inner outer section area row col column columns top bottom left right center bar link links button buttons btn icon icons slot unit thread layout primary secondary global group panel this now the us on of to in for and my is js"
APART_WORDS = "has with no without"
APART_TAGS = "nav menu footer aside button select option dialog template svg"
AD_WORDS = "ad ads advert adverts advertisement advertising sponsor sponsored"
ROLES = "complementary contentinfo navigation search banner dialog alertdialog menu toolbar form"
# A fitted margin's prior weighs as many blocks; it stays within LIMIT, so that marks outweigh it.
PRIOR, LIMIT = 50.0, 3.0

_RAW, _BLOCK, _VOID, _UNSEEN, _SELF_ENDING = (set(x.split()) for x in (RAW, BLOCK, VOID, UNSEEN, SELF_ENDING))
_BAD, _GOOD, _PLACE, _APART, _AD, _ROLES, _NEVER = (set(x.split()) for x in (BAD_WORDS, GOOD_WORDS, PLACE_WORDS, APART_WORDS, AD_WORDS, ROLES, APART_TAGS))
# What holds a block: nothing that says so, an item of a list or table, a paragraph or heading.
_FRAMES = {x: 1 for x in ITEM_TAGS.split()} | {x: 2 for x in PROSE_TAGS.split()}
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_BOGUS = re.compile(r"<[!?/][^>]*>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?+)*+))>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW}
_UNDRAWN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Block:
    """A piece of text: its block's number, the parent whose children lie side by side, its distance in the DOM from the piece before."""

    __slots__ = ("text", "length", "linked", "number", "holder", "element", "gap", "cost", "table", "frame")

    def __init__(self, text: str, length: int, linked: int, number: int, holder: int, element: int, gap: int):
        self.text, self.length, self.linked, self.number, self.holder, self.element, self.gap = text, length, linked, number, holder, element, gap
        self.cost, self.table, self.frame = 0.0, 0, 0


class Element:
    """An open tag: its parent, what its tag, its name and its hiding add, and the table it lies in."""

    __slots__ = ("parent", "tag", "kind", "name", "hidden", "table")

    def __init__(self, parent: int, tag: str, kind: float, name: float, hidden: float, table: int):
        self.parent, self.tag, self.kind, self.name, self.hidden, self.table = parent, tag, kind, name, hidden, table


def _token_cost(token: str) -> float:
    """What one word of a class or id says.  Words of place and of praise are passed over; the last of the others counts most."""
    parts = [x.lower() for x in _PARTS.findall(token)]
    if parts and parts[0] in _APART:
        return 0.0
    rest = [x for x in parts if x not in _PLACE and x not in _GOOD]
    bad = sum(x in _BAD for x in rest)
    if bad:
        return -8.0 if rest[-1] in _BAD or not _AD.isdisjoint(rest) else -6.0 * bad / len(rest)
    return 2.0 if not _GOOD.isdisjoint(parts) else 0.0


def _attribute_cost(tag: str, attributes: str, inside: bool) -> tuple[float, float]:
    """What an element's names say, and what hides it."""
    name_cost = hidden = 0.0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            costs = [_token_cost(x) for x in value.split()]
            if min(costs, default=0) < 0:
                name_cost += 0 if inside and tag in ("h1", "h2", "p") else min(costs)
            else:
                name_cost += max(costs, default=0)
        elif name == "role":
            name_cost += -8 if value.strip().lower() in _ROLES else 2 if value.strip().lower() in ("main", "article") else 0
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _UNDRAWN.search(value)):
            hidden -= 9
    return name_cost, hidden


def _excuse(elements: list[Element], found: list[Block]) -> None:
    """Take back what speaks against an element that holds the page's title or only article and most of its running text."""
    struck, gone, titled = [0], [False], [False]
    articles = [i for i, e in enumerate(elements) if e.tag == "article" and e.name >= 0]
    for i, e in enumerate(elements[1:], 1):
        struck.append(i if e.kind + e.name <= -2 else struck[e.parent])
        gone.append(e.hidden < 0 or e.kind < -50 or gone[e.parent])
        titled.append(titled[e.parent] and struck[i] != i or e.tag in ("h1", "main") or articles == [i])
    if not any(struck):
        return
    mass, title = defaultdict(float), set()
    for b in found:
        if not gone[b.element]:
            if b.linked * 3 < b.length:
                mass[struck[b.element]] += b.length - b.linked
            if titled[b.element]:
                title.add(struck[b.element])
    clean = mass[0]
    for i in range(len(elements) - 1, 0, -1):
        e = elements[i]
        if struck[i] != i or e.tag in _NEVER:
            continue
        up = struck[e.parent]
        if mass[i] > clean and i in title or mass[i] > 3 * clean and not title and e.name > -8 and (e.tag == "form" or e.kind == 0):
            e.kind, e.name = 0.0, 0.0
            mass[up] += mass[i]
            title |= {up} if i in title else set()
        elif e.tag == "header" and i in title:
            title.add(up)


def _set_costs(elements: list[Element], found: list[Block]) -> None:
    """Give every block the evidence of all elements around it."""
    _excuse(elements, found)
    total, frames = [0.0], [0]
    for e in elements[1:]:
        outer, cost = total[e.parent], e.kind + e.name + e.hidden
        # Inside boilerplate nothing speaks for content any more.
        total.append(outer + (min(cost, 0) if outer < -4 else cost))
        frames.append(_FRAMES.get(e.tag, 0) if e.tag in _BLOCK else frames[e.parent])
    for b in found:
        b.cost, b.table, b.frame = total[b.element], elements[b.element].table, frames[b.element]


def blocks(html: str) -> list[Block]:
    """The pieces of a page's text blocks in order, with the classifier's evidence from their elements."""
    out: list[Block] = []
    elements = [Element(0, "", 0.0, 0.0, 0.0, 0)]
    # Open elements: tag, number, whether in an article.
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    opened: Counter[str] = Counter()
    number, links, text, linked = 0, 0, [], 0
    lowest = before = 1  # the least depth since the last piece, and that piece's depth

    def flush(ends: bool = True) -> None:
        nonlocal linked, number, lowest, before
        if text:
            piece = "".join(map(unescape, text))
            length = len(" ".join(piece.split()))
            if length:
                gap = len(stack) + before - 2 * lowest
                out.append(Block(piece, length, linked, number, stack[-2][1] if len(stack) > 1 else 0, stack[-1][1], gap))
                lowest = before = len(stack)
            elif out and out[-1].number == number:
                out[-1].text += piece
            text.clear()
        linked = 0
        number += ends

    def close(depth: int) -> None:
        nonlocal lowest
        for tag, *_ in stack[depth:]:
            opened[tag] -= 1
        del stack[depth:]
        lowest = min(lowest, len(stack))

    def enter(tag: str, kind: float, name: float, hidden: float, inside: bool) -> None:
        parent = stack[-1][1]
        elements.append(Element(parent, tag, kind, name, hidden, len(elements) if tag == "table" else elements[parent].table))
        stack.append((tag, len(elements) - 1, inside))
        opened[tag] += 1

    def say(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(piece)

    pos, last, grammar = 0, html.rfind(">"), _TAG
    while 0 <= (at := html.find("<", pos)) < last:
        after = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            m = _COMMENT.match(html, at)
        elif after.isascii() and after.isalpha() or after == "/" and html[at + 2 : at + 3].isalpha():
            m = grammar.match(html, at)
            if not m and grammar is _TAG:
                # A value's quote is never closed; from here on a tag ends at the first ">".
                grammar = _PLAIN_TAG
                m = grammar.match(html, at)
        else:
            m = _BOGUS.match(html, at) if after in ("!", "?", "/") else None
        if not m:
            say(html[pos : at + 1])
            pos = at + 1
            continue
        if at > pos:
            say(html[pos:at])
        pos = m.end()
        if m.re not in (_TAG, _PLAIN_TAG):
            continue
        ending, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in _RAW:
            flush(tag not in ("script", "style", "noscript"))
            if not ending and (end := _END[tag].search(html, pos)):
                pos = end.end()
            elif not ending and not attributes.endswith("/"):
                pos = len(html)
            continue
        if tag not in _BLOCK:
            if tag == "br":
                say(" ")
            elif ending and opened[tag]:
                flush(False)
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            elif not ending and tag not in _VOID and attributes and sum(costs := _attribute_cost(tag, attributes, stack[-1][2])) < 0:
                flush(False)
                enter(tag, 0.0, *costs, stack[-1][2])
            if tag == "a":
                links = 0 if ending else 1
            continue
        flush()
        links = 0
        if ending:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            continue
        # Elements that their next sibling closes, together with inline elements left open in them.
        while opened["p"] or (tag in _SELF_ENDING and opened[tag]):
            depth = len(stack) - 1
            while depth and stack[depth][0] not in _BLOCK:
                depth -= 1
            if stack[depth][0] != "p" and not (stack[depth][0] == tag and tag in _SELF_ENDING):
                break
            close(depth)
        if tag not in _VOID and not (tag in _UNSEEN and attributes.endswith("/")):
            inside = stack[-1][2]
            costs = _attribute_cost(tag, attributes, inside) if attributes and tag not in ("html", "body", "main") else (0.0, 0.0)
            enter(tag, -1 if tag == "header" and inside else TAG_COST.get(tag, 0), *costs, inside or tag in ("article", "main"))
    if pos < len(html):
        say(html[pos:])
    flush()
    _set_costs(elements, out)
    return out


def _measures(found: list[Block]) -> list[tuple[int, float, bool, int]]:
    """Length, share of linked text, whether it ends like a sentence, and what holds it, of every block.  The pieces that one element has in a
    block are measured together, and so are the cells of a table of at least four, none long: such a table holds data, others only place things."""
    length: Counter[tuple[int, int]] = Counter()
    linked: Counter[tuple[int, int]] = Counter()
    tables: dict[int, list[Block]] = {}
    for b in found:
        length[b.number, b.element] += b.length
        linked[b.number, b.element] += b.linked
        if b.table:
            tables.setdefault(b.table, []).append(b)
    data = {t: (sum(b.length for b in cells), sum(b.linked for b in cells)) for t, cells in tables.items() if len(cells) > 3 and max(b.length for b in cells) <= 200}
    out = []
    for b in found:
        n, in_links = data[b.table] if b.table in data else (length[b.number, b.element], linked[b.number, b.element])
        out.append((n, min(1.0, in_links / n), b.table in data or b.text.rstrip().endswith((".", "!", "?", ":", ";", "\u3002", "\u0964", "\u061f")), b.frame))
    return out


def _bin(n: int, density: float, ends: bool, frame: int) -> tuple[int, int, int, int]:
    return min(n, 1023).bit_length(), min(3, math.ceil(density * 3)), int(ends), frame


def _prior(n: float, density: float) -> float:
    """The margin before anything is fitted: above 0 for content."""
    size = min(n, 400) / 400
    return 3.0 * size - 0.6 - 4.0 * density * (1 - size / 2)


Model = dict[tuple[int, int, int, int], tuple[float, float]]


def _preferences(found: list[Block], model: Model | None) -> list[float]:
    """The classifier's margins: above 0 for content.  A fitted bin holds the weights of its content and of its boilerplate."""
    out = []
    for b, measured in zip(found, _measures(found)):
        margin = _prior(*measured[:2])
        content, other = (model or {}).get(_bin(*measured), (0.0, 0.0))
        if content or other:
            believed = 1 / (1 + math.exp(-margin))
            margin = math.log((content + PRIOR * believed) / (other + PRIOR * (1 - believed)))
        out.append(b.cost + max(-LIMIT, min(LIMIT, margin)))
    return out


def _flow(room: dict[int, dict[int, float]], source: int, sink: int) -> set[int]:
    """Saturate the graph by blocking flows (room is what is left); returns the source side of a minimum cut."""
    while True:
        level, line = {source: 0}, deque([source])
        while line:
            u = line.popleft()
            for v, c in room[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    line.append(v)
        if sink not in level:
            return set(level)
        ways = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(room[a][b] for a, b in zip(path, path[1:]))
                full = len(path)
                for i, (a, b) in enumerate(zip(path, path[1:])):
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0.0) + push
                    if room[a][b] <= 1e-9:
                        full = min(full, i + 1)
                del path[full:]
                continue
            for v in ways[u]:
                if room[u][v] > 1e-9 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                level[u] = -1


def _cut(prefer: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The source side of a minimum cut: True for content.  Capacities: prefer to the terminals, edges both ways."""
    n = len(prefer)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    prefer = list(prefer)
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and (abs(prefer[i]) > sum(near[i].values()) or not near[i]):
            label[i] = prefer[i] > 0
            for j, w in near[i].items():
                prefer[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = -1, -2
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
        for i in rest:
            room[i][source] = room[i][sink] = 0.0
            if prefer[i] > 0:
                room[source][i] = prefer[i]
            else:
                room[i][sink] = -prefer[i]
        content = _flow(room, source, sink)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def extract(html: str | None, model: Model | None = None) -> str:
    """The main text of one page; without a model by the prior margins alone."""
    found = blocks(html or "")
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            edges[i - 1, i] = 1.6 / (1 + block.gap)
        if block.holder in last:
            at = (last[block.holder], i)
            edges[at] = edges.get(at, 0) + 0.8
        last[block.holder] = i
    texts: dict[int, list[str]] = {}
    for block, kept in zip(found, _cut(_preferences(found, model), edges)):
        if kept:
            texts.setdefault(block.number, []).append(block.text)
    return " ".join(" ".join("".join(pieces).split()) for pieces in texts.values())


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that a task holds few pages as Python objects."""
    for lo in range(0, batch.num_rows, 500):
        yield batch.slice(lo, 500)


def fit(pages: DataFrame) -> Model:
    """How much marked content and marked boilerplate falls into each bin of measures, over all pages.

    Tasks send one row per bin and label, and the model has at most 10 x 4 x 2 x 3 bins, whatever the table.  Both labels weigh as
    much as the scarcer; a table that has marked blocks of one label only, or none, leaves every bin to its prior."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, int, int, int, bool]] = Counter()
        for batch in batches:
            for part in _parts(batch):
                for page in part.column("html").to_pylist():
                    found = blocks(page or "")
                    for b, measured in zip(found, _measures(found)):
                        if b.cost >= 4 or -50 < b.cost <= -6:
                            seen[*_bin(*measured), b.cost > 0] += 1
        columns = list(zip(*(key + (n,) for key, n in seen.items()))) or [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["size", "density", "ends", "frame", "content", "n"])

    counts = pages.select("html").mapInArrow(count, "size int, density int, ends int, frame int, content boolean, n long")
    rows = counts.groupBy("size", "density", "ends", "frame", "content").agg(F.sum("n").alias("n")).collect()
    total = {label: sum(r.n for r in rows if r.content == label) for label in (True, False)}
    if not all(total.values()):
        return {}
    scarcer = min(total.values())
    model: dict[tuple[int, int, int, int], list[float]] = {}
    for r in rows:
        model.setdefault((r["size"], r.density, r.ends, r.frame), [0.0, 0.0])[0 if r.content else 1] += r.n * scarcer / total[r.content]
    return {key: (content, other) for key, (content, other) in model.items()}


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html), by ``model`` or one fitted on these pages."""
    model = fit(pages) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                texts = [extract(x, model) for x in part.column("html").to_pylist()]
                counts = pa.array([len(x) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
