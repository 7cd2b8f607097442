"""Main-text extraction by wrapper induction over the pages of a host.

Pages of a host are dealt into groups of bounded size, so a host with a third of all pages is many groups. In each group:

1. Every page becomes a tree of block elements; inline markup is part of a block's text, and runs of equal siblings are one
   node of the page's skeleton (a list of any length has one shape).
2. The pages of the group are aligned, those that mark an article (or main element) with one another and the others with one another, or with all where one of
   these kinds has but one content: the most frequent skeleton is the wrapper, and simple tree matching aligns every other one with it; pages share skeletons,
   so each alignment is computed once.
3. A wrapper node that has the same text beside nearly all distinct contents is constant where it has that text; the others are varying slots. Pages of
   one content count once. The slots show where the content is: in the shortest run of nodes with nearly all varying text, and in all of the element that
   holds that run. Constant nodes outside it are template; inside it they stay. Two distinct pages are enough; one page shows no template.
   Marks check that: an article is content as a whole (headings and closing lines that many articles of a host share are no template), but of several on a
   page those with nothing but template are none.
4. From that content the parts are left out that markup itself sets apart: navigation, headers, footers, sidebars, notices, adverts, forms, scripts and
   comments. Names that articles use as well (discussion, search, ...) set a part apart only if it is mostly links; ids of headings, paragraphs and list
   items never do, and those of sections only if they say nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import workspace

#: Pages of a group, about; share of a group's distinct contents beside which a constant node has its text; hundredths of the varying letters that
#: the content range has.
GROUP, SAME, MOST_VARYING = 500, 0.9, 95
#: Sums of an alignment that are held at once.
CELLS = 1 << 20

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes template textarea title svg math object audio video canvas head select button".split())
#: Elements that are never content.
APART = frozenset("nav footer aside form menu dialog".split())
#: What closes an open element of the same scope: a start tag on the left ends open ones on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "tbody": {"tbody", "thead", "tfoot", "tr"}, "tfoot": {"tbody", "thead", "tr"}, "thead": {"tbody"}}
SCOPE = frozenset("html body table ul ol dl div section article aside nav header footer main form blockquote".split())
#: Words of class, id and role that set a part aside.
ASIDE_WORDS = frozenset("ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pager pagination masthead footer sidebar rail widget cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond disqus reply replies discussion form search skip toolbar hidden complementary contentinfo".split())
#: Those of ASIDE_WORDS that also name parts of articles, and words that tell the two apart when they stand in one name with them.
DOUBTFUL_WORDS = frozenset("related recommended discussion search form share sharing social notice alert reply replies".split())
SURE_WORDS = frozenset("post posts article articles story stories news products videos links button buttons bar box icons input form".split())
#: Words beside which those describe a page's layout, so that the part may hold the article, and those that say what a part goes with.
LAYOUT_WORDS = frozenset("with has no container wrapper wrap layout page site main body content row".split())
BESIDE_WORDS = frozenset(("with", "has", "no"))
#: Elements whose ids are targets of links: they say what the text is about.
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p li".split())
#: Share of a doubtful part's letters in links from which it is no text of the article; share of an article's that a layout part holds.
LINKS, MOST = 0.5, 0.5
#: Words that set an article or main element aside.
OTHER_ARTICLES = frozenset("ad promo sponsored related comment comments reply teaser".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """A block element: ``items`` are its texts (raw, with a flag for link text) and child nodes in order. ``apart``: never content;
    ``layout``: content only where it holds most of the article; ``doubtful``: content unless it is mostly links; ``outside``:
    cannot hold the article; ``head``: a header, of which an article keeps the headings."""

    __slots__ = ("tag", "label", "apart", "layout", "doubtful", "outside", "head", "main", "items", "slot")

    def __init__(self, tag: str, attributes: str = "") -> None:
        found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower().strip()
        self.tag, self.label = tag, f"{tag} {found.get('class', '')}".strip()
        words = set(_WORD.findall(names)) if names else set()
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        named = bool(words & (OTHER_ARTICLES if tag in ("article", "main") else ASIDE_WORDS)) and tag not in ("body", "html")
        sure, self.doubtful = _naming(tag, found) if named else (False, False)
        self.layout = sure and bool(words & LAYOUT_WORDS) and tag not in ("article", "main")
        self.apart = tag in APART or hidden or sure and not self.layout
        self.outside = tag in APART or hidden or named and not words & LAYOUT_WORDS
        self.head = tag == "header" or "header" in words
        self.main = tag in ("article", "main") or "main" in found.get("role", "").lower() or (tag in ("div", "section") and bool(words & {"article", "post", "entry", "story"}) and not (tag in APART or hidden or named) and not self.head)
        self.items: list = []
        self.slot: int | None = None


def _naming(tag: str, found: dict[str, str]) -> tuple[bool, bool]:
    """Whether the names of an element surely, and whether they perhaps, set it aside in an article."""
    if tag in ("article", "main"):
        return True, False
    sure = perhaps = False
    for kind in ("class", "id", "role"):
        if kind == "id" and tag in ANCHORS:
            continue
        for name in found.get(kind, "").lower().split():
            words = set(_WORD.findall(name))
            aside = words & ASIDE_WORDS
            if not aside or words & BESIDE_WORDS:
                continue
            if kind == "id" and tag == "section":
                # the id of a section is its subject, unless it says nothing else
                sure = sure or words <= ASIDE_WORDS - DOUBTFUL_WORDS
            elif kind == "role" or aside - DOUBTFUL_WORDS or words & SURE_WORDS - aside or len(aside) > 1:
                sure = True
            else:
                perhaps = tag not in _HEADINGS
    return sure, perhaps


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    open_nodes, link, at = [root], 0, 0
    n = len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            open_nodes[-1].items.append((html[at:], link > 0))
            break
        if m.start() > at:
            open_nodes[-1].items.append((html[at : m.start()], link > 0))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            if tag in BLOCKS:
                for k in range(len(open_nodes) - 1, 0, -1):
                    if open_nodes[k].tag == tag:
                        del open_nodes[k:]
                        link = 0
                        break
            elif tag in ("td", "th"):
                open_nodes[-1].items.append((" ", False))
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                # an element that is never closed: a head or button is passed over, the rest swallows the page
                at = end.end() if end else at if tag in ("head", "button", "select", "svg", "math", "object", "audio", "video", "canvas") else n
            continue
        if tag in BLOCKS:
            closing = CLOSES.get(tag, ())
            for k in range(len(open_nodes) - 1, 0, -1):
                over = open_nodes[k].tag
                if over == "p" or over in closing:
                    del open_nodes[k:]
                    link = 0
                    break
                if over in SCOPE:
                    break
            if tag in ("html", "body"):
                continue
            node = Node(tag, m[3])
            open_nodes[-1].items.append(node)
            if tag not in VOID:
                open_nodes.append(node)
        elif tag == "a":
            link += 1
        elif tag in ("br", "td", "th", "img", "wbr"):
            open_nodes[-1].items.append((" " if tag != "wbr" else "", False))
    return root


class Shapes:
    """Skeletons (a label and the skeletons of the children), each known by a number: equal ones have the same, and children have
    lower numbers than their parents. Pages may be nested and wide at will, so nothing here recurses."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, tuple[int, ...]], int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.digests: list[bytes] = []
        self.found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def shape(self, label: str, children: tuple[int, ...] = ()) -> int:
        key = (label, children)
        if key not in self.numbers:
            self.numbers[key] = len(self.labels)
            self.labels.append(label)
            self.children.append(children)
            self.sizes.append(1 + sum(self.sizes[c] for c in children))
            self.digests.append(hashlib.sha256(b"".join([label.encode("utf-8", "surrogatepass"), b"\0", *(self.digests[c] for c in children)])).digest())
        return self.numbers[key]

    def skeleton(self, node: Node) -> tuple[int, list[list[Node]]]:
        """The skeleton of a page, in which a run of children of one label is one child with all of their children; and the
        elements of each of its nodes in preorder."""
        groups: list[list[Node]] = []
        above: list[int] = []
        todo = [([node], -1)]
        while todo:
            nodes, parent = todo.pop()
            todo.extend((run, len(groups)) for run in reversed(_runs(nodes)))
            groups.append(nodes)
            above.append(parent)
        below: list[list[int]] = [[] for _ in groups]
        for k in range(len(groups) - 1, 0, -1):
            below[above[k]].append(self.shape(groups[k][0].label, tuple(reversed(below[k]))))
        return self.shape(node.label, tuple(reversed(below[0]))), groups

    def match(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """Simple tree matching of two skeletons of one label: the most pairs of nodes, top-down and in order, with equal labels; and
        the places of the children that match."""
        todo = [(a, b)]
        while todo:
            pair = todo[-1]
            if pair in self.found:
                todo.pop()
                continue
            x, y = self.children[pair[0]], self.children[pair[1]]
            head = tail = 0
            # children of one skeleton at the same end: no other pairing of them is better
            while head < min(len(x), len(y)) and x[head] == y[head]:
                head += 1
            while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
                tail += 1
            left, right = x[head : len(x) - tail], y[head : len(y) - tail]
            rows, cols = list(dict.fromkeys(left)), list(dict.fromkeys(right))
            by_label: dict[str, list[int]] = {}
            for q in cols:
                by_label.setdefault(self.labels[q], []).append(q)
            need = [(p, q) for p in rows for q in by_label.get(self.labels[p], ()) if p != q and (p, q) not in self.found]
            if need:
                todo.extend(need)
                continue
            gains = np.zeros((len(rows), len(cols)), np.int64)
            place = {q: k for k, q in enumerate(cols)}
            for k, p in enumerate(rows):
                for q in by_label.get(self.labels[p], ()):
                    gains[k, place[q]] = self.sizes[p] if p == q else self.found[p, q][0]
            where = {p: k for k, p in enumerate(rows)}
            inner = _best_pairs(np.array([where[p] for p in left], np.int64), np.array([place[q] for q in right], np.int64), gains)
            pairs = [(k, k) for k in range(head)] + [(head + i, head + j) for i, j in inner] + [(len(x) - tail + k, len(y) - tail + k) for k in range(tail)]
            same = sum(self.sizes[c] for c in x[:head]) + sum(self.sizes[c] for c in x[len(x) - tail :])
            self.found[pair] = 1 + same + sum(int(gains[where[left[i]], place[right[j]]]) for i, j in inner), pairs
            todo.pop()
        return self.found[a, b]

    def align(self, shape: int, wrapper: int) -> list[int | None]:
        """For each node of ``shape`` in preorder the preorder place of its partner in ``wrapper``."""
        out: list[int | None] = []
        todo: list[tuple[int, int | None, int]] = [(shape, wrapper if self.labels[shape] == self.labels[wrapper] else None, 0)]
        while todo:
            a, b, at = todo.pop()
            if b is None:
                out.extend([None] * self.sizes[a])
            elif a == b:
                out.extend(range(at, at + self.sizes[a]))
            else:
                out.append(at)
                partner = dict(self.match(a, b)[1])
                starts = list(accumulate((self.sizes[c] for c in self.children[b]), initial=at + 1))
                for i in range(len(self.children[a]) - 1, -1, -1):
                    j = partner.get(i)
                    todo.append((self.children[a][i], None if j is None else self.children[b][j], 0 if j is None else starts[j]))
        return out


def _runs(nodes: list[Node]) -> list[list[Node]]:
    runs: list[list[Node]] = []
    for child in (x for n in nodes for x in n.items if isinstance(x, Node)):
        if runs and runs[-1][0].label == child.label:
            runs[-1].append(child)
        else:
            runs.append([child])
    # children of several instances repeat a pattern: one node for each label
    if len(nodes) > 1:
        by: dict[str, list[Node]] = {}
        for run in runs:
            by.setdefault(run[0].label, []).extend(run)
        runs = list(by.values())
    return runs


def _sums(x: np.ndarray, y: np.ndarray, gains: np.ndarray) -> Iterator[np.ndarray]:
    """For each number of heads of ``x``, from 0, the best sums with each number of heads of ``y``."""
    best = np.zeros(len(y) + 1, np.int64)
    yield best
    for i in x.tolist():
        further = best.copy()
        np.maximum(best[1:], best[:-1] + gains[i, y], out=further[1:])
        best = np.maximum.accumulate(further)
        yield best


def _best_pairs(x: np.ndarray, y: np.ndarray, gains: np.ndarray) -> list[tuple[int, int]]:
    """The places in two sequences of a common subsequence with the greatest sum of ``gains[x, y]``. Long sequences are halved where the best sums of the
    two halves meet, so memory is bounded by CELLS and their length."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > CELLS and b - a > 1:
            middle = (a + b) // 2
            *_, before = _sums(x[a:middle], y[c:d], gains)
            *_, after = _sums(x[middle:b][::-1], y[c:d][::-1], gains)
            cut = c + int((before + after[::-1]).argmax())
            todo += [(middle, b, cut, d), (a, middle, c, cut)]
            continue
        best = np.stack(list(_sums(x[a:b], y[c:d], gains)))
        i, j, found = b - a, d - c, []
        while i and j:
            gain = gains[x[a + i - 1], y[c + j - 1]]
            if gain and best[i, j] == best[i - 1, j - 1] + gain:
                found.append((a + i - 1, c + j - 1))
                i, j = i - 1, j - 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
        out += reversed(found)
    return out


def own_text(node: Node) -> str:
    return " ".join("".join(x[0] for x in node.items if not isinstance(x, Node)).split())


def _walk(node: Node) -> Iterator[Node]:
    """A node and those in it that markup doesn't set apart."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(c for c in reversed(x.items) if isinstance(c, Node) and not c.apart)


def _regions(node: Node) -> list[Node]:
    """The outermost articles, without any the main elements."""
    for want in ("article", "main", None):
        found: list[Node] = []
        todo = list(reversed(node.items))
        while todo:
            x = todo.pop()
            if isinstance(x, Node) and not x.outside:
                if x.tag == want or want is None and x.main:
                    found.append(x)
                else:
                    todo.extend(reversed(x.items))
        if found:
            return found
    return [node]


def _letters(node: Node, known: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """The letters of a part without what is set aside in it, and those of them in links. ``known`` keeps them by the node's id()."""
    todo = [(node, False)]
    while todo:
        x, ready = todo.pop()
        if id(x) in known:
            continue
        parts = [c for c in x.items if isinstance(c, Node) and not c.apart]
        if not ready:
            todo.append((x, True))
            todo.extend((c, False) for c in parts)
            continue
        own = [(len("".join(c[0].split())), c[1]) for c in x.items if not isinstance(c, Node)]
        total = sum(n for n, _ in own) + sum(known[id(c)][0] for c in parts)
        known[id(x)] = total, sum(n for n, link in own if link) + sum(known[id(c)][1] for c in parts)
    return known[id(node)]


def blocks(node: Node, template: set[int]) -> list[str]:
    """The texts of the blocks of a page's content in page order, without those of the ``template`` nodes. What an article holds is no template, but of several
    articles those that hold nothing else are. Content of which nothing is left keeps its template, and then what perhaps is set aside."""
    out: list[str] = []
    held: list[tuple[str, bool]] = []
    letters: dict[int, tuple[int, int]] = {}

    def flush() -> None:
        # a reference ends where its run of text ends
        text = " ".join("".join(unescape(t) for t, _ in held).split())
        held.clear()
        if text:
            out.append(text)

    def left_out(x: Node, region: Node, whole: bool) -> bool:
        if x.layout and not whole:
            return _letters(x, letters)[0] <= MOST * _letters(region, letters)[0]
        if x.doubtful:
            total, linked = _letters(x, letters)
            return linked > LINKS * total
        return False

    def walk(region: Node, template: set[int], sparing: bool) -> None:
        whole = region is node  # the page has no article, so blocks of links alone are menus
        todo = [(region, iter(region.items), False)]
        while todo:
            x, items, heading_only = todo[-1]
            for item in items:
                if isinstance(item, Node):
                    flush()
                    if not item.apart and not (item.head and whole) and (sparing or not left_out(item, region, whole)):
                        todo.append((item, iter(item.items), heading_only or item.head))
                        break
                elif x.slot not in template and not (heading_only and x.tag not in _HEADINGS):
                    held.append(item)
            else:
                if whole and held and all(link or not t.strip() for t, link in held):
                    held.clear()
                flush()
                todo.pop()

    regions = _regions(node)
    if regions[0] is not node:
        regions, template = [r for r in regions if not _is_template(r, template)] or regions, set()
    for region in regions:
        had = len(out)
        for kept, sparing in ((template, False), (set(), False), (set(), True)):
            if len(out) == had:
                walk(region, kept, sparing)
    return out


def _is_template(region: Node, template: set[int]) -> bool:
    """Whether a part has text, and all of it in nodes of the template."""
    texts = [x.slot in template for x in _walk(region) if own_text(x)] if template else []
    return bool(texts) and all(texts)


def _content_range(shapes: Shapes, wrapper: int, varying: np.ndarray) -> tuple[int, int]:
    """The preorder places of a wrapper's content, from the letters that vary in each of its nodes: the shortest run of nodes with MOST_VARYING of them, and all of
    the element that holds the run, unless that is the page itself."""
    sums = np.concatenate([[0], np.cumsum(varying)])
    wanted = -(-sums[-1] * MOST_VARYING // 100)
    ends = np.searchsorted(sums, sums[:-1] + wanted)
    fits = np.flatnonzero(ends <= len(varying))
    first = int(fits[np.argmin(ends[fits] - fits)])
    last = int(ends[first])
    at, shape, end = 0, wrapper, len(varying)
    while True:
        start = at + 1
        for child in shapes.children[shape]:
            if start <= first and last <= start + shapes.sizes[child]:
                at, shape, end = start, child, start + shapes.sizes[child]
                break
            start += shapes.sizes[child]
        else:
            return (first, last) if at == 0 else (at, end)


def _templates(trees: list[Node | None], contents: list[str], among: list[int]) -> dict[int, set[int]]:
    """The wrapper of the pages ``among``: for each of them the places of its template nodes, which its nodes then have as ``slot``."""
    # pages that are copies of one another say nothing about the template
    distinct = len({contents[k] for k in among})
    if distinct < 2:
        return {}
    shapes = Shapes()
    found = {k: shapes.skeleton(trees[k]) for k in among}
    counts = Counter(f[0] for f in found.values())
    wrapper = min(counts, key=lambda s: (-counts[s], shapes.digests[s]))
    paths = {s: shapes.align(s, wrapper) for s in counts}
    said: dict[int, dict[int, str]] = {}  # the text of each wrapper node on each page
    beside: dict[tuple[int, str], set[str]] = {}
    for k in among:
        for slot, nodes in zip(paths[found[k][0]], found[k][1]):
            for x in nodes:
                x.slot = slot
        parts: dict[int, list[str]] = {}
        above: list[tuple[Node, int]] = [(trees[k], 0)]
        while above:
            node, place = above.pop()
            # what has no partner in the wrapper is the page's own, where it stands
            place = place if node.slot is None else node.slot
            if t := own_text(node):
                parts.setdefault(place, []).append(t)
            above.extend((c, place) for c in reversed(node.items) if isinstance(c, Node) and not c.apart)
        said[k] = {slot: "\n".join(texts) for slot, texts in parts.items()}
        for slot, text in said[k].items():
            beside.setdefault((slot, text), set()).add(contents[k])
    constant = {slot: text for (slot, text), around in beside.items() if len(around) >= SAME * distinct and len(around) > 1}
    varying = np.zeros(shapes.sizes[wrapper], np.int64)
    for slot, text in beside:
        if constant.get(slot) != text:
            varying[slot] += len(text)
    if not varying.any():
        return {}
    first, last = _content_range(shapes, wrapper, varying)
    return {k: {slot for slot, text in said[k].items() if constant.get(slot) == text and not first <= slot < last} for k in among}


def extract_group(pages: list[str | None], aligned: bool = True) -> list[str]:
    """The main text of each page of a group of one host. ``aligned``: whether the pages say what of one another is template."""
    trees = [parse(p) if p else None for p in pages]
    marked = ["\n".join(blocks(t, set())) if t is not None else "" for t in trees]
    contents = list(marked)
    if not aligned:
        return contents
    there = [k for k, t in enumerate(trees) if t is not None]
    bare = {k for k in there if _regions(trees[k])[0] is trees[k]}
    # pages with an article and pages without one mostly come from different templates
    for own in ([k for k in there if k not in bare], sorted(bare)):
        found = _templates(trees, marked, own if len({marked[k] for k in own}) > 1 else there) if own else {}
        for k in own:
            if found.get(k):
                contents[k] = "\n".join(blocks(trees[k], found[k]))
    return contents


def with_main_text(df: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """``key``, ``url`` and ``text`` (string: the main text) of every row.

    Null and empty pages and pages without content have the empty text. Null or odd urls share the empty host. Repeated rows are
    each extracted; a null key passes through. An empty table gives an empty result; other columns are not read. The pages are
    shuffled once, by host and a salt that splits hosts of more than GROUP pages.
    """
    spark = df.sparkSession
    workspace.bound_batches(spark, 200)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    pages = df.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).cast("string").alias("h"), host.alias("host"))
    large = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select(F.col("host").alias("large"), F.ceil(F.col("n") / GROUP).alias("groups"))
    # as many rows as there are hosts with over GROUP pages; as a table its size is known before the join is planned, so while it
    # fits a broadcast the pages are not shuffled for it
    large = workspace.stage(large, "hosts")
    met = pages.join(large, F.col("host") == F.col("large"), "left")
    salted = met.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("k", "u"), F.col("groups")), F.lit(0)))
    dealt = salted.select("host", "salt", "k", "u", "h").repartition(workspace.task_count(spark), "host", "salt").sortWithinPartitions("host", "salt", "k", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            texts = extract_group([r[2] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string())], ["k", "u", "text"])

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field("k").type
            for host, salt, k, u, h in zip(*(b.column(c).to_pylist() for c in ("host", "salt", "k", "u", "h"))):
                if (host, salt) != now or len(rows) >= 4 * GROUP:
                    if rows:
                        yield done()
                    now, rows = (host, salt), []
                rows.append((k, u, h))
        if rows:
            yield done()

    kind = pages.schema["k"].dataType.simpleString()
    return dealt.mapInArrow(run, f"k {kind}, u string, text string").select(F.col("k").alias(key), F.col("u").alias(url), "text")
