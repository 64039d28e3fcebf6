"""Main text of web pages: same-host pages are aligned by simple tree matching into wrappers."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, small_batches

#: Two pages of each host, those of least and greatest hash, are the pivots that all its pages are aligned with.
PIVOTS = 2
#: A text is constant in a slot where so large a part of a host's distinct pages has it there, and so
#: many pages at least: (share, pages), outside the content and inside it.
CONSTANT = {False: (0.5, 3), True: (0.8, 5)}
#: A slot is template where so large a part of its texts stands on other pages too, and so many of them at least.
RECURRING = (0.22, 3)
#: The content is sought in the child that holds so much of an element's varying text.
DESCENT = 0.6
#: Weight of varying text in elements named like furniture, and in those marked as the main part.
NAMED_WEIGHT, MAIN_WEIGHT = 0.1, 3.0
#: A furniture name doesn't count on an element with so much of a page's text.
MOST = 0.6
#: Wrappers up to so many bytes are broadcast; more are joined by the host.
BROADCAST_BYTES = 32 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr input link meta param source track".split())
RAW = frozenset("script style textarea title iframe xmp".split())
#: Elements whose content is never text of the page; unclosed ones end with the element around them.
HIDDEN = frozenset("noscript template svg object select annotation annotation-xml".split())
FORMULA = frozenset("math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = FORMULA | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = HIDDEN | frozenset("ul ol dl table article section div body html nav aside header footer form main".split())

#: Elements that hold no content of their own, and those that may.
SKIPPED_TAGS = frozenset("head nav footer aside button dialog menu".split())
DOUBTFUL_TAGS = frozenset("form fieldset".split())
#: Name parts after which the next one tells of something else on the page, or of nothing.
ABOUT_OTHERS = frozenset("no has with without not hide".split())
#: Elements below which no content is sought.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl pre blockquote figure figcaption address tr".split())
#: Elements of text, whose names are slugs of what they say and never make them furniture.
TEXT_TAGS = LEAVES | frozenset("table tbody thead caption td th".split())
#: Parts of names that tell of an element's place or make, not of what it holds.
LAYOUT_WORDS = frozenset("area bar block bottom box btn button buttons col column container content count form global group icon icons inner item items js large left link links list main mobile outer page panel post posts primary right row secondary section site slot slots small sticky text title top unit wrap wrapper".split())
#: Names that don't count in a marked main part, where articles use them of their own boxes.
BOX_NAMES = frozenset("alert notice notices search widget discussion".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus respond reply replies".split())
SKIPPED_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "topnav subnav sidenav topbar share sharing social related recommended popup modal overlay toolbar pagination pager widget login search copyright teaser teasers rail".split()
)


#: Pairs of elements beside each other from which on a matching's table is made row by row.
WIDE = 1 << 14
#: Elements nested deeper are children of the one at this depth; what is hidden or named around them still counts.
DEEPEST = 200


class Node:
    """A block element. `hidden` and `main` hold for all below it; `named` is 2 for certain furniture, 1 for doubtful, and its own."""

    __slots__ = ("tag", "parent", "children", "hidden", "named", "main", "texts", "shape")

    def __init__(self, tag: str, parent: Node | None = None, hidden: bool = False, named: int = 0, main: bool = False) -> None:
        self.tag, self.parent, self.hidden, self.named, self.main = tag, parent, hidden, named, main
        self.children: list[Node] = []
        self.texts: list[int] = []
        self.shape = 0


def set_shapes(root: Node) -> None:
    """Give every element a number that elements with the same tags in the same order below them share."""
    nodes, k = [root], 0
    while k < len(nodes):
        nodes.extend(nodes[k].children)
        k += 1
    for node in reversed(nodes):
        node.shape = hash((node.tag, tuple(c.shape for c in node.children)))


def furniture_parts(value: str) -> set[str]:
    """The parts of a class or id in lower case, without those after a part like `no` or `has`.

    A name with a part that is none of furniture or layout, like `related-work`, tells of its content and has none.
    """
    parts: set[str] = set()
    for name in value.split():
        about_others = False
        words = [part.lower() for part in NAME_PART.findall(name)]
        if not all(w in SKIPPED_NAMES or w in LAYOUT_WORDS or w in ABOUT_OTHERS or w.isdigit() for w in words):
            continue
        for part in words:
            if not about_others:
                parts.add(part)
            about_others = part in ABOUT_OTHERS
    return parts


def marks(tag: str, attributes: str, inside_main: bool) -> tuple[bool, int, bool]:
    """Whether an element is hidden, how surely it is furniture by its name or attributes, and whether it is marked as the main part."""
    named = 2 if tag in SKIPPED_TAGS or tag == "header" and not inside_main else 1 if tag in DOUBTFUL_TAGS else 0
    hidden, main = tag in HIDDEN, tag in ("article", "main")
    if len(attributes) > 3:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                if tag in TEXT_TAGS:
                    continue
                parts = furniture_parts(value)
                if inside_main or main:
                    parts -= BOX_NAMES
                if name == "id":
                    parts.discard("discussion")
                if not parts.isdisjoint(COMMENT_NAMES):
                    named = 2
                elif not (main or tag in ("body", "html") or parts.isdisjoint(SKIPPED_NAMES)):
                    named = max(named, 1)
            elif name == "role":
                if value.lower() in SKIPPED_ROLES:
                    named = 1 if value.lower() == "form" else 2
                main = main or value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
    return hidden, named, main


def parse(source: str) -> tuple[Node, list[str], list[Node]]:
    """The tree of a page's block elements, its blocks of text, and each block's element. Inline elements only mark text."""
    root = Node("#page")
    stack = [root]
    blocks: list[str] = []
    owners: list[Node] = []
    held: list[str] = []
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            stack[-1].texts.append(len(blocks))
            blocks.append(text)
            owners.append(stack[-1])

    def close(tags, scope=()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                for node in stack[k:]:
                    open_tags[node.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    at = 0
    while True:
        found = TOKEN.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text:
            held.append(entities.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        ends, tag, attributes = found.groups()
        tag = (tag or "").lower()
        if not tag or tag in INLINE:
            continue
        if held:
            flush()
        if ends:
            if open_tags[tag] > 0:
                close((tag,))
            continue
        if attributes.endswith("/>") and (tag == "svg" or open_tags["svg"] > 0):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            if tag == "xmp":
                held.append(source[at : end.start() if end else len(source)])
                flush()
            at = end.end() if end else len(source)
            continue
        if open_tags["p"] > 0 and tag in CLOSES_P:
            close(("p",), SCOPE)
        if tag in SAME_KIND:
            close(SAME_KIND[tag], SCOPE)
        if tag in VOID:
            continue
        around, parent = stack[-1], stack[min(len(stack) - 1, DEEPEST)]
        hidden, named, main = marks(tag, attributes, around.main)
        # At the greatest depth the tree's parent doesn't carry what the elements between say.
        if parent is not around:
            named = max(named, around.named)
        node = Node(tag, parent, around.hidden or hidden, named, around.main or main)
        parent.children.append(node)
        stack.append(node)
        open_tags[tag] += 1
    if held:
        flush()
    set_shapes(root)
    return root, blocks, owners


def pair_all(a: Node, b: Node, pairs: list[tuple[Node, Node]]) -> int:
    """Pair up two elements of the same shape with all below them."""
    begin = len(pairs)
    todo = [(a, b)]
    while todo:
        u, v = todo.pop()
        pairs.append((u, v))
        todo.extend(zip(u.children, v.children, strict=True))
    return len(pairs) - begin


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]], known: dict[tuple[int, int], int] | None = None) -> int:
    """Simple tree matching of two elements with equal tags: the most nodes that pair up in order and depth, put in `pairs`.

    `known` has the sizes of matchings by the two elements' shapes.
    """
    known = {} if known is None else known
    pairs.append((a, b))
    x, y = a.children, b.children
    size, begin, end = 1, 0, 0
    # Elements of the same shape at the ends of the lists pair off; no other pairing has more nodes.
    while begin < len(x) and begin < len(y) and x[begin].shape == y[begin].shape:
        size += pair_all(x[begin], y[begin], pairs)
        begin += 1
    while end < len(x) - begin and end < len(y) - begin and x[-1 - end].shape == y[-1 - end].shape:
        size += pair_all(x[-1 - end], y[-1 - end], pairs)
        end += 1
    x, y = x[begin : len(x) - end], y[begin : len(y) - end]
    if not x or not y:
        return size
    if len(x) * len(y) > WIDE:
        return size + match_wide(x, y, pairs, known)
    best = [[0] * (len(y) + 1)]
    for u in x:
        above, row = best[-1], [0]
        for j, v in enumerate(y):
            w = 0
            if u.tag == v.tag:
                key = u.shape, v.shape
                w = known.get(key, 0)
                if not w:
                    w = known[key] = match(u, v, [], known)
            row.append(max(above[j + 1], row[j], above[j] + w))
        best.append(row)
    i, j = len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            match(x[i], y[j], pairs, known)
    return size + best[-1][-1]


def match_wide(x: list[Node], y: list[Node], pairs: list[tuple[Node, Node]], known: dict[tuple[int, int], int]) -> int:
    """`match` of two long lists of elements, one row of the table at a time.

    Each k-th row is kept, k about the root of their number, and the rows between two of them are
    made again on the way back. The work is the product of the lists' lengths in numpy and that of
    their numbers of shapes in Python.
    """
    kinds = {v.shape: v for v in y}
    order = {shape: k for k, shape in enumerate(kinds)}
    of_y = np.array([order[v.shape] for v in y])
    weights: dict[int, np.ndarray] = {}

    def weight(u: Node) -> np.ndarray:
        if u.shape not in weights:
            for shape, v in kinds.items():
                if u.tag == v.tag and not known.get((u.shape, shape)):
                    known[u.shape, shape] = match(u, v, [], known)
            weights[u.shape] = np.array([known.get((u.shape, shape), 0) if v.tag == u.tag else 0 for shape, v in kinds.items()], np.int32)
        return weights[u.shape][of_y]

    def rows(begin: int, end: int, row: np.ndarray) -> Iterator[np.ndarray]:
        for u in x[begin:end]:
            row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight(u)))]).astype(np.int32)
            yield row

    step = isqrt(len(x)) + 1
    kept = [np.zeros(len(y) + 1, np.int32)]
    for begin in range(0, len(x), step):
        *_, last = rows(begin, min(begin + step, len(x)), kept[-1])
        kept.append(last)
    size, j = int(kept[-1][-1]), len(y)
    for k in range(len(kept) - 2, -1, -1):
        begin = k * step
        block = [kept[k], *rows(begin, min(begin + step, len(x)), kept[k])]
        i = len(block) - 1
        while i and j:
            if block[i][j] == block[i - 1][j]:
                i -= 1
            elif block[i][j] == block[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                match(x[begin + i], y[j], pairs, known)
    return size


def chars_below(root: Node, blocks: list[str]) -> dict[int, int]:
    """Characters of the shown text in each element and below it, by the element's identity."""
    nodes, k = [root], 0
    while k < len(nodes):
        nodes.extend(nodes[k].children)
        k += 1
    total: dict[int, int] = {}
    for node in reversed(nodes):
        own = 0 if node.hidden else sum(len(blocks[t]) for t in node.texts)
        total[id(node)] = own + sum(total[id(c)] for c in node.children)
    return total


def furniture(root: Node, blocks: list[str], owners: list[Node], top: Node | None = None) -> list[bool]:
    """For each block whether it is hidden, or in an element named as furniture below `top`.

    A doubtful name doesn't count on an element that holds most of the text under `top`.
    """
    top = top or root
    known: dict[int, bool] = {}
    chars: dict[int, int] = {}

    def holds_most(node: Node) -> bool:
        chars.update(chars or chars_below(root, blocks))
        return chars[id(node)] >= MOST * chars[id(top)]

    def gone(node: Node) -> bool:
        path = []
        while node is not top and node.parent is not None and id(node) not in known:
            path.append(node)
            node = node.parent
        answer = known.get(id(node), False) if node is not top else False
        for node in reversed(path):
            answer = answer or node.named == 2 or node.named == 1 and not holds_most(node)
            known[id(node)] = answer
        return answer

    return [node.hidden or gone(node) for node in owners]


def lineage(node: Node | None) -> Iterator[Node]:
    """An element and those around it."""
    while node is not None:
        yield node
        node = node.parent


def under(node: Node, top: Node) -> bool:
    return any(x is top for x in lineage(node))


def page_text(owners: list[Node], gone: list[bool], template: set[int], top: Node | None = None) -> list[int]:
    """The blocks of a page's main text: those of the marked article if there is one, but none that is `gone` or template.

    With `top`, the element that the host's wrapper says holds the content, only what is below it.
    """
    own = [k for k, node in enumerate(owners) if not gone[k] and k not in template and (top is None or under(node, top))]
    return [k for k in own if owners[k].main] or own


class Pivot:
    """A pivot's tree with its elements numbered."""

    def __init__(self, source: str) -> None:
        self.root = parse(source)[0]
        self.nodes: list[Node] = []
        todo = [self.root]
        while todo:
            node = todo.pop()
            self.nodes.append(node)
            todo.extend(node.children)
        self.number = {id(node): k for k, node in enumerate(self.nodes)}

    def align(self, page: Node) -> dict[int, tuple[int, Node, Node]]:
        """For each of a page's elements that has one, by identity, the number of the pivot's element, this, and itself."""
        pairs: list[tuple[Node, Node]] = []
        match(page, self.root, pairs)
        return {id(u): (self.number[id(v)], v, u) for u, v in pairs}

    def places(self, owners: list[Node], ranks: list[int], paired: dict[int, tuple[int, Node, Node]]) -> Iterator[tuple[int, int]]:
        """The slot (element, rank) of each of an aligned page's blocks; rank -1 where only an element around it is the pivot's."""
        for owner, rank in zip(owners, ranks, strict=True):
            found = paired.get(id(owner))
            if found is not None and rank < len(found[1].texts):
                yield found[0], rank
                continue
            while found is None and owner.parent is not None:
                owner = owner.parent
                found = paired.get(id(owner))
            yield found[0] if found else 0, -1

    def content(self, mass: dict[int, float]) -> Node | None:
        """The deepest element that holds most of the varying text, the marked article around it if there is one.

        None where the text isn't below any single element of the body. A heading that varies belongs to the content.
        """
        below = [0.0] * len(self.nodes)
        headed = [False] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            node = self.nodes[k]
            below[k] += mass.get(k, 0.0)
            headed[k] |= node.tag == "h1" and below[k] > 0
            if node.parent is not None:
                up = self.number[id(node.parent)]
                below[up] += below[k]
                headed[up] |= headed[k]
        at = self.root
        while below[self.number[id(at)]] > 0:
            ranked = sorted(at.children, key=lambda c: -below[self.number[id(c)]])
            if not ranked or ranked[0].tag in LEAVES or below[self.number[id(ranked[0])]] < DESCENT * below[self.number[id(at)]]:
                break
            if any(headed[self.number[id(c)]] for c in ranked[1:]):
                break
            at = ranked[0]
        for node in lineage(at):
            if node.main:
                at = node
        return None if at.tag in ("#page", "html", "body") else at


#: Kinds of a wrapper's rows: an element's varying text, a template slot, a constant text, and one so constant that it is none of the content.
MASS, SLOT, TEXT, STRICT = range(4)


class Wrapper:
    """A host's wrapper: what its pages have in common with each pivot, and where in it the content stands."""

    def __init__(self, pivots: list[str], rows: list[dict]) -> None:
        self.pivots = [Pivot(p) for p in pivots]
        mass: list[dict[int, float]] = [{} for _ in pivots]
        self.slots: list[set[tuple]] = [set() for _ in pivots]
        self.strict: list[set[tuple]] = [set() for _ in pivots]
        for r in rows or ():
            if r["kind"] == MASS:
                mass[r["pivot"]][r["elem"]] = r["mass"]
            elif r["kind"] == SLOT:
                self.slots[r["pivot"]].add((r["elem"], r["rank"]))
            else:
                (self.strict if r["kind"] == STRICT else self.slots)[r["pivot"]].add((r["elem"], r["rank"], r["text"]))
        self.contents = [p.content(m) for p, m in zip(self.pivots, mass, strict=True)]

    def extract(self, root: Node, blocks: list[str], owners: list[Node]) -> list[int]:
        top = None
        paired = [pivot.align(root) for pivot in self.pivots]
        for pairs, content in zip(paired, self.contents, strict=True):
            if top is None and content is not None:
                top = next((u for _, v, u in pairs.values() if v is content), None)
        template: set[int] = set()
        rank_of, digests = ranks(owners), [digest(x) for x in blocks]
        for pivot, pairs, slots, strict in zip(self.pivots, paired, self.slots, self.strict, strict=True):
            if strict or slots and top is None:
                for k, place in enumerate(pivot.places(owners, rank_of, pairs)):
                    text = (*place, digests[k])
                    if text in strict or top is None and not owners[k].main and (place in slots or text in slots):
                        template.add(k)
        kept = page_text(owners, furniture(root, blocks, owners, top), template, top)
        return kept or page_text(owners, furniture(root, blocks, owners), set())


def ranks(owners: list[Node]) -> list[int]:
    """Each block's rank among the blocks of its element."""
    return [bisect_left(node.texts, k) for k, node in enumerate(owners)]


def digest(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - 2**63


def signature(blocks: list[str], shingle: int = 5) -> int:
    """A hash of the least shingle hashes of a text's two longest blocks, which copies share and near copies for the most part."""
    import xxhash

    least = []
    for block in sorted(blocks, key=len)[-2:]:
        words = block.split()
        runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
        least.append(min(map(xxhash.xxh3_64_intdigest, map(" ".join, runs))))
    return digest(str(least))


class Parsed:
    """What tasks made of the hosts met lately."""

    def __init__(self, most: int = 100) -> None:
        self.known, self.most = {}, most

    def get(self, host: str, make):
        if host not in self.known:
            if len(self.known) >= self.most:
                for old in list(islice(self.known, self.most // 2)):
                    del self.known[old]
            self.known[host] = make()
        return self.known[host]


def with_pivots(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html, host) with pivots, the html of two pages of the host that are at most twice as long as its mean."""
    named = pages.where("host <> '' and html is not null")
    length, key = F.octet_length("html"), F.xxhash64("html")
    mean = cut(named.groupBy("host").agg(F.avg(length).alias("mean")).withColumnRenamed("host", "mean_host"))
    small = lambda df: F.broadcast(df) if df.count() <= 1_000_000 else df
    usual = named.join(small(mean), F.col("host") == F.col("mean_host")).where(length <= 2 * F.col("mean"))
    ends = cut(usual.groupBy("host").agg(F.min(key).alias("least"), F.max(key).alias("most")).withColumnRenamed("host", "end_host"))
    found = named.join(small(ends), F.col("host") == F.col("end_host")).where(key.isin(F.col("least"), F.col("most")))
    chosen = cut(found.groupBy("host", key.alias("k")).agg(F.min("html").alias("p")).groupBy("host").agg(F.sort_array(F.collect_set("p")).alias("pivots")).withColumnRenamed("host", "pivot_host"))
    size = chosen.agg(F.sum(F.octet_length(F.concat_ws("", "pivots")))).first()[0] or 0
    return pages.join(F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen, F.col("host") == F.col("pivot_host"), "left")


def wrapper_rows(aligned: DataFrame) -> DataFrame:
    """Rows (host, wrapper): per host and pivot, the varying text of each element, the template slots and the constant texts.

    Every page is aligned with its host's pivots. A slot's text counts once for each distinct
    signature of the main texts it comes with, so copies of a page do not turn its article into
    template. All counts are grouped sums over all pages; a host's wrapper has a few rows for each
    element of its pivots.
    """

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = Parsed()
        for batch in batches:
            rows = []
            for i, (host, html) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)):
                pivots = parsed.get(host, lambda i=i: [Pivot(p) for p in batch.column(2)[i].as_py()])
                root, blocks, owners = parse(html or "")
                named = furniture(root, blocks, owners)
                page = signature([blocks[k] for k in page_text(owners, named, set())])
                rank_of, digests = ranks(owners), [digest(x) for x in blocks]
                masses = [len(x) * (NAMED_WEIGHT if out else MAIN_WEIGHT if owner.main else 1.0) for x, out, owner in zip(blocks, named, owners, strict=True)]
                for j, pivot in enumerate(pivots):
                    rows.append((host, j, -1, 0, 0, page, 0.0))
                    loose: Counter[int] = Counter()
                    for (elem, rank), text, mass, owner in zip(pivot.places(owners, rank_of, pivot.align(root)), digests, masses, owners, strict=True):
                        if rank < 0 and not owner.hidden:
                            loose[elem] += mass
                        elif not owner.hidden:
                            rows.append((host, j, elem, rank, text, page, mass))
                    # Text without a slot counts as varying: it goes by its page.
                    rows += [(host, j, elem, -1, page, page, mass) for elem, mass in loose.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "pivot", "elem", "rank", "text", "page", "mass"])

    seen = aligned.where("pivots is not null").select("host", "html", "pivots").mapInArrow(observe, "host string, pivot int, elem int, rank int, text long, page long, mass double")
    slot = ["host", "pivot", "elem", "rank"]
    once = seen.groupBy(*slot, "text", "page").agg(F.max("mass").alias("mass"))
    counted = cut(once.groupBy(*slot, "text").agg(F.count("*").alias("n"), F.max("mass").alias("mass")))
    pages = counted.where("elem = -1").select(F.col("host").alias("h"), F.col("pivot").alias("j"), F.col("n").alias("pages")).where("pages > 1")
    known = counted.where("elem >= 0").join(pages, (F.col("host") == F.col("h")) & (F.col("pivot") == F.col("j")))
    row = lambda kind, elem="elem", rank=F.lit(-1), text=F.lit(0), mass=F.lit(0.0): F.struct(F.col("pivot"), F.col(elem), rank.cast("int").alias("rank"), F.lit(kind).alias("kind"), text.cast("long").alias("text"), mass.cast("double").alias("mass"))
    masses = known.groupBy("host", "pivot", "elem").agg(F.sum(F.when(F.col("n") == 1, F.col("mass"))).alias("mass")).where("mass > 0")
    again = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    slots = known.where("rank >= 0").groupBy(*slot).agg(F.sum("n").alias("all"), again.alias("again")).where((F.col("again") >= RECURRING[1]) & (F.col("again") > RECURRING[0] * F.col("all")))
    constant = lambda inside: (F.col("n") >= CONSTANT[inside][1]) & (F.col("n") >= CONSTANT[inside][0] * F.col("pages"))
    texts = known.where("rank >= 0").where(constant(False))
    kinds = F.array(F.lit(TEXT), F.lit(STRICT))
    texts = texts.withColumn("kind", F.explode(F.when(constant(True), kinds).otherwise(F.array(F.lit(TEXT)))))
    every = masses.select("host", row(MASS, mass=F.col("mass")).alias("w")).union(slots.select("host", row(SLOT, rank=F.col("rank")).alias("w")))
    every = every.union(texts.select("host", F.struct("pivot", "elem", "rank", "kind", "text", F.lit(0.0).alias("mass")).alias("w")))
    return every.groupBy("host").agg(F.collect_list("w").alias("wrapper"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of `pages`: the main text of the whole page.

    A host's wrapper comes from aligning its pages with two pivots by simple tree matching. Texts
    that recur in a slot on pages that differ are template; what varies is weighed by the element
    it stands in, and the deepest element that holds most of it is where the host's pages have
    their content. A page's text is what stands below the element that aligns with that one. Names
    and tags are a prior: they weigh varying text, they leave out menus, notices, adverts, forms or
    comments inside the content, and on a page without a wrapper (no host, alone on it, or unlike
    the pivots) they decide, save doubtful ones on an element with most of the page's text.

    Null html is an empty page. A long page is parsed whole, at any depth. Repeated rows each give a
    row; equal pages count once in the wrapper. Columns other than the three named play no part,
    whatever their names. An empty table gives an empty result. Pages are not grouped by host in
    any task: counts are grouped sums, and wrappers go back to the pages by a join.
    """
    small_batches(pages.sparkSession, 200)
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/:?#]+)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    aligned = with_pivots(rows)
    wrappers = cut(wrapper_rows(aligned).withColumnRenamed("host", "wrapper_host"))
    small = wrappers.agg(F.sum(F.size("wrapper"))).first()[0] or 0
    side = F.broadcast(wrappers) if 64 * small <= BROADCAST_BYTES else wrappers
    joined = aligned.join(side, F.col("host") == F.col("wrapper_host"), "left").select("page_id", "url", "html", "host", "pivots", "wrapper")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = Parsed()
        for batch in batches:
            texts = []
            wrapped = batch.column(5).is_valid().to_pylist()
            for i, (html, host) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True)):
                root, blocks, owners = parse(html or "")
                if wrapped[i]:
                    kept = parsed.get(host, lambda i=i: Wrapper(batch.column(4)[i].as_py(), batch.column(5)[i].as_py())).extract(root, blocks, owners)
                else:
                    kept = page_text(owners, furniture(root, blocks, owners), set())
                texts.append(" ".join(blocks[k] for k in kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"))
