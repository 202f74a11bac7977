"""HTML extraction by site style trees: what a site's pages have alike is no article.

The block elements of a host's pages are merged into one tree (Yi, Liu and Li's
style tree): of every node the layouts are counted that pages give it, of every
leaf the words and link targets.  A node whose layouts and contents vary from
page to page matters; one that always looks alike, or says the same, doesn't.
Elements that HTML itself sets apart from the content (NEVER, ROLES, hidden
ones) are no part of a page's text and aren't in the tree.  Names of classes and
ids, headings, and a place outside a page's article element are a prior: they
lower or raise what was measured, and decide nothing where nothing was.
"""

from __future__ import annotations

import functools
import html
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import apart, by_value, checkpoint
from lexloom.llm.hashing import mix
from lexloom.operators.postings import packed, unpacked

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
NEVER = frozenset("aside button canvas dialog embed fieldset footer form frame head iframe input label map menu nav noembed noframes noscript object optgroup option script search select style svg template textarea title video audio xmp".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class and id attributes that name something beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus disclaimer dropdown footer form gdpr login menu modal nav navbar navigation navmenu newsletter notice notification overlay pager pagination popup privacy promo promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets".split()
)
HEADS = frozenset(("header", "masthead", "topbar"))
# Elements and words that name a part of the article.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FAVOURED = frozenset("article articlebody body content entry headline intro lead post story subtitle text title".split())
#: What an opening tag closes, up to the nearest of these containers.
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^>]*+)>|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[^a-z0-9]+")
_MASK = (1 << 63) - 1
#: What a name or a place that points away from the article leaves of a branch's importance, and what one that points to it makes of it.
PRIOR, FAVOUR = 0.25, 2.0
#: Share of a node's importance that is its contents', the rest being its layouts'.
GAMMA = 0.5
#: Elements nested deeper than this belong to the tree's node at that depth.
DEPTH = 64
#: Values kept of a leaf's words: the least hash in each of so many parts of the hashes' range.
BINS = 16
#: A host with fewer different pages is judged with the pages of others that have its template; verdicts stand on so many pages at least.
LEAST_PAGES = 3
#: A branch goes whose importance, and that of all in it, is below this share of the site's best node.
BRANCH = 0.6
#: In an article, or a branch that matters, goes what says less new than this share of the site's mean; so does a repeated text elsewhere.
SAME = 0.2
#: Verdicts (8 bytes each) that are broadcast; more of them meet their pages host by host, so many pages at a time.
BROADCAST_VERDICTS, PAGES = 1_000_000, 500
#: Small hosts (8 bytes each) that are broadcast; more are joined.
BROADCAST_HOSTS = 1_000_000
#: What of its pages a task holds until it is packed: so many entries (a text, word, layout or ancestor of a page's node), and pages.
HELD, HELD_PAGES = 1 << 20, 1 << 15
#: Bytes of a site's pages whose entries are counted together at most; and those beyond which a site's entries are dealt out, to SPREAD tasks if that many bytes let it.
PART, LIGHT, SPREAD = 1 << 24, 1 << 20, 32
OUT, SOLID, LOW, TEXT, JUDGED = range(1, 6)
_OUTSIDE = 0x5BD1E9955BD1E995 & _MASK
_SCOPE = ("button", "td", "th", "table")


class Node:
    """A node of a page: its path in the site's tree, and what is known of it before the tree is."""

    __slots__ = ("tag", "path", "up", "depth", "never", "main", "prior", "block")

    def __init__(self, tag: str, path: int, up: Node | None, depth: int, never: bool, main: bool, prior: float, block: bool) -> None:
        self.tag, self.path, self.up, self.depth, self.never, self.main, self.prior, self.block = tag, path, up, depth, never, main, prior, block


class Block:
    """A text of a page, the block element it stands in, and the inline tags and link targets in it."""

    __slots__ = ("node", "text", "inline", "links", "leaf", "prior")

    def __init__(self, node: Node, text: str, inline: tuple[str, ...], links: tuple[str, ...]) -> None:
        self.node, self.text, self.inline, self.links, self.leaf, self.prior = node, text, inline, links, node.path, node.prior


def _mixed(*parts: object) -> int:
    """A hash that is the same in every process."""
    return hash_text("\x1f".join(map(str, parts)))


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) & _MASK


def _never(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    """Is an element set apart by HTML itself?"""
    if tag in NEVER or tag == "header" and not in_main or attrs.get("role", "").lower() in ROLES:
        return True
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I))


def _prior(tag: str, attrs: dict[str, str], in_main: bool) -> float:
    """What the element's name and its class and id say of it: PRIOR, 1 or FAVOUR."""
    if tag in ("body", "html") or tag in MAIN and not in_main and "comment" not in attrs.get("class", "").lower():
        return 1.0
    words = set(_PART.split(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    if words & BESIDE or not in_main and words & HEADS:
        return PRIOR
    return FAVOUR if tag in HEADINGS or words & FAVOURED else 1.0


def parse(page: str, known: dict) -> tuple[list[Block], dict[int, list[str]]]:
    """A page's text blocks in order, and the child tags of each tree node.

    Time is linear in the page's length: for every tag the places where it is
    open are at hand, so nothing is searched, and what a closing tag closes is
    closed once.
    """
    root = Node("", 0, None, 0, False, False, 1.0, True)
    stack = [root]
    places: dict[str, list[int]] = {}
    blocks: list[Block] = []
    children: dict[int, list[str]] = {}
    text: list[str] = []
    inline: list[str] = []
    links: list[str] = []
    owners = [root]  # the nearest block of every open element

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                blocks.append(Block(owners[-1], whole, tuple(inline), tuple(links)))
        inline.clear()
        links.clear()

    def innermost(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(k: int) -> None:
        for n in stack[k:]:
            places[n.tag].pop()
        del stack[k:], owners[k:]

    at, size = 0, len(page)
    last = page.rfind(">")
    while at < size:
        if at > last:  # no tag can end here
            if not stack[-1].never:
                text.append(page[at:])
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                if not stack[-1].never:
                    text.append(m[0])
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in VOID:
                continue
            k = innermost(tag)
            if k:
                if any(n.block for n in stack[k:]):
                    flush()
                cut(k)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCK
        if block:
            flush()
            k = innermost("p")
            if k > innermost(*_SCOPE):
                cut(k)
            if tag in _SAME:
                k = innermost(*(("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)))
                if k > innermost(*_SAME[tag]):
                    cut(k)
        if tag in VOID:
            continue
        parent, home = stack[-1], owners[-1]
        raw = m[3] or m[6] or ""
        key = (parent.path, parent.depth, tag, raw, parent.main, parent.never)
        made = known.get(key)
        if made is None:
            attrs = {a.lower(): v.strip("\"'") for a, v in _ATTR.findall(raw)} if raw.strip("/ \t\n") else {}
            never = parent.never or _never(tag, attrs, parent.main)
            deep = home.depth >= DEPTH
            own = (re.sub(r"\d+", "", attrs.get("id", "")), *sorted(attrs.get("class", "").split()))
            prior = _prior(tag, attrs, parent.main)
            # An inline element has no branch that could be judged: its name alone sets it apart.
            made = (home.path if deep else _mixed(home.path, tag, *own), never or prior < 1 and not block, parent.main or tag in MAIN, prior if block and not deep else 1.0)
            if len(known) < 100_000:
                known[key] = made
        path, never, main, prior = made
        if block:
            node = Node(tag, path, home.up if home.depth >= DEPTH else home, min(DEPTH, home.depth + 1), never, main, PRIOR if home.prior < 1 else prior, True)
            children.setdefault(home.path, []).append(tag)
        else:
            node = Node(tag, home.path, home.up, home.depth, never, main, home.prior, False)
            if not never:
                inline.append(tag)
                if tag == "a":
                    links.append(raw)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            if not never:
                text.append(page[at : end.start() if end else size])
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else size
        elif not raw.rstrip().endswith("/") or block:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
            owners.append(node if block else home)
    flush()
    if any(b.node.main for b in blocks):
        for b in blocks:
            if not b.node.main:
                b.leaf, b.prior = b.node.path ^ _OUTSIDE, PRIOR * min(1.0, b.prior)
    return blocks, children


def above(node: Node) -> Iterator[Node]:
    """The block and the blocks around it, without the page itself."""
    while node.up is not None:
        yield node
        node = node.up


def sketch(words: set[str]) -> list[int]:
    """The least hash of a set's words in each of BINS parts of their range: sets share as many as they share words."""
    import xxhash

    least: dict[int, int] = {}
    for w in words:
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & _MASK
        b = h % BINS
        if h < least.get(b, _MASK + 1):
            least[b] = h
    return list(least.values())


def hashed(words: Iterable[str]) -> list[int]:
    """A hash of every word."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & _MASK for w in words]


def template(blocks: list[Block]) -> int:
    """A number for the page's outline: which parts with text its body has."""
    tops = set()
    for b in blocks:
        chain = [n.path for n in above(b.node) if n.tag not in ("html", "body")]
        tops.add(chain[-1] if chain else 0)
    return _mixed("template", *sorted(tops))


def tree_rows(page: str, known: dict) -> tuple[int, int, dict[int, tuple[float, Counter, int, set[int], set[str]]]]:
    """A page's template, its copy, and of each of its nodes: (prior, texts of a leaf, layout, the nodes above it, words and link targets of a leaf).

    The layout is that of the node's child blocks; of a leaf its inline tags, and how many texts.
    The copy is a number that tells pages of different texts apart.
    """
    blocks, children = parse(page, known)
    found: dict[int, Counter] = {}
    prior: dict[int, float] = {}
    layout: dict[int, list] = {}
    words: dict[int, set[str]] = {}
    up: dict[int, set[int]] = {}
    for b in blocks:
        prior[b.leaf] = b.prior
        layout.setdefault(b.leaf, []).extend((*b.inline, "/"))
        new = b.leaf not in found
        found.setdefault(b.leaf, Counter())[hash_text(b.text)] += 1
        own = words.setdefault(b.leaf, set())
        own.update(b.text.split())
        own.update("a " + x for x in b.links)
        if not new:
            continue
        lower = [b.leaf]
        for n in above(b.node):
            prior.setdefault(n.path, n.prior)
            if n.path != b.leaf:
                for x in lower:
                    up.setdefault(x, set()).add(n.path)
                lower.append(n.path)
    # Adverts may differ on copies of a page; where there is nothing else, they are what it is.
    copy = _mixed(*sorted([f for p, own in found.items() if prior[p] >= 1 for f in own] or [f for own in found.values() for f in own])) | 1
    return template(blocks), copy, {p: (prior[p], found.get(p, Counter()), _mixed(*children.get(p, []), "", *layout.get(p, [])), up.get(p, set()), words.get(p, set())) for p in prior}


class Tree:
    """What a task's pages say of their sites' trees, each word and layout once with the pages that have it.

    Entries are of a kind: 0, a leaf's text, with how often the page has it; 1, a
    node's layout; 2, an ancestor of a node, of copy 0, as it holds for any page;
    3, a leaf's words and link targets, all of them if `whole`, else their sketch.
    """

    def __init__(self, whole: bool, parts: dict[int, int]) -> None:
        self.whole, self.parts = whole, parts
        self.clear()

    def clear(self) -> None:
        self.groups: dict[tuple[int, int], int] = {}
        self.priors: list[float] = []
        self.entries: dict = {}
        self.copies = {0: 0}
        self.entry, self.times = array("q"), array("q")
        self.runs: tuple[array, array, array] = array("q"), array("q"), array("q")  # group, copy, how many entries

    def full(self) -> bool:
        return len(self.entry) >= HELD or len(self.copies) > HELD_PAGES

    def add(self, site: int, copy: int, nodes: dict) -> None:
        ids = self.entries
        c = self.copies.setdefault(copy, len(self.copies))
        for path, (prior, texts, layout, up, words) in nodes.items():
            g = self.groups.setdefault((site, path), len(self.groups))
            if g == len(self.priors):
                self.priors.append(prior)
            self.priors[g] = min(prior, self.priors[g])
            times = list(texts.values())
            keys = [*((0, f) for f in texts), (1, layout), *(words if self.whole else sketch(words))]
            for at, own in ((c, keys), (0, [(2, a) for a in up])):
                self.entry.extend([ids.setdefault(k, len(ids)) for k in own])
                for column, value in zip(self.runs, (g, at, len(own))):
                    column.append(value)
            self.times.extend(times)
            self.times.extend([1] * (len(keys) + len(up) - len(times)))

    def packed(self) -> pa.RecordBatch:
        words = iter(hashed(k for k in self.entries if isinstance(k, str)))
        keys = [k if isinstance(k, tuple) else (3, next(words) if isinstance(k, str) else k) for k in self.entries]
        kinds, features = np.array([k for k, _ in keys], np.uint8), np.array([f for _, f in keys], np.int64)
        group, copy, many = (np.array(x, np.int64) for x in self.runs)
        entry = np.array(self.entry, np.int64)
        # Entries of a large site go to its parts by their feature.
        parts = np.array([self.parts.get(site, 1) for site, _ in self.groups], np.uint64)
        group = np.repeat(group, many)
        part = (mix(features.view(np.uint64))[entry] % parts[group]).astype(np.int64)
        there, group = np.unique(group * int(parts.max()) + part, return_inverse=True)
        of, part = np.divmod(there, int(parts.max()))
        cols = pack(group, entry, np.repeat(copy, many), np.array(self.times, np.int64), kinds, features, np.fromiter(self.copies, np.int64), len(there))
        site, path = np.array(list(self.groups), np.int64).reshape(-1, 2)[of].T
        return pa.RecordBatch.from_arrays([pa.array(site), pa.array(path), pa.array(part), pa.array(np.array(self.priors)[of]), *cols], [*_KEYS, *_PACKED])


_KEYS = ("site", "path", "part", "prior")
#: A packed row's columns: its entries' kinds, features (hashes), numbers of pages; these pages' places among the row's copies; of texts, how often; and the copies.
_PACKED = ("kinds", "features", "counts", "gaps", "times", "copies")
_TREE = "site long, path long, part long, prior double, kinds binary, features binary, counts binary, gaps binary, times binary, copies binary"


def pack(group: np.ndarray, entry: np.ndarray, copy: np.ndarray, n: np.ndarray, kinds: np.ndarray, features: np.ndarray, copies: np.ndarray, groups: int) -> list[pa.Array]:
    """The _PACKED columns of rows 0 to groups - 1: for each entry of a group its copies, and the largest n of each."""
    order = np.lexsort((n, copy, entry, group))
    group, entry, copy, n = (x[order] for x in (group, entry, copy, n))
    own = (group[1:] != group[:-1]) | (entry[1:] != entry[:-1])
    last = np.append(own | (copy[1:] != copy[:-1]), True)
    group, entry, copy, n = (x[last] for x in (group, entry, copy, n))
    at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (entry[1:] != entry[:-1])))
    every = np.arange(groups + 1)
    pairs, local = np.unique(group * len(copies) + copy, return_inverse=True)
    first = np.searchsorted(pairs // len(copies), every)
    local = local - first[group]
    gap = np.diff(local, prepend=0)
    gap[at] = local[at]
    kind, rows, postings = kinds[entry[at]], np.searchsorted(group[at], every), np.searchsorted(group, every)
    text = kinds[entry] == 0
    texts = np.searchsorted(group[text], every)

    def binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
        data = np.ascontiguousarray(data).view(np.uint8)
        return pa.Array.from_buffers(pa.large_binary(), groups, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())

    def integers(v: np.ndarray, edges: np.ndarray) -> pa.Array:
        data, end = packed(v)
        return binary(data, np.concatenate(([0], end))[edges])

    counts = np.diff(np.append(at, len(group)))
    return [binary(kind, rows), binary(features[entry[at]], 8 * rows), integers(counts, rows), integers(gap, postings), integers(n[text], texts), binary(copies[pairs % len(copies)], 8 * first)]


def unpack(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row, kind, feature) of every entry, and (entry, copy, n) of its pages."""

    def held(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = rows[name]
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8), edges - edges[0]

    kind, edges = held("kinds")
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    feature, count, gap = held("features")[0].copy().view(np.int64), unpacked(held("counts")[0]), unpacked(held("gaps")[0])
    entry, first = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
    local = np.cumsum(gap)
    local -= np.repeat(local[first] - gap[first], count)
    copies, edges = held("copies")
    n = np.ones(len(entry), np.int64)
    n[kind[entry] == 0] = unpacked(held("times")[0])
    return row, kind, feature, entry, copies.copy().view(np.int64)[edges[row[entry]] // 8 + local], n


def _stats(whole: bool, parts: dict[int, int]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        tree = Tree(whole, parts)
        for batch in batches:
            for host, small, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                outline, copy, nodes = tree_rows(page.as_py() or "", known)
                tree.add(outline if small else host, copy, nodes)
                if tree.full():
                    yield tree.packed()
                    tree.clear()
        if tree.groups:
            yield tree.packed()

    return run


def tree_parts(pages: DataFrame, least_pages: int = LEAST_PAGES, whole: bool = False) -> DataFrame:
    """The pages' parts of their sites' trees, packed, see Tree; a site is a host, or what small hosts' pages of one template are.

    Sites of more than LIGHT bytes have several parts, a number for each such site, which the tasks are told.
    """
    hosts = checkpoint(_hosts(pages))
    small = hosts.where(F.col("m") < least_pages).select(F.col("host").alias("small"))
    large = hosts.where(F.col("m") >= least_pages)
    pooled, n_small = hosts.join(small, F.col("host") == F.col("small")).agg(F.sum("bytes"), F.count(F.lit(1))).first()
    if (pooled or 0) > PART:  # which of these are of one template only parsing tells
        large = large.select("host", "bytes").unionByName(_templates(pages, small).groupBy(F.col("template").alias("host")).agg(F.sum("bytes").alias("bytes")))
    parts = {r["host"]: r["parts"] for r in large.select("host", F.greatest(F.ceil(F.col("bytes") / PART), F.least(F.lit(SPREAD), F.ceil(F.col("bytes") / LIGHT))).alias("parts")).where("parts > 1").toLocalIterator()}
    if n_small <= BROADCAST_HOSTS:
        small = F.broadcast(small)
    rows = pages.join(small, apart("host") == apart("small"), "left")
    return rows.select("host", F.col("small").isNotNull().alias("small"), "html").mapInArrow(_stats(whole, parts), _TREE)


def _counted(rows: pa.Table) -> pa.Table:
    """A site's entries, or a part of them, over all copies: path, kind, k (copies that have it), feature, many (such entries), n, s (sums of n and n log n), prior.

    Texts that several copies have and ancestors are rows of their own; of layouts and words it is told how many have which k.
    """
    paths, where = np.unique(rows["path"].to_numpy(), return_inverse=True)
    prior = np.full(len(paths), np.inf)
    np.minimum.at(prior, where, rows["prior"].to_numpy())
    row, kind, feature, entry, copy, n = unpack(rows)
    path = where[row]
    order = np.lexsort((feature, kind, path))
    new = np.append(True, functools.reduce(np.logical_or, (x[order][1:] != x[order][:-1] for x in (path, kind, feature))))
    thing = np.empty(len(order), np.int64)
    thing[order] = np.cumsum(new) - 1
    path, kind, feature = (x[order[new]] for x in (path, kind, feature))
    copies, code = np.unique(copy, return_inverse=True)
    key = thing[entry] * len(copies) + code
    order = np.lexsort((n, key))
    key, n = key[order], n[order]
    last = np.append(key[1:] != key[:-1], True)
    of, n = key[last] // len(copies), n[last].astype(np.float64)
    k, total, s = (np.bincount(of, w, len(path)) for w in (None, n, n * np.log(n)))
    single = ((kind == 0) & (k > 1)) | (kind == 2)
    same, many = np.unique(np.stack((path, kind, k), 1)[(kind == 1) | (kind == 3)], axis=0, return_counts=True)
    cols = [np.concatenate(x) for x in ((path[single], same[:, 0]), (kind[single], same[:, 1]), (k[single], same[:, 2]))]
    ones = np.ones(int(single.sum()), np.int64)
    texts = pa.array(np.append(feature[single], same[:, 0]), mask=np.arange(len(cols[0])) >= len(ones))
    site = rows["site"][0].as_py()
    return pa.table(
        [pa.array(np.full(len(cols[0]), site)), pa.array(paths[cols[0]]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int64)), texts, pa.array(np.append(ones, many)), pa.array(np.append(total[single].astype(np.int64), same[:, 2])), pa.array(np.append(s[single], 0.0 * same[:, 2])), pa.array(prior[cols[0]])],
        names=["site", "path", "kind", "k", "feature", "many", "n", "s", "prior"],
    )


def _hosts(pages: DataFrame) -> DataFrame:
    """host, m (its different pages), bytes."""
    own = pages.groupBy("host", F.xxhash64("html").alias("page")).agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    return own.groupBy("host").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"))


def small_hosts(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Hosts of fewer different pages than that."""
    return _hosts(pages).where(F.col("m") < least_pages).select(F.col("host").alias("small"))


def _templates(pages: DataFrame, small: DataFrame) -> DataFrame:
    """host, template, bytes of these hosts' pages."""
    return pages.join(small, apart("host") == apart("small"), "left_semi").select("host", "html").mapInArrow(_outlines, "host long, template long, bytes long")


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        outlines = [template(parse(page.as_py() or "", known)[0]) for page in batch.column(1)]
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outlines, pa.int64()), sizes], ["host", "template", "bytes"])


def style_tree(pages: DataFrame, least_pages: int = LEAST_PAGES, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The merged trees of all sites: (nodes, texts).

    A site is a host, or the pages of small hosts that have one template.
    nodes: site, path, pages, prior, content, layout, measured, importance, site_content;
    texts: site, path, feature, pages, importance, site_content of those
    texts of leaves that several pages have.

    With m pages that have a leaf, a feature that k of them have in shares p has
    the importance 1 - (k / m) (-sum p log_m p): one of a single page has 1, one
    on all pages 0.  A node's content is the mean importance of the
    words and link targets below it (of all if `whole`, else of their sketches), its layout the entropy of its layouts in
    base m; measured is (1 - GAMMA) layout + GAMMA content, and importance is that times the
    prior, 1 at most.  site_content is the mean over all leaves of a site.  Pages of one
    site with equal texts are one page.
    """
    raw = tree_parts(pages, least_pages, whole)
    # What only one page has is counted, not kept: a site's templates and repeated texts are stored, not its pages.
    flat = checkpoint(raw.groupBy("site", "part").applyInArrow(_counted, "site long, path long, kind int, k long, feature long, many long, n long, s double, prior double"))
    kind, k, n = F.col("kind"), F.col("k").cast("double"), F.col("n").cast("double")
    entropy = F.when(k > 1, F.greatest(F.log(n) - F.col("s") / n, F.lit(0.0)))
    nodes = flat.groupBy("site", "path").agg(
        F.sum(F.when(kind == 1, k * F.col("many"))).alias("pages"),
        F.sum(F.when(kind == 1, k * F.log(k) * F.col("many"))).alias("same"),
        F.coalesce(F.sum(F.when(kind == 3, F.col("many"))), F.lit(0)).alias("features"),
        F.sum(F.when(kind == 3, entropy * k * F.col("many"))).alias("spread"),
        F.min("prior").alias("prior"),
        F.collect_set(F.when(kind == 2, F.col("feature"))).alias("above"),
    )
    base = F.log(F.greatest(F.col("pages"), F.lit(2.0)))
    nodes = checkpoint(nodes.withColumn("lost", F.coalesce(F.col("spread") / F.col("pages") / base, F.lit(0.0))))
    inner = nodes.select(F.col("site").alias("h"), F.explode("above").alias("up"), "lost", "features").groupBy("h", "up").agg(F.sum("lost").alias("below"), F.sum("features").alias("many"))
    whole = nodes.groupBy(F.col("site").alias("w")).agg((1 - F.sum("lost") / F.sum("features")).alias("site_content"))
    joined = nodes.join(inner, (nodes.site == inner.h) & (nodes.path == inner.up), "left").join(whole, F.col("site") == F.col("w"))
    content = 1 - (F.col("lost") + F.coalesce("below", F.lit(0.0))) / (F.col("features") + F.coalesce("many", F.lit(0)))
    layout = (F.log("pages") - F.col("same") / F.col("pages")) / base
    joined = joined.withColumn("content", content).withColumn("layout", layout).withColumn("measured", (1 - GAMMA) * F.col("layout") + GAMMA * F.col("content"))
    found = joined.select("site", "path", "pages", "prior", "content", "layout", "measured", F.least(F.col("measured") * F.col("prior"), F.lit(1.0)).alias("importance"), "site_content", "above")
    at = found.select(F.col("site").alias("h"), F.col("path").alias("p"), F.col("pages").alias("m"), "site_content")
    texts = flat.where((kind == 0) & (k > 1)).select("site", "path", "feature", "k", entropy.alias("entropy")).join(at, (F.col("site") == F.col("h")) & (F.col("path") == F.col("p")))
    importance = 1 - F.col("k") / F.col("m") * F.col("entropy") / F.log(F.greatest(F.col("m"), F.lit(2.0)))
    return found, texts.select("site", "path", "feature", F.col("m").alias("pages"), importance.alias("importance"), "site_content")


def verdicts(pages: DataFrame, least_pages: int = LEAST_PAGES, whole: bool = False) -> DataFrame:
    """site, path, feature, state: what the trees say of their nodes.

    OUT: the branch goes, its importance and that of all nodes in it being below
    BRANCH of the best node's; SOLID: it reaches that itself; LOW: what it
    holds is so alike that it goes even in an article (SAME); TEXT: so does this
    text of a leaf outside of one; JUDGED (path 0): the site has a tree.
    """
    nodes, texts = style_tree(pages, least_pages, whole)
    nodes = nodes.where(F.col("pages") >= least_pages)
    best = nodes.groupBy(F.col("site").alias("b")).agg(F.max("importance").alias("best"))
    top = nodes.select(F.col("site").alias("h"), F.explode("above").alias("up"), "importance").groupBy("h", "up").agg(F.max("importance").alias("inside"))
    judged = nodes.join(top, (nodes.site == top.h) & (nodes.path == top.up), "left").join(best, F.col("site") == F.col("b"))
    bar = BRANCH * F.col("best")
    states = F.array(
        F.when(F.greatest("importance", F.coalesce("inside", F.lit(0.0))) < bar, OUT), F.when(F.col("importance") >= bar, SOLID), F.when(F.col("content") < SAME * F.col("site_content"), LOW)
    )
    none = F.lit(0).cast("long")
    rows = judged.select("site", "path", none.alias("feature"), F.explode(states).alias("state")).where("state is not null")
    same = texts.where((F.col("pages") >= least_pages) & (F.col("importance") < SAME * F.col("site_content")))
    return rows.unionByName(same.select("site", "path", "feature", F.lit(TEXT).alias("state"))).unionByName(best.select(F.col("b").alias("site"), none.alias("path"), none.alias("feature"), F.lit(JUDGED).alias("state")))


class Verdicts:
    """Verdicts as sorted 64-bit keys, looked up for a page's nodes."""

    def __init__(self, site: np.ndarray, path: np.ndarray, feature: np.ndarray, state: np.ndarray) -> None:
        self.keys = np.unique(self.key(site, path, feature, state))

    @staticmethod
    def key(site, path, feature, state) -> np.ndarray:  # noqa: ANN001
        x = mix(np.asarray(site).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for part in (path, feature, state):
            x = mix(x ^ mix(np.asarray(part).astype(np.int64).view(np.uint64) + np.uint64(0xD6E8FEB86659FD93)))
        return x

    def of(self, site: int, blocks: list[Block]) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
        """What holds for a page: (path, state) of its nodes, (leaf, text) that go."""
        paths = {n.path for b in blocks for n in above(b.node)} | {b.leaf for b in blocks}
        nodes = [(p, s) for p in paths for s in (OUT, SOLID, LOW)]
        texts = list({(b.leaf, hash_text(b.text)) for b in blocks if not b.node.main})
        if not nodes:
            return set(), set()
        asked = [(p, 0, s) for p, s in nodes] + [(p, f, TEXT) for p, f in texts]
        cols = np.array(asked, np.int64).T
        keys = self.key(np.full(len(asked), site, np.int64), *cols)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        there = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return {x for x, y in zip(nodes, there) if y}, {x for x, y in zip(texts, there[len(nodes) :]) if y}

    def site(self, host: int, outline: int) -> int:
        key = self.key(np.array([host]), np.zeros(1), np.zeros(1), np.full(1, JUDGED))
        at = int(np.searchsorted(self.keys, key[0]))
        return host if at < len(self.keys) and self.keys[at] == key[0] else outline


def article(blocks: list[Block], states: set[tuple[int, int]], texts: set[tuple[int, int]]) -> list[Block]:
    """The blocks that the tree leaves.

    From the page down to a block, a branch goes if it is OUT; in an article or
    main element, or below a node that matters (SOLID), only if a name is
    against it or it is LOW.  Repeated texts go outside of articles.
    """
    known: dict[int, tuple[bool, bool]] = {}

    def seen(node: Node | None) -> tuple[bool, bool]:
        """(gone, inside)"""
        if node is None or node.up is None:
            return False, False
        if node.path not in known:
            gone, inside = seen(node.up)
            if not gone:
                gone = (node.path, LOW) in states and node.prior <= 1 if (inside or node.main) and node.prior >= 1 else (node.path, OUT) in states
            known[node.path] = gone, inside or (node.path, SOLID) in states
        return known[node.path]

    left = [b for b in blocks if not seen(b.node)[0] and (b.leaf == b.node.path or (b.leaf, OUT) not in states)]
    return [b for b in left if b.node.main or (b.leaf, hash_text(b.text)) not in texts] if texts else left


def page_text(page: str | None, host: int, found: Verdicts, known: dict) -> str:
    blocks, _ = parse(page or "", known)
    return "\n".join(b.text for b in article(blocks, *found.of(found.site(host, template(blocks)), blocks)))


def _extract(width: int, shared):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = [page_text(page.as_py(), host, shared.value, known) for host, page in zip(batch.column(width).to_pylist(), batch.column(width + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:width], "text", "n_chars"])

    return run


def _extract_group(width: int):  # noqa: ANN202
    def run(pages: pa.Table, rows: pa.Table) -> pa.Table:
        found, known = Verdicts(*(rows[c].to_numpy() for c in ("site", "path", "feature", "state"))), {}
        texts = [page_text(page.as_py(), host, found, known) for host, page in zip(pages["_host"].to_pylist(), pages["_html"])]
        return pa.table([*(pages.column(k) for k in range(width)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*pages.column_names[:width], "text", "n_chars"])

    return run


def html_extract(pages: DataFrame, least_pages: int = LEAST_PAGES, carry: tuple[str, ...] = ("page_id", "url"), broadcast: int = BROADCAST_VERDICTS, whole: bool = True) -> DataFrame:
    """The `carry` columns of pages, text and n_chars: the main text of every page.

    Each host's pages are merged into a style tree (nodes are paths of block
    elements with their classes and ids); pages of hosts with fewer than
    `least_pages` different ones are merged by template instead, over all such
    hosts.  From every page go the branches that matter little beside the
    site's best node (see verdicts and article): those whose layout and words
    are alike on its pages, and sooner if a name or the place outside the
    page's article speaks against them.  A branch named like a comment or an
    advert stays if nothing else varies more.  In an article only such names,
    and what says the same everywhere, count.  Where fewer than `least_pages`
    pages of a site have a node, nothing is known of it, and it stays.  Elements
    that HTML itself sets apart (menus, forms, asides, scripts) are no text.
    Character references are decoded, white space in a block becomes one space,
    and blocks are joined by one newline.

    Null or empty html gives an empty text, a null url the host ''; repeated
    rows each give the same; very long or deep pages take time in proportion to
    their length (elements nested deeper than DEPTH share the tree's node at
    that depth); an empty table gives an empty one, and columns of pages named
    like results are replaced.  Texts of equal importance are judged alike.

    Pages are parsed twice, in batches, and only hashes are shuffled in
    between, of all words (without `whole`, of a sketch of each leaf's): a task
    gives each once for many pages, with the pages' places, and what is counted
    together is a site, or a part of a large one's entries.  If small hosts have
    more than PART bytes, their pages are parsed once more; more than
    BROADCAST_HOSTS of them shuffle the pages themselves.  Verdicts
    are rows of a site and a path: counted first, up to `broadcast` of them are
    sent to all tasks as 8 bytes each; more of them meet their pages by host,
    a large host in groups of PAGES pages.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    own = pages.select(F.xxhash64(host).alias("host"), F.col("html").cast("string").alias("html"))
    found = checkpoint(verdicts(own, least_pages, whole))
    carry = tuple(c for c in carry if c not in ("text", "n_chars"))
    rows = pages.select(*carry, F.xxhash64(host).alias("_host"), F.col("html").cast("string").alias("_html"))
    schema = T.StructType([*rows.schema.fields[: len(carry)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    if found.limit(broadcast + 1).count() <= broadcast:
        cols = found.toArrow()
        shared = pages.sparkSession.sparkContext.broadcast(Verdicts(*(cols[c].to_numpy() for c in ("site", "path", "feature", "state"))))
        return rows.mapInArrow(_extract(len(carry), shared), schema)
    # A small host's pages need the verdicts of their templates, which only parsing tells.
    homes = _templates(own, small_hosts(own, least_pages)).select("host", "template").distinct()
    by_host = found.withColumn("_h", F.col("site")).unionByName(homes.join(found, homes.template == found.site).select(*found.columns, F.col("host").alias("_h")))
    sizes = rows.groupBy(F.col("_host").alias("_g")).agg(F.ceil(F.count(F.lit(1)) / PAGES).alias("_parts"))
    dealt = rows.join(sizes, apart("_host") == apart("_g")).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).drop("_g", "_parts")
    met = by_host.join(sizes, F.col("_h") == F.col("_g")).select(F.col("_g").alias("_h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_p"), "site", "path", "feature", "state")
    return dealt.groupBy("_host", "_part").cogroup(met.groupBy("_h", "_p")).applyInArrow(_extract_group(len(carry)), schema)


by_value(__name__)
