"""Main text of web pages by inferred wrappers: union-free regular expressions over the pages of a host.

A page is a stream of block tags and texts, nested as the tags are. Two streams with equal tags are aligned pairwise; at a
mismatch, repetitions on either side become repeated groups, what is left on one side only becomes optional, and texts that
differ become slots. The expression of a host is the alignment of all its pages. Tasks align the pages that they read, so only
expressions are shuffled, never pages; expressions align like pages, so a host with a third of all pages costs no more than
one expression a task. On the whole expression it is decided which nodes hold the article; pages are then read along it.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_batches, written

#: Nodes of expressions that a task holds before it passes them on.
HELD_NODES = 200_000
#: Children of a node beyond which their order is given up: each tag stands once, optional and repeated.
MOST_CHILDREN = 48
#: Blocks in a repeated group, and levels of nesting that are told apart, at most.
LONGEST_GROUP, DEEPEST = 6, 100
#: A text that is the same on so many pages of a host, and on all that have its slot, is the template's.
TEMPLATE_PAGES = 3
#: Share of the text of a node that a child has to hold to be taken in its place, where no tag names the article.
DOMINANT = 0.7
#: Bytes of decisions up to which they are broadcast; beyond it they are joined by host.
BROADCAST_BYTES = 32 << 20

# fixed values: elements of HTML, and words by which pages name what is not the article
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul""".split()
)
RAW = "script style noscript template svg iframe object textarea title canvas audio video math noembed noframes xmp"
OUT_TAGS = frozenset("nav footer aside form button select option menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promotion sidebar sidebars
    widget widgets menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert alerts popup
    popups modal overlay newsletter subscribe signup login share sharing social related recommended recommendations trending comment comments commentlist
    disqus reply replies respond discussion form forms search toolbar pagination pager copyright paywall""".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
NO_PART = frozenset("has no with without is not".split())
MAIN_VALUES = frozenset("articlebody".split())
#: An open element that the start of another ends, and the elements beyond which it isn't looked for.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: Elements that may hold the article where no tag names it.
HOLDERS = frozenset("body html div section center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    rf"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(?:{RAW.replace(" ", "|")})(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?:{RAW.replace(" ", "|")})[^>]*>|\Z)"""
    r"""|<(?P<shut>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)|<[!?][^>]*+>|</?[a-zA-Z!?][^>]*+\Z|</[^a-zA-Z][^>]*>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Node:
    """A block or a text of an expression. ``part``: o is out, h a header, m named as the article; a text has ``fixed``, its hash while all are equal."""

    __slots__ = ("label", "part", "optional", "repeated", "loose", "pages", "chars", "links", "fixed", "kids", "text", "article")

    def __init__(self, label: str, part: str = "", chars: int = 0, links: int = 0, fixed: str | None = None, text: str | None = None):
        self.label, self.part, self.optional, self.repeated, self.loose = label, part, False, False, False
        self.pages, self.chars, self.links, self.fixed, self.text, self.article = 1, chars, links, fixed, text, False
        self.kids: list[Node] = []

    def packed(self) -> list:
        flags = self.optional + 2 * self.repeated + 4 * self.loose + 8 * self.article
        return [self.label, self.part, flags, self.pages, self.chars, self.links, self.fixed, [k.packed() for k in self.kids]]

    @classmethod
    def unpacked(cls, x: list) -> Node:
        out = cls(x[0], x[1], x[4], x[5], x[6])
        out.optional, out.repeated, out.loose, out.article, out.pages = bool(x[2] & 1), bool(x[2] & 2), bool(x[2] & 4), bool(x[2] & 8), x[3]
        out.kids = [cls.unpacked(k) for k in x[7]]
        return out

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)

    def pattern(self) -> str:
        """The expression as text, for people."""
        inner = " ".join(k.pattern() for k in self.kids)
        out = ("#" if self.fixed is None else "=") if self.label == "#" else f"({inner})" if self.label.startswith("(") else f"<{self.label}>{inner}"
        out = f"({out})" if (self.optional or self.repeated) and not out.startswith("(") else out
        return out + "+" * self.repeated + "?" * self.optional


@lru_cache(maxsize=1 << 14)
def _judged(tag: str, name: str) -> tuple[str, str]:
    """(label, part) of a start tag: the name with its classes and id, digits left out."""
    found = {a.lower(): (b or c or d) for a, b, c, d in _ATTRIBUTE.findall(tag[1 + len(name) :])}
    named = f"{found.get('class', '')} {found.get('id', '')}".split()
    label = ".".join([name, *dict.fromkeys(re.sub(r"[\d_-]+$", "", re.sub(r"\d+", "", n)) for n in named)]).rstrip(".")
    role = found.get("role", "").lower()
    if name in ("html", "body"):
        return name, ""
    if name in OUT_TAGS or role in OUT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return label, "o"
    header = name == "header"
    for n in named:
        words = [w.lower() for w in _WORD.findall(n)]
        if words and words[0] not in NO_PART:
            if not OUT_WORDS.isdisjoint(words):
                return label, "o"
            header = header or not HEADER_WORDS.isdisjoint(words)
    if name in MAIN_TAGS or role in MAIN_TAGS or found.get("itemprop", "").lower() in MAIN_VALUES:
        return label, "m"
    return label, "h" if header else ""


def parsed(page: str) -> Node:
    """The blocks and texts of a page, nested; end tags that are left out are supplied, those without a start are ignored."""
    root = Node("")
    nodes, names = [root], [""]
    buf: list[str] = []
    links = at = muted = 0
    mute, linked = "", False

    def flush() -> None:
        nonlocal links
        if buf:
            text = " ".join(references.unescape("".join(buf)).split())
            if text:
                nodes[-1].kids.append(Node("#", "", len(text), min(links, len(text)), hashlib.md5(text.encode("utf-8", "replace")).hexdigest()[:16], text))
            buf.clear()
        links = 0

    def end(depth: int) -> None:
        del nodes[depth:], names[depth:]

    for m in _TAG.finditer(page):
        start = m.start()
        if start > at and not muted:
            buf.append(page[at:start])
            if linked:
                links += start - at
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        shut = m["shut"]
        if name not in BLOCKS:
            if muted:
                muted += (name == mute) * (-1 if shut else 1)
            elif name == "a":
                linked = not shut
            elif name == "br":
                buf.append(" ")
            if not shut and not muted and (name == "button" or " " in m[0] and name not in ("a", "meta", "link", "img", "input") and _judged(m[0], name)[1] == "o"):
                mute, muted = name, 1
            continue
        muted, linked = 0, False
        flush()
        if shut:
            if name in names:
                end(len(names) - 1 - names[::-1].index(name))
            continue
        if names[-1] == "p" or names[-1] in HEADINGS and name in HEADINGS:
            end(len(names) - 1)
        if name in ENDS:
            own, bound = ENDS[name]
            for i in range(len(names) - 1, 0, -1):
                if names[i] in own:
                    end(i)
                    break
                if names[i] in bound:
                    break
        if name == "hr":
            continue
        names.append(name)
        if len(nodes) >= DEEPEST:
            nodes.append(nodes[-1])
        else:
            node = Node(*_judged(m[0], name))
            nodes[-1].kids.append(node)
            nodes.append(node)
    if not muted:
        buf.append(page[at:])
    flush()
    return root


def _alike(a: Node, b: Node) -> float:
    """How much the tags within two nodes agree, 0 to 1."""
    x, y = {k.label for k in a.kids}, {k.label for k in b.kids}
    return len(x & y) / len(x | y) if x or y else 1.0


def merged(a: Node, b: Node) -> Node:
    """``a`` after its alignment with ``b``, which has the same label."""
    a.pages, a.chars, a.links = a.pages + b.pages, a.chars + b.chars, a.links + b.links
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
    if a.fixed != b.fixed:
        a.fixed = None
    a.loose = a.loose or b.loose
    a.kids = _loosened(a.kids + b.kids) if a.loose else aligned(a.kids, b.kids)
    _bound(a)
    return a


def _bound(node: Node) -> None:
    """Too many children are collapsed, and if that doesn't do, their order is given up."""
    if len(node.kids) > MOST_CHILDREN:
        node.kids = collapsed(node.kids)
        if len(node.kids) > MOST_CHILDREN:
            node.kids, node.loose = _loosened(node.kids), True


def compact(node: Node) -> Node:
    """A parsed page as the expression of itself, of bounded width."""
    for k in node.kids:
        compact(k)
    _bound(node)
    return node


def _again(a: Node, b: Node) -> Node:
    """One repeated node of two within a page: they are pages of one slot, but not two pages."""
    pages = max(a.pages, b.pages)
    a = merged(a, b)
    a.pages, a.repeated = pages, True
    return a


def _loosened(kids: list[Node]) -> list[Node]:
    """Each label once, optional and repeated."""
    out: dict[str, Node] = {}
    for k in _flat(kids):
        if k.label in out:
            _again(out[k.label], k)
        else:
            out[k.label] = k
            k.optional = k.repeated = True
    return list(out.values())


def _flat(kids: Iterable[Node]) -> Iterator[Node]:
    """Nodes with those of groups in their place."""
    for k in kids:
        if _is_group(k):
            yield from _flat(k.kids)
        else:
            yield k


def collapsed(kids: list[Node]) -> list[Node]:
    """Neighbours that repeat become one repeated node, and repeated runs of up to ``LONGEST_GROUP`` nodes one repeated group."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].label == k.label and (out[-1].repeated or k.repeated or _alike(out[-1], k) >= 0.5):
            out[-1] = _again(out[-1], k)
        else:
            out.append(k)
    for length in range(2, LONGEST_GROUP + 1):
        labels = [k.label for k in out]
        at, kept = 0, []
        while at < len(out):
            run = labels[at : at + length]
            times = 1
            while len(run) == length and labels[at + times * length : at + (times + 1) * length] == run:
                times += 1
            if times == 1:
                kept.append(out[at])
                at += 1
                continue
            group = Node("(" + " ".join(run) + ")")
            group.repeated, group.kids = True, out[at : at + length]
            group.pages = max(k.pages for k in group.kids)
            for t in range(1, times):
                for i in range(length):
                    group.kids[i] = _again(group.kids[i], out[at + t * length + i])
            for k in group.kids:
                k.repeated = False
            kept.append(group)
            at += times * length
        out = kept
    return out


def _retracted(a: list[str], b: list[str], start: int) -> int:
    """Where the mismatch after ``start`` equal labels begins, if a repetition runs into it: before the first round of that repetition."""
    for length in range(1, LONGEST_GROUP + 1):
        if length > start:
            break
        run = a[start - length : start]
        if a[start : start + length] == run or b[start : start + length] == run:
            while start >= length and a[start - length : start] == run:
                start -= length
            return start
    return start


def _grouped(kids: list[Node], groups: list[Node]) -> list[Node]:
    """Runs with the labels of one of ``groups`` as such a group, if it is one round only, too."""
    for g in groups:
        run = [k.label for k in g.kids]
        at, out = 0, []
        while at < len(kids):
            if [k.label for k in kids[at : at + len(run)]] == run:
                own = Node(g.label)
                own.repeated, own.kids = True, kids[at : at + len(run)]
                own.pages = max(k.pages for k in own.kids)
                out.append(own)
                at += len(run)
            else:
                out.append(kids[at])
                at += 1
        kids = out
    return kids


def _is_group(node: Node) -> bool:
    return node.label.startswith("(")


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Both sequences in one: equal labels merged, the rest optional. Repetitions are looked for where the sequences differ only."""
    p, q = [k.label for k in a], [k.label for k in b]
    if p == q:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    start = 0
    while start < min(len(p), len(q)) and p[start] == q[start]:
        start += 1
    start = _retracted(p, q, start)
    p, q = p[start:][::-1], q[start:][::-1]
    stop = 0
    while stop < min(len(p), len(q)) and p[stop] == q[stop]:
        stop += 1
    stop = _retracted(p, q, stop)
    x, y = collapsed(a[start : len(a) - stop]), collapsed(b[start : len(b) - stop])
    x, y = _grouped(x, [k for k in y if _is_group(k)]), _grouped(y, [k for k in x if _is_group(k)])
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            here = 1 + _alike(x[i], y[j]) + best[i + 1][j + 1] if x[i].label == y[j].label else 0.0
            best[i][j] = max(here, best[i + 1][j], best[i][j + 1])
    i = j = 0
    middle = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].label == y[j].label and best[i][j] == 1 + _alike(x[i], y[j]) + best[i + 1][j + 1]:
            middle.append(merged(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i][j] == best[i + 1][j]:
            x[i].optional = True
            middle.append(x[i])
            i += 1
        else:
            y[j].optional = True
            middle.append(y[j])
            j += 1
    head = [merged(p, q) for p, q in zip(a[:start], b[:start], strict=True)]
    tail = [merged(p, q) for p, q in zip(a[len(a) - stop :], b[len(b) - stop :], strict=True)]
    return head + middle + tail


def _template(node: Node) -> bool:
    """Whether a text is the template's: the same on all pages that have it, and on enough of them."""
    return node.label == "#" and node.fixed is not None and node.pages >= TEMPLATE_PAGES


def _prose(node: Node) -> int:
    """Characters that are neither the template's, nor of links, nor in what is out."""
    if node.part == "o":
        return 0
    if node.label == "#":
        return 0 if _template(node) else node.chars - node.links
    return sum(map(_prose, node.kids))


def _named(node: Node) -> list[Node]:
    """The outermost nodes that a tag names as the article, articles before what holds them."""
    if node.part == "o":
        return []
    inner = [n for k in node.kids for n in _named(k)]
    if node.part != "m":
        return inner
    return inner if inner and 2 * sum(map(_prose, inner)) >= _prose(node) else [node]


def decide(root: Node) -> Node:
    """Mark the nodes that hold the article: those that a tag names, or else the smallest block with most of the prose."""
    named = [(n, _prose(n)) for n in _named(root)]
    most = max((p for _, p in named), default=0)
    if most:
        for n, p in named:
            n.article = 10 * p >= most
        return root
    node = root
    while True:
        total = _prose(node)
        inner = max((k for k in _flat(node.kids) if k.label.split(".")[0] in HOLDERS and k.part != "h" and any(c.label != "#" for c in k.kids)), key=_prose, default=None)
        if inner is None or not total or _prose(inner) < DOMINANT * total:
            break
        node = inner
    node.article = True
    return root


def _counterparts(page: list[Node], rule: list[Node]) -> Iterator[tuple[Node, Node | None]]:
    """Each node of a page with the node of the expression that it goes to."""
    if page is rule:
        yield from zip(page, rule, strict=True)
        return
    options: dict[str, list[tuple[int, int, Node]]] = {}  # place, the place from which the next is looked for, node
    place = 0
    for r in rule:
        inner = list(_flat([r]))
        for i, n in enumerate(inner):
            options.setdefault(n.label, []).append((place + i, place if _is_group(r) or r.repeated else place + 1, n))
        place += len(inner)
    at = 0
    for k in page:
        some = options.get(k.label, [])
        if len(some) > 1:
            some = sorted([o for o in some if o[0] >= at] or some, key=lambda o: -_alike(k, o[2]))
        if some:
            at = max(at, some[0][1])
        yield k, some[0][2] if some else None


def _read(page: Node, rule: Node | None, inside: bool, varied: bool, blocks: list[str]) -> bool:
    """Add the texts of the article to ``blocks``; whether the page has a node that holds it."""
    hit = False
    for k, r in _counterparts(page.kids, rule.kids if rule is not None else []):
        if k.label == "#":
            heading = page.label.split(".")[0] in HEADINGS
            if inside and not (r is not None and varied and not heading and _template(r) and not r.repeated and r.fixed == k.fixed):
                blocks.append(k.text)
        elif k.part != "o":
            starts = r is not None and r.article
            if inside or starts or not (k.part == "h" and not r):
                hit |= starts
                hit |= _read(k, r, inside or starts, varied, blocks)
    return hit


def main_text(page: Node, rule: Node | None) -> str:
    """The article of a parsed page by the decided expression of its host, or by its own where the page has no node that holds it."""
    blocks: list[str] = []
    if rule is None or not _read(page, rule, rule.article, _prose(rule) > 0, blocks) and not rule.article:
        rule = decide(page)
        blocks = []
        _read(page, rule, rule.article, False, blocks)
    return "\n".join(blocks)


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, expression): one of all pages of a host that a task holds at a time."""
    held: dict[str, Node] = {}
    nodes = 0
    for batch in split_batches(batches, "html"):
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            tree = compact(parsed(page))
            had = held.get(host)
            before = 0 if had is None else len(had.kids)
            held[host] = tree if had is None else merged(had, tree)
            nodes += tree.size() if had is None else max(0, len(held[host].kids) - before)
        if nodes > HELD_NODES:
            yield _rows(held)
            held, nodes = {}, 0
    if held:
        yield _rows(held)


def _rows(held: dict[str, Node]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"host": list(held), "expression": [json.dumps(n.packed(), ensure_ascii=False, separators=(",", ":")) for n in held.values()]})


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expressions sorted by host to one a host, decided."""
    rows = (row for batch in batches for row in zip(batch.column("host").to_pylist(), batch.column("expression").to_pylist(), strict=True))
    for host, some in groupby(rows, lambda r: r[0]):
        node = None
        for _, text in some:
            other = Node.unpacked(json.loads(text))
            node = other if node is None else merged(node, other)
        yield _rows({host: decide(node)})


def host_of(url: str | Column = "url") -> Column:
    """The lower-case host of a URL without port and user; null if there is none."""
    host = F.lower(F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:\s]+)", 1))
    return F.when(host != "", host)


def infer(pages: DataFrame) -> DataFrame:
    """(host, expression): the wrapper of every host of ``pages(url, html)`` as JSON, with its article nodes marked. Pages without a host have none."""
    rows = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).where("host IS NOT NULL AND html <> ''")
    schema = "host string, expression string"
    parts = written(rows.mapInArrow(_expressions, schema))
    return written(parts.repartition("host").sortWithinPartitions("host", "expression").mapInArrow(_folded, schema))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the article of each row of ``pages(page_id, url, html)``.

    A page without a host, or whose host's expression doesn't fit it, is read by its own expression. A null or empty page, or one without an article, has an empty text. Ids
    and URLs may be null or repeat, each row gives a row; pages may be of any length; other columns are ignored; an empty table stays empty.
    """
    rules = infer(pages).withColumnRenamed("host", "of")
    size = rules.agg(F.sum(F.length("expression"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of().alias("host"))
    both = rows.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "expression")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in split_batches(batches, "html"):
            texts = []
            for page, expression in zip(batch.column("html").to_pylist(), batch.column("expression").to_pylist(), strict=True):
                if expression is not None and expression not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[expression] = Node.unpacked(json.loads(expression))
                texts.append(main_text(parsed(page), known.get(expression)) if page else "")
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")
