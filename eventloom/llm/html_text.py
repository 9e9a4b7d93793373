"""Main text of web pages, by wrappers inferred for each host: union-free regular expressions of its pages' tokens.

A page's tokens are its tags and texts. Its own expression comes first: of elements of one kind that follow one another under
their parent one is kept as a repeated part, and where a kind recurs after others, all from its first to its last place become
a repeated group. The expressions of a host's pages are then aligned one after the other. Below each pair of aligned
elements the best alignment of their parts is found; parts that only one side has become optional, parts that the sides have
in another order become a repeated group, texts that differ become slots, and aligned elements are aligned inside in turn.

Aligning depends on the order of pages, so that is fixed: expressions of equal form are first added up, which no order
changes, and the different forms of a host are aligned from the commonest to the rarest, in groups dealt by a
hash of the form where they are many. The wrapper so depends on the host's pages and not on how they are stored.

The wrapper decides what is the article. It is in an
article element, else a main element, else one whose class or id says content, else the innermost element whose slots hold most of the
host's text outside links; where hardly anything differs, as among versions of one article, all text counts for that. Parts whose element says menu, header, footer, sidebar, notice, advert, form, script, style or comment
are left out. A class, id or role only hints at that: it counts if all pages that align there have it, and doesn't count
where the slots below hold most of the text, or the article, of those pages, unless it speaks of comments alone. All other text of the article stays, also what all pages of the host repeat; template are
containers without a slot that hold links, or that lie before or after all slots of an element which nothing but its text shows to hold the article.

Defined results: null or empty html, and pages without article, give an empty text. Pages whose url is null or has no host
share one wrapper. Repeated pages are each extracted. A very long page is parsed whole, in time in proportion to its length; below ``MAX_DEPTH``
elements its texts count as its last element's. Other columns pass through; an output column that clashes with one, in any case of letters, replaces it.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Columns, Scratch, tidied

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NOT_LETTERS = re.compile("[^a-z]+")

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that pages use for anything: two of them align only by what their class, id and role say.
GENERIC = frozenset("div section span ul ol aside table form p".split())
#: Parts of an article rather than what holds it.
PARTS = HEADINGS | frozenset("p li dt dd blockquote pre #text".split())
#: An opening tag on the left ends an open element on the right, unless one of the last set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Elements that aren't part of an article, and words in a class, id or role that hint at such parts.
DROPPED = frozenset("head nav footer aside form button select option datalist fieldset noscript template svg canvas object audio video dialog menu script style textarea title xmp iframe noembed noframes".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus remark remarks feedback reply replies respond".split())
DROPPED_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations footer copyright widget widgets toolbar pagination pager paywall login signup search skip complementary contentinfo".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
CONTENT_WORDS = frozenset("article content post entry story body text main".split())
#: Words that leave the hint beside them as it is: "comment-list" hints, and "related-work" or "has-sidebar" doesn't.
PLAIN_WORDS = CONTENT_WORDS | frozenset(
    "list box area section wrapper wrap container block inner outer bar link links posts articles stories items item thread top bottom left right site page primary secondary global sticky fixed floating buttons button icons icon group row column col slot unit panel module region zone google mobile desktop small large title heading form field message policy media tags category user users reader readers visitor".split()
)
#: Parts that a wrapper keeps apart below one element; beyond that the rarest join one of their tag. Depth of a wrapper.
MAX_CHILDREN, MAX_DEPTH = 64, 32
#: Share of a host's text outside links from which what differs tells where the article is; where less differs, the pages are versions of one article, and all their text does.
DIFFERS = 0.2
#: Wrappers aligned in one group, and wrappers that a task holds before it hands them on.
GROUP, HELD = 64, 4096
TEXT = "#text"


def _marks(tokens: frozenset[str], words: frozenset[str]) -> bool:
    """Whether a class, id or role hints at these words."""
    for token in tokens:
        parts = token.split("-")
        if any(p in words for p in parts) and all(p in DROPPED_WORDS or p in HEADER_WORDS or p in PLAIN_WORDS for p in parts):
            return True
    return False


def kind(tag: str, tokens: frozenset[str]) -> str:
    """drop, header, article, main, content, or nothing."""
    marked = _marks(tokens, DROPPED_WORDS)
    if tag in ("article", "main") and not marked:
        return tag
    if tag in ("html", "body"):
        return ""
    if tag in DROPPED or marked:
        return "drop"
    if tag == "header" or _marks(tokens, HEADER_WORDS):
        return "header"
    return freed(tag, tokens)


def freed(tag: str, tokens: frozenset[str]) -> str:
    """The kind of an element whose words don't make it dropped or a header."""
    if tag in ("article", "main"):
        return tag
    return "content" if tag not in INLINE and tag not in HEADINGS and any(p in CONTENT_WORDS for t in tokens for p in t.split("-")) else ""


# ---------------------------------------------------------------------- pages
class _Element:
    """An element of a page: what it holds in order, and its place in the page's expression."""

    __slots__ = ("chars", "children", "depth", "linked", "node", "tag", "tokens")

    def __init__(self, tag: str, tokens: frozenset[str], depth: int):
        self.tag, self.tokens, self.depth = tag, tokens, depth
        self.chars = self.linked = 0  # of all texts below, when its expression is made
        self.children: list[_Element | tuple[str, int]] = []
        self.node: Node | None = None


_NONE: frozenset[str] = frozenset()
_KNOWN: dict[str, frozenset[str]] = {}


def _tokens(attrs: str) -> frozenset[str]:
    """The letters of every class, id and role, joined by hyphens where other signs were."""
    if "=" not in attrs:
        return _NONE
    found = _KNOWN.get(attrs)
    if found is None:
        found = frozenset(filter(None, (_NOT_LETTERS.sub("-", t).strip("-") for g in NAMES.findall(attrs) for t in "".join(g).lower().split())))
        if len(_KNOWN) < 10_000:
            _KNOWN[attrs] = found
    return found


def parse(page: str) -> _Element:
    """The page as elements that aren't inline and texts: (text, its characters inside links), white space as single spaces."""
    root = _Element("#page", _NONE, 0)
    stack: list[_Element] = [root]
    pieces: list[str] = []
    links, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            stack[-1].children.append((text, min(linked, len(text))))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text.strip())

    n = len(page)
    last = page.rfind(">") + 1  # no tag ends after it, so none is looked for there
    while at < n:
        m = TOKEN.search(page, at, last) if at < last else None
        if m is None:
            add(re.split("<[!?]", page[at:], maxsplit=1)[0] if at >= last else page[at:last])
            if at >= last:
                break
            at = last
            continue
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["data"]:
                add(m["data"])
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                if stack[-1].tag == tag:
                    flush()
                    stack.pop()
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        attrs = m["attrs"]
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        tokens = _tokens(attrs)
        inline = tag in INLINE
        if inline:
            links += tag == "a"
            if not tokens or kind(tag, tokens) != "drop" or attrs.rstrip().endswith("/"):
                continue
        flush()
        if tag in RAW:
            # nothing inside is markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
        if not inline:
            if tag == "body" or tag in ("article", "main", "div", "p", "h1", "section"):
                for k in range(1, len(stack)):
                    if stack[k].tag == "head":
                        del stack[k:]
                        break
            while stack[-1].tag == "p":
                stack.pop()
            if tag in ENDS:
                over, until = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in until:
                        break
                    if stack[k].tag in over:
                        del stack[k:]
                        break
            if tag in ("svg", "path") and attrs.rstrip().endswith("/"):
                continue
        element = _Element(tag, tokens, len(stack))
        stack[-1].children.append(element)
        stack.append(element)
    flush()
    return root


# ------------------------------------------------------------------- wrappers
def _mark(text: str) -> int:
    """A text's checksum and, in the last 24 bits, length."""
    return zlib.crc32(text.encode("utf-8", "replace")) << 24 | min(len(text), (1 << 24) - 1)


class Node:
    """A part of an expression: an element, or the texts at one place.

    ``group`` numbers the repeated group that it is in among its neighbours, 0 for none; ``again`` says that it follows itself.
    ``pages`` have it, in ``count`` places, below ``of`` of its parent's places. Texts have characters, those in links, and ``texts``, what
    all pages that have the part repeat there.
    """

    __slots__ = ("again", "chars", "count", "group", "index", "into", "items", "kind", "linked", "of", "pages", "parent", "tag", "texts", "tokens")

    def __init__(self, tag: str, tokens: frozenset[str]):
        self.tag, self.tokens = tag, tokens
        self.group, self.again = 0, False
        self.pages = self.count = self.of = 1
        self.chars = self.linked = 0
        self.texts: set[int] | None = None
        self.items: list[Node] = []
        self.into: Node | None = None

    def key(self) -> tuple[str, frozenset[str]]:
        return self.tag, self.tokens

    def dump(self) -> list:
        return [self.tag, sorted(self.tokens), self.group, int(self.again), self.pages, self.count, self.of, self.chars, self.linked, None if self.texts is None else sorted(self.texts), [x.dump() for x in self.items]]

    @classmethod
    def load(cls, x: list) -> Node:
        out = cls(x[0], frozenset(x[1]))
        out.group, out.again, out.pages, out.count, out.of, out.chars, out.linked = x[2], bool(x[3]), *x[4:9]
        out.texts = None if x[9] is None else set(x[9])
        out.items = [cls.load(y) for y in x[10]]
        return out

    def form(self) -> str:
        """The expression without counts and texts."""
        inner = "".join(f"{x.group}:{x.form()}" for x in self.items)
        return f"{self.tag}.{'.'.join(sorted(self.tokens))}({inner})"


def likeness(a: Node, b: Node) -> float:
    """How well two parts align; 0 if they can't."""
    if a.tag != b.tag:
        return 0.0
    if a.tokens == b.tokens:
        return 3.0
    if a.tag not in GENERIC:
        return 1.0
    shared = len(a.tokens & b.tokens) / len(a.tokens | b.tokens)
    return 1.0 + shared if shared >= 0.5 else 0.0


def best_alignment(left: list[Node], right: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Both sequences in order, the parts that align side by side, with the most likeness in all."""
    if len(left) == len(right) and all(a.tag == b.tag and a.tokens == b.tokens for a, b in zip(left, right, strict=True)):
        return list(zip(left, right, strict=True))
    n, m = len(left), len(right)
    like = [[likeness(a, b) for b in right] for a in left]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, mine = best[i], best[i + 1], like[i]
        for j in range(m - 1, -1, -1):
            x = max(below[j], row[j + 1])
            row[j] = max(x, mine[j] + below[j + 1]) if mine[j] else x
    out: list[tuple[Node | None, Node | None]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and like[i][j] and best[i][j] == like[i][j] + best[i + 1][j + 1]:
            out.append((left[i], right[j]))
            i, j = i + 1, j + 1
        elif i < n and best[i][j] == best[i + 1][j]:
            out.append((left[i], None))
            i += 1
        else:
            out.append((None, right[j]))
            j += 1
    return out


def merge(a: Node, b: Node, how: str) -> Node:
    """Takes b into a. They are ``sibling`` places of one page, below ``other`` places of their parent on one page, or of other ``pages``."""
    b.into = a
    a.tokens = a.tokens if a.tokens == b.tokens else a.tokens & b.tokens
    a.count += b.count
    a.chars += b.chars
    a.linked += b.linked
    a.again |= b.again or how == "sibling"
    a.of = max(a.of, b.of) if how == "sibling" else a.of + b.of
    if how == "pages":
        a.pages += b.pages
    else:
        a.pages = max(a.pages, b.pages)
    if b.texts is not None:
        a.texts = b.texts if a.texts is None else a.texts & b.texts if how == "pages" else a.texts | b.texts
    a.items = align(a.items, b.items, "pages" if how == "pages" else "other")
    return a


def align(left: list[Node], right: list[Node], how: str) -> list[Node]:
    """One sequence for two: aligned parts are merged, others become optional, and parts in crossing order a repeated group."""
    if not left or not right:
        return left or right
    merged, groups = [], []
    for a, b in best_alignment(left, right):
        groups.append(((0, a.group) if a is not None and a.group else None, (1, b.group) if b is not None and b.group else None))
        merged.append(merge(a, b, how) if a is not None and b is not None else a if a is not None else b)
    return grouped(merged, groups, how)


def grouped(items: list[Node], groups: list[tuple], how: str) -> list[Node]:
    """A sequence in which every kind is there once: what recurs with others between becomes, with them, a repeated group.

    ``groups`` names the groups that each item is in already.
    """
    first: dict[tuple, int] = {}
    kinds: dict[str, frozenset[str]] = {}
    spans: dict[tuple, list[int]] = {}
    for k, x in enumerate(items):
        if x.key() not in first:
            if len(first) >= MAX_CHILDREN:  # the wrapper's own parts come first, as they are in the fixed order of pages
                x.tokens = kinds.setdefault(x.tag, x.tokens)
            kinds[x.tag] = x.tokens
        key = x.key()
        if first.setdefault(key, k) < k and any(items[j].key() != key for j in range(first[key] + 1, k)):
            spans.setdefault(key, [first[key], k])[1] = k
        for g in groups[k]:
            if g is not None:
                spans.setdefault(g, [k, k])[1] = k
    if len(first) == len(items) and not spans:
        for x in items:
            x.group = 0
        return items
    number = [0] * len(items)
    at, upto = 0, -1
    for a, b in sorted(spans.values()):
        at += a > upto
        for k in range(max(a, upto + 1), b + 1):
            number[k] = at
        upto = max(upto, b)
    out: list[Node] = []
    place: dict[tuple, Node] = {}
    for k, x in enumerate(items):
        mine = place.get(x.key())
        if mine is None:
            x.group = number[k]
            place[x.key()] = x
            out.append(x)
        else:
            merge(mine, x, how)
    return out


def expression(element: _Element) -> Node:
    """The expression of an element of one page; every element below gets its ``node``."""
    node = element.node = Node(element.tag, element.tokens)
    items: list[Node] = []
    for child in element.children:
        if isinstance(child, tuple):
            element.chars, element.linked = element.chars + len(child[0]), element.linked + child[1]
            leaf = Node(TEXT, _NONE)
            leaf.chars, leaf.linked, leaf.texts = len(child[0]), child[1], {_mark(child[0])}
        elif element.depth >= MAX_DEPTH:
            for x in _below(child):
                x.node = node
            leaf = _flat(child)
            if leaf is None:
                continue
            element.chars, element.linked = element.chars + leaf.chars, element.linked + leaf.linked
        else:
            leaf = expression(child)
            element.chars, element.linked = element.chars + child.chars, element.linked + child.linked
        if items and items[-1].tag == leaf.tag and items[-1].tokens == leaf.tokens:
            merge(items[-1], leaf, "sibling")  # a square: the part repeats itself
        else:
            items.append(leaf)
    node.items = grouped(items, [(None,)] * len(items), "sibling")
    if element.tag in ("div", "section") and not element.tokens:
        node.tokens = _SAYS["links" if 0 < element.chars == element.linked else "blocks" if any(x.tag != TEXT for x in node.items) else "text"]
    return node


#: What stands for the class of a plain element: links, or other text, or further elements.
_SAYS = {what: frozenset([f"+{what}"]) for what in ("links", "text", "blocks")}


def _below(element: _Element) -> Iterator[_Element]:
    todo = [element]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in x.children if not isinstance(c, tuple)]


def _flat(element: _Element) -> Node | None:
    texts = [c for x in _below(element) for c in x.children if isinstance(c, tuple)]
    if not texts:
        return None
    leaf = Node(TEXT, _NONE)
    leaf.chars, leaf.linked, leaf.texts = sum(len(t) for t, _ in texts), sum(n for _, n in texts), {_mark(t) for t, _ in texts}
    return leaf


def _final(node: Node) -> Node:
    while node.into is not None:
        node = node.into
    return node


class Wrapper:
    """The expression of some pages of a host."""

    def __init__(self, root: Node | None = None, pages: int = 0, some: list[int] | None = None):
        self.root, self.pages = root, pages
        self.some = some or []  # the smallest checksums of pages, two at most
        self.plan: Plan | None = None

    @classmethod
    def of(cls, page: str) -> Wrapper:
        return cls(expression(parse(page)), 1, [_mark(page)])

    def form(self) -> str:
        """A name of the expression's form."""
        return hashlib.blake2b(self.root.form().encode("utf-8", "replace"), digest_size=12).hexdigest()

    def align(self, other: Wrapper) -> Wrapper:
        """Takes in the wrapper of other pages. Where both have one form, no order of doing so changes the result."""
        self.pages += other.pages
        self.some = sorted({*self.some, *other.some})[:2]
        self.root = other.root if self.root is None else merge(self.root, other.root, "pages")
        return self

    def dump(self) -> str:
        return json.dumps([self.pages, self.some, self.root.dump()], separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> Wrapper:
        pages, some, root = json.loads(text)
        return cls(Node.load(root), pages, some)

    def expression(self) -> str:
        """The wrapper written out: ? is optional, + repeated, #slot a text that varies, #text one that doesn't."""

        def write(x: Node, above: int) -> str:
            text = ("#text" if x.texts else "#slot") if x.tag == TEXT else f"<{'.'.join((x.tag, *sorted(x.tokens)))}>{sequence(x.items, x.count)}</{x.tag}>"
            mark = ("+" if x.again else "") + ("?" if x.of < above else "")
            return f"({text}){mark}" if mark else text

        def sequence(items: list[Node], above: int) -> str:
            out, k = "", 0
            while k < len(items):
                end = k + 1
                while items[k].group and end < len(items) and items[end].group == items[k].group:
                    end += 1
                inner = "".join(write(x, above) for x in items[k:end])
                out += f"({inner})+" if items[k].group else inner
                k = end
            return out

        return sequence(self.root.items, self.root.count)


class Plan:
    """What a wrapper says of its parts: their kinds, where the article is, and what around it is template."""

    def __init__(self, wrapper: Wrapper):
        self.root, self.pages = wrapper.root, wrapper.pages
        self.nodes: list[Node] = []
        todo: list[tuple[Node, Node | None]] = [(self.root, None)]
        while todo:
            x, parent = todo.pop()
            x.parent, x.index, x.kind = parent, len(self.nodes), kind(x.tag, x.tokens) if x.tag != TEXT else ""
            self.nodes.append(x)
            todo += [(y, x) for y in reversed(x.items)]
        self.leaves = [x for x in self.nodes if x.tag == TEXT]
        # texts that all pages repeat at one place; one page, or copies of it, can't tell them
        self.fixed = {x.index: x.texts for x in self.leaves if x.texts and x.pages >= self.pages} if len(wrapper.some) > 1 else {}
        slots = {x.index: n for x in self.leaves if (n := x.chars - x.linked - _chars(self.fixed.get(x.index, ())) * x.pages) > 0}
        for x in self._freed(slots):
            x.kind = freed(x.tag, x.tokens)
        weights = {x.index: x.chars - x.linked for x in self.leaves if not any(y.kind in ("drop", "header") for y in self.above(x))}
        told = sum(slots.get(k, 0) for k in weights) >= DIFFERS * sum(weights.values())
        self.told, self.tiers = told, self._tiers(slots if told else weights)
        self.still = self._still()
        self.known: dict[str, list[Node | None]] = {}

    def above(self, x: Node) -> Iterator[Node]:
        """The node and all around it."""
        while x is not None:
            yield x
            x = x.parent

    def _still(self) -> frozenset[int]:
        """Containers whose texts are all fixed."""
        fixed: dict[int, bool] = {}
        for x in self.leaves:
            same = x.chars <= _chars(self.fixed.get(x.index, ())) * x.pages
            for y in self.above(x):
                fixed[y.index] = fixed.get(y.index, True) and same
        return frozenset(x.index for x in self.nodes if fixed.get(x.index) and x.tag not in PARTS and x.tag not in INLINE and x.kind not in ("article", "main"))

    def _freed(self, slots: dict[int, int]) -> list[Node]:
        """The parts that are kept though a word drops them: their slots hold most of the text of pages that have them, or
        they are an article or main element; unless the pages have another article that isn't dropped."""
        soft = [x for x in self.nodes if x.kind == "drop" and x.tag not in DROPPED or x.kind == "header" and x.tag != "header"]
        if not soft:
            return []
        marked = {x.index for x in soft}
        hard = {x.index for x in self.nodes if x.kind in ("drop", "header")} - marked
        open_ = [(x, n) for x in self.leaves if (n := slots.get(x.index)) and not any(y.index in hard for y in self.above(x))]
        held: dict[int, int] = {}
        for x, n in open_:
            for y in self.above(x):
                held[y.index] = held.get(y.index, 0) + n
        each = held.get(0, 0) / max(self.pages, 1)
        out: dict[int, Node] = {}
        while True:
            # text outside headings below each root that stands without what is dropped
            body: dict[int, int] = {}
            beside = 0
            for x, n in open_:
                around = list(self.above(x))
                if any(y.tag in HEADINGS or y.index in marked and y.index not in out for y in around):
                    continue
                for y in around:
                    what = freed(y.tag, y.tokens) if y.index in out else y.kind
                    if what in ("article", "main", "content") and not (y.again or y.group):
                        body[y.index] = body.get(y.index, 0) + n
                    if y.parent is None:
                        beside += n
            best = None
            for x in soft:
                if x.index in out or x.index not in held or any(y.index in marked and y.index not in out for y in self.above(x.parent)):
                    continue
                words = {p for t in x.tokens for p in t.split("-")}
                if words & COMMENT_WORDS and words <= COMMENT_WORDS | PLAIN_WORDS:
                    continue  # comments, however long
                mixed = not all(p in DROPPED_WORDS or p in HEADER_WORDS for p in words)
                article = x.tag in ("article", "main") and mixed and not x.again
                mine = held[x.index] / max(x.pages, 1)
                if not article and mine <= each / 2:
                    continue
                if not article and not mixed and beside / max(self.pages, 1) >= mine / 10:
                    continue  # words that only drop, and other text that no word drops
                if any(self.nodes[y].pages + x.pages > self.pages and n / self.nodes[y].pages >= mine / 10 for y, n in body.items()):
                    continue
                best = max(best or (False, False, 0, 0), (article, mixed, mine, -x.index))
            if best is None:
                return list(out.values())
            out[-best[3]] = self.nodes[-best[3]]

    def _tiers(self, slots: dict[int, int]) -> list[tuple[str, frozenset[int]]]:
        """Where the host keeps its article: (kind, parts), the first to be tried first."""
        tiers: dict[str, list[int]] = {"article": [], "main": [], "content": []}
        held: dict[int, int] = {}
        for x in self.nodes:
            around = list(self.above(x))
            if any(y.kind in ("drop", "header") for y in around):
                continue
            if x.kind in tiers:
                tiers[x.kind].append(x.index)
            for y in around:
                held[y.index] = held.get(y.index, 0) + slots.get(x.index, 0)
        total = held.get(0, 0)
        # the innermost element that still holds most of the text, and isn't one of its repeated parts
        most = [k for k, n in held.items() if n > 0.6 * total and not any(x.again or x.group or x.tag in PARTS for x in self.above(self.nodes[k]))]
        tiers["densest"] = [max(most, key=lambda k: (len(list(self.above(self.nodes[k]))), -k))] if total and most else []
        return [(name, frozenset(parts)) for name, parts in tiers.items() if parts]

    def places(self, page: Node) -> list[Node | None]:
        """The wrapper's part for every part of a page's expression, in the order of its text. It depends on the form alone."""
        out: list[Node | None] = []

        def walk(x: Node, mine: Node | None) -> None:
            out.append(mine)
            at = {}
            if mine is not None and x.items:
                at = {id(b): a for a, b in best_alignment(mine.items, x.items) if a is not None and b is not None}
                for b in x.items:  # parts in another order
                    if id(b) not in at and (same := next((a for a in mine.items if a.key() == b.key()), None)) is not None:
                        at[id(b)] = same
            for b in x.items:
                walk(b, at.get(id(b)))

        walk(page, self.root)
        return out


def _chars(marks) -> int:
    return sum(m & ((1 << 24) - 1) for m in marks)


def main_text(page: str | None, plan: Plan | None) -> str:
    """The article's texts of a page, by what its host's wrapper says of the parts that they align with."""
    root = parse(page or "")
    top = expression(root)
    order: list[Node] = []

    def number(x: Node) -> None:
        x.index = len(order)
        order.append(x)
        for y in x.items:
            number(y)

    number(top)
    if plan is None:
        plan = Plan(Wrapper(top, 1, [_mark(page or "")]))
        at: list[Node | None] = list(order)
    else:
        form = top.form()
        if form not in plan.known:
            if len(plan.known) > 1000:
                plan.known.clear()
            plan.known[form] = plan.places(top)
        at = plan.known[form]

    # every text with whether all pages repeat it there, and (kind, part, heading, of links) of the elements around it
    found: list[tuple[str, bool, list[tuple[str, int, bool, bool]]]] = []

    todo: list[tuple[_Element, list[tuple[str, int, bool, bool]]]] = [(root, [])]
    while todo:
        element, around = todo.pop()
        if isinstance(element, tuple):
            text, leaf = element
            part = at[leaf.index] if leaf is not None else None
            found.append((text, part is not None and _mark(text) in plan.fixed.get(part.index, ()), around))
            continue
        own = _final(element.node)
        deep = element.depth > MAX_DEPTH  # its expression is that of the element above
        part = at[own.index] if not deep else None
        what = kind(element.tag, element.tokens) if part is None else part.kind
        around = [*around, (what, -1 if part is None else part.index, element.tag in HEADINGS, 2 * element.linked > element.chars)]
        leaf = next((x for x in own.items if x.tag == TEXT), None)
        todo += [((c[0], leaf), around) if isinstance(c, tuple) else (c, around) for c in reversed(element.children)]

    def kept(around: list[tuple[str, int, bool, bool]], base: int) -> bool:
        """Whether a text below a root belongs to the article; of headers in it, headings do."""
        kinds = [k for k, *_ in around]
        if "drop" in kinds or "header" in kinds[: base + 1]:
            return False
        return "header" not in kinds or any(h for _, _, h, _ in around[kinds.index("header") :])

    def menu(fixed: bool, around: list[tuple[str, int, bool, bool]]) -> bool:
        return fixed and any(k in plan.still and links for _, k, _, links in around)

    for name, parts in plan.tiers:
        out = []
        for text, fixed, around in found:
            base = next((k for k, (what, part, *_) in enumerate(around) if part in parts or what == name), -1)
            if base >= 0 and kept(around, base):
                still = fixed and base + 1 < len(around) and around[base + 1][1] in plan.still
                out.append((text, menu(fixed, around), fixed, still))
        if out:
            told = [k for k, x in enumerate(out) if not x[2]] if name == "densest" and plan.told else []
            around_it = lambda k: told and not told[0] < k < told[-1]
            return " ".join([x[0] for k, x in enumerate(out) if not (x[1] or x[3] and around_it(k))] or [x[0] for x in out])
    return " ".join(t for t, fixed, around in found if not menu(fixed, around) and kept(around, len(around) - 1))


# ------------------------------------------------------------------ over tables
def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


_WRAPPER = "host string, form string, wrapper string"


def _added(table: pa.Table) -> pa.Table:
    """Of wrappers of one host and form, one."""
    out = Wrapper()
    for text in table.column("wrapper"):
        out.align(Wrapper.load(text.as_py()))
    return pa.table({"host": table.column("host")[:1], "form": table.column("form")[:1], "wrapper": pa.array([out.dump()], pa.string())})


def _aligned(table: pa.Table) -> pa.Table:
    """Of wrappers of one host, one: aligned from the most pages to the fewest, and by form."""
    found = [Wrapper.load(x) for x in table.column("wrapper").to_pylist()]
    out = Wrapper()
    for _, _, w in sorted(((-w.pages, f, w) for f, w in zip(table.column("form").to_pylist(), found, strict=True)), key=lambda x: x[:2]):
        out.align(w)
    return pa.table({"host": table.column("host")[:1], "form": pa.array([out.form()], pa.string()), "wrapper": pa.array([out.dump()], pa.string())})


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, wrapper of every host. Tasks add up what they read by form; forms with very many rows, and hosts with very many forms, are salted."""
    given = Columns(pages)
    source = given.frame.select(host_of(given.text(url)).alias("host"), given.text(html).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Wrapper] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[n] for k in held], pa.string()) for n in (0, 1)] + [pa.array([w.dump() for w in held.values()], pa.string())], names=["host", "form", "wrapper"])
            held.clear()
            return out

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = Wrapper.of(page.as_py() or "")
                key = host, mine.form()
                held[key] = held[key].align(mine) if key in held else mine
                if len(held) >= HELD:
                    yield handed()
        yield handed()

    scratch = Scratch(pages.sparkSession, "wrappers")
    now, step = scratch.save(source.mapInArrow(tidied(read), _WRAPPER), "0"), 0

    def reduced(keys: list[str], salt: Column, together) -> None:
        nonlocal now, step
        while (most := now.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > 1:
            dealt = now.withColumn("salt", F.pmod(salt, F.lit(-(-most // GROUP))))
            step += 1
            now = scratch.save(dealt.groupBy(*keys, "salt").applyInArrow(together, _WRAPPER), str(step))
            scratch.drop(str(step - 1))

    reduced(["host", "form"], F.xxhash64("wrapper"), _added)
    reduced(["host"], F.xxhash64("form"), _aligned)
    return now.select("host", "wrapper")


#: Wrappers of all hosts are broadcast up to this many characters together; beyond that they are joined.
BROADCAST_CHARS = 8_000_000


def extract(pages: DataFrame, url: str = "url", html: str = "html", columns: list[str] | None = None, wrappers: DataFrame | None = None) -> DataFrame:
    """The columns with text, the main text, and n_chars, its code points."""
    given = Columns(pages, columns, ("text", "n_chars"))
    schema = given.schema(("text", "string"), ("n_chars", "long"))
    wrappers = infer(pages, url, html) if wrappers is None else wrappers
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    source = given.frame.select(*given.passing(), given.text(html).alias("html"), host_of(given.text(url)).alias("host"))
    shared = None
    if size <= BROADCAST_CHARS:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})  # its size is checked
    else:
        source = source.join(wrappers, "host", "left").select(*given.passing(), "html", F.col("wrapper").alias("host"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Plan | None] = {}
        for batch in batches:
            texts = []
            for page, name in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                name = name.as_py()
                if name not in known:
                    if len(known) > 256:
                        known.clear()
                    wrapper = shared.value.get(name) if shared is not None else name
                    known[name] = Plan(Wrapper.load(wrapper)) if wrapper else None
                texts.append(main_text(page.as_py(), known[name]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return given.named(source.mapInArrow(tidied(apply), schema))
