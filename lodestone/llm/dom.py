"""A small DOM of block elements and text blocks, and simple tree matching of two of them.

Nothing here recurses, so nesting may be of any depth. A node's shape (a hash of its tags and theirs below it) stands for it in the
matching: weights depend on shapes alone, so they are found once for each pair of shapes that differ, and children with
equal shapes at both ends of two lists are paired at once. Memory of an alignment grows with the longer list times the
root of the shorter one.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import xxhash

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content is not markup, and elements without content.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand inside a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements of which an open one ends where one of its own kind begins, up to the given ancestors.
CLOSED_BY = {"p": None, "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "thead": ("table",), "tbody": ("table",)}
#: Elements and names of classes, ids and roles that hold no article text.
APART = frozenset("nav footer aside form script style head noscript template iframe select button menu dialog svg object canvas fieldset textarea title xmp noembed noframes".split())
_APART_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|side|ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|commentlist|replies|reply|respond|disqus|discussion|widget|popup|modal|overlay|paywall|toolbar|pagination|pager|search|skip|masthead|complementary|contentinfo|navigation|dialog)(?:$|[\s_-])",
    re.I,
)


@dataclass(slots=True)
class Node:
    tag: str
    apart: bool = False
    kids: list["Node"] = field(default_factory=list)
    text: str = ""
    size: int = 1
    shape: int = 0
    height: int = 0


def _apart(tag: str, attrs: str, inside: bool) -> bool:
    if tag in APART or tag == "header" and not inside:
        return True
    if attrs and tag not in ("html", "body", "article", "main"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I) or name in ("class", "id", "role") and _APART_NAME.search(value):
                return True
    return False


def parse(page: str) -> Node:
    """The tree of a page; inline elements vanish in their block, text blocks are leaves with tag '#text'."""
    root = Node("html")
    stack, pieces, at, article, opened = [root], [], 0, 0, Counter()

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                stack[-1].kids.append(Node("#text", stack[-1].apart, text=text))
            pieces.clear()

    def close(k: int) -> None:
        nonlocal article
        flush()
        article -= sum(n.tag in ("article", "main") for n in stack[k:])
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    for t in iter(lambda: _TOKEN.search(page, at), None):
        pieces.append(page[at : t.start()])
        at = t.end()
        tag = (t[2] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if t[1]:
            if tag in INLINE:
                if tag != "br":
                    continue
                pieces.append(" ")
                continue
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag == "br" or tag == "img":
            pieces.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in INLINE and not _apart(tag, t[3], True):
            continue
        if tag in INLINE:  # an inline element to leave out: up to its end
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else at
            pieces.append(" ")
            continue
        flush()
        if stack[-1].tag == "p" and tag not in VOID:
            close(len(stack) - 1)
        if tag in CLOSED_BY and opened[tag] > 0:
            stop = CLOSED_BY[tag] or ()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in stop or tag == "p":
                    break
        if tag in VOID:
            continue
        node = Node(tag, stack[-1].apart or _apart(tag, t[3], article > 0))
        stack[-1].kids.append(node)
        stack.append(node)
        opened[tag] += 1
        article += tag in ("article", "main")
    pieces.append(page[at:])
    close(1)
    _measure(root)
    return root


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.kids))
    return out


def _measure(root: Node) -> None:
    """Sizes, heights and shapes, from the leaves up."""
    for n in reversed(preorder(root)):
        n.size = 1 + sum(k.size for k in n.kids)
        n.height = 1 + max((k.height for k in n.kids), default=-1)
        n.shape = xxhash.xxh3_64_intdigest(f"{n.tag}({','.join(map(str, (k.shape for k in n.kids)))})")


#: Weights of pairs of shapes, kept from page to page.
_WEIGHTS: dict[tuple[int, int], int] = {}
_MANY = 1_000_000


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]]) -> None:
    """Simple tree matching: adds the pairs of the largest order-keeping match of two trees with equal roots."""
    if len(_WEIGHTS) > _MANY:
        _WEIGHTS.clear()
    _weigh(a, b)
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.kids and y.kids:
            todo.extend(reversed(_aligned(x.kids, y.kids)))


def _known(a: Node, b: Node) -> int | None:
    """The weight of two nodes; None if it has to be found."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.size
    if not a.kids or not b.kids:
        return 1
    return _WEIGHTS.get((a.shape, b.shape))


def _weigh(a: Node, b: Node) -> None:
    """Finds the weights of all pairs of shapes that the match of a and b asks for, from the leaves up."""
    todo, found = [(a, b)], {}
    while todo:
        x, y = todo.pop()
        if (x.shape, y.shape) in found or _known(x, y) is not None:
            continue
        found[x.shape, y.shape] = (x, y)
        i, n, m = _ends(x.kids, y.kids)
        left = {k.shape: k for k in x.kids[i:n]}
        right = {k.shape: k for k in y.kids[i:m]}
        todo.extend((p, q) for p in left.values() for q in right.values() if p.tag == q.tag)
    for x, y in sorted(found.values(), key=lambda p: p[0].height + p[1].height):
        i, n, m = _ends(x.kids, y.kids)
        same = sum(k.size for k in x.kids[:i]) + sum(k.size for k in x.kids[n:])
        _WEIGHTS[x.shape, y.shape] = 1 + same + _Table(x.kids[i:n], y.kids[i:m]).total


def _ends(a: list[Node], b: list[Node]) -> tuple[int, int, int]:
    """(i, n, m): a[:i] and b[:i], and a[n:] and b[m:], have equal shapes pair by pair; no pairing of them is better."""
    i, n, m = 0, len(a), len(b)
    while i < min(n, m) and a[i].shape == b[i].shape:
        i += 1
    while n > i and m > i and a[n - 1].shape == b[m - 1].shape:
        n, m = n - 1, m - 1
    return i, n, m


class _Table:
    """The best order-keeping pairing of two lists of nodes; rows of its table are kept at every step-th place and found again between."""

    def __init__(self, a: list[Node], b: list[Node]):
        self.a, self.b = a, b
        kinds = {k.shape: k for k in b}
        self.kinds, place = list(kinds.values()), {s: i for i, s in enumerate(kinds)}
        self.at, self.rows = np.array([place[k.shape] for k in b], np.int64), {}
        self.step = isqrt(len(a)) + 1
        row, self.kept = np.zeros(len(b) + 1, np.int64), {len(a): np.zeros(len(b) + 1, np.int64)}
        for p in range(len(a) - 1, -1, -1) if b else ():
            row = self._row(p, row)
            if p % self.step == 0:
                self.kept[p] = row
        self.total = int(row[0])

    def _weights(self, p: int) -> np.ndarray:
        x = self.a[p]
        if x.shape not in self.rows:
            self.rows[x.shape] = np.array([_known(x, k) for k in self.kinds], np.int64)[self.at]
        return self.rows[x.shape]

    def _row(self, p: int, below: np.ndarray) -> np.ndarray:
        w = self._weights(p)
        out = below.copy()
        out[:-1] = np.maximum(below[:-1], np.where(w > 0, below[1:] + w, 0))
        return np.maximum.accumulate(out[::-1])[::-1]

    def pairs(self) -> list[tuple[Node, Node]]:
        out, p, q, block = [], 0, 0, {}
        while p < len(self.a) and q < len(self.b):
            if p not in block or p + 1 not in block:
                end = min(len(self.a), (p // self.step + 1) * self.step)
                block = {end: self.kept[end]}
                for k in range(end - 1, p - 1, -1):
                    block[k] = self._row(k, block[k + 1])
            w = int(self._weights(p)[q])
            if w and block[p][q] == block[p + 1][q + 1] + w:
                out.append((self.a[p], self.b[q]))
                p, q = p + 1, q + 1
            elif block[p][q] == block[p + 1][q]:
                p += 1
            else:
                q += 1
        return out


def _aligned(a: list[Node], b: list[Node]) -> list[tuple[Node, Node]]:
    i, n, m = _ends(a, b)
    return [*zip(a[:i], b[:i], strict=True), *_Table(a[i:n], b[i:m]).pairs(), *zip(a[n:], b[m:], strict=True)]
