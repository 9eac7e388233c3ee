"""Main-text extraction by wrapper induction.

A page's DOM becomes a folded tree: sibling elements of equal label (tag, class, id, digits
blurred) and equal structure are one node, as the records of a list are in a wrapper.  The
commonest folded tree of a host, by distinct articles, is its wrapper; every other tree is
aligned with it by simple tree matching, the dynamic programme that maximises the pairs of
equally labelled nodes in order.  All nodes of the DOM take part, within articles and outside.

Aligned nodes whose text is the same wherever they occur are template; the others are slots.
The content is the part of the wrapper where the varying text is: from the root down, the
search follows the child that holds ``most`` of its node's varying text, and leaves out what
holds less than ``least`` of it, headings excepted.  It ends at an article or main element that it comes to;
where no child has enough for it to go on, such elements are the content if they hold half of
the varying text.  A page of a host with too few articles for a wrapper is read by its tags alone.  In what varies, menus,
headers, footers, sidebars, notices, adverts, forms and reader comments are told by tag, class,
id and role, since their text may vary as well.

A node is template only if ``support`` different articles have it, and a ``share`` of those that
could: the host's articles under the same outermost article or main element, or neither.  So
copies of a page keep its blocks, however many they are, and so does a node that few articles
have.  What an article is, for this count, is the text where a single page has most of its own.

Scale: a page is parsed once, in a map; its blocks go to the shared folder (no more than the
texts), and what is joined and counted is hashes of nodes.  Counts are of distinct articles by
host and node, combined map-side, so a host with a third of all pages is no larger than any
other; trees are aligned once each, exactly, in time that the product of their numbers of different
nodes bounds (``align``); a decision is one row for each distinct tree, joined with
the pages by host and tree, where adaptive execution splits what is hot.  No row grows with a
host's pages: a wrapper's counts are bounded by its nodes.

Defined results: null or empty html gives an empty text; a page of null or odd address belongs
to the host ''; markup that ends early or nests wrongly is read as browsers do, roughly; nesting
may be of any depth and a page of any length; repeated rows are extracted each; ties between
wrappers go to the larger hash; an empty table gives an empty one.  Kept columns come back as
they are, whatever their names, but for one named ``text``, whose place the result takes.
"""

from __future__ import annotations

import html as entities
import re
import tempfile
from collections import Counter, defaultdict
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if, column_list, pieces, quoted, unfold, with_fields

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody"
    " td tfoot th thead tr ul".split()
)
#: Tags whose text is never content.
_OUT = frozenset("head script style noscript template textarea select option button form fieldset input iframe object svg canvas nav aside footer title xmp noembed noframes menu dialog".split())
#: Words of classes, ids and roles that mark what surrounds content.
_AROUND = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar aside widget widgets ad ads"
    " advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice"
    " notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply"
    " replies respond discussion share sharing social related recommended recommendations pagination pager toolbar skip copyright"
    " complementary contentinfo search".split()
)
_ABOUT = frozenset("has have with no without open closed".split())
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSED_BY = {
    "p": _BLOCK - {"html", "head", "body"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
#: An implied end doesn't reach beyond these.
_WALL = {"p": frozenset("table td th button object li div section article main blockquote body aside nav header footer form".split()) , "li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"]), "head": frozenset()}
_OPENERS = {t: [x for x, by in _CLOSED_BY.items() if t in by] for t in _BLOCK | {"option"}}
_DIGITS = re.compile(r"\d+")


#: Different articles that make a host's pages worth aligning.
ENOUGH = 3
#: Tags that the search for the content goes down through.
_GROUPS = frozenset("html body div section main article center table tbody tr td".split())
_HEADING = re.compile(r"(?:h[1-6]|hgroup)(?:[.#]|$)")


def _tag_of(label: str) -> str:
    return re.split(r"[.#]", label, maxsplit=1)[0]


@lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[str, bool]:
    """Label, and whether class, id or role say that this surrounds content."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    label = tag + "".join(f"{sign}{_DIGITS.sub('0', found[k].strip())}" for k, sign in (("class", "."), ("id", "#")) if found.get(k))
    label = re.sub(r"[\s()/,]+", "_", label)
    if len(label) > 80:  # long class lists by their hash
        label = f"{tag}.~{xxhash.xxh3_64_hexdigest(label.encode('utf-8', 'surrogatepass'))}"
    if tag in ("html", "body", "main"):
        return label, False
    for token in " ".join(found.values()).split():
        names = {x.lower() for x in _NAMES.findall(token)}
        # an article or a page part is often said to have, or to lack, a sidebar or comments
        if names & _AROUND and not names & _ABOUT and (tag != "article" or token.lower() in _AROUND):
            return label, True
    return label, False


class Block:
    __slots__ = ("around", "article", "linked", "links", "main", "node", "text")

    def __init__(self, node: int, text: str, article: bool, main: bool, around: bool, links: int):
        self.node, self.text, self.article, self.main, self.around, self.links, self.linked = node, text, article, main, around, links, False


class Page:
    """A page's folded tree (``parents`` and ``labels``, in preorder) and its blocks of text in order."""

    __slots__ = ("blocks", "labels", "parents")

    def __init__(self, source: str | None):
        self.blocks: list[Block] = []
        raw = ([-1], [""])  # parents and labels of the block elements, in order
        if source:
            self._read(source, *raw)
        self._fold(*raw)
        self._link()

    def _read(self, source: str, parents: list[int], labels: list[str]) -> None:
        # of each open element: tag, node, in article, in main, out, surrounds
        stack = [("", 0, False, False, False, False)]
        opened: Counter = Counter()
        parts: list[str] = []
        links = at = anchors = 0

        def flush():
            nonlocal links
            if parts:
                if text := " ".join("".join(parts).split()):
                    _, node, article, main, out, around = stack[-1]
                    if not out:
                        self.blocks.append(Block(node, text, article, main, around, links))
                parts.clear()
            links = 0

        def close(to: int):
            nonlocal anchors
            if any(stack[k][0] in _BLOCK for k in range(to, len(stack))):
                flush()
            for k in range(to, len(stack)):
                opened[stack[k][0]] -= 1
                anchors -= stack[k][0] == "a"
            del stack[to:]

        size = len(source)
        while at < size:
            m = _TAG.search(source, at)
            text = source[at : m.start() if m else size]
            if text and not stack[-1][4]:
                text = entities.unescape(text) if "&" in text else text
                parts.append(text)
                if anchors:
                    links += len(text.strip())
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if m[0].startswith("<![CDATA[") and not stack[-1][4]:
                    parts.append(m[0][9:].removesuffix("]]>"))
                continue
            tag, rest = tag.lower(), m[3] if m[2] else m[6]
            if m[1] or m[4]:
                k = len(stack) - 1 if opened[tag] else 0
                while k:
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] in ("article", "table") and tag not in ("article", "main", "section", "div", "body", "html"):
                        break
                    k -= 1
                continue
            for opener in _OPENERS.get(tag, ()):
                k = len(stack) - 1 if opened[opener] else 0
                while k:
                    if stack[k][0] == opener:
                        close(k)
                        break
                    if stack[k][0] in _WALL[opener]:
                        break
                    k -= 1
            label, around = _marks(tag, rest) if "=" in rest else (tag, False)
            node = stack[-1][1]
            if tag in _BLOCK:
                flush()
                parents.append(stack[-1][1])
                labels.append(label)
                node = len(labels) - 1
            elif tag == "br":
                parts.append(" ")
            _, _, article, main, out, under = stack[-1]
            if tag in _VOID or rest.endswith("/") and tag in ("svg", "path"):
                continue
            here = tag == "article" and not under and not around
            around = under or around and not (article and ("header" in label or "title" in label)) or tag == "header" and not article
            stack.append((tag, node, article or here, main or tag == "main", out or tag in _OUT, around))
            opened[tag] += 1
            anchors += tag == "a"
            if tag in _RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
                stack.pop()
                opened[tag] -= 1
        while len(stack) > 1:
            close(len(stack) - 1)
        flush()

    def _fold(self, parents: list[int], labels: list[str]) -> None:
        """Siblings of equal label and structure become one node; children come after their parent."""
        below: list[dict[int, None]] = [{} for _ in labels]
        shapes: dict[tuple, int] = {}
        shape = [0] * len(labels)
        order: list[list[int]] = [[] for _ in labels]
        for i in range(1, len(labels)):
            order[parents[i]].append(i)
        for i in range(len(labels) - 1, -1, -1):
            for c in order[i]:
                below[i].setdefault(shape[c])
            shape[i] = shapes.setdefault((labels[i], *below[i]), len(shapes))
        self.parents, self.labels = [-1], [""]
        at, seen = [0] * len(labels), {}
        for i in range(1, len(labels)):
            key = (at[parents[i]], shape[i])
            if key not in seen:
                seen[key] = len(self.labels)
                self.parents.append(key[0])
                self.labels.append(labels[i])
            at[i] = seen[key]
        for block in self.blocks:
            block.node = at[block.node]

    def _link(self) -> None:
        """Marks the blocks of lists that are links, and other blocks that are."""
        top: list[int | None] = [None] * len(self.labels)
        for i in range(1, len(self.labels)):
            top[i] = top[self.parents[i]]
            if top[i] is None and _tag_of(self.labels[i]) in ("ul", "ol", "table", "dl"):
                top[i] = i
        links, whole = Counter(), Counter()
        for b in self.blocks:
            group = b.node if top[b.node] is None else top[b.node]
            links[group] += b.links
            whole[group] += len(b.text)
        for b in self.blocks:
            group = b.node if top[b.node] is None else top[b.node]
            b.linked = links[group] >= 0.8 * whole[group]

    def region(self) -> list[Block]:
        """The blocks that tags and words take for content."""
        for tag in ("article", "main"):
            if chosen := [b for b in self.blocks if getattr(b, tag) and not b.around]:
                return chosen
        return [b for b in self.blocks if not b.around and not b.linked]

    def subject(self) -> str:
        """The text that tells one article from another: the region's, where most of it is."""
        blocks = self.region()
        if blocks and not blocks[0].article and not blocks[0].main:
            mass = Counter()
            for b in blocks:
                mass[b.node] += len(b.text)
            inside = within(self.parents, descend(self.parents, self.labels, mass)[0])
            blocks = [b for b in blocks if inside[b.node]]
        return "\n".join(b.text for b in blocks)


def within(parents: list[int], roots: set[int]) -> list[bool]:
    """Of each node: whether it or a node above it is a root."""
    out = [0 in roots] * len(parents)
    for i in range(1, len(parents)):
        out[i] = i in roots or out[parents[i]]
    return out


def descend(parents: list[int], labels: list[str], mass: dict[int, int], most: float = 0.8, least: float = 0.1) -> tuple[set[int], str]:
    """Roots of the part of a tree where the mass is, and what told them.

    The search goes down by mass.  If it comes to the only outermost article (or, without one, main
    element), that is the place, and both told it; if such elements hold half of the mass and the search ended
    above them, or within one of several, tags did; else the search alone.
    """
    n = len(labels)
    whole = [mass.get(i, 0) for i in range(n)]
    below: list[list[int]] = [[] for _ in labels]
    for i in range(n - 1, 0, -1):
        whole[parents[i]] += whole[i]
        below[parents[i]].append(i)
    named = _named(parents, labels, whole)
    at, also = 0, set()
    while True:
        if named == {at}:
            return named, "both"
        best = max(below[at], key=lambda i: (whole[i], -i), default=None)
        if best is None or _tag_of(labels[best]) not in _GROUPS or whole[best] < most * whole[at] or not whole[at]:
            return (named, "tags") if named else ({at} | also, "wrapper")
        also |= {i for i in below[at] if i != best and (_HEADING.match(labels[i]) or whole[i] >= least * whole[at])}
        at = best


def _named(parents: list[int], labels: list[str], whole: list[int]) -> set[int]:
    """The outermost article elements if they hold half of the mass, else the main elements if these do."""
    for tag in ("article", "main"):
        under = [False] * len(labels)
        roots = set()
        for i in range(1, len(labels)):
            is_one = _tag_of(labels[i]) == tag
            under[i] = under[parents[i]] or is_one
            if is_one and not under[parents[i]]:
                roots.add(i)
        if roots and 2 * sum(whole[i] for i in roots) >= whole[0] > 0:
            return roots
    return set()


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def node_keys(parents: list[int], labels: list[str]) -> list[int]:
    """Of each node a hash of its path; equally labelled siblings are told by their number."""
    keys, seen = [0] * len(labels), Counter()
    for i in range(1, len(labels)):
        up = (parents[i], labels[i])
        keys[i] = _hash(f"{keys[parents[i]]}/{labels[i]}/{seen[up]}")
        seen[up] += 1
    return keys


#: Cells of a dynamic programme that are looped over; larger ones go by rows of arrays.  Both try all pairs.
_ALL = 1024
#: Bytes of worths of pairs that an alignment holds in memory; more go to a temporary file.
_HELD = 64 << 20
#: Cells of a programme's table that are held while its way back is told; larger ones are done again from rows kept on the way.
_CELLS = 1 << 24


def _heaviest(pairs: list[tuple[int, int, int]], width: int) -> tuple[int, list[tuple[int, int]]]:
    """Of (i, j, weight) the chain that rises in both and weighs most: prefix maxima over j in a binary indexed tree."""
    tree: list[tuple[int, int]] = [(0, -1)] * (width + 1)
    before, at = [-1] * len(pairs), 0
    order = sorted(range(len(pairs)), key=lambda n: (pairs[n][0], -pairs[n][1]))
    for n in order:
        _, j, weight = pairs[n]
        best, k = (0, -1), j
        while k:
            best = max(best, tree[k])
            k &= k - 1
        before[n], k = best[1], j + 1
        while k <= width:
            tree[k] = max(tree[k], (best[0] + weight, n))
            k += k & -k
    best, k = (0, -1), width
    while k:
        best = max(best, tree[k])
        k &= k - 1
    out, at = [], best[1]
    while at >= 0:
        out.append(pairs[at][:2])
        at = before[at]
    return best[0], out


class _Worths:
    """A number for each pair of two groups' kinds, row by row: an array, or a stretch of a file."""

    __slots__ = ("at", "file", "kind", "rows", "width")

    def __init__(self, rows: int, width: int, kind: np.dtype, file=None):
        self.width, self.kind, self.file, self.rows = width, kind, file, None
        if file is None:
            self.rows = np.zeros((rows, width), kind)
        else:
            self.at = file.seek(0, 2)
            file.truncate(self.at + rows * width * kind.itemsize)

    def put(self, row: int, values: np.ndarray) -> None:
        if self.file is None:
            self.rows[row] = values
        else:
            self.file.seek(self.at + row * self.width * self.kind.itemsize)
            self.file.write(values.astype(self.kind).tobytes())

    def row(self, row: int) -> np.ndarray:
        if self.file is None:
            return self.rows[row]
        self.file.seek(self.at + row * self.width * self.kind.itemsize)
        return np.frombuffer(self.file.read(self.width * self.kind.itemsize), self.kind)


class _Group:
    """The kinds of subtrees that one path of labels leads to in either tree, with their places; groups below by label."""

    __slots__ = ("below", "cells", "chain", "mine", "needed", "theirs", "worths")

    def __init__(self, mine: dict[int, int], theirs: dict[int, int], needed: bool):
        self.mine, self.theirs, self.needed = mine, theirs, needed
        self.below: dict[str, _Group] = {}
        self.cells, self.chain, self.worths = 0, None, None

    def single(self) -> bool:
        return len(self.mine) == len(self.theirs) == 1


class _Matching:
    """Simple tree matching of two trees, kind by kind: subtrees that are equal are one kind, told once."""

    def __init__(self, one: tuple[list[int], list[str]], other: tuple[list[int], list[str]]):
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        (self.code_a, self.below_a), (self.code_b, self.below_b) = (self._kinds(known, *tree) for tree in (one, other))
        self.file, self.free = None, _HELD
        self.groups = self._grouped()

    def _kinds(self, known: dict[tuple, int], parents: list[int], labels: list[str]) -> tuple[list[int], list[list[int]]]:
        below, code = [[] for _ in labels], [0] * len(labels)
        for i in range(1, len(labels)):
            below[parents[i]].append(i)
        for i in range(len(labels) - 1, -1, -1):
            key = (labels[i], tuple(code[c] for c in below[i]))
            if key not in known:
                known[key] = len(known)
                self.labels.append(key[0])
                self.kids.append(key[1])
                self.size.append(1 + sum(self.size[c] for c in key[1]))
            code[i] = known[key]
        return code, below

    def _between(self, a: int, b: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
        """How many children are equal at the start, and both lists without those that are so at the start and end."""
        x, y, start, end = self.kids[a], self.kids[b], 0, 0
        least = min(len(x), len(y))
        while start < least and x[start] == y[start]:
            start += 1
        while end < least - start and x[-1 - end] == y[-1 - end]:
            end += 1
        return start, x[start : len(x) - end], y[start : len(y) - end]

    def _by_label(self, kinds) -> dict[str, dict[int, int]]:
        found: dict[str, dict[int, int]] = {}
        for k in kinds:
            places = found.setdefault(self.labels[k], {})
            places.setdefault(k, len(places))
        return found

    def _grouped(self) -> list[_Group]:
        """All groups, one after that which it is below; what a pair's worth is isn't needed where the pair is sure."""
        a, b = self.code_a[0], self.code_b[0]
        groups = [_Group({a: 0}, {b: 0}, False)]
        for g in groups:
            if g.single():
                (a,), (b,) = g.mine, g.theirs
                _, x, y = self._between(a, b)
            else:
                x, y = ([c for k in side for c in self.kids[k]] for side in (g.mine, g.theirs))
            g.cells = len(x) * len(y)
            needed = g.needed or not (g.single() and g.cells == 1)
            theirs = self._by_label(y)
            for label, places in self._by_label(x).items():
                if label in theirs:
                    g.below[label] = _Group(places, theirs[label], needed)
            groups += g.below.values()
        return groups

    def _table(self, g: _Group) -> _Worths:
        kind = np.min_scalar_type(min(max(self.size[k] for k in side) for side in (g.mine, g.theirs)))
        taken = len(g.mine) * len(g.theirs) * kind.itemsize
        if taken <= self.free:
            self.free -= taken
            return _Worths(len(g.mine), len(g.theirs), kind)
        self.file = self.file or tempfile.TemporaryFile()
        return _Worths(len(g.mine), len(g.theirs), kind, self.file)

    def weigh(self) -> None:
        """The most nodes that are paired within each pair of a group, from the leaves up."""
        for g in reversed(self.groups):
            if not g.needed:
                continue
            g.worths = self._table(g)
            if g.single() or g.cells <= _ALL:
                for a, row in g.mine.items():
                    told = [self.match(g, a, b) for b in g.theirs]
                    g.worths.put(row, np.array([worth for worth, _ in told]))
                if g.single():
                    g.chain = told[0][1]
            else:
                self._weigh_rows(g)

    def _steps(self, g: _Group, columns: dict[str, tuple[list[int], list[int]]]):
        """The step from a row of a programme to the next; ``columns``: by label, those of children and these children's kinds."""
        places = {}
        for label, (at, kinds) in columns.items():
            if label in g.below:
                theirs = g.below[label].theirs
                all_of = len(at) == at[-1] - at[0] + 1  # slices are faster
                to, before = (slice(at[0], at[-1] + 1), slice(at[0] - 1, at[-1])) if all_of else (np.array(at), np.array(at) - 1)
                places[label] = g.below[label], to, before, np.array([theirs[k] for k in kinds])

        def step(row: np.ndarray, kind: int) -> np.ndarray:
            if self.labels[kind] not in places:
                return row
            h, to, before, theirs = places[self.labels[kind]]
            new = row.copy()
            new[to] = np.maximum(row[to], row[before] + h.worths.row(h.mine[kind])[theirs])
            return np.maximum.accumulate(new, out=new)

        return step

    def _weigh_rows(self, g: _Group) -> None:
        """Each kind of the first tree against all of the second at once: their programmes side by side in one row,
        each lifted above the one before, so that maxima don't pass from one to the next."""
        lift = 1 + max(self.size[b] for b in g.theirs)
        long = np.array([len(self.kids[b]) for b in g.theirs])
        base = np.repeat(np.arange(len(long)) * lift, long + 1)
        ends = np.cumsum(long + 1) - 1
        columns: dict[str, tuple[list[int], list[int]]] = {}
        at = 0
        for b in g.theirs:
            for k, q in enumerate(self.kids[b], at + 1):
                to, kinds = columns.setdefault(self.labels[q], ([], []))
                to.append(k)
                kinds.append(q)
            at += len(self.kids[b]) + 1
        step = self._steps(g, columns)
        for a, place in g.mine.items():
            row = base
            for p in self.kids[a]:
                row = step(row, p)
            g.worths.put(place, row[ends] - base[ends] + 1)

    def match(self, g: _Group, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """The most nodes that are paired in two subtrees, and the places of the children that are."""
        if a == b:
            return self.size[a], [(k, k) for k in range(len(self.kids[a]))]
        start, x, y = self._between(a, b)
        m, n = len(self.kids[a]), len(self.kids[b])
        chain = [(k, k) for k in range(start)] + [(k, n - m + k) for k in range(start + len(x), m)]
        total = 1 + sum(self.size[self.kids[a][k]] for k, _ in chain)
        if not x or not y:
            return total, chain
        both = Counter(self.labels[q] for q in y)
        both = sum(both[self.labels[p]] for p in x)
        if len(x) * len(y) == 1:
            more = [(0, 0)] if both else []
            most = self._worth(g, x[0], y[0]) if both and g.needed else 0
        elif len(x) * len(y) <= _ALL:
            most, more = self._looped(g, x, y)
        elif both * 2000 < len(x) * (4000 + len(y)):  # few pairs are of equal label
            most, more = self._sparse(g, x, y)
        else:
            most, more = self._by_rows(g, x, y)
        return total + most, chain + [(start + i, start + j) for i, j in more]

    def _worth(self, g: _Group, p: int, q: int) -> int:
        h = g.below[self.labels[p]]
        return h.worths.row(h.mine[p]).item(h.theirs[q])

    def _looped(self, g: _Group, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        best = [[0] * (len(y) + 1)]
        names = [self.labels[q] for q in y]
        for p in x:
            name, up, row = self.labels[p], best[-1], [0]
            if name in g.below:
                h = g.below[name]
                worths = h.worths.row(h.mine[p])
                for j, q in enumerate(y):
                    both = worths.item(h.theirs[q]) if names[j] == name else 0
                    row.append(max(up[j + 1], row[j], up[j] + both))
            best.append(row if len(row) > 1 else up)
        i, j, chain = len(x), len(y), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                chain.append((i, j))
        return best[-1][-1], chain

    def _sparse(self, g: _Group, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        places = defaultdict(list)
        for j, q in enumerate(y):
            places[self.labels[q]].append(j)
        return _heaviest([(i, j, self._worth(g, p, y[j])) for i, p in enumerate(x) for j in places.get(self.labels[p], ())], len(y))

    def _by_rows(self, g: _Group, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
        columns: dict[str, tuple[list[int], list[int]]] = {}
        for j, q in enumerate(y, 1):
            to, kinds = columns.setdefault(self.labels[q], ([], []))
            to.append(j)
            kinds.append(q)
        step = self._steps(g, columns)
        each = max(isqrt(len(x)) + 1, _CELLS // (len(y) + 1))
        kept = [np.zeros(len(y) + 1, np.int32)]
        row = kept[0]
        for i in range((len(x) - 1) // each * each):
            row = step(row, x[i])
            if (i + 1) % each == 0:
                kept.append(row)
        most, j, chain = None, len(y), []
        while kept:
            first = (len(kept) - 1) * each
            rows = [kept.pop()]
            for p in x[first : first + each]:
                rows.append(step(rows[-1], p))
            most = int(rows[-1][-1]) if most is None else most
            for i in range(len(rows) - 1, 0, -1):
                if j and rows[i][j] != rows[i - 1][j]:
                    j = int(np.searchsorted(rows[i], rows[i][j])) - 1
                    chain.append((first + i - 1, j))
        return most, chain

    def pairs(self) -> dict[int, int]:
        out, left = {}, [(0, 0, self.groups[0])]
        while left:
            i, j, g = left.pop()
            a, b = self.code_a[i], self.code_b[j]
            if a == b:  # equal subtrees, each in preorder
                out.update(zip(range(i, i + self.size[a]), range(j, j + self.size[a]), strict=True))
                continue
            out[i] = j
            chain = self.match(g, a, b)[1] if g.chain is None else g.chain
            for k, m in chain:
                p = self.below_a[i][k]
                left.append((p, self.below_b[j][m], g.below.get(self.labels[self.code_a[p]])))
        return out


def align(one: tuple[list[int], list[str]], other: tuple[list[int], list[str]]) -> dict[int, int]:
    """Simple tree matching of two trees (parents, labels): nodes of the first to nodes of the second.

    No matching that keeps order and parents pairs more nodes, however long the lists of children
    are: each programme tries all pairs of equal label.  Equal subtrees are weighed once; equal ones
    at both ends of two lists are paired at once, which no better matching can beat; long programmes
    go by rows of arrays, or over their pairs alone where few are of equal label.  Time is the product
    of the numbers of different nodes at most.  Worths of pairs beyond ``_HELD`` bytes go to a temporary file.
    """
    matching = _Matching(one, other)
    try:
        matching.weigh()
        return matching.pairs()
    finally:
        if matching.file:
            matching.file.close()


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


_SEEN = (
    "host string, tree string, parents array<int>, labels array<string>, article long,"
    " slots array<struct<node:int,hash:long,chars:long>>, blocks array<struct<node:int,text:string,around:boolean,linked:boolean,own:boolean>>"
)
_SLOT = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64())]))
_BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string()), ("around", pa.bool_()), ("linked", pa.bool_()), ("own", pa.bool_())]))


def _seen(batches):
    """Of each page: host, tree, hash of its subject, what each node holds, and its blocks."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), _SLOT, _BLOCKS]
    names = ["host", "tree", "parents", "labels", "article", "slots", "blocks"]
    for batch in pieces(batches, rows=500):
        rows = []
        for url, source in zip(column_list(batch, "url"), column_list(batch, "html"), strict=True):
            page = Page(source)
            texts, chars = defaultdict(list), Counter()
            for b in page.blocks:
                texts[b.node].append(b.text)
                chars[b.node] += 0 if b.around or b.linked and not (b.article or b.main) else len(b.text)
            own = {id(b) for b in page.region()}
            tree = xxhash.xxh3_128_hexdigest("\x02".join(f"{p} {x}" for p, x in zip(page.parents, page.labels, strict=True)).encode("utf-8", "surrogatepass"))
            slots = [{"node": k, "hash": _hash("\n".join(v)), "chars": chars[k]} for k, v in texts.items()]
            blocks = [{"node": b.node, "text": b.text, "around": b.around, "linked": b.linked, "own": id(b) in own} for b in page.blocks]
            rows.append((host_of(url), tree, page.parents, page.labels, _hash(page.subject()), slots, blocks))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("kept")), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["kept", *names])


def _keyed(batches):
    """Of each tree: its nodes' keys, those of the wrapper's nodes where they are aligned, and their roots' keys."""
    for batch in pieces(batches, rows=500):
        made = []
        for row in batch.to_pylist():
            tree, wrapper = (row["parents"], row["labels"]), (row["wrapper"]["parents"], row["wrapper"]["labels"])
            keys, goal = node_keys(*tree), node_keys(*wrapper)
            if tree != wrapper:
                for a, b in align(tree, wrapper).items():
                    keys[a] = goal[b]
            roots = [0] * len(keys)
            tags = [_tag_of(x) for x in row["labels"]]
            kind = [""] * len(keys)
            for i in range(1, len(keys)):  # the outermost article, else the outermost main element
                roots[i], kind[i] = roots[row["parents"][i]], kind[row["parents"][i]]
                if kind[i] != "article" and tags[i] == "article" or not kind[i] and tags[i] == "main":
                    roots[i], kind[i] = keys[i], tags[i]
            made.append((keys, roots, tree == wrapper))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("host", "tree", "parents", "labels")), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.bool_())], names=["host", "tree", "parents", "labels", "keys", "roots", "whole"])


def _regions(batches):
    """Of each wrapper: the keys of the roots of its content, and whether their tag says so."""
    for batch in pieces(batches, rows=500):
        roots, told = [], []
        for row in batch.to_pylist():
            at = {k: i for i, k in enumerate(row["keys"])}
            found, said = descend(row["parents"], row["labels"], {at[x["key"]]: x["chars"] for x in row["mass"] or []})
            roots.append([row["keys"][i] for i in found] if row["mass"] else [])
            told.append(said)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roots, pa.list_(pa.int64())), pa.array(told, pa.string())], names=["host", "content", "told"])


def _decided(batches):
    """Of each tree: which nodes are template, and which of the others are in the content."""
    for batch in pieces(batches, rows=500):
        fixed, content = [], []
        for row in batch.to_pylist():
            still, roots = set(row["still"] or ()), set(row["content"] or ())
            inside = within(row["parents"], {i for i, k in enumerate(row["keys"]) if k in roots})
            fixed.append([i in still for i in range(len(inside))])
            content.append([x and i not in still for i, x in enumerate(inside)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fixed, pa.list_(pa.bool_())), pa.array(content, pa.list_(pa.bool_())), batch.column(batch.schema.get_field_index("told"))], names=["host", "tree", "fixed", "inside", "told"])


def induce(seen: DataFrame, support: int = 5, share: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """(host, tree, fixed, inside, told) of each tree of a host of ``ENOUGH`` different articles.

    ``seen``: host, tree, parents, labels, article, slots of each page.  ``fixed`` and ``inside``
    tell of each node whether it is template, and whether it is content; ``told``, what told the
    content's place (``descend``).
    """
    scratch = scratch or Scratch(seen.sparkSession, "html")
    known = scratch.save(seen.select("host", "tree", "article", "slots").distinct(), "known")
    hosts = known.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("articles"))
    hosts = broadcast_if(scratch.save(hosts.where(F.col("articles") >= ENOUGH).select("host"), "hosts"), F.lit(1), 100_000)
    counts = known.join(hosts, "host", "left_semi").select("host", "tree", "article").distinct().groupBy("host", "tree").agg(F.count("*").alias("articles"))
    shapes = seen.join(hosts, "host", "left_semi").select("host", "tree", "parents", "labels").dropDuplicates(["host", "tree"])
    trees = scratch.save(shapes.join(counts, ["host", "tree"]), "trees")
    wrappers = trees.groupBy("host").agg(F.max_by(F.struct("parents", "labels"), F.struct("articles", "tree")).alias("wrapper"))
    wrappers = broadcast_if(scratch.save(wrappers, "wrappers"), F.size("wrapper.parents"), 1_000_000)
    keyed = trees.join(wrappers, "host").select("host", "tree", "parents", "labels", "wrapper").mapInArrow(_keyed, "host string, tree string, parents array<int>, labels array<string>, keys array<long>, roots array<long>, whole boolean")
    keyed = scratch.save(keyed, "keyed")
    small = broadcast_if(keyed.select("host", "tree", "keys", "roots"), F.size("keys"), 1_000_000)
    slots = F.transform("slots", lambda s: F.struct(F.get("keys", s["node"]).alias("key"), F.get("roots", s["node"]).alias("root"), s["hash"].alias("hash"), s["chars"].alias("chars")))
    nodes = known.join(small, ["host", "tree"]).select("host", "article", F.inline(slots))
    # one row for each article that has the node, however many pages and trees show it
    held = nodes.groupBy("host", "key", "article").agg(F.min("root").alias("root"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.max("chars").alias("chars"))
    held = held.groupBy("host", "key").agg(F.min("root").alias("root"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("chars").alias("chars"), F.count("*").alias("articles"))
    could = nodes.select("host", "root", "article").distinct().groupBy("host", "root").agg(F.count("*").alias("could"))
    still = (F.col("lo") == F.col("hi")) & (F.col("articles") >= support) & (F.col("articles") >= share * F.col("could"))
    stats = scratch.save(held.join(could, ["host", "root"]).select("host", "key", "chars", still.alias("still")), "stats")
    # a wrapper's nodes only: no more than one tree has
    whole = keyed.where("whole").select("host", "parents", "labels", "keys")
    mass = whole.select("host", F.explode("keys").alias("key")).join(stats.where("not still and chars > 0"), ["host", "key"])
    mass = mass.groupBy("host").agg(F.collect_list(F.struct("key", "chars")).alias("mass"))
    regions = scratch.save(whole.join(mass, "host", "left").mapInArrow(_regions, "host string, content array<long>, told string"), "regions")
    gone = keyed.select("host", "tree", F.posexplode("keys").alias("pos", "key")).join(stats.where("still").select("host", "key"), ["host", "key"])
    gone = gone.groupBy("host", "tree").agg(F.collect_list("pos").alias("still"))
    regions = broadcast_if(regions, F.size("content") + 1, 1_000_000)
    both = keyed.join(gone, ["host", "tree"], "left").join(regions, "host").select("host", "tree", "parents", "keys", "still", "content", "told")
    return both.mapInArrow(_decided, "host string, tree string, fixed array<boolean>, inside array<boolean>, told string")


def _joined(test) -> "F.Column":
    return F.array_join(F.transform(F.filter("blocks", test), lambda b: b["text"]), "\n")


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), support: int = 5, share: float = 0.5, scratch: Scratch | None = None, told: str | None = None) -> DataFrame:
    """``keep`` columns and ``text``, the main text of each page.

    ``told`` names a column that says what found it: ``wrapper``, the search by varying text; ``both``, the
    search, at an element that its tag names too; ``tags``, such elements where the search was in doubt;
    ``page``, the page's own tags, without a wrapper or where it finds nothing.
    """
    scratch = scratch or Scratch(pages.sparkSession, "html")
    keep = tuple(c for c in keep if c != "text")
    kept = F.struct(*([F.col(quoted(c)).alias(c) for c in keep] or [F.lit(0).alias("none")]))
    rows = pages.select(kept.alias("kept"), "url", "html")
    seen = scratch.save(rows.mapInArrow(_seen, with_fields(rows.select("kept").schema, _SEEN)), "seen")
    decided = scratch.save(induce(seen, support, share, scratch), "decided")
    scratch.drop("known", "hosts", "trees", "wrappers", "keyed", "stats", "regions")
    decided = broadcast_if(decided, F.size("fixed"), 2_000_000)
    joined = seen.select("kept", "host", "tree", "blocks").join(decided, ["host", "tree"], "left")
    on = lambda name, b: F.coalesce(F.get(name, b["node"]), F.lit(False))
    wrapped = _joined(lambda b: on("inside", b) & ~b["around"] & (F.coalesce(F.col("told") != "wrapper", F.lit(False)) | ~b["linked"]))
    # a page that has nothing where its host has its content is read by its tags
    plain = _joined(lambda b: b["own"] & ~on("fixed", b))
    found = joined.select("kept", F.when(wrapped != "", wrapped).otherwise(plain).alias("text"), F.when(wrapped != "", F.col("told")).otherwise("page").alias("told"))
    return unfold(found, [*keep, "text"], *([F.col("told").alias(told)] if told else []))


def report(pages: DataFrame, **options) -> DataFrame:
    """The contract's row of each page, and what decided it."""
    return extract(pages, told="decided", **options).withColumn("n_chars", F.length("text").cast("long"))
