"""Main text of web pages: site style trees, whose branches count by entropy, and what pages declare about their parts."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, mix, sliced, stored

#: The base of what weighs an element's own importance against that of the elements below it: its power by the number of styles.
GAMMA = 0.9
#: Elements that are below this importance, with all that is in them, are noise, where at least so many pages of a host and this share of them have the element.
THRESHOLD, LEAST_PAGES, LEAST_SHARE = 0.3, 5, 0.02
#: What noise still weighs where the node with the most text is sought, so that copies of a long article outweigh a short menu.
LEAST_WEIGHT = 0.1
#: Features that a task tallies before it hands them on (half as many that come to a place are merged at once), characters that count as one at least, and bytes of pages for each place that they go to.
TALLY, FEATURE_CHARACTERS, PLACE_BYTES = 1 << 21, 8, 16 << 20
#: Places among which the features of a leaf are dealt; the fewer, the less often its hash is sent.
LEAF_PLACES = 4
#: Hosts that have more than one page in so many are dealt to so many places.
HOT_SHARE, SALTS = 256, 64
#: Noise of all trees, of some 24 bytes each, up to which they are sent to every task; beyond, pages and trees meet by host.
BROADCAST_NODES = 1 << 18
#: Of those, what a task holds as maps at once, with one host's more.
KEPT_NODES = 1 << 16

#: HTML's elements by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
HEAD = set("base link meta noscript script style template title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: A start tag ends these, up to what bounds them.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "tbody", "tfoot"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}}
SCOPES = set("html table td th caption object template".split())
#: Attributes that say how an element is shown; elements that differ in them are not one in the tree.
DISPLAY = set("align background bgcolor border cellpadding cellspacing class color face height nowrap size style valign width".split())

HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p", "blockquote", "pre"}

#: Elements, roles and words in names of classes and ids that declare furniture, and those that declare the article.
FURNITURE_TAGS = set("aside button canvas datalist dialog embed fieldset footer form head iframe input legend map menu nav noembed noframes noscript object script search select style svg template textarea title xmp audio video".split())
FURNITURE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
FURNITURE_WORDS = set(
    "ad ads adv advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs comment comments commenting consent cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notification overlay pagination pager paywall popup promo promotion recommended related replies reply respond responses search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
READERS_WORDS = set("comment comments commenting discussion disqus replies reply respond responses".split())
MAIN_WORDS = set("article content entry main post story".split())
IGNORED_FIRST = set("has is js no with".split())

#: Elements open at once, as in browsers; what is deeper is text of the last.
DEPTH = 512
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)>""")
#: A tag without its brackets that ends where its text ends, whatever follows.
_SURE = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|=(?!\s*+["'])|["'])*+)""")
#: Tags up to this length are kept as they are met, so many of them, and so many nodes of style trees.
TAG_LENGTH, KEPT_TAGS, KEPT_STYLES = 128, 1 << 14, 1 << 17
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSES = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_OUT = ("furniture", "weak", "readers")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _declared(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """What an element declares: furniture, weak (furniture, unless the article is in it), readers (comments), article, main, content or nothing."""
    if tag in FURNITURE_TAGS:
        return "weak" if tag in ("form", "fieldset") else "furniture"
    if tag == "header" and not in_article:
        return "weak"
    if not attributes:
        return tag if tag in ("article", "main") else ""
    role = attributes.get("role", "").lower()
    if role in FURNITURE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "").lower()):
        return "furniture"
    # ids of headings and inline elements are made from their text
    names = attributes.get("class", "") + (" " + attributes.get("id", "") if tag not in INLINE and tag not in HEADINGS else "")
    named = [[w.lower() for w in _WORDS.findall(token)] for token in names.split()]
    ends = {w for words in named if words and words[0] not in IGNORED_FIRST for w in (words[0], words[-1])}
    if ends & READERS_WORDS:
        return "readers"
    if tag in ("article", "main") or role in ("article", "main"):
        return role if role in ("article", "main") else tag
    if attributes.get("itemprop") == "articleBody":
        return "article"
    if tag in ("html", "body"):
        return ""
    if ends & FURNITURE_WORDS or not in_article and any(words and words[-1] == "header" and words[0] not in MAIN_WORDS for words in named):
        return "weak"
    return "content" if ends & MAIN_WORDS else ""


class _Tag:
    """What a tag says by itself: is it an end tag, the name with display attributes, what is declared outside and inside of articles, an image's or a link's address."""

    __slots__ = ("closes", "tag", "name", "outside", "inside", "image", "link")

    def __init__(self, closes: str, tag: str, rest: str):
        self.closes, self.tag = bool(closes), tag.lower()
        if closes:
            return
        tag = self.tag
        attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /\n\t\r\f") else {}
        self.outside = self.inside = _declared(tag, attributes, False)
        if self.outside == "weak":
            self.inside = _declared(tag, attributes, True)
        self.image, self.link = attributes.get("src") if tag == "img" else None, attributes.get("href") if tag == "a" else None
        self.name = tag + "".join(f" {k}={' '.join(sorted(set(v.split())))}" for k, v in sorted(attributes.items()) if k in DISPLAY) if attributes else tag


class _Tags(dict):
    """Tags by their text between the brackets, as they are met; None for what is no tag or ends elsewhere."""

    def __missing__(self, text: str) -> _Tag | None:
        if len(self) > KEPT_TAGS:
            self.clear()
        m = _SURE.fullmatch(text)
        self[text] = out = _Tag(*m.groups()) if m else None
        return out


_TAGS = _Tags()


class Page:
    """The elements of a page as a tree; inline elements that declare nothing belong to the text around them.

    Nodes are numbered in page order: ``tag``, ``name`` (with display attributes), ``said`` (see ``_declared``),
    ``parent``, ``parts``, the texts and the numbers of the nodes in it, and ``refs``, the images and links in those
    texts. Text beside elements is a node ``#text`` of its own; these come last. Tags that are left open or do not match
    end as browsers end them, but for elements that are moved.
    """

    def __init__(self, source: str):
        self.tag, self.name, self.said, self.parent, self.parts = ["#page"], ["#page"], [""], [-1], [[]]
        # an open block: its tag, its node, what is open inline in it, and how often; open blocks are counted up to the next bound of scope
        self._open, self._scopes = [["#page", 0, [], {}]], [{}]
        self._articles = 0
        self.refs: dict[int, list[tuple[int, str]]] = {}
        self._read(source)
        self._runs()

    def _read(self, source: str) -> None:
        at, n, bracket, find = 0, len(source), 0, source.find
        while at < n:
            i = find("<", at)
            if i < 0:
                self._text(source[at:])
                return
            if i > at:
                self._text(source[at:i])
            if bracket < i:
                bracket = find(">", i)
                if bracket < 0:
                    bracket = n + TAG_LENGTH
            # most tags end at the next bracket, and were met before
            if bracket - i <= TAG_LENGTH and (it := _TAGS[source[i + 1 : bracket]]):
                at = bracket + 1
            else:
                then = source[i + 1 : i + 2]
                if source.startswith("<!--", i):
                    end = find("-->", i + 4)
                    at = n if end < 0 else end + 3
                    continue
                if then in ("!", "?") or then == "/" and not ((letter := source[i + 2 : i + 3]).isascii() and letter.isalpha()):
                    end = find(">", i)
                    at = n if end < 0 else end + 1
                    continue
                if then != "/" and not (then.isascii() and then.isalpha()):
                    self._text("<")
                    at = i + 1
                    continue
                if not (m := _TAG.match(source, i)):
                    return  # a tag without an end swallows the rest
                at, it = m.end(), _Tag(*m.groups())
            if it.closes:
                self._end(it.tag)
                continue
            self._start(it)
            if it.tag in RAW:
                close = _CLOSES[it.tag].search(source, at)
                at = close.start() if close else n

    def _node(self) -> int:
        top = self._open[-1]
        return top[2][-1][1] if top[2] else top[1]

    def _text(self, text: str) -> None:
        top = self._open[-1]
        self.parts[top[2][-1][1] if top[2] else top[1]].append(html.unescape(text) if "&" in text else text)

    def _ref(self, kind: str, to: str) -> None:
        node = self._node()
        self.refs.setdefault(node, []).append((len(self.parts[node]), f"\x00{kind} {to}"))
        self.parts[node].append("")

    def _runs(self) -> None:
        """Text beside elements, with its images and links, becomes a node of its own."""
        for i in self.around():
            parts, refs = self.parts[i], dict(self.refs.get(i, ()))
            if not refs and not any(isinstance(p, str) and p.strip() for p in parts):
                continue
            self.refs.pop(i, None)
            self.parts[i], run, found = [], [], []
            for k, p in enumerate([*parts, -1]):
                if isinstance(p, str):
                    found += [(len(run), refs[k])] if k in refs else []
                    run.append(p)
                    continue
                if found or any(t.strip() for t in run):
                    self.parts[i].append(self._append("#text", "#text", "", i, run))
                    if found:
                        self.refs[len(self.tag) - 1] = found
                else:
                    self.parts[i] += run
                self.parts[i] += [p] if p >= 0 else []
                run, found = [], []

    def around(self) -> list[int]:
        """The nodes that have nodes in them, in page order."""
        return sorted(set(self.parent))[1:]

    def _append(self, tag: str, name: str, said: str, parent: int, parts: list) -> int:
        self.tag.append(tag)
        self.name.append(name)
        self.said.append(said)
        self.parent.append(parent)
        self.parts.append(parts)
        return len(self.tag) - 1

    def _add(self, tag: str, name: str, said: str) -> int:
        parent = self._node()
        node = self._append(tag, name, said, parent, [])
        self.parts[parent].append(node)
        return node

    def _pop(self) -> None:
        tag, node, *_ = self._open.pop()
        self._articles -= self.said[node] in ("article", "main")
        if tag in SCOPES:
            self._scopes.pop()
        self._scopes[-1][tag] -= 1

    def _close(self, tags: set[str], bounds: set[str] = frozenset()) -> None:
        """End the innermost open block of ``tags``, if no scope or bound lies between."""
        scope = self._scopes[-1]
        for t in tags:
            if scope.get(t):
                break
        else:
            return
        for block in reversed(self._open):
            if block[0] in tags:
                while self._open[-1] is not block:
                    self._pop()
                self._pop()
                return
            if block[0] in bounds or block[0] in SCOPES:
                return

    def _start(self, it: _Tag) -> None:
        tag, scope = it.tag, self._scopes[-1]
        if scope.get("head") and tag not in HEAD:
            self._close({"head"})
        if tag in ENDS_P and scope.get("p"):
            self._close({"p"})
        if tag in ENDS:
            if tag in ("tr", "thead", "tbody", "tfoot") or tag in ("td", "th"):
                self._leave_cell(ENDS[tag])
            else:
                self._close(ENDS[tag], BOUNDS.get(tag, frozenset()))
        if tag in VOID:
            if it.image:
                self._ref("image", it.image)
            if tag != "wbr" and tag not in INLINE:
                self._text(" ")
            return
        said = it.inside if self._articles > 0 else it.outside
        if tag in INLINE:
            top, here = self._open[-1], self._node()
            top[2].append((tag, self._add(tag, it.name, said) if said in _OUT and self.said[here] not in _OUT else here))
            top[3][tag] = top[3].get(tag, 0) + 1
            if it.link:
                self._ref("link", it.link)
            return
        if len(self._open) >= DEPTH:
            self._text(" ")
            return
        self._articles += said in ("article", "main")
        node = self._add(tag, it.name, said)
        self._open.append([tag, node, [], {}])
        scope = self._scopes[-1]
        scope[tag] = scope.get(tag, 0) + 1
        if tag in SCOPES:
            self._scopes.append({})

    def _leave_cell(self, tags: set[str]) -> None:
        """End open cells, rows and groups of the innermost table."""
        while len(self._open) > 1 and self._open[-1][0] not in ("table", "template", "html"):
            at = next((i for i in range(len(self._open) - 1, max(0, len(self._open) - 64), -1) if self._open[i][0] in tags or self._open[i][0] == "table"), 0)
            if not at or self._open[at][0] == "table":
                return
            while len(self._open) > at:
                self._pop()

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            top = self._open[-1]
            if top[3].get(tag):
                while True:
                    last = top[2].pop()[0]
                    top[3][last] -= 1
                    if last == tag:
                        return
            return
        if tag in ("body", "html"):
            return
        if tag == "br" or tag == "p" and not self._scopes[-1].get("p"):
            self._text(" ")
            return
        if tag in SCOPES:
            # its own scope is the innermost one, or one further out
            at = next((i for i in range(len(self._open) - 1, 0, -1) if self._open[i][0] in SCOPES or self._open[i][0] == tag), 0)
            while at and self._open[at][0] != tag and (tag == "table" and self._open[at][0] in ("td", "th", "caption")):
                at = next((i for i in range(at - 1, 0, -1) if self._open[i][0] in SCOPES), 0)
            if at and self._open[at][0] == tag:
                while len(self._open) > at:
                    self._pop()
            return
        self._close({tag})

    def furniture(self) -> list[bool]:
        """Of each node, does it or a node around it declare to be furniture? An article inside another is one of its readers' comments.

        Weak declarations (names of classes, forms, headers) do not hold for what has all the page's articles or main
        parts in it, and for none if nothing else were left.
        """
        n = len(self.tag)
        strict = self._out([s in _OUT for s in self.said])
        if any(s in ("article", "main") and not o for s, o in zip(self.said, strict, strict=True)):
            return strict
        holds = [s in ("article", "main") for s in self.said]
        for i in range(n - 1, 0, -1):
            if holds[i] and self.said[i] not in ("furniture", "readers"):
                holds[self.parent[i]] = True
        if holds[0]:
            return self._out([s in ("furniture", "readers") or s == "weak" and not h for s, h in zip(self.said, holds, strict=True)])
        if any(not o and any(isinstance(p, str) and p.strip() for p in parts) for o, parts in zip(strict, self.parts, strict=True)):
            return strict
        return self._out([s in ("furniture", "readers") for s in self.said])

    def _out(self, own: list[bool]) -> list[bool]:
        n = len(own)
        out, article = [False] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            out[i] = own[i] or out[p] or self.said[i] == "article" and article[p]
            article[i] = article[p] or self.said[i] == "article"
        return out


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_MASK, _ODD = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed odd multipliers


def _joined(a: int, b: int) -> int:
    """A hash of a hash and a number."""
    x = ((a ^ (a >> 29)) * _ODD[2] + b * _ODD[0] + 1) & _MASK
    x = ((x ^ (x >> 30)) * _ODD[1]) & _MASK
    return x ^ (x >> 31)


class _Styles(dict):
    """A style of an element, and the elements in it, by the element and the sequence of names in it, as they are met."""

    def __init__(self):
        self.size = 0

    def __missing__(self, key: tuple[int, tuple[str, ...]]) -> tuple[int, list[int]]:
        element, names = key
        style = _joined(element, _hash(*names) & _MASK)
        out = style, [_joined(style, place) for place in range(len(names))]
        if self.size > KEPT_STYLES:
            self.clear()
            self.size = 0
        if len(names) <= KEPT_STYLES:
            self[key] = out
            self.size += 1 + len(names)
        return out


def _styled(page: Page, root: int, styles: _Styles) -> tuple[list[int], list[int], list[list[int]]]:
    """(element, style in it, nodes in it) of each node of a page in its host's style tree.

    Two nodes are one element of the tree if their parents are one, have the same style, which is the sequence of names
    in them, and the nodes have the same place in it: so an element's identity follows from the path to it. The style
    of a leaf is 0, the root's element is that of the host.
    """
    n = len(page.tag)
    ids, within, inside = [0] * n, [0] * n, [()] * n
    ids[0] = root & _MASK
    for i in page.around():
        inside[i] = kids = [p for p in page.parts[i] if not isinstance(p, str)]
        within[i], elements = styles[ids[i], tuple([page.name[k] for k in kids])]
        for k, element in zip(kids, elements, strict=True):
            ids[k] = element
    return ids, within, inside


def _gathered(page: Page, roots: list[int], wanted) -> str:
    """The text of ``roots`` and of the wanted nodes in them, in page order; blocks are set apart by blanks."""
    pieces, todo = [], [(r, 0) for r in reversed(roots)]
    while todo:
        node, k = todo.pop()
        parts, block = page.parts[node], page.tag[node] not in INLINE and page.tag[node] != "#text"
        if k == 0 and block:
            pieces.append(" ")
        while k < len(parts) and (isinstance(parts[k], str) or not wanted(parts[k])):
            pieces.append(parts[k] if isinstance(parts[k], str) else " ")
            k += 1
        if k < len(parts):
            todo += [(node, k + 1), (parts[k], 0)]
        elif block:
            pieces.append(" ")
    return "".join(pieces)


def main_text(source: str, root: int = 0, noise: dict[int, float] | None = None, styles: _Styles | None = None) -> str:
    """The main text of a page, given its host's element and the outermost noise of its style tree as {element: importance}."""
    page = Page(source)
    out = page.furniture()
    # the page is laid on the tree from the top; what is in noise is noise
    low, important = [False] * len(out), [1.0] * len(out)
    if noise:
        for i, element in enumerate(_styled(page, root, _Styles() if styles is None else styles)[0]):
            p = page.parent[i]
            if i and low[p]:
                low[i], important[i] = True, important[p]
            elif element in noise:
                low[i], important[i] = True, noise[element]
    for kind in ("article", "main"):
        outer = [i for i in range(len(out)) if page.said[i] == kind and not out[i] and not low[i]]
        inside = set(outer)
        roots = [i for i in outer if not _within(page, i, inside)]
        if roots:
            return " ".join(_gathered(page, roots, lambda k: not out[k]).split())
    # no declared article: the node with the most text of its own and in its paragraphs, weighed by importance, stays, and what the tree does not call furniture
    mass = [0.0] * len(out)
    for i, parts in enumerate(page.parts):
        if not out[i]:
            of = page.parent[i] if page.tag[i] == "#text" else i
            mass[page.parent[of] if of and page.tag[of] in PROSE else of] += max(important[i], LEAST_WEIGHT) * sum(len(p.strip()) for p in parts if isinstance(p, str))
    content = [i for i in range(len(out)) if page.said[i] == "content" and not out[i] and not low[i]]
    if content:
        inside = set(content)
        roots = [i for i in content if not _within(page, i, inside)]
        if sum(_total(page, r, mass) for r in roots) * 2 >= sum(mass):
            return " ".join(_gathered(page, roots, lambda k: not out[k]).split())
    top = max(range(len(out)), key=lambda i: (mass[i], -i))
    keep, i = {top}, top
    while i > 0:
        i = page.parent[i]
        keep.add(i)
    drop = list(out)
    for i in range(1, len(out)):
        p = page.parent[i]
        drop[i] = out[i] or drop[p] or low[i] and i not in keep and not _under(page, i, top)
    return " ".join(_gathered(page, [0], lambda k: not drop[k]).split())


def _within(page: Page, i: int, nodes: set[int]) -> bool:
    while (i := page.parent[i]) >= 0:
        if i in nodes:
            return True
    return False


def _under(page: Page, i: int, top: int) -> bool:
    while i > top:
        i = page.parent[i]
    return i == top


def _total(page: Page, root: int, mass: list[float]) -> float:
    todo, n = [root], 0.0
    while todo:
        i = todo.pop()
        n += mass[i]
        todo += [p for p in page.parts[i] if not isinstance(p, str)]
    return n


def host_of(url: str) -> Column:
    """Between the first :// and the next /, ? or #, in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


_KINDS = {"leaf": np.uint64, "word": np.uint32, "n": np.float64, "x": np.float64}
_STYLE = {"element": np.uint64, "style": np.uint64, "under": np.uint64, "root": np.uint64, "kids": np.int32, "k": np.float64}
_PACKED = "place int, " + ", ".join(f"{c} binary" for c in [*_KINDS, *_STYLE])


class _Tally:
    """Sums over pages: how often each feature stands in each leaf, and how many pages have each style of each element."""

    def __init__(self, places: int):
        self.places, self.styles = places, _Styles()
        self._begin()

    def _begin(self) -> None:
        self.leaves, self.counts, self.size = {}, {}, 0
        # of each leaf on each page: its number and its page's weight, its text, and the images and links in it by leaf
        self.of_leaf, self.weights, self.texts, self.refs, self.of_ref = array("Q"), array("d"), [], [], []

    def add(self, root: int, source: str, weight: float) -> None:
        page = Page(source)
        ids, within, inside = _styled(page, root, self.styles)
        counts, leaves, size = self.counts, self.leaves, len(ids)
        for i, kids in enumerate(inside):
            key = ids[i], within[i]
            if key in counts:
                counts[key][-1] += weight
            else:
                counts[key] = [within[page.parent[i]] if i else 0, ids[0], len(kids), weight]
            if not kids:
                parts, refs = page.parts[i], page.refs.get(i, ())
                text = parts[0] if len(parts) == 1 else "".join(parts)
                if refs:
                    self.refs += [ref for _, ref in refs]
                    self.of_ref += [len(self.texts)] * len(refs)
                elif not text or text.isspace():
                    continue
                self.of_leaf.append(leaves.setdefault(key[0], len(leaves)))
                self.weights.append(weight)
                self.texts.append(text)
                size += len(refs) + max(text.count(" ") + 1, len(text) // FEATURE_CHARACTERS)
        self.size += size

    def _features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf on a page, feature, how often it stands there): words, images and links by their 32-bit hashes."""
        split = pc.utf8_split_whitespace(pa.array(self.texts, pa.large_string()))
        met = pa.concat_arrays([split.flatten(), pa.array(self.refs, split.type.value_type)]).dictionary_encode()
        codes = np.array([zlib.crc32(f) for f in met.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
        on = np.concatenate([pc.list_parent_indices(split).to_numpy(), np.array(self.of_ref, np.int64)]).astype(np.uint64)
        at = met.indices.to_numpy()
        empty = pc.index(met.dictionary, "").as_py()
        if empty >= 0:
            on, at = on[at != empty], at[at != empty]
        found = np.sort((on << np.uint64(32)) | codes[at])
        first = _firsts(found)
        return (found[first] >> np.uint64(32)).astype(np.int64), found[first].astype(np.uint32), np.diff([*first, len(found)]) if len(first) else first

    def taken(self) -> pa.RecordBatch:
        """What was added, a row for each place that it goes to: the features and styles whose hashes say so."""
        leaves = np.fromiter(self.leaves, np.uint64, len(self.leaves))
        on, word, times = self._features()
        of, weights = np.array(self.of_leaf, np.uint64)[on], np.array(self.weights)[on]
        place = _places(leaves[of] + (word % np.uint32(LEAF_PLACES)), self.places)
        order = np.lexsort((word, of, place)) if len(leaves) > 1 << 20 or self.places > 1 << 12 else np.argsort((place << np.uint64(52)) | (of << np.uint64(32)) | word)
        of, word, place, times, weights = of[order], word[order], place[order], times[order].astype(np.float64), weights[order]
        first = _firsts(of, word)
        n, x = (np.add.reduceat(v, first) if len(first) else v for v in (times * weights, weights * times * np.log(times)))
        features = {"leaf": leaves[of[first]], "word": word[first], "n": n, "x": x}, place[first]
        keys = list(self.counts)
        rows = [np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint64), *(np.array(v, kind) for v, kind in zip(zip(*self.counts.values(), strict=True), list(_STYLE.values())[2:], strict=True))]
        at = _places(rows[0] ^ rows[1], self.places)
        order = np.lexsort((rows[1], rows[0], at))
        styles = {c: v[order] for c, v in zip(_STYLE, rows, strict=True)}, at[order]
        cuts = [np.searchsorted(p, np.arange(self.places + 1)) for _, p in (features, styles)]
        columns = [[v[s:e].tobytes() for s, e in zip(cut, cut[1:], strict=False)] for (values, _), cut in zip((features, styles), cuts, strict=True) for v in values.values()]
        self._begin()
        return pa.RecordBatch.from_arrays([pa.array(range(self.places), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["place", *_KINDS, *_STYLE])


def _places(hashes: np.ndarray, places: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(32)) % np.uint64(places)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins, in sorted rows."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


_SUMMED = "element bigint, style bigint, under bigint, root bigint, kids int, k double, features double, entropy double"
_SUMMED_NAMES = [c.split()[0] for c in _SUMMED.split(", ")]


def _merged(parts: list[dict[str, np.ndarray]], keys: tuple[str, str], sums: str) -> dict[str, np.ndarray]:
    """One row for each pair of ``keys``, in their order, with the sums of ``sums``."""
    whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    order = np.lexsort((whole[keys[1]], whole[keys[0]]))
    first = _firsts(*(whole[c][order] for c in keys))
    return {c: np.add.reduceat(v[order], first) if c in sums and len(first) else v[order[first]] for c, v in whole.items()}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that came to a place, merged as it comes: rows of styles with their pages, and rows of leaves with features (kids is -1) and the sum of their entropies, times log m."""
    held = {"word": [], "style": []}
    tables = {"word": (_KINDS, ("leaf", "word"), "nx"), "style": (_STYLE, ("element", "style"), "k")}
    waiting, whole = Counter(), Counter()
    for b in batches:
        for i in range(b.num_rows):
            for t, (kinds, keys, sums) in tables.items():
                part = {c: np.frombuffer(b.column(c)[i].as_py(), kind) for c, kind in kinds.items()}
                held[t].append(part)
                waiting[t] += len(part[t])
                if waiting[t] > max(TALLY // 2, whole[t]):
                    held[t] = [_merged(held[t], keys, sums)]
                    whole[t], waiting[t] = len(held[t][0][t]), 0
    f, s = (_merged(held[t], keys, sums) for t, (_, keys, sums) in tables.items())
    entropy = np.log(f["n"]) - f["x"] / f["n"]
    first = _firsts(f["leaf"])
    size = np.diff([*first, len(entropy)]) if len(first) else first
    entropy = np.add.reduceat(entropy, first) if len(first) else entropy
    leaf, rows, none = f["leaf"][first], len(s["k"]), np.zeros(len(first))
    columns = {c: np.concatenate([v, none.astype(v.dtype)]) for c, v in s.items()}
    columns["element"][rows:], columns["kids"][rows:] = leaf, -1
    columns = {c: v.view(np.int64) if v.dtype == np.uint64 else v for c, v in columns.items()}
    zeros = np.zeros(rows)
    out = pa.table({**columns, "features": np.concatenate([zeros, size]), "entropy": np.concatenate([zeros, entropy])})
    yield from out.select(_SUMMED_NAMES).to_batches(max_chunksize=1 << 16)


def _parts(pages: DataFrame) -> DataFrame:
    """The rows of ``_summed`` of all ``pages`` (host, html). Pages that are equal count as one, so each of c copies weighs 1 / c."""
    hashed = pages.withColumn("_page", F.xxhash64("host", "html"))
    copies = stored(hashed.groupBy("_page").agg(F.count("*").alias("_copies")).where("_copies > 1"))
    places = 1 + int(pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]) // PLACE_BYTES
    weighed = hashed.join(copies, "_page", "left").select(F.xxhash64("host").alias("root"), "html", (1 / F.coalesce("_copies", F.lit(1))).cast("double").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(places)
        for b in sliced(batches, "html"):
            for root, source, weight in zip(*(b.column(c).to_pylist() for c in ("root", "html", "weight")), strict=True):
                tally.add(root, source, weight)
                if tally.size >= TALLY:
                    yield tally.taken()
        if tally.size:
            yield tally.taken()

    return weighed.mapInArrow(run, _PACKED).repartition(places, "place").groupBy("place").applyInArrow(_summed, _SUMMED)


def importances(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(element, under, root, m, importance, most) and (element, up), the element around it: all elements of the style trees of ``pages`` (host, html) that two pages have, with their composite importance and the largest of those in them.

    The pages of a host merge into one tree by the identities of their nodes: m pages have an element, and k of them
    with the same style. An element's own importance is the entropy of its styles to the base m; its composite one is
    (1 - g) times that and g times the mean over its styles, weighed by k / m, of the mean over the elements in each,
    where g is ``GAMMA`` to the power of the number of styles. Of a leaf it is 1 less the mean entropy of its features,
    words, images and links, over the m pages; without features, 0. What a single page has is of importance 1, with
    all in it, so it is no row but counts above. A composite importance is a weighted sum over
    all elements in it, so sums reach twice as far in each round, and rounds grow with the logarithm of the depth.
    """
    parts = stored(_parts(pages))
    leaves = parts.where("kids < 0").groupBy("element").agg(F.sum("features").alias("features"), F.sum("entropy").alias("entropy"))
    k = F.round("k", 6)
    single = F.when(k <= 1, k).otherwise(0.0)
    held = parts.where("kids >= 0").withColumn("k", k).groupBy("element").agg(
        F.first("under").alias("under"), F.first("root").alias("root"), F.sum("k").alias("m"), F.count("*").alias("styles"), F.sum(k * F.log(k)).alias("klogk"),
        F.sum(F.when(F.col("kids") > 0, single).otherwise(0.0)).alias("single"), F.sum(F.when(F.col("kids") == 0, k).otherwise(0.0)).alias("bare"), F.max("kids").alias("kids")).where("m > 1")
    log_m, g = F.log("m"), F.when(F.col("kids") > 0, F.pow(F.lit(GAMMA), F.col("styles"))).otherwise(1.0)
    # features over the pages in which the element is a leaf
    bare = F.when(F.col("bare") <= 1, F.col("bare")).otherwise(F.col("bare") * F.coalesce(1 - F.col("entropy") / F.col("features") / F.log("bare"), F.lit(0.0)))
    own = (1 - g) * (log_m - F.col("klogk") / F.col("m")) / log_m + g * (F.col("single") + bare) / F.col("m")
    most = F.when((F.col("single") > 0) | (F.col("bare") == 1), 1.0).when(F.col("bare") > 0, bare / F.col("bare")).otherwise(0.0)
    elements = stored(held.join(leaves, "element", "left").select("element", "under", "root", "m", own.alias("own"), (g / F.col("m")).alias("g"), most.alias("most")))
    styles = parts.where("kids > 0").withColumn("k", k).where("k > 1").select("element", "style", "k", "kids")
    # an element's part in that of the one around it; then in those 2, 4, 8 .. further out
    around = styles.join(elements.select("element", "g"), "element").select(F.col("style").alias("under"), F.col("element").alias("up"), (F.col("g") * F.col("k") / F.col("kids")).alias("part"))
    at = stored(elements.join(around, "under", "left").select("element", "up", "part", F.col("own").alias("sum")))
    first, rounds = at, []
    while not at.where("up is not null").isEmpty():
        rounds.append(at.where("up is not null").select("element", "up"))
        more = at.where("up is not null").groupBy("up").agg(F.sum(F.col("part") * F.col("sum")).alias("more")).withColumnRenamed("up", "element")
        further = at.where("up is not null").select(F.col("element").alias("up"), F.col("up").alias("further"), F.col("part").alias("then"))
        at = stored(at.join(more, "element", "left").join(further, "up", "left").select("element", F.col("further").alias("up"), (F.col("part") * F.col("then")).alias("part"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum")))
    whole = elements.drop("own", "g").join(at.select("element", F.round("sum", 6).alias("importance")), "element").withColumn("most", F.greatest("importance", F.round("most", 6)))
    for pairs in rounds:
        whole = stored(whole)
        within = pairs.join(whole.select("element", "most"), "element").groupBy("up").agg(F.max("most").alias("within")).withColumnRenamed("up", "element")
        whole = whole.join(within, "element", "left").withColumn("most", F.greatest("most", "within")).drop("within")
    return stored(whole), first.select("element", "up")


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, tree): of each host in ``pages`` (host, html) the outermost noise of its style tree, as an array of (element, importance).

    An element is noise if its composite importance and that of every element in it are below ``THRESHOLD``, and
    ``LEAST_PAGES`` pages and ``LEAST_SHARE`` of the host's have it: so an array never holds more than 1 / ``LEAST_SHARE``
    times the elements of an average page. What is in noise is not listed again.
    """
    elements, around = importances(pages)
    roots = elements.where("element = root").select("root", F.col("m").alias("pages"))
    noise = stored(elements.join(roots, "root").where((F.col("most") < THRESHOLD) & (F.col("m") >= LEAST_PAGES) & (F.col("m") >= LEAST_SHARE * F.col("pages"))).select("element", "root", "importance"))
    inner = around.join(noise.select(F.col("element").alias("up")), "up").select("element")
    outermost = noise.join(inner, "element", "left_anti")
    hosts = pages.select("host").distinct().withColumn("root", F.xxhash64("host"))
    return outermost.groupBy("root").agg(F.collect_list(F.struct("element", "importance")).alias("tree")).join(hosts, "root").select("host", "tree")


def hot_hosts(pages: DataFrame) -> DataFrame:
    """Hosts that have more than one page in ``HOT_SHARE``: that many at most."""
    n = pages.count()
    return pages.groupBy("host").count().where(F.col("count") * HOT_SHARE > n).select("host", F.lit(True).alias("_hot"))


def extracted(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """Add text, the main text, to ``pages``, a row for each row.

    The host's style tree of whole pages, with composite importance by entropy, says what is noise; a page is laid on
    it, and noise goes, but for the node with the most text. What a page declares is looked at with it: its article is
    what declares to be one (article, then main, then names of classes and ids) and is no noise as a whole, without
    furniture in or around it: elements, roles and names that stand for menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments. From a declared article the tree takes nothing, since it is to be
    whole.

    Character references are decoded; blocks are joined, and white space is turned, into one blank; tags that are never
    closed end as in browsers. Null html counts as empty and gives an empty text; a null url is a host of its own name,
    the empty one. Equal rows give equal results. Other columns pass through; text is replaced.
    Names that start with an underscore are kept for this function.
    """
    rows = pages.drop("text").withColumns({"_host": host_of(url), "_html": F.coalesce(source, F.lit(""))})
    small = rows.select(F.col("_host").alias("host"), F.col("_html").alias("html"))
    trees = stored(style_trees(small)).select(F.col("host").alias("_host"), F.col("tree").alias("_tree"))
    nodes = trees.agg(F.coalesce(F.sum(F.size("_tree")), F.lit(0))).first()[0]
    both = (rows.join(F.broadcast(trees), "_host", "left") if nodes <= BROADCAST_NODES else _dealt(rows, trees)).withColumn("_root", F.xxhash64("_host"))
    keep = [c for c in rows.columns if c not in ("_host", "_html")]
    packed = dict(both.dtypes)["_html"] == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[int, dict[int, float]] = {}
        styles = _Styles()
        for b in sliced(batches, "_html"):
            texts = []
            for i, (root, page) in enumerate(zip(b.column("_root").to_pylist(), b.column("_html").to_pylist(), strict=True)):
                if root not in read:
                    # some hosts' trees are kept, so that rows need not come by host
                    if sum(map(len, read.values())) > KEPT_NODES:
                        read = {}
                    read[root] = {x["element"] & _MASK: x["importance"] for x in b.column("_tree")[i].as_py() or ()}
                texts.append(main_text(zlib.decompress(page).decode() if packed else page, root, read[root], styles))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return both.mapInArrow(run, extended(both.select(keep), text="string")).select(*[c for c in pages.columns if c != "text"], "text")


def _dealt(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """Pages, compressed, with their hosts' trees; a hot host's tree goes to many places, and its pages each to one of them."""
    hot = F.broadcast(hot_hosts(rows.select(F.col("_host").alias("host"))).withColumnRenamed("host", "_host"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int")).otherwise(0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_html"):
            html_ = pa.array([zlib.compress(t.encode(), 1) for t in b.column("_html").to_pylist()], pa.binary())
            yield b.set_column(b.schema.get_field_index("_html"), "_html", html_)

    dealt = rows.join(hot, "_host", "left").withColumn("_salt", salt).drop("_hot")
    dealt = dealt.mapInArrow(pack, T.StructType([T.StructField("_html", T.BinaryType()) if f.name == "_html" else f for f in dealt.schema]))
    return dealt.join(trees.join(hot, "_host", "left").select("_host", F.explode(salts).alias("_salt"), "_tree"), ["_host", "_salt"], "left").drop("_salt")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: For the template of the given pages, whose article stands between its tags: SQL has no parser for others.
ORACLE = r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages
), plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM article
), decoded AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'),
         '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS text FROM plain
)
SELECT page_id, url, text, length(text) AS n_chars FROM decoded
"""
