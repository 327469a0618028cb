"""HTML pages as sequences of leaf blocks with their ancestors: a small tolerant reader, one pass over the page.

Time and memory are linear in the page whatever its markup: the end of a tag is looked for once for each way its quotes can
pair up, open elements are found by name without a walk, and a block points at its ancestors instead of copying them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass

#: Element names of HTML and MathML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template svg iframe textarea select datalist canvas video audio title annotation annotation-xml".split())
#: Of these, what is read up to its end tag whatever stands in it (not within the foreign one).
RAW = frozenset("script style textarea title iframe".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var del button img wbr".split()) | MATH
#: Elements that a start tag of the named ones closes, if open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES |= dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th"))
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split())
#: Elements beyond which an open paragraph, or an open item, is not closed.
HOLDS_P = tuple("td th li div article section body main aside footer header nav form".split())
HOLDS_ITEMS = tuple("ul ol dl table select menu".split())

NAME_END = re.compile(r"[\s/>]")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Path:
    """Features of the open elements: those that the innermost ones add to the ones around them."""

    __slots__ = ("up", "own")

    def __init__(self, up: Path | None, own: tuple[str, ...]):
        self.up, self.own = up, own

    def all(self) -> set[str]:
        out, at = set(), self
        while at:
            out.update(at.own)
            at = at.up
        return out


@dataclass
class Block:
    """A run of text between block boundaries."""

    text: str
    path: Path  # "t:" and the name of open block elements, "n:" and the words of the class, id and role of all open ones
    leaf: str  # the innermost open block element
    link: int = 0  # characters inside links


class Open:
    """The open elements, innermost last."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...], Path]] = []
        self.where: dict[str, list[int]] = defaultdict(list)  # places by name
        self.outer: list[int] = []  # places of block elements
        self.hiding: list[int] = []
        self.features: Counter[str] = Counter()
        self.root = Path(None, ())

    def push(self, tag: str, names: list[str], hides: bool) -> None:
        k = len(self.stack)
        own = tuple(f for f in dict.fromkeys([f"n:{n}" for n in names] + ([f"t:{tag}"] if tag not in INLINE else [])))
        new = tuple(f for f in own if not self.features[f])
        self.features.update(own)
        up = self.path()
        self.stack.append((tag, own, Path(up, new) if new else up))
        self.where[tag].append(k)
        if tag not in INLINE:
            self.outer.append(k)
        if hides:
            self.hiding.append(k)

    def pop_from(self, k: int) -> None:
        while len(self.stack) > k:
            tag, own, _ = self.stack.pop()
            self.where[tag].pop()
            self.features.subtract(own)
        for places in (self.outer, self.hiding):
            while places and places[-1] >= k:
                places.pop()

    def path(self) -> Path:
        return self.stack[-1][2] if self.stack else self.root

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these names, -1 without one."""
        return max((self.where[t][-1] for t in tags if self.where[t]), default=-1)

    def outermost_beyond(self, tags: tuple[str, ...], stop: int) -> int:
        """The place of the outermost open element of these names that is inside place ``stop``, -1 without one."""
        found = [self.where[t][i] for t in tags if (i := bisect_right(self.where[t], stop)) < len(self.where[t])]
        return min(found, default=-1)


def tag_end(page: str, start: int, dead: set[int]) -> int:
    """Where the tag that opens at ``start`` has its ``>``: the first outside quotes, or the first of all if the quotes do not pair up, or -1.

    ``dead`` keeps the ends of quotes from which a search has failed before, so that no stretch is searched the same way twice.
    """
    seen, at = [], start
    while m := QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at or at in dead:
            break
        seen.append(at)
    dead.update(seen)
    return page.find(">", start)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Markup, comments, scripts and hidden elements leave no text; character references are decoded.

    Hidden elements are open elements like others, so they end where HTML ends them, with or without an end tag. The head is no
    element here: what may stand in it leaves no text by itself, and anything else ends it. A tag without any end is text.
    """
    out: list[Block] = []
    text: list[str] = []
    tree, dead = Open(), set()
    link_chars, at, size = 0, 0, len(page)

    def flush() -> None:
        nonlocal link_chars
        if text:
            joined = SPACE.sub(" ", "".join(text)).strip()
            if joined:
                k = tree.hiding[0] if tree.hiding else len(tree.stack)
                inner = tree.outer[bisect_right(tree.outer, k - 1) - 1] if tree.outer and tree.outer[0] < k else -1
                out.append(Block(joined, tree.stack[k - 1][2] if k else tree.root, tree.stack[inner][0] if inner >= 0 else "", min(link_chars, len(joined))))
            text.clear()
        link_chars = 0

    def add(raw: str, decode: bool = True) -> None:
        nonlocal link_chars
        if raw and not tree.hiding:
            s = html.unescape(raw) if decode and "&" in raw else raw
            text.append(s)
            if tree.where["a"]:
                link_chars += len(s.strip())

    def close(k: int) -> None:
        """Close the element at place ``k`` and all inside it; shown text before it is a block of its own."""
        if not tree.hiding or k < tree.hiding[0]:
            flush()
        tree.pop_from(k)

    def end_tag(tag: str) -> None:
        k = tree.last(tag)
        if tag in INLINE:
            if k > (tree.outer[-1] if tree.outer else -1):
                tree.pop_from(k)
        else:
            if k < 0 and not tree.hiding and tag not in SKIPPED:
                flush()
            if k >= 0:
                if tag in SKIPPED:
                    tree.pop_from(k)
                else:
                    close(k)

    def start_tag(tag: str, attrs: str) -> None:
        nonlocal at
        closed = attrs.endswith("/") and not re.search(r"=\s*[^\s\"'>]*/\Z", attrs)
        foreign = tree.last("svg")
        if foreign >= 0 and (tag in ENDS_P or tag == "body") and tree.last("foreignobject", "desc", "title") < foreign:
            tree.pop_from(tree.where["svg"][0])
            foreign = -1
        if tag in RAW and foreign < 0:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if m or not closed:
                end = page.find(">", m.end()) if m else -1
                at = end + 1 if end >= 0 else size
            return
        if tag in SKIPPED:
            if not closed:
                tree.push(tag, [], True)
            return
        if tag == "head":
            return
        if tag == "body" and tree.hiding and not tree.where["body"]:  # ends what the head has left open
            k = min((tree.where[t][0] for t in SKIPPED if tree.where[t]), default=-1)
            if k >= 0:
                tree.pop_from(k)
        if tag == "br":
            if not tree.hiding:
                text.append("\n")
            return
        if tag not in INLINE:
            if tag in ENDS_P and (k := tree.last("select", "datalist")) >= 0:  # of these a block element is no part
                tree.pop_from(k)
            if not tree.hiding:
                flush()
            if tag in ENDS_P and (k := tree.outermost_beyond(("p",), tree.last(*HOLDS_P, *SKIPPED))) >= 0:
                close(k)
            if tag in CLOSES and (k := tree.outermost_beyond(CLOSES[tag], tree.last(*HOLDS_ITEMS, *(SKIPPED - {"select"})))) >= 0:
                close(k)
        if tag in VOID or closed:
            return
        names: list[str] = []
        hidden = False
        for name, value in ATTR.findall(attrs) if attrs else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            elif name == "hidden" or name == "aria-hidden" and value.strip() == "true":
                hidden = True
            elif name in ("class", "id", "role"):
                names += WORD.findall(value)
        tree.push(tag, names, hidden)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            break
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        first = page[lt + 2 : lt + 3] if closing else after
        if first in LETTERS and first:
            end = tag_end(page, lt + 1, dead)
            if end < 0:
                break
            add(page[at:lt])
            at = end + 1
            begin = lt + 1 + closing
            stop = NAME_END.search(page, begin).start()
            tag = page[begin:stop].lower()
            if closing:
                end_tag(tag)
            else:
                start_tag(tag, page[stop:end].strip())
        elif after in ("!", "?") and after or closing and first:
            add(page[at:lt])
            if page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt + 9)
                add(page[lt + 9 : end if end >= 0 else size])
                at = end + 3 if end >= 0 else size
            else:
                mark = "-->" if page.startswith("<!--", lt) else ">"
                end = page.find(mark, lt + 2)
                at = end + len(mark) if end >= 0 else size
        else:
            add(page[at : lt + 1])
            at = lt + 1
    add(page[at:])
    flush()
    return out
