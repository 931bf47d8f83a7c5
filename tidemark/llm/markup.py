"""A small reader of web pages: blocks of text with the elements around them. It never fails on broken markup, and its time grows in
proportion to the page, however deep or broken the page is."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import xxhash

# quotes hold a value together only after an equals sign; nothing is tried twice
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?>"[^"]*"|'[^']*')|=)*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s/"']))([^\s=/"'>]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""")
CUT_OFF = re.compile(r"</?[a-zA-Z!]|<\Z")
ZEROS, TOO_LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
#: Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these ends an open one of those.
ENDS = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
HOLDS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main nav ol section table td th ul".split())
ENDS_P = BLOCK - frozenset("br option body html head tbody td tfoot th thead tr caption legend summary dt dd figcaption".split())
#: Every element that a start tag ends.
CLOSES = {name: ENDS.get(name, frozenset()) | (frozenset({"p"}) if name in ENDS_P else frozenset()) for name in {*ENDS, *ENDS_P}}


class Element:
    """A place in the page: a path of signatures. Elements of one path share their place.

    Only elements that begin a block or carry a class, id or role make a place; others share that of the element around them.
    """

    __slots__ = ("parent", "name", "signature", "depth", "token", "facts", "below")

    def __init__(self, parent: Element | None, name: str, signature: str) -> None:
        self.parent, self.name, self.signature = parent, name, signature
        self.depth = parent.depth + 1 if parent else 0
        # a running hash of the path, so a path costs the same at any depth; even, as texts have odd tokens
        self.token = xxhash.xxh3_64_intdigest(f"{parent.token if parent else 0}\x1f{signature}") >> 2 << 1
        self.facts = None  # what a caller derives from the path
        self.below: dict[str, Element] = {}

    def child(self, name: str, signature: str) -> Element:
        found = self.below.get(signature)
        if found is None:
            found = self.below[signature] = Element(self, name, signature)
        return found

    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at.parent:
            out.append(at.signature)
            at = at.parent
        return tuple(out[::-1])


class Block(NamedTuple):
    element: Element  #: the place it is in
    text: str  #: with references decoded and white space runs as one space
    linked: int  #: characters of it inside links


def signature(name: str, attributes: str) -> str:
    """The element's name with its class, id and role, in lower case, digits left out."""
    if not attributes or "=" not in attributes:
        return name
    found = [v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role")]
    return re.sub(r"\d+", "", ".".join([name, *(x for v in found for x in v.split())])) if found else name


def decoded(raw: str) -> str:
    """Text with character references decoded; a number beyond all characters is U+FFFD."""
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = TOO_LARGE.sub("�", ZEROS.sub("&#", raw))
    return html.unescape(raw)


class Open:
    """The open elements. A scope is what lies inside the innermost element of HOLDS; counts say what is open without a search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Element]] = []
        self.total: defaultdict[str, int] = defaultdict(int)
        self.scopes: list[tuple[str, defaultdict[str, int]]] = [("", defaultdict(int))]

    def push(self, name: str, place: Element) -> None:
        self.stack.append((name, place))
        self.total[name] += 1
        self.scopes[-1][1][name] += 1
        if name in HOLDS:
            self.scopes.append((name, defaultdict(int)))

    def close(self, names: frozenset[str]) -> list[str]:
        """Ends the innermost element with one of the names and all inside it; their names."""
        gone = []
        while not gone or gone[-1] not in names:
            name, _ = self.stack.pop()
            if name in HOLDS:
                self.scopes.pop()
            self.scopes[-1][1][name] -= 1
            self.total[name] -= 1
            gone.append(name)
        return gone

    def reaches(self, name: str) -> bool:
        """Whether an end tag of this name ends something: elements of HOLDS keep in what isn't of their kind."""
        return self.total[name] > 0 if name in HOLDS or name in ("html", "head") else self.scopes[-1][1][name] > 0

    def inside(self, names: frozenset[str]) -> bool:
        """Whether one of the names is open in the scope, or is the element around it."""
        around, counts = self.scopes[-1]
        if around in names:
            return True
        for x in names:
            if counts.get(x):
                return True
        return False


def blocks(page: str | None, hrefs: list[str] | None = None) -> Iterator[Block]:
    """The page's blocks; the addresses of its a elements go to hrefs, with references decoded."""
    page, parts, linked, links = page or "", [], 0, 0  # links: open a elements
    top, opened, at = Element(None, "", ""), Open(), 0

    def place() -> Element:
        return opened.stack[-1][1] if opened.stack else top

    def flush(inner: Element | None = None) -> Iterator[Block]:
        nonlocal parts, linked
        if not parts:
            return
        text = " ".join("".join(parts).split())
        if text:
            yield Block(inner or place(), text, linked)
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = decoded(raw)
            parts.append(text)
            if links:
                linked += len(text)

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = rest.rfind("<")
            add(rest if cut < 0 or not CUT_OFF.match(rest, cut) else rest[:cut])  # a tag cut off by the end of the page
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if parts and name in BLOCK:
            yield from flush()
        if m[1]:
            if opened.reaches(name):
                inner = place()
                gone = opened.close(frozenset({name}))
                links -= gone.count("a")
                if parts and not BLOCK.isdisjoint(gone):
                    yield from flush(inner)
        elif name not in VOID:
            ends = CLOSES.get(name)
            if ends and opened.inside(ends):
                links -= opened.close(ends).count("a")
            if not m[3].endswith("/") or name in BLOCK:
                if name in RAW:
                    end = RAW_END[name].search(page, at)
                    at = end.end() if end else len(page)
                else:
                    own = signature(name, m[3])
                    opened.push(name, place().child(name, own) if name in BLOCK or "." in own else place())
                    links += name == "a"
                    if hrefs is not None and name == "a":
                        hrefs += [decoded(v.strip("\"'")).strip() for k, v in ATTRIBUTE.findall(m[3]) if k.lower() == "href"][:1]
    yield from flush()
