"""Operator 9: main text of web pages by template deduction over the pages of a host.

1. Each page's tokens are its element paths and its paths with their block's text. Over a host's distinct pages each token has a vector
   of occurrences; sums of hashes of (page, number) stand for it, so vectors of any length are added up before the shuffle.
2. Tokens of a host with equal vectors form a class, in the order of their mean places. A class is a candidate if it has two tokens or more
   and is on at least SUPPORT per cent of the host's pages, LEAST pages or more.
3. On a page a class is valid with those of its tokens that come in the class's order, two or more, and if it nests with all valid classes
   of more support: all of it lies in one slot (between two neighbouring tokens) of the other, or the other way about, or they are apart.
   The valid classes, one inside the other, are the page's template.
4. The blocks fall into the slots between template tokens. A block whose very text is a template token is boilerplate, inside a marked
   article too, and so is one inside an element for menus, headers, footers, sidebars, notices, adverts, forms or comments. If the page
   marks its article, what is left in there is the text; else it is all that is left in the slot with the most running text, in page
   order: headlines, lists, short and linked paragraphs too. Slots lie in the template's elements, whatever they are called. Elements around the main slot itself (a form or a sidebar layout that wraps the page)
   don't count as boilerplate.

Defined results: null and empty pages, and pages without main text (all of it links, or boilerplate), give an empty text; a null address is a host of its own; hosts with
few pages have no template and rely on the elements; repeated pages count once for the template and are extracted each.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, scratch, stored
from .markup import Block, Element, blocks

SUPPORT, LEAST = 60, 5
#: Elements, and words of classes, ids and roles, that mark what isn't main text.
ASIDE = frozenset("nav footer aside form menu button select dialog fieldset datalist svg canvas object template head".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply "
    "replies discussion sidebar side aside widget widgets menu menus nav navbar navigation topbar breadcrumb breadcrumbs pagination pager share "
    "sharing social footer masthead toolbar related recommended recommendations trending popular search searchbox skip legal copyright "
    "disclaimer complementary contentinfo".split()
)
#: Of these, the elements and words that whole pages are wrapped in as well; and starts of classes that say what an element has, not what it is.
AROUND = frozenset("form fieldset object template dialog".split())
LAYOUT = frozenset("sidebar side aside widget widgets menu menus nav navbar navigation topbar toolbar search searchbox skip login modal overlay".split())
HAS = ("has-", "with-", "no-", "without-")
MAIN = frozenset("article main".split())
#: Elements that are parts of a text and so never a slot, those of them whose text is running, and the length from which any other block's is.
TEXT = frozenset(
    "p h1 h2 h3 h4 h5 h6 hgroup ul ol dl dir li dt dd blockquote pre figure figcaption address details summary header".split()
)
PROSE, RUNNING = frozenset("p h1 blockquote pre li dd".split()), 80


def host(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def marks(signature: str) -> frozenset[str]:
    """The words of a signature's classes, ids and roles."""
    return frozenset(w for x in signature.split(".")[1:] if not x.startswith(HAS) for w in re.split(r"[^a-z]+", x) if w)


class Facts(NamedTuple):
    """What a place's path says, from that of the place around it."""

    barred: bool = False  #: inside an element that never holds a page's main text; those around the innermost main element don't count
    inside: bool = False  #: inside an article or main element
    reset: bool = False  #: inside a main element
    mark: Element | None = None  #: the innermost place that may mark boilerplate
    main: Element | None = None  #: the outermost place that marks the article
    text: Element | None = None  #: the outermost place of TEXT
    prose: bool = False


def facts(e: Element) -> Facts:
    chain = []
    while e.facts is None and e.parent:
        chain.append(e)
        e = e.parent
    at = e.facts or Facts()
    for e in reversed(chain):
        name, words = e.name, marks(e.signature) if "." in e.signature else frozenset()
        main = name == "main"
        barred, mark = (False, None) if main else (at.barred, at.mark)
        barred = barred or name in ASIDE - AROUND or name == "header" and not at.inside
        if name in AROUND or name not in ("html", "body", "main", "article") and words & MARKS:
            mark = e
        is_main = name in MAIN or e.signature.endswith(".main") or "articlebody" in words
        at = e.facts = Facts(barred, at.inside or name in MAIN, at.reset or main, mark, at.main or (e if is_main else None),
                             at.text or (e if name in TEXT else None), at.prose or name in PROSE)
    return at


def around(e: Element) -> bool:
    """Whether all marks of the element are of a kind that elements around whole pages have as well."""
    return marks(e.signature) & MARKS <= LAYOUT


def outer(mark: Element | None) -> Element | None:
    """The next marked place around a marked one."""
    return facts(mark.parent).mark if mark and not mark.name == "main" else None


class Marked:
    """For each marked place: how many marked places around it, itself included, still count, and the innermost of them."""

    def __init__(self, wraps: set[int]) -> None:
        self.wraps, self.known = wraps, {}

    def left(self, mark: Element | None) -> tuple[int, Element | None]:
        chain = []
        while mark and mark.token not in self.known:
            chain.append(mark)
            mark = outer(mark)
        n, top = self.known[mark.token] if mark else (0, None)
        for e in reversed(chain):
            if e.token not in self.wraps:
                n, top = n + 1, e
            self.known[e.token] = (n, top)
        return n, top


def without_boilerplate(found: list[Block]) -> list[Block]:
    """The blocks that no element marks as boilerplate; marks of the elements around the main slot don't count.

    An element is around it if it has a layout mark only and over half of the page's running text, or if it is around the slot with
    the fewest marks (of several, a marked article, and then the one with the most running text)."""
    found = [b for b in found if not facts(b.element).barred]
    if not any(facts(b.element).mark for b in found):
        return found
    runs = running(found)
    size: Counter[int] = Counter()
    places: dict[int, Element] = {}
    for b in runs:
        if mark := facts(b.element).mark:
            size[mark.token] += len(b.text) - b.linked
            while mark and mark.token not in places:
                places[mark.token] = mark
                mark = outer(mark)
    for e in sorted(places.values(), key=lambda e: -e.depth):  # what is inside counts for the marks around it too
        if up := outer(e):
            size[up.token] += size[e.token]
    total = sum(len(b.text) - b.linked for b in runs)
    wraps = {t for t, e in places.items() if 2 * size[t] > total and around(e)}
    marked = Marked(wraps)
    slots: dict[tuple, int] = {}
    for b in runs:
        f = facts(b.element)
        n, top = marked.left(f.mark)
        above, above_top = n, top
        if f.main:
            above, above_top = (0, None) if f.reset else marked.left(facts(f.main.parent).mark)
        # text directly in a marked element is that element's own
        if not n or (n <= above and top.token != b.element.token):
            key = (above, f.main is None, above_top.token if above_top else 0)
            slots[key] = slots.get(key, 0) + len(b.text) - b.linked
            if above_top:
                places[above_top.token] = above_top
    if slots:
        best = min(slots, key=lambda s: (s[0], s[1], -slots[s]))
        mark = places.get(best[2])
        while mark:
            wraps.add(mark.token)
            mark = outer(mark)
    marked = Marked(wraps)
    return [b for b in found if not marked.left(facts(b.element).mark)[0]]


def text_token(b: Block) -> int:
    return xxhash.xxh3_64_intdigest(f"{b.element.token}\x1e{b.text}") >> 2 << 1 | 1


def tokens(found: list[Block]) -> dict[int, tuple[int, int]]:
    """A page's tokens (every path around a block, the path with its number, and the path with the block's text), their numbers and first places.

    A path by itself counts as there or not. With its number (its token is the negative one) it counts each time that the page enters it, and each further
    block directly in it: six list items count as six, a box once."""
    out: dict[int, tuple[int, int]] = {}
    at, before = 0, None
    for b in found:
        new, e, last = [], b.element, before
        while e.parent and e is not last:
            while last is not None and last.depth > e.depth:
                last = last.parent
            if last is e:
                break
            new.append(e.token)
            e = e.parent
        if not new and b.element.parent:
            new = [b.element.token]
        before = b.element
        for t in reversed(new):
            n, first = out.get(-t, (0, at + 1))
            out[-t] = (n + 1, first)
            if not n:
                out[t] = (1, at)
                at += 2
        t = text_token(b)
        n, first = out.get(t, (0, at))
        out[t] = (n + 1, first)
        at += 1
    return out


def templates(pages: DataFrame, url: str = "url", page: str = "html", support: int = SUPPORT, least: int = LEAST) -> DataFrame:
    """A row for each host: n_pages (all rows), and the candidate classes of its template, those of most support first, each in its order."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sums: dict[tuple, list[int]] = {}
                for name, page_hash, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    for token, (n, first) in tokens(list(blocks(t.as_py()))).items():
                        h = xxhash.xxh3_64_intdigest(f"{page_hash} {n}")
                        s = sums.setdefault((name, token), [0, 0, 0, 0])
                        s[0] += h & 0x7FFFFFFF
                        s[1] += h >> 33
                        s[2] += 1
                        s[3] += first
                cols = [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64())]
                cols += [pa.array([s[j] for s in sums.values()], pa.int64()) for j in range(4)]
                yield pa.RecordBatch.from_arrays(cols, ["host", "token", "v1", "v2", "n", "at"])

    rows = pages.select(host(url).alias("host"), F.xxhash64(page).alias("h"), F.col(page).alias("p"))
    hashes = rows.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    sizes = hashes.groupBy("host").agg(F.sum("n").alias("n_pages"), F.count(F.lit(1)).alias("n_distinct"))
    once = rows.dropDuplicates(["host", "h"]).select("host", "h", "p")
    found = once.mapInArrow(count, "host string, token long, v1 long, v2 long, n long, at long")
    found = found.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("v1", "v2", "n", "at")])
    often = found.where(F.col("n") >= least).join(sizes, "host").where(F.col("n") * 100 >= F.col("n_distinct") * support)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])
    classes = often.groupBy("host", "v1", "v2", "n").agg(ordered.alias("tokens")).where(F.size("tokens") > 1)
    first = F.sort_array(F.collect_list(F.struct("n", F.size("tokens").alias("size"), "tokens")), asc=False)
    known = classes.groupBy("host").agg(F.transform(first, lambda x: x["tokens"]).alias("classes"))
    return sizes.join(known, "host", "left").select("host", "n_pages", F.coalesce("classes", F.expr("cast(array() as array<array<bigint>>)")).alias("classes"))


def in_order(places: list[int]) -> list[int]:
    """Indices of a longest increasing run of places."""
    ends, last, before = [], [], [0] * len(places)
    for k, x in enumerate(places):
        at = bisect.bisect_left(ends, x)
        before[k] = last[at - 1] if at else -1
        ends[at:], last[at:] = [x, *ends[at + 1 :]], [k, *last[at + 1 :]]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def nests(a: list[int], b: list[int]) -> bool:
    """Whether two sorted lists of places are apart, or one lies between two neighbours of the other."""
    return bisect.bisect(a, b[0]) == bisect.bisect(a, b[-1]) or bisect.bisect(b, a[0]) == bisect.bisect(b, a[-1])


def template(found: list[Block], classes: Iterable[list[int]]) -> frozenset[int]:
    """The tokens of the classes that are valid on this page."""
    at = tokens(found) if classes else {}
    valid: list[list[int]] = []
    kept: list[int] = []
    for c in classes or ():
        there = [t for t in c if t in at]
        there = [there[k] for k in in_order([at[t][1] for t in there])]
        places = [at[t][1] for t in there]
        if len(there) > 1 and all(nests(v, places) for v in valid):
            valid.append(places)
            kept += there
    return frozenset(kept)


def running(found: list[Block]) -> list[Block]:
    """Blocks of running text: paragraphs, headlines, list items and long blocks that aren't links for the most part; where there are none,
    all that aren't links."""
    own = [b for b in found if 2 * b.linked <= len(b.text)]
    return [b for b in own if len(b.text) - b.linked >= RUNNING or facts(b.element).prose] or own


def slot(found: list[Block], known: frozenset[int]) -> Element | None:
    """The innermost place around all running text, or the template's place around that one; None without running text."""
    runs = [b.element for b in running(found)]
    if not runs:
        return None
    n = Counter(e.token for e in runs)
    # an element that holds a single block directly is a part of the text, as those of TEXT are
    starts = {e.token: e for e in runs}.values()
    starts = [(t.parent if (t := facts(e).text) else e.parent if n[e.token] == 1 and e.parent else e) for e in starts]
    # the deepest place that all of them are inside: counts go up from the deepest ones
    inside = Counter(e.token for e in starts)
    queue = [(-e.depth, e.token) for e in starts]
    places = {e.token: e for e in starts}
    heapq.heapify(queue)
    total, done = len(starts), set()
    while queue:
        _, token = heapq.heappop(queue)
        if token in done:
            continue
        done.add(token)
        e = places[token]
        if inside[token] == total or not e.parent:
            break
        inside[e.parent.token] += inside[token]
        if e.parent.token not in places:
            places[e.parent.token] = e.parent
            heapq.heappush(queue, (-e.parent.depth, e.parent.token))
    top = e
    while e.parent:
        if e.token in known:
            return e
        e = e.parent
    return top


def within(found: list[Block], top: Element) -> list[Block]:
    """The blocks inside a place."""
    known = {top.token: True}
    out = []
    for b in found:
        chain, e = [], b.element
        while e is not None and e.token not in known:
            chain.append(e.token)
            e = e.parent
        hit = known[e.token] if e is not None else False
        known.update(dict.fromkeys(chain, hit))
        if hit:
            out.append(b)
    return out


def chosen(found: list[Block], known: frozenset[int]) -> list[Block]:
    """The blocks of the template's slot that holds the page's text, where no article is marked.

    The template's elements (whose numbers are in a valid class: the host's pages have them as often as the others of it) cut the page into slots: a block is in
    that of the innermost one around it. The slot with the most running text is the page's; an element around it is taken instead if it adds a headline that the slot
    lacks and less than half as much running text again. Without such elements, the innermost place around all running text is the slot."""
    holders: dict[int, Element | None] = {}

    def holder(e: Element) -> Element | None:
        chain, at = [], e
        while at is not None and at.token not in holders:
            if -at.token in known and at.name not in TEXT and at.name not in ("html", "body"):
                holders[at.token] = at
                break
            chain.append(at.token)
            at = at.parent
        top = holders[at.token] if at is not None else None
        holders.update(dict.fromkeys(chain, top))
        return top

    size: Counter[int] = Counter()
    slots: dict[int, Element | None] = {}
    for b in running(found):
        e = holder(b.element)
        slots.setdefault(e.token if e else 0, e)
        size[e.token if e else 0] += len(b.text) - b.linked
    if not any(slots.values()):
        top = slot(found, known)
        return within(found, top) if top else []
    best = slots[max(slots, key=lambda t: (size[t], t != 0))]
    if best is None:
        return [b for b in found if holder(b.element) is None]
    headline = lambda some: any(b.element.name == "h1" or facts(b.element).text and facts(b.element).text.name == "h1" for b in some)
    text = lambda some: sum(len(b.text) - b.linked for b in running(some))
    inside = within(found, best)
    while best.parent and (up := holder(best.parent)):
        more = within(found, up)
        if headline(inside) or not headline(more) or 2 * text(more) > 3 * text(inside):
            break
        best, inside = up, more
    return inside


def main_text(found: list[Block], classes: Iterable[list[int]] = ()) -> str:
    known = template(found, classes)
    left = without_boilerplate([b for b in found if text_token(b) not in known])
    inside = [b for b in left if facts(b.element).main]
    if not inside:
        inside = chosen(left, known)
    return " ".join(b.text for b in inside)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", support: int = SUPPORT, least: int = LEAST) -> DataFrame:
    """page_id, url and text of every page. A host with more than one page in 10,000 has its template broadcast, others are joined."""
    known = stored(templates(pages, url, page, support, least), scratch(pages.sparkSession), "templates")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host(url).alias("host"))
    total = known.agg(F.sum("n_pages")).first()[0] or 0
    joined = join_hot(rows, known, ["host"], "n_pages", total).select("page_id", "url", "html", "classes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, classes in zip(batch.column(2), batch.column(3), strict=True):
                texts.append(main_text(list(blocks(t.as_py())), classes.as_py() or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")
