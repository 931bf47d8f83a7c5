"""Operator 6: Jaccard join of word n-gram sets over prefix trees, and the components of its links.

1. Each text becomes its set of 64-bit shingle hashes. A task packs its documents into flushes, in which equal sets are one; a set of a flush is a
   node. Shingles are dealt out by hash range, in packed arrays, and counted exactly; those in two sets or more come back to their node
   with their number of sets. A shingle that a flush holds more than once travels as one count, so that a phrase which most documents
   share doesn't fill one bucket. A node with less than the threshold's part of its shingles shared has no link.
2. The rest have their shared shingles in one global order, rarest first. Two linked nodes share one of the first
   s - ceil(t n) + 1 (s shared of n), the prefix.
3. Nodes meet by the least hash of their shingles (MEETS of them, one after another; from the second on only one node for each component
   of a place). A block of them is laid in one prefix tree, which is walked by all of them.
4. What is left: every list of a prefix shingle whose nodes are in two components or more. All nodes of such a list take a seat at one place;
   all pairs of seats in different components are compared, in blocks of bounded size. So no link between two components is left. Large places
   are cut by bands of set size: a set goes only to blocks of sets from about half to twice its size, since others can't link with it.
5. The tree stores whole ordered sets. It is walked by many sets at once: overlaps of shared paths are counted once for each of them, and a
   subtree is left as soon as even its longest rest can't reach the threshold. A walk gives links that join components only, never all pairs.

Defined results: null and empty texts (no words) have an empty set and are linked with nothing; a text with fewer words than `words`
is one shingle; repeated rows are members of one class (a class is known by a 128-bit hash of its set); null ids rank last (a component of null
ids only has a null id).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap_bits, few_tasks, give_back, join_hot, mark_survivors, scratch, survivor_bitmap, tidy
from .common import stored_compact as stored
from .components import components

WORDS, PER_CENT = 5, 75
FLUSH = 1_000_000  #: shingles a task holds before it deals them out
BUCKET_BYTES = 16 << 20  #: text a bucket of shingles stands for
SETS = 60_000  #: sets in a flush, so that two bytes name one
MEETS = 3  #: least hashes by which nodes meet
STEP, FRONTIER, CELLS = 32, 1 << 15, 1 << 23  #: shingles of an edge compared at once, pairs of walkers and edges at once, bytes of the walkers' table
MASK48 = np.uint64((1 << 48) - 1)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
NODES = "doc_id long, n long, h1 long, h2 long, node long, size int, pre array<long>, body binary, g array<long>"


class Limits(NamedTuple):
    """Sizes of blocks; results don't depend on them."""

    sets: int = 1024  #: in a tree
    shingles: int = 1 << 20  #: in a tree
    small: int = 64  #: places with fewer nodes share a tree


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and the white space of the contract
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    if not len(h):
        return h
    width = min(words, len(h))
    n = len(h) - width + 1
    g = np.full(n, width, np.uint64)
    for k in range(width):
        g = (g ^ h[k : n + k]) * ODD[k % len(ODD)]
        g ^= g >> np.uint64(29)
    return np.unique(g)


class Tree:
    """A prefix tree of ordered sets with paths pressed together, in arrays, walked by many sets at once.

    A node has its edge (a range of shingles), its children (a range of nodes), the sets that end in it, the longest rest below it, and
    the smallest size (all shingles, shared or not) of a set below it.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.sizes = np.asarray(sizes, np.int64)
        self.vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        flat, lengths = flat.astype(np.int32), np.array([len(s) for s in sets])
        starts = np.cumsum(lengths) - lengths
        keys = [flat[a : a + n].astype(">i4").tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        order = np.array(sorted(range(len(sets)), key=keys.__getitem__))
        self.flat, self.order = flat, order
        starts, lengths, sizes = starts[order], lengths[order], self.sizes[order]
        nodes, queue = [[0, 0, 0, 0, 0, 0, 0, 0]], [(0, 0, len(order), 0)]
        for at, lo, hi, depth in queue:  # grows as it goes
            first, last = starts[lo] + depth, starts[hi - 1] + depth
            m = min(lengths[lo], lengths[hi - 1]) - depth
            if hi - lo == 1:
                same = m
            else:  # sorted: what the first and the last share, all share
                differ = np.flatnonzero(flat[first : first + m] != flat[last : last + m])
                same = differ[0] if len(differ) else m
            end = depth + same
            ends = lo + int(np.searchsorted(lengths[lo:hi] > end, True)) if hi - lo > 1 else hi  # those that end here come first
            child = len(nodes)
            if ends < hi:
                token = flat[starts[ends:hi] + end]
                cuts = [ends, *(np.flatnonzero(token[1:] != token[:-1]) + ends + 1).tolist(), hi]
                queue += [(child + k, a, b, end) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                nodes += [[0] * 8 for _ in cuts[1:]]
            nodes[at] = [first, first + same, child, len(nodes), lo, ends, int(lengths[lo:hi].max()) - end, int(sizes[lo:hi].min())]
        self.nodes = np.array(nodes, np.int64).T

    def walk(self, sets: list[np.ndarray], sizes: np.ndarray, per_cent: int = PER_CENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links as arrays (walker, set of the tree): overlap * 100 >= per_cent * union."""
        width = len(self.vocabulary)
        some = max(1, min(256, CELLS // (width + 1)))
        for at in range(0, len(sets), some):
            yield from self._walk(sets[at : at + some], np.asarray(sizes[at : at + some], np.int64), at, per_cent)

    def _walk(self, sets: list[np.ndarray], sizes: np.ndarray, base: int, per_cent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        low, high, child, children, ends, ended, longest, least = self.nodes
        lengths = np.array([len(s) for s in sets])
        has = np.zeros((len(sets), len(self.vocabulary) + 1), bool)
        tokens = np.concatenate(sets)
        place = np.searchsorted(self.vocabulary, tokens)
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == tokens
        has[np.repeat(np.arange(len(sets)), lengths)[known], place[known]] = True
        whole, steps = 100 + per_cent, np.arange(STEP)
        stack = [(np.arange(len(sets)), np.zeros(len(sets), np.int64), np.full(len(sets), low[0]), np.zeros(len(sets), np.int64))]
        while stack:
            p, node, pos, overlap = stack.pop()
            if len(p) > FRONTIER:
                stack += [tuple(x[k : k + FRONTIER] for x in (p, node, pos, overlap)) for k in range(0, len(p), FRONTIER)]
                continue
            end = np.minimum(pos + STEP, high[node])
            at = pos[:, None] + steps[: max(1, int((end - pos).max(initial=0)))]
            inside = at < end[:, None]
            overlap = overlap + (has[p[:, None], self.flat[np.minimum(at, len(self.flat) - 1)]] & inside).sum(1)
            rest = np.minimum(high[node] - end + longest[node], lengths[p] - overlap)
            on = whole * (overlap + rest) >= per_cent * (sizes[p] + least[node])  # remaining-length bound
            p, node, pos, overlap = p[on], node[on], end[on], overlap[on]
            done = pos == high[node]
            if not done.all():
                stack.append((p[~done], node[~done], pos[~done], overlap[~done]))
                p, node, overlap = p[done], node[done], overlap[done]
            k, inner = spread(ends[node], ended[node])
            if len(k):
                found = self.order[inner]
                hit = whole * overlap[k] >= per_cent * (sizes[p[k]] + self.sizes[found])
                if hit.any():
                    yield base + p[k][hit], found[hit]
            k, inner = spread(child[node], children[node])
            if len(k):
                stack.append((p[k], inner, low[inner], overlap[k]))


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges: the range's number and the value, for each value in it."""
    n = high - low
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + low[k]


class Labels:
    """Components of what one block joins."""

    def __init__(self, labels: Iterable[int]) -> None:
        self.up = {x: x for x in labels}

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


class Seat(NamedTuple):
    node: int
    root: int
    size: int  #: of its whole set
    tokens: np.ndarray  #: shared shingles in the global order


def joins(seats: list[Seat], walkers: Iterable[list[Seat]] | None = None, per_cent: int = PER_CENT) -> Iterator[tuple[int, int]]:
    """Links between seats in different components, enough to join all that are linked: (node, node).

    All seats are laid in one tree. Without walkers, the first seats walk it (near copies are mostly joined by those), then
    all that aren't in the largest component; with walkers, only those walk it.
    """
    if not seats:
        return
    tree, labels = Tree([s.tokens for s in seats], np.array([s.size for s in seats])), Labels({s.root for s in seats})

    def walked(some: list[Seat]) -> Iterator[tuple[int, int]]:
        for s in some:
            labels.up.setdefault(s.root, s.root)
        for a, b in tree.walk([s.tokens for s in some], np.array([s.size for s in some]), per_cent) if some else ():
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                if labels.join(some[x].root, seats[y].root):
                    yield some[x].node, seats[y].node

    if walkers is not None:
        for some in walkers:
            yield from walked(some)
        return
    yield from walked(seats[:2])
    found = [labels.find(s.root) for s in seats]
    names, counts = np.unique(found, return_counts=True)
    most = int(names[counts.argmax()])
    yield from walked([s for s, r in zip(seats, found, strict=True) if r != most])


def six_bytes(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(data: bytes, n: int | None = None, start: int = 0) -> np.ndarray:
    n = (len(data) - start) // 6 if n is None else n
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :6] = np.frombuffer(data, np.uint8, 6 * n, start).reshape(n, 6)
    return whole.view("<u8").ravel()


def nodes_of(docs: DataFrame, text: str, doc_id: str, words: int, per_cent: int) -> DataFrame:
    """Steps 1 and 2: a row (doc_id, n, h1, h2) for each document, and a row (n, h1, h2, node, size, pre, body, g) for each node that may have a link:
    pre is its prefix, body all its shared shingles in six bytes each, g its least hashes."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    names, kinds = ["key", "kind", "payload"], (pa.int64(), pa.int32(), pa.binary())

    def named(tokens: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
        """What tells shingles apart from here on: 48 bits and the bucket, as good as 64 bits for sets of this size."""
        return tokens & MASK48 | (np.asarray(bucket, np.uint64) & np.uint64(0x7FFF)) << np.uint64(48)

    @tidy
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, seen, count, turn = [], [], {}, 0, 0
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            name = part << 24 | turn
            head = struct.pack("<q", name)
            out = []
            local, table = b"", np.array([(h1, h2, len(g)) for (h1, h2), g in held], "<i8").reshape(-1, 3)
            if held:
                tokens = np.concatenate([g for _, g in held])
                owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(g) for _, g in held])
                bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
                order = np.argsort(tokens, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], tokens[order[1:]] != tokens[order[:-1]]]))
                times = np.diff(np.append(first, len(tokens)))
                again = np.repeat(times > 1, times)
                mine, times = order[again], times[times > 1].astype("<u4")
                many = mine[np.cumsum(times) - times]  # one place of each shingle that the flush has more than once, in the order of the buckets
                local = struct.pack("<I", len(many)) + times.tobytes() + named(tokens[many], bucket[many]).astype("<u8").tobytes() + owner[mine].tobytes()
                one = np.sort(order[~again])
                one = one[np.argsort(bucket[one], kind="stable")]  # in a bucket in the order of their sets, which packs well
                edges = np.arange(buckets + 1, dtype=np.uint32)
                one_at, many_at = np.searchsorted(bucket[one], edges), np.searchsorted(bucket[many], edges)
                one_owner, one_short, many_short = owner[one], six_bytes(tokens[one]), six_bytes(tokens[many])
                for b in np.unique(bucket).tolist():
                    lo, hi, low, high = one_at[b], one_at[b + 1], many_at[b], many_at[b + 1]
                    out.append((b, 1, head + struct.pack("<I", hi - lo) + one_owner[lo:hi].tobytes() + one_short[6 * lo : 6 * hi] + times[low:high].tobytes() + many_short[6 * low : 6 * high]))
            out.append((xxhash.xxh32_intdigest(head) % buckets, 0, head + struct.pack("<II", len(held), len(rows)) + table.tobytes() + pack_docs(rows) + local))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g = shingles(t.as_py(), words)
                c = class_of(g)
                rows.append((key, len(g), *c))
                count += 16
                if len(g) and c not in seen:
                    seen[c] = None
                    held.append((c, g))
                    count += len(g)
                if count >= FLUSH or len(held) == SETS:
                    yield flush()
                    rows, held, seen, count, turn = [], [], {}, 0, turn + 1
        if rows:
            yield flush()

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket: for each flush its shingles that are in two sets or more, and in how many."""
        out = [(struct.unpack_from("<q", p)[0], -1, p) for p in rows.payload[rows.kind == 0]]
        flushes, owners, ones, times, many = [], [], [], [], []
        for p in rows.payload[rows.kind == 1]:
            name, m = struct.unpack_from("<qI", p)
            flushes.append(name)
            owners.append(np.frombuffer(p, "<u2", m, 12))
            ones.append(from_six(p, m, 12 + 2 * m))
            at = 12 + 8 * m
            r = (len(p) - at) // 10
            times.append(np.frombuffer(p, "<u4", r, at))
            many.append(from_six(p, r, at + 4 * r))
        if flushes:
            token = np.concatenate([*ones, *many])
            weight = np.concatenate([np.ones(sum(map(len, ones)), np.int64), *times])
            order = np.argsort(token)
            ordered = token[order]
            first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            sums = np.add.reduceat(weight[order], np.flatnonzero(first))
            df = np.empty(len(token), np.uint32)
            df[order] = np.minimum(sums, 0xFFFFFFFF)[np.cumsum(first) - 1]
            lo, low = 0, sum(map(len, ones))
            for name, owner, one, some in zip(flushes, owners, ones, many, strict=True):
                mine = df[lo : lo + len(one)]
                shared = mine > 1
                m = int(shared.sum())
                if m or len(some):
                    out.append((name, int(key[0]), struct.pack("<I", m) + owner[shared].tobytes() + mine[shared].tobytes() + six_bytes(one[shared]) + df[low : low + len(some)].tobytes()))
                lo, low = lo + len(one), low + len(some)
        give_back()
        return pd.DataFrame(out, columns=names)

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Of a flush: its documents, and its sets with enough shared shingles, in the global order."""
        head = next(iter(rows.payload[rows.kind == -1]))
        name, m, d = struct.unpack_from("<qII", head)
        table = np.frombuffer(head, "<i8", 3 * m, 16).reshape(m, 3)
        at = 16 + 24 * m
        out = [(doc, n, h1, h2, None, None, None, None, None) for doc, n, h1, h2 in unpack_docs(head[at : at + DOC.itemsize * d])]
        at += DOC.itemsize * d
        owners, dfs, tokens, local_df = [], [], [], []
        replies = rows[rows.kind >= 0].sort_values("kind")
        for bucket, p in zip(replies.kind, replies.payload, strict=True):
            k = struct.unpack_from("<I", p)[0]
            owners.append(np.frombuffer(p, "<u2", k, 4))
            dfs.append(np.frombuffer(p, "<u4", k, 4 + 2 * k))
            tokens.append(named(from_six(p, k, 4 + 6 * k), bucket))
            local_df.append(np.frombuffer(p, "<u4", (len(p) - 4 - 12 * k) // 4, 4 + 12 * k))
        if m and (r := struct.unpack_from("<I", head, at)[0]):  # shingles that the flush itself has more than once, in the order of the buckets
            times, token = np.frombuffer(head, "<u4", r, at + 4), np.frombuffer(head, "<u8", r, at + 4 + 4 * r)
            owners.append(np.frombuffer(head, "<u2", int(times.sum()), at + 4 + 12 * r))
            dfs.append(np.repeat(np.concatenate(local_df), times))
            tokens.append(np.repeat(token, times))
        if owners:
            owner, df, token = map(np.concatenate, (owners, dfs, tokens))
            enough = 100 * np.bincount(owner, minlength=m) >= per_cent * table[:, 2]
            mine = enough[owner]
            owner, df, token = owner[mine], df[mine], token[mine]
            order = np.lexsort((token, df, owner))
            owner, token = owner[order], token[order]
            which, low, high = runs(owner)
            least = []
            for j in range(MEETS):
                x = (token ^ ODD[j]) * ODD[j + 1]
                x = (x ^ x >> np.uint64(31)) * ODD[j + 2]
                least.append(np.minimum.reduceat(x, low).view(np.int64) if len(low) else low)
            body = six_bytes(token)
            for k, (c, lo, hi) in enumerate(zip(which.tolist(), low.tolist(), high.tolist(), strict=True)):
                h1, h2, n = table[c].tolist()
                out.append((None, n, h1, h2, name << 16 | c, hi - lo, token[lo : lo + hi - lo - -(-per_cent * n // 100) + 1].view(np.int64), body[6 * lo : 6 * hi], [int(x[k]) for x in least]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in NODES.split(", ")]).astype({"doc_id": "Int64", "node": "Int64", "size": "Int64"})

    packed = "key long, kind int, payload binary"
    return (docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(deal, packed)
            .groupBy("key").applyInPandas(count, packed)
            .groupBy("key").applyInPandas(gather, NODES))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[starts], starts, np.append(starts[1:], len(x)) if len(x) else starts


DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8"), ("h1", "<i8"), ("h2", "<i8")])


def pack_docs(rows: list[tuple]) -> bytes:
    return np.array([(d or 0, d is None, *rest) for d, *rest in rows], DOC).tobytes()


def unpack_docs(data: bytes) -> list[tuple]:
    return [(None if none else d, *rest) for d, none, *rest in np.frombuffer(data, DOC).tolist()]


SEATED = "place long, block long, walks boolean, node long, root long, n long, body binary"


def compared(seated: DataFrame, per_cent: int, limits: Limits, complete: bool) -> DataFrame:
    """Links (u, v) between the components of each (place, block) of SEATED rows.

    complete: all walkers are compared with all that only sit (a block with no row that walks: all with all); the block's tree is bounded by how the
    caller cut it. Else a block is taken piece by piece, each with the first two seats of its place, and small places share a tree.
    """

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        def rows() -> Iterator[tuple[tuple[int, int], bool, Seat]]:
            for batch in batches:
                cols = [batch.column(k).to_pylist() for k in range(6)]
                for place, block, walks, node, root, n, body in zip(*cols, batch.column(6), strict=True):
                    yield (place, block), walks, Seat(node, root, n, from_six(body.as_py()))

        def piecewise() -> Iterator[tuple[int, int]]:
            held, first, total, at = [], [], 0, None
            for key, _, seat in rows():
                if key != at:
                    if len(held) >= limits.small:
                        yield from joins(held, None, per_cent)
                        held, total = [], 0
                    at, first = key, []
                if held and (len(held) >= limits.sets or total >= limits.shingles):
                    yield from joins(held, None, per_cent)
                    held, total = list(first), 0
                if len(first) < 2:
                    first.append(seat)
                held.append(seat)
                total += len(seat.tokens)
            yield from joins(held, None, per_cent)

        def whole() -> Iterator[tuple[int, int]]:
            stream = rows()
            now = next(stream, None)
            while now is not None:
                key, seats = now[0], []
                while now is not None and now[0] == key and not now[1]:
                    seats.append(now[2])
                    now = next(stream, None)

                def walkers() -> Iterator[list[Seat]]:
                    nonlocal now
                    some = []
                    while now is not None and now[0] == key:  # noqa: B023
                        some.append(now[2])
                        now = next(stream, None)
                        if len(some) == 256:
                            yield some
                            some = []
                    yield some

                if now is not None and now[0] == key:
                    yield from joins(seats, walkers(), per_cent)
                    while now is not None and now[0] == key:
                        now = next(stream, None)
                else:
                    yield from joins(seats, None, per_cent)

        out = []
        for link in whole() if complete else piecewise():
            out.append(link)
            if len(out) == 10_000:
                yield links(out)
                out = []
        if out:
            yield links(out)

    dealt = seated.repartition(F.col("place"), F.col("block")).sortWithinPartitions("place", "block", "walks", "node")
    return few_tasks(dealt).mapInArrow(run, "u long, v long")


def with_bodies(seats: DataFrame, nodes: DataFrame) -> DataFrame:
    """seats with n and body of their node. A bitmap of the seats' nodes keeps most other bodies out of the shuffle."""
    bits = bitmap_bits(seats.count())
    bodies = nodes.select("node", "n", "body").withColumn("_h", F.xxhash64("node"))
    bitmap = survivor_bitmap(seats.select(F.xxhash64("node").alias("_h")), "_h", bits)
    bodies = mark_survivors(bodies, "_h", bitmap, "_in", bits).where("_in").select("node", "n", "body")
    return seats.join(bodies.hint("merge"), "node")


def merged(label: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) of all nodes after links between nodes have joined their roots."""
    links = stored(links, folder, f"{name}-links")
    if links.isEmpty():
        return label
    of = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    edges = links.join(of("u"), "u").join(of("v"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    up = components(edges, folder, f"{name}-groups").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(label.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), folder, f"{name}-labels")


def met(nodes: DataFrame, label: DataFrame, total: int, folder: str, per_cent: int, limits: Limits) -> DataFrame:
    """Step 3: labels after nodes have met by their least hashes."""
    for j in range(MEETS):
        if j == 0:
            seats = nodes.select(F.col("g")[0].alias("place"), "node", F.col("node").alias("root"), "n", "body")
        else:
            # one node for each component of a place
            here = nodes.select("node", F.col("g")[j].alias("place")).join(label, "node")
            one = here.groupBy("place", "root").agg(F.min("node").alias("node"))
            mixed = one.groupBy("place").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
            seats = with_bodies(stored(join_hot(one, mixed, ["place"], "m", total).where("m is not null").select("place", "node", "root"), folder, f"meet-{j}"), nodes)
        # hot places are cut into blocks; their first and last node sits in all of them
        sizes = seats.groupBy("place").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("h0"), F.max("node").alias("h1")).where(F.col("m") > F.greatest(F.lit(limits.sets), F.lit(total // 10_000)))
        cut = seats.join(F.broadcast(sizes), "place", "left")  # 10,000 at most
        blocks = F.ceil(F.col("m") / F.lit(limits.sets)).cast("int")
        own = F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))
        block = F.when(F.col("m").isNull(), F.array(F.lit(0))).when(F.col("node").isin([]) | (F.col("node") == F.col("h0")) | (F.col("node") == F.col("h1")), F.sequence(F.lit(0), blocks - 1)).otherwise(own)
        seated = cut.select("place", F.explode(block).alias("block"), F.lit(False).alias("walks"), "node", "root", "n", "body")
        label = merged(label, compared(seated, per_cent, limits, False), folder, f"meet-{j}")
    return label


def band(n: Column, per_cent: int) -> Column:
    """Number of a set's size on a scale of powers: sets that can link are in one band or in neighbours. The power is a little larger than the
    greatest ratio of linked sizes, so that rounding can't part two of them, and large enough for a few hundred bands at most."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(1.0001 * max(100 / per_cent, 1.05))).cast("int")


def placed(seats: DataFrame, folder: str, per_cent: int, limits: Limits) -> DataFrame:
    """Seats (place, node, root, size, n) with `at`, the blocks that each goes to: structs of block and walks.

    A place beyond the limits is cut by bands of set size, and each band by hash. A seat sits in one block of its own band; what isn't in the place's
    largest component also walks the blocks of its band and of the two next to it: other bands hold no set that it could link with.
    """
    seats = stored(seats.withColumn("band", band(F.col("n"), per_cent)), folder, "seats")
    cells = seats.groupBy("place", "band", "root").agg(F.count(F.lit(1)).alias("part"), F.sum("size").alias("size"))
    number = lambda m, size: F.ceil(F.greatest(F.col(m) / F.lit(limits.sets), F.col(size) / F.lit(limits.shingles))).cast("int")
    bands = cells.groupBy("place", "band").agg(F.sum("part").alias("m"), F.sum("size").alias("size")).withColumn("blocks", number("m", "size"))
    cuts = bands.groupBy("place").agg(F.sum("m").alias("m"), F.sum("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("cuts"))
    shares = cells.groupBy("place", "root").agg(F.sum("part").alias("part"))
    major = shares.groupBy("place").agg(F.max_by("root", F.struct("part", "root")).alias("major"))  # ties too go one way
    cut = F.when(number("m", "size") > 1, F.col("cuts")).alias("cuts")
    places = cuts.join(major, "place").select("place", "m", "major", cut)
    seats = join_hot(seats, places, ["place"], "m", seats.count())
    name = lambda b, k: F.shiftleft(b.cast("long"), 32) + k
    own = name(F.col("band"), F.pmod(F.xxhash64("node"), F.col("cuts")[F.col("band")]))
    sits = F.struct(F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(own).cast("long").alias("block"), F.lit(False).alias("walks"))
    near = F.filter(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.map_contains_key("cuts", b))
    inside = lambda b: F.transform(F.sequence(F.lit(0), F.col("cuts")[b] - 1), lambda k: F.struct(name(b, k).alias("block"), F.lit(True).alias("walks")))
    walks = F.when(F.col("cuts").isNotNull() & (F.col("root") != F.col("major")), F.flatten(F.transform(near, inside)))
    none = F.expr("cast(array() as array<struct<block:bigint,walks:boolean>>)")
    return seats.select("place", "node", "root", F.concat(F.array(sits), F.coalesce(walks, none)).alias("at"))


def settled(nodes: DataFrame, label: DataFrame, folder: str, per_cent: int, limits: Limits) -> DataFrame:
    """Step 4: labels after all lists of prefix shingles with more than one component have been compared whole."""
    rooted = stored(nodes.select("node", "n", "size", "pre").join(label, "node"), folder, "rooted")
    entries = rooted.select(F.explode("pre").alias("tok"), "node", "root", "size", "n")
    total = rooted.agg(F.sum(F.size("pre"))).first()[0] or 0
    lists = entries.groupBy("tok").agg(F.min("root").alias("place"), F.max("root").alias("top"), F.count(F.lit(1)).alias("m"))
    lists = lists.where("place < top").select("tok", "place", "m")
    open_ = join_hot(entries, lists, ["tok"], "m", total).where("m is not null")
    seats = placed(open_.select("place", "node", "root", "size", "n").distinct(), folder, per_cent, limits)
    whole = with_bodies(stored(seats, folder, "placed"), nodes)
    seated = whole.withColumn("_s", F.explode("at")).select("place", "_s.*", "node", "root", "n", "body")
    return merged(label, compared(seated, per_cent, limits, True), folder, "rest")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, per_cent: int = PER_CENT, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, h1, h2), and (h1, h2, root) of the classes that may have a link."""
    folder = scratch(docs.sparkSession)
    rows = stored(nodes_of(docs, text, doc_id, words, per_cent), folder, "nodes")
    members = rows.where("node is null").select("doc_id", "n", "h1", "h2")
    nodes = rows.where("node is not null").drop("doc_id")
    label = nodes.select("node", F.col("node").alias("root"))
    label = met(nodes, label, nodes.count(), folder, per_cent, limits)
    label = settled(nodes, label, folder, per_cent, limits)
    return members, nodes.select("node", "h1", "h2").join(label, "node").groupBy("h1", "h2").agg(F.min("root").alias("root"))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, per_cent: int = PER_CENT, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return grouped(docs, text, doc_id, words, per_cent, limits).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, text: str, doc_id: str, words: int, per_cent: int, limits: Limits = Limits()) -> DataFrame:
    """The same with the hash of each document's set."""
    members, roots = classes(docs, text, doc_id, words, per_cent, limits)
    sized = members.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m"))
    rooted, total = sized.join(roots, ["h1", "h2"], "left"), members.count()
    linked = rooted.where("root is not null")
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("w"))
    alone = rooted.where("root is null").select("h1", "h2", "m", F.col("least").alias("component_id"))
    right = join_hot(linked, best, ["root"], "w", total).select("h1", "h2", "m", "component_id").unionByName(alone)
    out = join_hot(members, right, ["h1", "h2"], "m", total)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "h1", "h2")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of docs that are the smallest id of their component. Where an id repeats, each of its texts is judged by its own component; rows that
    repeat id and text stay together (exact dedup tells them apart), and so do rows with a null id."""
    spark = docs.sparkSession
    found = grouped(docs, text, doc_id, words, per_cent)
    marks = found.where("doc_id is not null").select("doc_id", "h1", "h2", F.coalesce(F.col("component_id") != F.col("doc_id"), F.lit(False)).alias("gone"))
    # ids with a row that goes; most often all rows of the id do
    ids = stored(marks.groupBy("doc_id").agg(F.max("gone").alias("some"), F.min("gone").alias("all")).where("some").select(F.col("doc_id").alias("_gone"), "all"), scratch(spark), "gone")
    key = F.col(f"`{doc_id}`").cast("long")
    kept = docs.join(ids.select("_gone"), key == F.col("_gone"), "left_anti")
    mixed = ids.where("not all")
    if mixed.isEmpty():
        return kept
    at = docs.columns.index(text)

    def classed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [class_of(shingles(t.as_py(), words)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in h], pa.int64()), pa.array([b for _, b in h], pa.int64())], [*batch.schema.names, "_h1", "_h2"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_h1", T.LongType()), T.StructField("_h2", T.LongType())])
    rows = docs.join(mixed.select("_gone"), key == F.col("_gone"), "left_semi").mapInArrow(classed, schema)
    stays = marks.where("not gone").select(F.col("doc_id").alias("_stays"), F.col("h1").alias("_k1"), F.col("h2").alias("_k2"))
    own = (key == F.col("_stays")) & (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2"))
    return kept.unionByName(rows.join(stays, own, "left_semi").drop("_h1", "_h2"))


def class_of(g: np.ndarray) -> tuple[int, int]:
    """The 128-bit hash of a set of shingles, as two whole numbers."""
    h = xxhash.xxh3_128_intdigest(g.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)
