"""Operator 11: what five filters remove in each order, and how they overlap.

Duplicates are found by radix tries. A first pass over the beginnings of texts gives prefixes that cut the texts into ranges of about
equal bytes: each task proposes the shortest prefixes that part its own texts at equal steps, Spark thins the proposals out range by range.
Where one prefix alone holds more than a range, its texts are dealt by their hash as well. Each task then inserts its whole texts into
compressed tries with the least id at the terminals, so that copies leave a task once, and a task for each range merges what arrives in a trie of
its own; walking it gives the least id of each different text. The failures of each row are a mask of five bits; masks are counted by part, and the 120
orders are worked out from 32 counts a part.

Defined results: a null text counts as empty; a null part as the empty string; a text is a duplicate if a smaller id has the same text, so rows
that share text and id aren't duplicates of each other; a null id is neither a duplicate nor makes one; of several labels of one id the greatest counts, null
labels count as 0; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, stored, tidy

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_SHARE, UPPER_SHARE = 200, 50, 3
SIGNS, UPPER, TAIL_BYTES = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0x80, 0xC0))
PREFIX = 256  #: bytes of a text that may decide its range; texts that share more are dealt by hash
PROPOSALS = 64  #: prefixes that a batch of CHUNK texts proposes
CHUNK = 100_000
FINER = 4  #: ranges for each partition of the shuffle
TRIE_BYTES = 32 << 20  #: a task's trie of what it reads is emptied at this size
RANGE_BYTES = 64 << 20  #: of a partition that a trie merges
BATCH_BYTES = 4 << 20


class Trie:
    """A compressed trie of byte strings with the least id at each terminal."""

    __slots__ = ("label", "children", "ends", "least")

    def __init__(self, label: bytes = b""):
        self.label, self.children, self.ends, self.least = label, {}, False, None

    def mark(self, number: int | None) -> None:
        self.ends = True
        if number is not None and (self.least is None or number < self.least):
            self.least = number

    def insert(self, text: bytes, number: int | None) -> int:
        """The bytes that came to be stored."""
        node, at = self, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                leaf = node.children[text[at]] = Trie(text[at:])
                leaf.mark(number)
                return len(leaf.label)
            if not text.startswith(child.label, at):
                k = common(child.label, text, at)
                middle = node.children[text[at]] = Trie(child.label[:k])
                middle.children[child.label[k]] = child
                child.label = child.label[k:]
                child = middle
            node, at = child, at + len(child.label)
        node.mark(number)
        return 0

    def texts(self) -> Iterator[tuple[bytes, int | None]]:
        """Each text with its least id, in order."""
        open_ = [(self, b"")]
        while open_:
            node, before = open_.pop()
            text = before + node.label
            if node.ends:
                yield text, node.least
            open_ += [(node.children[b], text) for b in sorted(node.children, reverse=True)]

    def hashes(self) -> Iterator[tuple[bytes, int | None]]:
        """The 128-bit hash of each text with its least id; a prefix is hashed once for all that share it."""
        open_ = [(self, xxhash.xxh3_128())]
        while open_:
            node, before = open_.pop()
            h = before.copy()
            h.update(node.label)
            if node.ends:
                yield h.digest(), node.least
            open_ += [(child, h) for child in node.children.values()]


def common(label: bytes, text: bytes, at: int) -> int:
    """The number of first bytes that label shares with text from at on."""
    n = min(len(label), len(text) - at)
    if n <= 32:
        return next((k for k in range(n) if label[k] != text[at + k]), n)
    differ = np.frombuffer(label, np.uint8, n) != np.frombuffer(text, np.uint8, n, at)
    first = int(differ.argmax())
    return first if differ[first] else n


def proposals(some: list[tuple[bytes, int, int]]) -> Iterator[tuple[bytes, int]]:
    """Prefixes that part these beginnings of texts (with size and hash, so that copies count once) at equal steps of bytes, each with the bytes from it
    to the next one."""
    pairs = sorted((head, n) for head, n, _ in set(some))
    step = max(1, sum(n for _, n in pairs) // PROPOSALS)
    cut, held = pairs[0][0][:8], 0
    for (before, n), (after, _) in zip(pairs, [*pairs[1:], (b"", 0)]):
        held += n
        if held >= step and after:
            yield cut, held
            cut, held = after[: common(before, after, 0) + 1], 0
    yield cut, held


def ranges(texts: DataFrame, partitions: int) -> tuple[list[bytes], list[int], int]:
    """Prefixes at which ranges begin, the number of parts of each range (one more than prefixes), and the bytes of all texts.

    texts has `t`, bytes. At most some FINER * partitions proposals reach the driver, of PREFIX bytes or fewer each.
    """

    @tidy
    def propose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[bytes, int, int]] = []

        def out() -> pa.RecordBatch:
            found = list(proposals(waiting))
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["p", "n"])

        for batch in batches:
            waiting.extend(zip(*(c.to_pylist() for c in batch.columns)))
            if len(waiting) >= CHUNK:
                yield out()
        if waiting:
            yield out()

    heads = texts.select(F.substring("t", 1, PREFIX), F.octet_length("t").cast("long") + 1, F.xxhash64("t")).mapInArrow(propose, "p binary, n long")
    heads = stored(heads.groupBy("p").agg(F.sum("n").alias("n")), scratch(texts.sparkSession), "prefixes")
    total = int(heads.agg(F.sum("n")).first()[0] or 0)
    wanted = FINER * max(partitions, total // RANGE_BYTES)
    step = max(1, total // (2 * wanted))

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, found = None, 0, []
        for batch in batches:
            for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first is not None and held + n > step:
                    found.append((first, held))
                    first, held = None, 0
                first, held = p if first is None else first, held + n
        if first is not None:
            found.append((first, held))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["p", "n"])

    few = heads.repartitionByRange("p").sortWithinPartitions("p").mapInArrow(thin, "p binary, n long")
    bounds, weights, held = [], [], 0
    for p, n in sorted((r.p, r.n) for r in few.collect()):
        p = bytes(p)
        if held + n > total // wanted and held:
            weights.append(held)
            bounds.append(p)
            held = 0
        held += n
    weights.append(held)
    return bounds, [max(1, round(w * wanted / max(1, total))) for w in weights], total


def least_ids(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """least, h: the least id of each different text and the text's 128-bit hash."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"), F.col(f"`{doc_id}`").cast("long").alias("i"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, parts, total = ranges(texts, partitions)
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    known = spark.sparkContext.broadcast((bounds, parts, first))

    @tidy
    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, parts, first = known.value

        def out(trie: Trie) -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for t, least in trie.texts():
                at = bisect_right(bounds, t)
                rows.append((first[at] + (zlib.crc32(t) % parts[at] if parts[at] > 1 else 0), t, least))
                held += len(t)
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

        trie, held = Trie(), 0
        for batch in batches:
            for t, i in zip(batch.column(0), batch.column(1)):
                held += trie.insert(t.as_py(), i.as_py()) + 200  # and the node itself
                if held >= TRIE_BYTES:
                    yield from out(trie)
                    trie, held = Trie(), 0
        yield from out(trie)

    def batch_of(rows: list[tuple[int, bytes, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["place", "t", "least"])

    @tidy
    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            for t, i in zip(batch.column(0), batch.column(1)):
                trie.insert(t.as_py(), i.as_py())
        ids, hashes = [], []
        for h, least in trie.hashes():
            hashes.append(h)
            ids.append(least)
            if len(ids) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["least", "h"])
                ids, hashes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["least", "h"])

    dealt = texts.mapInArrow(distinct, "place int, t binary, least long").repartition(max(partitions, total // RANGE_BYTES), "place")
    return dealt.select("t", "least").mapInArrow(merged, "least long, h binary")


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits 1, 2, 4, 8."""
    words = text.split()
    points = len(text) - (len(text) - len(text.translate(None, TAIL_BYTES)))
    upper = len(text) - len(text.translate(None, UPPER))
    signs = len(text) - len(text.translate(None, SIGNS))
    found = (len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_SHARE * len(words), 100 * upper > UPPER_SHARE * points, signs > 0)
    return sum(1 << k for k, failed in enumerate(found) if failed)


def masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """i, part, h and mask of each row: its id, its part, its text's hash and the filters A to E that it fails."""
    bounded_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hashes = [], []
            for t in batch.column(2):
                t = t.as_py()
                found.append(failures(t))
                hashes.append(xxhash.xxh3_128_digest(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array(found, pa.int32())], ["i", "part", "h", "mask"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    rows = rows.mapInArrow(run, "i long, part string, h binary, mask int")
    first = least_ids(docs, text, doc_id).select(F.col("least").alias("i"), "h", F.lit(True).alias("is_first"))
    again = F.col("i").isNotNull() & F.col("is_first").isNull()
    return rows.join(first, ["i", "h"], "left").select("i", "part", "h", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask"))


#: Every step of every order: the order, the step, the bits of the filters before it, its own bit.
STEPS = [
    {"filter_order": "".join(order), "step": k + 1, "before": sum(1 << FILTERS.index(f) for f in order[:k]), "bit": 1 << FILTERS.index(order[k])}
    for order in permutations(FILTERS)
    for k in range(len(order))
]


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang", label_id: str = "doc_id") -> DataFrame:
    """A row for each part, order and step with its counts."""
    mark = lambda c: F.max(F.coalesce((F.col(f"`{c}`") == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.where(F.col(f"`{label_id}`").isNotNull()).groupBy(F.col(f"`{label_id}`").cast("long").alias("i")).agg(mark("quality"), mark("toxic"))
    rows = masks(docs, text, doc_id, part).drop("h").join(known, "i", "left")
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    steps = F.from_json(F.lit(json.dumps(STEPS)), "array<struct<filter_order string, step int, before int, bit int>>")
    each = counts.withColumn("s", F.explode(steps)).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    # of all orders, a filter comes first among those that a row fails in one of as many as these are
    share = F.lit(120) / F.bit_count("mask")
    total = lambda when, value, name: F.sum(F.when(when, value).otherwise(0)).cast("long").alias(name)
    n = F.col("n")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, n, "kept"), total(fails & ~gone, n, "removed"), total(fails & gone, n, "redundant"), total(F.col("mask") == F.col("bit"), n, "unique_fails"),
        total(fails & ~gone, F.col("good"), "good_lost"), total(fails & ~gone, F.col("toxic"), "toxic_lost"), total(fails, n * share.cast("long"), "shapley"),
    )
