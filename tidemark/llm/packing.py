"""Operator 2: packing tokens into sequences of fixed capacity by minimum bin slack.

A document's full windows are sequences of their own. What remains of each document (less than one window) is packed block by
block inside a task: for each sequence a bitset subset-sum over the remaining lengths (with their counts) finds the multiset that
comes closest to the capacity, with the longest remainder as its seed, and the counts used are read back from the bitsets. If the
closest multiset leaves slack, a remainder is cut to fill it. Less than one sequence is left to the next block; at a partition's
end it is cut into sequences of powers of two, which need no padding. So nothing is shuffled, nothing is padded, and memory is
bounded by a block.

Defined results: null and empty texts have the end id only; rows with equal or null ids are packed each on its own; no row, no
sequence. sequence_id holds the partition's number above bit 40.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import tidy
from .tokens import shipped, worker_encoder

CAPACITY, END = 2048, 1
BLOCK = 4096  #: remainders packed at once
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], order: list[int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (within counts) that holds the longest and whose sum is closest to capacity without passing it.

    order: the lengths with a count, longest first. Bit s of a bitset says that a sum s can be made; a length with count c goes
    in as 1, 2, 4, ... copies. It stops at once when capacity itself can be made.
    """
    seed = order[0]
    room = capacity - seed
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in order if room else ():
        if length > room:
            continue
        left, n = min(counts[length] - (length == seed), room // length), 1
        while left > 0:
            n = min(n, left)
            left -= n
            wider = (reach | reach << (n * length)) & mask
            if wider != reach:
                steps.append((length, n, reach))
                reach = wider
            if reach & goal:
                break
            n *= 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {seed: 1}
    for length, n, before in reversed(steps):  # a sum that could be made without this step didn't need it
        if not before >> total & 1:
            used[length] = used.get(length, 0) + n
            total -= n * length
    return used


class Packer:
    """Takes documents' ids, gives pieces (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, block: int = BLOCK) -> None:
        self.capacity, self.block, self.next = capacity, block, 0
        self.rest: list[tuple] = []  # (doc_id, start, ids, doc_tokens)

    def _piece(self, part: tuple, offset: int) -> tuple:
        return (*part, self.next, offset)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at, n = 0, len(ids)
        while n - at >= self.capacity:
            yield self._piece((doc_id, at, ids[at : at + self.capacity], n), 0)
            self.next += 1
            at += self.capacity
        if at < n:
            self.rest.append((doc_id, at, ids[at:], n))
        if len(self.rest) >= self.block:
            yield from self.pack()

    def pack(self) -> Iterator[tuple]:
        """Sequences from the remainders until less than one sequence is left."""
        by: dict[int, list[tuple]] = {}
        for part in self.rest:
            by.setdefault(len(part[2]), []).append(part)
        total = sum(len(part[2]) for part in self.rest)
        counts = {k: len(v) for k, v in by.items()}
        order = sorted(counts, reverse=True)
        while total >= self.capacity:
            offset = 0
            for length, n in fill(counts, order, self.capacity).items():
                for _ in range(n):
                    yield self._piece(by[length].pop(), offset)
                    offset += length
                counts[length] -= n
                if not counts[length]:
                    order.remove(length)
            if offset < self.capacity:  # cut the shortest remainder that fills the slack; else any, until it is filled
                need = self.capacity - offset
                length = next((k for k in reversed(order) if k >= need), order[0] if order else 0)
                doc_id, start, ids, n = by[length].pop()
                counts[length] -= 1
                if not counts[length]:
                    order.remove(length)
                yield self._piece((doc_id, start, ids[:need], n), offset)
                left = (doc_id, start + need, ids[need:], n)
                if k := len(left[2]):
                    by.setdefault(k, []).append(left)
                    counts[k] = counts.get(k, 0) + 1
                    if counts[k] == 1:
                        order.append(k)
                        order.sort(reverse=True)
            self.next += 1
            total -= self.capacity
        self.rest = [part for parts in by.values() for part in parts]

    def finish(self) -> Iterator[tuple]:
        yield from self.pack()
        total = sum(len(part[2]) for part in self.rest)
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        offset = 0
        for doc_id, start, ids, n in self.rest:
            while len(ids):
                take = min(len(ids), sizes[0] - offset)
                yield self._piece((doc_id, start, ids[:take], n), offset)
                start, ids, offset = start + take, ids[take:], offset + take
                if offset == sizes[0]:
                    sizes.pop(0)
                    self.next, offset = self.next + 1, 0
        self.rest = []


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, and their ids (array column `ids`) if asked for."""
    data = shipped(docs.sparkSession, tokenizer)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def table(pieces: list[tuple], base: int) -> pa.RecordBatch:
        cols = {
            "doc_id": [p[0] for p in pieces], "start": [p[1] for p in pieces], "length": [len(p[2]) for p in pieces], "ids_crc32": [zlib.crc32(p[2].tobytes()) for p in pieces],
            "doc_tokens": [p[3] for p in pieces], "sequence_id": [base + p[4] for p in pieces], "offset": [p[5] for p in pieces],
        }
        arrays = [pa.array(cols[n], pa.int64()) for n in names]
        if with_ids:
            arrays.append(pa.array([p[2].astype(np.int32) for p in pieces], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, [*names, "ids"] if with_ids else names)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = worker_encoder(data.value), Packer(capacity)
        base, out = TaskContext.get().partitionId() << 40, []
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 256):
                for key, ids in zip(keys[at : at + 256], encode(texts.slice(at, 256).to_pylist()), strict=True):
                    out += packer.add(key, np.frombuffer(ids + last, "<u4"))
                    if len(out) >= 4096:
                        yield table(out, base)
                        out = []
        out += packer.finish()
        if out:
            yield table(out, base)

    return docs.select(doc_id, text).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
