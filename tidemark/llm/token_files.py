"""Operator 3: token-id files of patched frame-of-reference blocks.

Documents are dealt out by ranges of doc_id and sorted, so part k of the written table follows part k-1. A row of it is one
segment, a file of its own in the format below; Spark's writer puts it on whatever storage the folder names.

    segment  "PFR1", u32 documents, u32 ids, u32 blocks, then
             documents x (i64 doc_id, u8 1 if the id is null, u32 ids of it)
             blocks x u32 byte where the block starts, counted from the first block
             blocks, each of BLOCK ids but the last
    block    u32 smallest id, u8 width, u16 ids, u16 exceptions, the ids' distances from the smallest in `width` bits each
             (lowest bit first, filled up to a byte), then exceptions x (u16 place, u32 distance)

width is the smallest that holds at least PERCENT per cent of a block's distances; larger ones are exceptions.

Defined results: null and empty texts are the end id alone; null ids sort first; repeated ids keep each its own entry, in the
order of the table; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import shipped, worker_encoder

BLOCK, PERCENT, SEGMENT, END = 1024, 90, 1 << 20, 1
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
PATCH = np.dtype([("at", "<u2"), ("v", "<u4")])
HEAD = struct.Struct("<IBHH")
FILES = "shard int, segment int, ids_before long, n_ids long, payload binary"


def pack_bits(values: np.ndarray, width: int) -> list[bytes]:
    """Rows of values below 2**width, each row packed on its own."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(*values.shape, 4), axis=-1, bitorder="little")[..., :width]
    return [row.tobytes() for row in np.packbits(bits.reshape(len(values), -1), axis=-1, bitorder="little")]


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=-1, bitorder="little").view("<u4").ravel()


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    full = len(ids) // BLOCK
    groups = [ids[: full * BLOCK].reshape(full, BLOCK)] * bool(full) + [ids[full * BLOCK :].reshape(1, -1)] * bool(len(ids) % BLOCK)
    out: list[bytes] = []
    for rows in groups:
        low = rows.min(axis=1)
        far = rows - low[:, None]
        n = rows.shape[1]
        at = -(-n * PERCENT // 100) - 1
        widths = np.frexp(np.partition(far, at, axis=1)[:, at].astype(np.float64))[1]  # bits of the percentile; 0 for 0
        blocks: list[bytes] = [b""] * len(rows)
        for width in np.unique(widths).tolist():
            mine = np.flatnonzero(widths == width)
            d = far[mine]
            over = d >> np.uint32(width) if width < 32 else np.zeros_like(d)
            packed = pack_bits(np.where(over > 0, 0, d), width)
            for k, row, data, high in zip(mine.tolist(), d, packed, over, strict=True):
                places = np.flatnonzero(high)
                patch = np.empty(len(places), PATCH)
                patch["at"], patch["v"] = places, row[places]
                blocks[k] = HEAD.pack(int(low[k]), width, n, len(places)) + data + patch.tobytes()
        out += blocks
    return out


def encode_segment(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    heads = np.array([(d or 0, d is None, len(x)) for d, x in docs], DOC)
    ids = np.concatenate([x for _, x in docs]).astype("<u4")
    blocks = encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u4")
    return b"PFR1" + struct.pack("<III", len(docs), len(ids), len(blocks)) + heads.tobytes() + starts.tobytes() + b"".join(blocks)


def decode_block(data: bytes, start: int) -> np.ndarray:
    low, width, n, patches = HEAD.unpack_from(data, start)
    at, size = start + HEAD.size, -(-n * width // 8)
    out = unpack_bits(data[at : at + size], width, n) if width else np.zeros(n, "<u4")
    patch = np.frombuffer(data, PATCH, patches, at + size)
    out[patch["at"]] = patch["v"]
    return out + np.uint32(low)


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Heads of the documents, starts of the blocks, and where the blocks begin."""
    if data[:4] != b"PFR1":
        raise ValueError("not a segment of token ids")
    docs, _, blocks = struct.unpack_from("<III", data, 4)
    heads = np.frombuffer(data, DOC, docs, 16)
    starts = np.frombuffer(data, "<u4", blocks, 16 + docs * DOC.itemsize)
    return heads, starts, 16 + docs * DOC.itemsize + 4 * blocks


def decode_segment(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    heads, starts, base = read_segment(data)
    ids = np.concatenate([decode_block(data, base + int(s)) for s in starts]) if len(starts) else np.zeros(0, "<u4")
    cuts = np.cumsum(heads["n"])[:-1] if len(heads) else []
    return [(None if h["null"] else int(h["id"]), x) for h, x in zip(heads, np.split(ids, cuts), strict=True)] if len(heads) else []


def decode_range(data: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a segment, from the blocks that hold them only."""
    _, starts, base = read_segment(data)
    first = start // BLOCK
    some = [decode_block(data, base + int(s)) for s in starts[first : -(-stop // BLOCK)]]
    return np.concatenate(some)[start - first * BLOCK : stop - first * BLOCK] if some else np.zeros(0, "<u4")


def write_files(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "word_bpe_49k.json", end: int = END) -> None:
    data = shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = worker_encoder(data.value), TaskContext.get().partitionId()
        last = np.array([end], "<u4").tobytes()
        held, size, before, segment = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            row = [[shard], [segment], [before], [size], [encode_segment(held)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in FILES.split(", ")])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 256):
                for key, ids in zip(keys[at : at + 256], encode(texts.slice(at, 256).to_pylist()), strict=True):
                    held.append((key, np.frombuffer(ids + last, "<u4")))
                    size += len(held[-1][1])
                    if size >= SEGMENT:
                        yield flush()
                        before, segment, held, size = before + size, segment + 1, [], 0
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("id", "place").sortWithinPartitions("id", "place")  # the place splits many rows of one id or none
    rows.mapInArrow(run, FILES).write.parquet(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files.

    Only one number a shard (its ids) goes to the driver and back.
    """
    files = spark.read.schema(FILES).parquet(folder)
    totals = dict(files.groupBy("shard").agg(F.sum("n_ids")).collect())
    base, sofar = {}, 0
    for shard in sorted(totals):
        base[shard], sofar = sofar, sofar + totals[shard]
    known = spark.sparkContext.broadcast(base)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs, at, rows = decode_segment(payload.as_py()), known.value[shard] + before, []
                for key, ids in docs:
                    rows.append((key, at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "ids_before", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
