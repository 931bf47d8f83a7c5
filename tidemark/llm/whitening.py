"""Operator 13: embedding whitening by bit-sliced scatter.

Entries become whole numbers x = floor(64 * c) + 1,000,000. Each distinct vector counts once: a compact key of its numbers is grouped with a
partial aggregation before the shuffle. Blocks of distinct vectors are cut into bit planes (a word holds one bit of one dimension of 64 rows); the
weighted counts of ANDed planes are the exact cross-products of the block, which Spark sums as whole numbers. The driver gets one number a pair of
dimensions, centres them as integers (n * C - S * S'), and only then turns to floating point for the eigenvectors. x is shifted by
1,000,000 throughout, which no centred value sees.

Defined results: rows whose vector is null or holds a null, a NaN or an infinity are left out; repeated vectors are fitted once and returned for
each of their rows; vectors of several lengths are whitened among their own length each (ValueError beyond 64 lengths); empty vectors and an empty
table give no rows; components whose eigenvalue is zero to double precision (constant or dependent dimensions, a single vector) are left out; a null
id is carried as it is; other columns don't matter. An entry of 2**34 or more is an error, since its products would not fit exact sums.
`deviation` is null where it doesn't fit a long (from about 10**8 vectors on); `deviation_exact` holds it in 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_tasks, scratch, stored_compact, tidy

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
BLOCK = 16_384  #: rows of a block of bit planes
MOST = 1 << 40  #: of an entry's number
MOST_LENGTHS = 64
SUMS, COUNT = -1, -2  #: in place of a second dimension, and of the first


class Model(NamedTuple):
    n: int
    sums: list[int]  #: of floor(64 * c)
    components: np.ndarray  #: a column each
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector in a batch: the rows that remain and their floor(64 * c)."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        c = flat.reshape(-1, size) if len(rows) * size == len(flat) else flat[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            z = np.floor(SCALE * c[good])
        if z.size and np.abs(z).max() >= MOST:
            raise ValueError(f"an entry of {MOST // SCALE} or more has no exact products")
        yield rows[good], z.astype(np.int64)


def keys(z: np.ndarray) -> pa.Array:
    """Each row of numbers as bytes: in two, four or eight a number, as few as the row allows, so that equal rows and only those have equal bytes."""
    most = np.abs(z).max(axis=1)
    width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    if len(z) and width.min() == width.max():
        step = int(width[0]) * z.shape[1]
        offsets = (np.arange(len(z) + 1) * step).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(z), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(z.astype(f"<i{width[0]}")))]).cast(pa.binary())
    return pa.array([row.astype(f"<i{w}").tobytes() for row, w in zip(z, width)], pa.binary())


def unpacked(size: int, key: bytes) -> np.ndarray:
    return np.frombuffer(key, f"<i{len(key) // size}").astype(np.int64)


def planes(y: np.ndarray) -> np.ndarray:
    """Bit planes of rows of small whole numbers: [bit, dimension, word]; a word has one bit of 64 rows."""
    bits = max(1, int(y.max()).bit_length())
    pad = -len(y) % 64
    columns = np.ascontiguousarray(np.pad(y.T, ((0, 0), (0, pad))))
    return np.stack([np.ascontiguousarray(np.packbits(((columns >> b) & 1).astype(np.uint8), axis=1)).view(np.uint64) for b in range(bits)])


def scatter(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products (upper half) of the columns of z, as Python's whole numbers."""
    rows, size = z.shape
    low = z.min(axis=0)
    y = z - low
    sliced = planes(y)
    bits = len(sliced)
    kind = np.int64 if 2 * bits + rows.bit_length() < 63 else object
    weight = np.array([1 << b for b in range(bits)], kind)
    own = np.zeros((size, size), kind)
    for i in range(size):
        for a in range(max(1, int(y[:, i].max()).bit_length())):
            ones = np.bitwise_count(sliced[a, i] & sliced[:, i:]).sum(axis=2, dtype=np.int64)
            own[i, i:] += (1 << a) * (weight @ ones.astype(kind))
    sums, low, own = y.sum(axis=0).astype(object), low.astype(object), own.astype(object)
    products = own + np.multiply.outer(low, sums) + np.multiply.outer(sums, low) + rows * np.multiply.outer(low, low)
    return sums + rows * low, products


def distinct(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each distinct vector once: its length and the bytes of its numbers."""

    @tidy
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, z in numbers(batch.column(0)):
                if len(z):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), z.shape[1]), pa.int32()), keys(z)], ["size", "z"])

    found = df.select(F.col(f"`{vector}`").cast("array<double>").alias("c")).mapInArrow(encode, "size int, z binary")
    return found.dropDuplicates(["size", "z"])


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Vectors of one length, BLOCK at a time or what is left at the end."""
    waiting: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for size, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held = waiting.setdefault(size, [])
            held.append(unpacked(size, key))
            if len(held) == BLOCK:
                yield np.stack(waiting.pop(size))
    for held in waiting.values():
        yield np.stack(held)


def cross_products(vectors: DataFrame) -> DataFrame:
    """size, i, j, total: sums of products of dimensions i <= j; sums of dimension i where j is SUMS; the number of vectors where i is COUNT."""

    @tidy
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for z in blocks(batches):
            sums, products = scatter(z)
            t = totals.setdefault(z.shape[1], [0, 0, 0])
            totals[z.shape[1]] = [t[0] + len(z), t[1] + sums, t[2] + products]
        for size, (n, sums, products) in totals.items():
            i, j = np.triu_indices(size)
            values = [n, *sums, *products[i, j]]
            place = [np.concatenate([[COUNT], np.arange(size), i]), np.concatenate([[SUMS], np.full(size, SUMS), j])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), size), pa.int32()), *[pa.array(p, pa.int32()) for p in place], pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))],
                ["size", "i", "j", "total"],
            )

    return few_tasks(vectors).mapInArrow(add, "size int, i int, j int, total decimal(38,0)").groupBy("size", "i", "j").agg(F.sum("total").alias("total"))


def solved(n: int, sums: list[int], products: list[list[int]], components: int) -> Model:
    """Whole numbers are centred exactly; each entry of the covariance is rounded once."""
    size = len(sums)
    v = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            v[i, j] = v[j, i] = (n * products[i][j] - sums[i] * sums[j]) / (n * n)
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")
    order = order[e[order] > max(e.max(), 0.0) * size * np.finfo(np.float64).eps][:components]
    u = u[:, order]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)  # one sign, whatever the library does
    return Model(n, sums, u, e[order], float(np.trace(v)), 0.0)


def whitened(z: np.ndarray, m: Model) -> np.ndarray:
    mean = np.array([s / m.n for s in m.sums])
    return (z - mean) @ (m.components / np.sqrt(m.eigenvalues))


def deviations(z: np.ndarray, m: Model) -> list[int]:
    """Sums over dimensions of (n * z - S) ** 2, exact."""
    most = m.n * int(np.abs(z).max(initial=0)) + max(map(abs, m.sums))
    kind = np.int64 if z.shape[1] * most * most < 1 << 63 else object
    d = z.astype(kind) * m.n - np.array(m.sums, kind)
    return (d * d).sum(axis=1).tolist()


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vector. Two passes over the distinct vectors, which are written once."""
    vectors = stored_compact(distinct(df, vector), scratch(df.sparkSession), "vectors")
    found: dict[int, list] = {}
    for r in cross_products(vectors).collect():  # a row a pair of dimensions
        if r.size not in found:
            if len(found) == MOST_LENGTHS:
                raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
            found[r.size] = [0, [0] * r.size, [[0] * r.size for _ in range(r.size)]]
        held, total = found[r.size], int(r.total)
        if r.i == COUNT:
            held[0] = total
        elif r.j == SUMS:
            held[1][r.i] = total
        else:
            held[2][r.i][r.j] = total
    models = {size: solved(n, sums, products, components) for size, (n, sums, products) in found.items()}
    errors = identity_errors(vectors, models)
    return {size: m._replace(identity_error=errors.get(size, 0.0)) for size, m in models.items()}


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """How far the covariance of the whitened vectors is from the identity, measured on all of them."""
    known = vectors.sparkSession.sparkContext.broadcast(models)

    @tidy
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for z in blocks(batches):
            w = whitened(z, known.value[z.shape[1]])
            one = np.column_stack([w, np.ones(len(w))])  # the last row and column hold the sums
            totals[z.shape[1]] = totals.get(z.shape[1], 0.0) + one.T @ one
        for size, total in totals.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["size", "i", "j", "total"])

    sums = few_tasks(vectors).mapInArrow(add, "size int, i int, j int, total double").groupBy("size", "i", "j").agg(F.sum("total").alias("total"))
    raw = {size: np.zeros((len(m.eigenvalues) + 1,) * 2) for size, m in models.items()}
    for r in sums.collect():
        raw[r.size][r.i, r.j] = r.total
    errors = {}
    for size, t in raw.items():
        n, mean = models[size].n, t[-1, :-1] / models[size].n
        errors[size] = float(np.abs(t[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))
    return errors


def whiten(df: DataFrame, models: dict[int, Model], vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """A row for each remaining vector and component: id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    known = df.sparkSession.sparkContext.broadcast(models)
    names = [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]
    kind = df.schema[vec_id].dataType.simpleString()

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, z in numbers(batch.column(1)):
                if not len(rows):
                    continue
                m = known.value[z.shape[1]]
                k = len(m.eigenvalues)
                exact = deviations(z, m)
                again = pa.array(np.repeat(np.arange(len(rows)), k))
                column = lambda values: pa.array(np.tile(values, len(rows)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)).take(again), column(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(again), m.n, np.int64)),
                    pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(again), pa.array(whitened(z, m).ravel()), column(m.eigenvalues / m.trace),
                    pa.array(np.full(len(again), m.identity_error)), pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0)).take(again),
                ], names)

    schema = f"`{vec_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    return df.select(F.col(f"`{vec_id}`"), F.col(f"`{vector}`").cast("array<double>")).mapInArrow(run, schema)
