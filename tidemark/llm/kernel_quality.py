"""Operator 12: a quality classifier on random Fourier features of document statistics.

Each text becomes some thirty statistics (shares of kinds of characters, of repeated words, lines and windows, lengths, entropy), read once and
written as a narrow table. Standardised, they go through random Fourier features, which approximate a Gaussian kernel. Every task adds up the
normal equations of its training rows, Spark adds up those of the tasks, fold by fold; ridge weights are solved from the sums on the driver,
whose size is that of the features, not of the data. For the isotonic calibration each training row is scored by the weights
of the folds that it isn't in (the sum of all folds less its own), and the scores are counted in equal bins, which pool into a rising curve.

Defined results: a null text counts as empty and gets a score; all labelled rows train, without any bound; a label that is null isn't used, and of several
labels of one id the least counts; where an id repeats, each of its texts trains and is scored; a null id never trains and isn't held out; without labels of both
kinds the score is the share of label 1 among the training rows (0.5 without any); an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, few_tasks, scratch, stored, tidy
from .quality import repeated_words, word_hashes

FEATURES, RIDGE, SEED = 256, 1.0, 12
FOLDS, BINS = 5, 2048
THRESHOLD = 0.3
FAR = 4.0  #: standardised statistics are cut here, so that one odd number doesn't hide the others
TIE = 1e-3  #: weight of the raw score in the calibrated one, so that equal steps keep their order

#: Kinds of bytes whose shares are statistics.
KINDS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r", b"\t\x0b\x0c", b".", b",;:", b"!", b"?", b"\"'`", b"()[]{}", b"#$%&*|<>=+~^@\\", b"/_-",
    bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)),
)
KIND_OF = np.zeros((256, len(KINDS)))
for _k, _some in enumerate(KINDS):
    KIND_OF[list(_some), _k] = 1.0


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    size, n = max(1, len(data)), max(1, len(words))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    h = word_hashes(words)
    upper = sum(1 for w in words if w.isupper())
    return np.concatenate([
        counts @ KIND_OF / size,
        [
            np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0,
            (lengths <= 2).sum() / n, (lengths >= 12).sum() / n, len(set(words)) / n, repeated_words(h) / n, upper / n,
            len(set(lines)) / max(1, len(lines)), np.log1p(len(data) / max(1, len(lines))), float(-(share * np.log2(share)).sum()),
            sum(1 for x in lines if x.rstrip()[-1:] in b".!?:\"") / max(1, len(lines)),
        ],
    ]).astype(np.float32)


STATISTICS = len(statistics(""))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray  #: raw scores, rising
    values: np.ndarray  #: calibrated values at the knots, not falling


def directions() -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases for a Gaussian kernel whose width is the usual distance of two standardised rows."""
    r = np.random.default_rng(SEED)
    return r.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS), r.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of rows of statistics, with a last feature that is always 1."""
    w, phase = directions()
    z = np.clip((x - mean) / scale, -FAR, FAR)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones(len(x))])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The id, held_out and the statistics x of each row, written once: texts are read a single time."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([statistics(t.as_py()) for t in batch.column(2)]) if batch.num_rows else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * STATISTICS, pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["_id", "held_out", "x"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), held_out(doc_id).alias("held_out"), F.col(f"`{text}`").cast("string").alias("_text"))
    return stored(rows.mapInArrow(run, f"_id {kind}, held_out boolean, x array<float>"), scratch(docs.sparkSession), "statistics")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, STATISTICS)


def training_rows(rows: DataFrame, labels: DataFrame, label: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """fold, y and x of the rows that may train."""
    known = labels.select(F.col(f"`{label_id}`").alias("_key"), F.col(f"`{label}`").cast("double").alias("y")).where("y is not null and _key is not null").groupBy("_key").agg(F.min("y").alias("y"))
    fold = F.pmod(F.floor(F.crc32(F.col("_id").cast("string").cast("binary")) / 5), F.lit(FOLDS)).cast("int")
    return rows.where("not held_out").join(known, F.col("_id") == F.col("_key")).select(fold.alias("fold"), "y", "x")


def normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The sums of f f' and, in the last row, of y f over the training rows of each fold: [fold, row, feature]."""

    @tidy
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 2, FEATURES + 1))
        for batch in batches:
            f, y, fold = fourier(matrix(batch.column(2)), mean, scale), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for k in np.unique(fold):
                mine = fold == k
                total[k, :-1] += f[mine].T @ f[mine]
                total[k, -1] += y[mine] @ f[mine]
        if total.any():
            place = np.indices(total.shape[:2]).reshape(2, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(place[0]) + 1) * (FEATURES + 1), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(place[0], pa.int32()), pa.array(place[1], pa.int32()), lists], ["fold", "at", "v"])

    sums = few_tasks(rows).mapInArrow(add, "fold int, at int, v array<double>").groupBy("fold", "at").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    out = np.zeros((FOLDS, FEATURES + 2, FEATURES + 1))
    for r in sums.select("fold", "at", vector_to_array("v").alias("v")).collect():  # a row a feature and fold
        out[r.fold, r.at] = r.v
    return out


def ridge(sums: np.ndarray) -> np.ndarray:
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9  # the constant isn't held back
    return np.linalg.solve(sums[:-1] + penalty, sums[-1])


def pooled(count: np.ndarray, total: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: bins with their counts, label sums and score sums become knots and rising values."""
    blocks: list[list[float]] = []
    for n, y, s in zip(count, total, at):
        blocks.append([n, y, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([s / n for n, _, s in blocks]), np.array([y / n for n, y, _ in blocks])


def calibration(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values from scores by the weights of other folds; Spark counts them in BINS equal bins from -0.5 to 1.5."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, fold = fourier(matrix(batch.column(2)), mean, scale), batch.column(0).to_numpy()
            raw = np.clip((f * weights[fold]).sum(axis=1), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(BINS - 1, ((raw + 0.5) / 2 * BINS).astype(np.int64)), pa.int32()), batch.column(1), pa.array(raw)], ["bin", "y", "raw"])

    bins = rows.mapInArrow(run, "bin int, y double, raw double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("raw").alias("raw"))
    found = sorted(bins.collect())  # BINS rows at most
    return pooled(*(np.array([r[k] for r in found], np.float64) for k in ("n", "y", "raw")))


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", label_id: str = "doc_id") -> Model:
    """rows: what `measured` gives. Labels count as 1 from 1 on and as 0 below."""
    mine = stored(training_rows(rows, labels, label, label_id).withColumn("y", (F.col("y") >= 1).cast("double")), scratch(rows.sparkSession), "training")
    good = mine.agg(F.avg("y")).first()[0]
    if good in (None, 0.0, 1.0):
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, np.array([0.0]), np.array([0.5 if good is None else good]))
    moments = mine.select(Summarizer.metrics("mean", "std").summary(array_to_vector(F.col("x").cast("array<double>"))).alias("m")).first().m
    mean, std = moments["mean"].toArray(), moments["std"].toArray()
    scale = np.where(std > 1e-12, std, 1.0)
    sums = normal_equations(mine, mean, scale)
    others = np.stack([ridge(sums.sum(axis=0) - sums[k]) for k in range(FOLDS)])
    knots, values = calibration(mine, mean, scale, others)
    return Model(mean, scale, ridge(sums.sum(axis=0)), knots, values)


def calibrated(raw: np.ndarray, m: Model) -> np.ndarray:
    return (1 - TIE) * np.interp(raw, m.knots, m.values) + TIE * np.clip((raw + 0.5) / 2, 0, 1)


def score(rows: DataFrame, model: Model, doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The id, held_out, score and predicted of each row of `measured`."""
    known, kind = rows.sparkSession.sparkContext.broadcast(model), rows.schema["_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            raw = fourier(matrix(batch.column(2)), m.mean, m.scale) @ m.weights if m.weights is not None else np.zeros(batch.num_rows)
            p = calibrated(raw, m) if m.weights is not None else np.full(batch.num_rows, m.values[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [doc_id, "held_out", "score", "predicted"])

    return rows.select("_id", "held_out", "x").mapInArrow(run, f"`{doc_id}` {kind}, held_out boolean, score double, predicted int")
