"""Operator 1: quality rules and a calibrated classifier.

Hashed word 1- and 2-grams and hashed character 3-grams feed a logistic regression. It is trained on at most SAMPLE labelled rows (those
whose id has the smallest hash; a bounded, documented sample), on three quarters of them; Platt scaling on the last quarter turns
its score into a probability. Every text is then scored in Arrow batches and held against a fixed threshold, after fixed base rules.

Defined results: a null or empty text has no words and fails the base rules; where no labelled rows of both kinds exist, the base
rules alone decide; rows with a null label aren't used; repeated rows are scored each on its own; where an id repeats,
one of its texts is trained on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

SAMPLE = 4000  #: labelled rows for training, at most
WORD_BITS, CHAR_BITS = 12, 12
THRESHOLD = 0.5  #: of the probability that a text is good
SYMBOLS, BLANK = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 20
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words which the text has twice or more."""
    n = len(h) - WINDOW + 1
    if n < 2:
        return 0
    g = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(WINDOW):
        g = (g ^ h[k : n + k]) * np.uint64(0xFF51AFD7ED558CCD)
        g ^= g >> np.uint64(31)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def statistics(text: str | None) -> tuple[tuple[int, ...], bytes, np.ndarray]:
    """The base counts, the text's bytes, and its words' hashes."""
    text = text or ""
    data = text.encode()
    words = data.split()
    h = word_hashes(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - (len(data) - len(data.translate(None, BLANK)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(h)), data, h


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def features(data: bytes, h: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed word 1- and 2-grams and of character 3-grams (bytes of the whole text)."""
    pair = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)
    words = np.concatenate([h >> np.uint64(64 - WORD_BITS), pair >> np.uint64(64 - WORD_BITS)]).astype(np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    gram = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS) if len(b) > 2 else b[:0]
    w = np.bincount(words, minlength=1 << WORD_BITS).astype(np.float32)
    c = np.bincount(gram.astype(np.int64), minlength=1 << CHAR_BITS).astype(np.float32)
    return np.concatenate([np.sqrt(w / max(1.0, w.sum())), np.sqrt(c / max(1.0, c.sum()))])


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 1e-4, rate: float = 4.0) -> np.ndarray:
    """Weights and bias of a logistic regression, by accelerated gradient steps."""
    w, v, b, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for k in range(steps):
        m = k / (k + 3)
        aw, ab = w + np.float32(m) * v, b + m * vb
        err = 1 / (1 + np.exp(-(x @ aw + ab))) - y
        nw, nb = aw - np.float32(rate) * (x.T @ err.astype(np.float32) / len(y) + np.float32(decay) * aw), ab - rate * err.mean()
        v, vb, w, b = nw - w, nb - b, nw, nb
    return np.append(w, b).astype(np.float64)


def platt(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b so that 1 / (1 + exp(-(a * score + b))) is the probability of y; by Newton steps on smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    z = np.stack([score, np.ones_like(score)], 1)
    start = w = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        x = z @ w
        return float(np.sum(np.logaddexp(0, x) - target * x) + 5e-4 * np.sum((w - start) ** 2))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - target) + 1e-3 * (w - start)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:  # a shorter step where the full one overshoots
            step = step / 2
        w = w - step
    return float(w[0]), float(w[1])


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE, label_id: str = "doc_id"
) -> np.ndarray | None:
    """Weights, bias, and Platt's two numbers; None where labels of both kinds are missing. The labelled rows meet in one task: at most `sample`,
    one for each id (where an id repeats, the text with the least hash)."""
    usable = labels.select(F.col(label_id).alias("_key"), F.col(label).alias("_label")).where("_label is not null and _key is not null")
    share = min(1.0, 2 * sample / max(1, usable.count()))  # only about twice the sample's rows are sorted
    usable = usable.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    ids = usable.groupBy("_key").agg(F.min("_label").alias("_label"))
    ids = ids.orderBy(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)), "_key").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), F.col("_id") == F.col("_key")).select("_label", "_text", "_id")

    @tidy
    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(*statistics(t.as_py())[1:]).astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(x, pa.binary()), batch.column(2)], ["y", "x", "id"])

    def learn(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ys, xs, ids = [], [], []
        for f in frames:
            ys += f.y.tolist()
            ids += f.id.tolist()
            xs.append(np.frombuffer(b"".join(f.x), np.float16).reshape(len(f), -1))
        y = np.array(ys, np.float64)
        if not len(y) or y.min() == y.max():
            return
        x, order = np.concatenate(xs), np.lexsort((ids, [xxhash.xxh32_intdigest(str(i)) for i in ids]))
        x, y = x[order].astype(np.float32), y[order]
        held = np.arange(len(y)) % 4 == 3
        if y[~held].min() == y[~held].max():
            held[:] = False
        w = fit(x[~held], y[~held])
        score = x[held] @ w[:-1] + w[-1]
        a, b = platt(score, y[held]) if held.any() and y[held].min() != y[held].max() else (1.0, 0.0)
        yield pd.DataFrame({"w": [np.append(w, [a, b]).tobytes()]})

    each = rows.mapInArrow(vectors, f"y int, x binary, id {docs.schema[doc_id].dataType.simpleString()}").groupBy("id").agg(F.min("y").alias("y"), F.min_by("x", F.xxhash64("x")).alias("x"))
    one = each.select("y", "x", "id").repartition(1).mapInPandas(learn, "w binary")
    found = one.collect()
    return np.frombuffer(found[0].w) if found else None


def scorer(model: np.ndarray | None) -> Callable[[bytes, np.ndarray], float]:
    """The probability that a text is good; 1 without a model."""
    if model is None:
        return lambda data, h: 1.0
    w, b, a, c = model[:-3].astype(np.float32), *model[-3:]
    return lambda data, h: float(1 / (1 + np.exp(-np.clip(a * (features(data, h) @ w + b) + c, -60, 60))))


def score(docs: DataFrame, model: np.ndarray | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without its text, with the base counts, base_failed, probability and kept, which take the place of columns with these names."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name not in (text, *STATS, "base_failed", "probability", "kept")]
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], *[f"{s} long" for s in STATS], "base_failed boolean, probability double, kept boolean"])
    names = [*[f.name for f in rest], *STATS, "base_failed", "probability", "kept"]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = scorer(known.value)
        for batch in batches:
            stats, failed, p = [], [], []
            for t in batch.column(len(rest)):
                counts, data, h = statistics(t.as_py())
                stats.append(counts)
                failed.append(base_failed(counts[0], counts[4]))
                p.append(chance(data, h))
            kept = [not f and x >= threshold for f, x in zip(failed, p, strict=True)]
            cols = [pa.array([s[k] for s in stats], pa.int64()) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *cols, pa.array(failed), pa.array(p, pa.float64()), pa.array(kept, pa.bool_())], names)

    return docs.select(*[f"`{f.name}`" for f in rest], text).mapInArrow(run, out)


def keep_good(docs: DataFrame, model: np.ndarray | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with their columns."""
    known, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = scorer(known.value)
        for batch in batches:
            kept = []
            for t in batch.column(at):
                counts, data, h = statistics(t.as_py())
                kept.append(not base_failed(counts[0], counts[4]) and chance(data, h) >= threshold)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
