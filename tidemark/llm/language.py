"""Operator 7: language of whole texts and of their spans.

A word's script (by the ranges of its letters) narrows the languages to those that the training rows showed in that script; hashed
character 1- to 3-grams of the word score each of them; Viterbi over a text's words with a penalty for each switch labels spans. The
text's language is the one with the most letters, its score that language's share of them.

It learns from at most PER_LANG rows of each language (those whose id has the smallest hash; a bounded, documented sample) whose
crc32(id) mod 3 isn't 1. Languages, sources and ids are no inputs of a prediction.

Defined results: null texts and texts without a letter are `und` with score 0; a null id isn't held out and isn't learned from;
without a training row all texts are `und`; ties go to the language first in alphabetical order; repeated rows are each predicted, and count each in
training; an empty table gives an empty result; other columns, whatever their names, are never read. More than LANGS different languages are an
error: the driver holds 256 KB for each, and a column with so many values holds something else.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import tidy

PER_LANG, BITS, SWITCH = 600, 15, 12.0
LANGS = 500  #: languages at most
GROUP, GROUP_BYTES = 1024, 4 << 20  #: texts labelled at once, by number and by size (a longer text goes alone)
CACHE = 200_000  #: words whose scores a worker keeps
#: Starts of script ranges and the script from there on (fixed values; blocks of the Unicode standard).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
)
STARTS = [s for s, _ in SCRIPTS]
#: ASCII bytes: A-Z lower-cased, all but letters turned to spaces; bytes of other characters stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(PLAIN).split()


def script(word: bytes) -> str | None:
    """The script of most letters; None without a letter."""
    if word.isascii():
        return "latin"
    seen: dict[str, int] = {}
    for c in word.decode("utf-8", "replace"):
        if c.isalpha():
            name = SCRIPTS[bisect.bisect_right(STARTS, ord(c)) - 1][1]
            seen[name] = seen.get(name, 0) + 1
    return max(sorted(seen), key=seen.get) if seen else None


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the hashed n-grams of all words (with a mark at both ends), and the word of each."""
    data = np.frombuffer(b"".join([b"^%b$" % w for w in words]), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    slots, owners = [], []
    for n in (1, 2, 3):
        h = np.full(max(0, len(data) - n + 1), n, np.uint32)
        for k in range(n):
            h = (h ^ data[k : len(h) + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        whole = owner[: len(h)] == owner[n - 1 :]
        slots.append((h >> np.uint32(32 - BITS))[whole])
        owners.append(owner[: len(h)][whole])
    return np.concatenate(slots).astype(np.int64), np.concatenate(owners)


class Scores:
    """Scores of words, a row for each word seen; bounded."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: dict[str, list[bool]]) -> None:
        self.langs, self.table, self.scripts = langs, table, scripts
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(self.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def find(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.at) > CACHE:
            self.clear()
        new = list({w for words in docs for w in words}.difference(self.at))
        if new:
            slot, owner = grams(new)
            rows = np.stack([np.bincount(owner, self.table[slot, k], len(new)) for k in range(len(self.langs))], 1).astype(np.float32)
            letters = np.ones(len(new), np.int64)
            for k, w in enumerate(new):
                s = script(w)
                if s is None:
                    rows[k], letters[k] = 0, 0
                else:
                    letters[k] = len(w) if w.isascii() else sum(map(str.isalpha, w.decode("utf-8", "replace")))
                    if not all(may := self.scripts.get(s, [True] * len(self.langs))) and any(may):
                        rows[k][~np.array(may)] = -1e4
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.rows, self.letters = np.concatenate([self.rows, rows]), np.concatenate([self.letters, letters])
        at = self.at
        return [np.fromiter(map(at.__getitem__, words), np.int64, len(words)) for words in docs]


def viterbi(scores: list[np.ndarray], penalty: float = SWITCH) -> list[np.ndarray]:
    """The best labels of each sequence of score rows; all sequences step together, longest first."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lengths = np.array([len(scores[k]) for k in order])
    out = [np.zeros(len(s), np.int16) for s in scores]
    if not len(lengths) or not lengths[0]:
        return out
    flat = np.concatenate([scores[k] for k in order])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1))  # sequences with a row t
    back = np.zeros(flat.shape, np.int16)
    best = flat[start[: alive[0]]].copy()
    last = np.zeros((len(lengths), flat.shape[1]), np.float32)
    own = np.arange(flat.shape[1], dtype=np.int16)[None, :]
    for t in range(1, lengths[0]):
        n = alive[t]
        if n < len(best):
            last[n : len(best)] = best[n:]
            best = best[:n]
        top = best.argmax(1)
        jump = (best[np.arange(n), top] - penalty)[:, None]
        rows = start[:n] + t
        back[rows] = np.where(best >= jump, own, top[:, None])
        best = np.maximum(best, jump) + flat[rows]
    last[: len(best)] = best
    label = last.argmax(1).astype(np.int16)
    labels = np.zeros(len(flat), np.int16)
    for t in range(lengths[0] - 1, -1, -1):
        n = alive[t]
        rows = start[:n] + t
        labels[rows] = label[:n]
        if t:
            label[:n] = back[rows, label[:n]]
    for k, lo, n in zip(order, start, lengths, strict=True):
        out[k] = labels[lo : lo + n]
    return out


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_lang: int = PER_LANG, most: int = LANGS) -> tuple[list[str], np.ndarray, dict] | None:
    """Languages, log shares of n-grams, and the scripts of each; None without a training row. ValueError beyond `most` languages."""
    mine = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    if mine.select(lang).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} different values of {lang}")
    ids = mine.select(F.col(doc_id).alias("_key"), F.col(lang).alias("_lang"), F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)).alias("_hash"))
    # only about twice the sample's rows of a language are ranked; one row a language is broadcast
    cut = ids.groupBy("_lang").agg(F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.count(F.lit(1))).alias("_share"))
    ids = ids.join(F.broadcast(cut), "_lang").where(F.col("_hash") < F.col("_share") * (1 << 30))
    ids = ids.withColumn("_rank", F.row_number().over(W.partitionBy("_lang").orderBy("_hash", "_key"))).where(F.col("_rank") <= per_lang)
    rows = mine.select(doc_id, text, lang).join(F.broadcast(ids.select("_key").distinct()), F.col(doc_id) == F.col("_key")).select(lang, text)

    @tidy
    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each language and part: numbers of hashed n-grams, and of words by script."""
        found: dict[str, np.ndarray] = {}
        shown: dict[str, dict[str, int]] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(t.as_py())
                if words:
                    found[name] = found.get(name, 0) + np.bincount(grams(words)[0], minlength=1 << BITS)
                    mine = shown.setdefault(name, {})
                    for w in words:
                        if s := script(w):
                            mine[s] = mine.get(s, 0) + 1
        if found:
            names = list(found)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([found[n].astype("<i8").tobytes() for n in names], pa.binary()), pa.array([[f"{s} {c}" for s, c in shown[n].items()] for n in names], pa.list_(pa.string()))], ["lang", "grams", "scripts"])

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(g, "<i8") for g in f.grams)
        return pd.DataFrame({"lang": [key[0]], "grams": [total.tobytes()], "scripts": [[x for s in f.scripts for x in s]]})

    shape = "lang string, grams binary, scripts array<string>"
    found = rows.mapInArrow(counts, shape).groupBy("lang").applyInPandas(add, shape).orderBy("lang").collect()
    if not found:
        return None
    langs = [r.lang for r in found]
    table = np.stack([np.frombuffer(r.grams, "<i8") for r in found], 1) + 0.5
    table = np.log(table / table.sum(0)).astype(np.float32)
    table -= table.mean(1, keepdims=True)
    scripts: dict[str, list[bool]] = {}
    for k, r in enumerate(found):
        mine: dict[str, int] = {}
        for s, c in (x.split(" ") for x in r.scripts):
            mine[s] = mine.get(s, 0) + int(c)
        for s, c in mine.items():
            if 100 * c >= sum(mine.values()):
                scripts.setdefault(s, [False] * len(langs))[k] = True
    return langs, table, scripts


def labelled(texts: list[str | None], known: Scores) -> Iterator[tuple[str, float, list[bytes], np.ndarray]]:
    """Language, score, words and their labels of each text."""
    docs = [words_of(t) for t in texts]
    at = known.find(docs)
    for words, rows, label in zip(docs, at, viterbi([known.rows[r] for r in at]), strict=True):
        weight = np.bincount(label, known.letters[rows], len(known.langs)) if len(rows) else np.zeros(1)
        total = weight.sum()
        if not total:
            yield "und", 0.0, words, label
        else:
            k = int(weight.argmax())
            yield known.langs[k], float(weight[k] / total), words, label


def _in_groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = int(np.searchsorted(ends[at : at + GROUP], before + GROUP_BYTES, "right"))
        part = batch.slice(at, max(1, n))
        yield part, part.column(column).to_pylist()
        at += part.num_rows


def predict(docs: DataFrame, model: tuple | None, text: str = "text", doc_id: str = "doc_id", spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score; with spans also the spans: language, first word, words."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = SCHEMA + ", spans array<struct<lang:string,start:int,words:int>>" * spans
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(*known.value) if known.value else None
        for batch in batches:
            for part, texts in _in_groups(batch, 2):
                found = list(labelled(texts, scores)) if scores else [("und", 0.0, [], np.zeros(0, np.int16)) for _ in texts]
                cols = [part.column(0).cast(pa.int64()), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                if spans:
                    rows = []
                    for _, _, _, label in found:
                        cut = np.flatnonzero(np.diff(label)) + 1 if len(label) else np.zeros(0, np.int64)
                        edges = [0, *cut.tolist(), len(label)] if len(label) else [0]
                        rows.append([{"lang": scores.langs[label[a]], "start": a, "words": b - a} for a, b in zip(edges, edges[1:], strict=False)])
                    cols.append(pa.array(rows, kind))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "spans"][: len(cols)])

    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: tuple | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs with a language that holds at least this share of their letters, with their columns."""
    known, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(*known.value) if known.value else None
        for batch in batches:
            for part, texts in _in_groups(batch, at):
                kept = [name != "und" and share >= least for name, share, _, _ in labelled(texts, scores)] if scores else [False] * len(texts)
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
