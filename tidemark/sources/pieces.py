"""Records of text files that line breaks don't end for certain, read by many tasks: CSV fields with line breaks, JSON arrays.

A file is read in pieces (lines, or what lies between closing braces) by Spark's own splits. Where a split begins nobody knows whether it is inside a
quoted text, so a first pass works out what each split makes of either beginning. The driver puts these together in file order (one row a split), which gives
every split its true beginning, and a second pass cuts the records. Only records across the border of splits are joined by a shuffle, two pieces a split.
Pieces go through Python in Arrow batches: no built-in function carries a state from row to row without gathering a whole file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

State = tuple[int, int]  #: inside a quoted text or not, depth
WHOLE, TAIL, MIDDLE, HEAD = range(4)


def csv_step(piece: str, state: State) -> State:
    """A line of CSV: quotes count at the beginning of a field only, as the whole-file reader has it."""
    inside, at = state[0], 0
    if '"' not in piece:
        return state
    while True:
        if not inside:
            if not piece.startswith('"', at):
                at = piece.find(",", at) + 1
                if not at:
                    return 0, 0
                continue
            at += 1
        at = piece.find('"', at) + 1
        if not at:
            return 1, 0
        inside = 1
        if piece.startswith('"', at):
            at += 1
            continue
        inside, at = 0, piece.find(",", at) + 1
        if not at:
            return 0, 0


_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)


def json_step(piece: str, state: State) -> State:
    """What comes before a closing brace, and that brace."""
    inside, depth = state
    if inside:
        rest = _REST.match(piece)
        if not rest:
            return state
        piece = piece[rest.end() :]
    bare = _STRING.sub("", piece)
    open_ = bare.find('"')
    if open_ >= 0:
        bare = bare[:open_]
    depth += bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
    return (1, depth) if open_ >= 0 else (0, depth - 1)


class Form:
    """How pieces make records."""

    def __init__(self, separator: str, step: Callable[[str, State], State], base: State):
        self.separator, self.step, self.base = separator, step, base  #: base: the state after a record


CSV = Form("\n", csv_step, (0, 0))
JSON_ARRAY = Form("}", json_step, (0, 1))


def pieces(spark: SparkSession, path: str, form: Form) -> DataFrame:
    """value, path, start: the pieces of all files with the beginning of their split, in order within a split."""
    return spark.read.option("lineSep", form.separator).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for value, path, start in zip(*(c.to_pylist() for c in batch.columns)):
            yield (path, start), value


def beginnings(parts: DataFrame, form: Form) -> dict[tuple[str, int], State]:
    """The state at the beginning of each split."""
    step = form.step

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[State]] = {}
        for split, value in _by_split(batches):
            states = found.setdefault(split, [(0, 0), (1, 0)])
            states[:] = [step(value, s) for s in states]
        cols = [[s[0] for s in found], [s[1] for s in found], *[[states[k][i] for states in found.values()] for k in (0, 1) for i in (0, 1)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 5))], ["path", "start", "i0", "d0", "i1", "d1"])

    rows = sorted(parts.mapInArrow(run, "path string, start long, i0 long, d0 long, i1 long, d1 long").collect())
    out: dict[tuple[str, int], State] = {}
    before, state = None, (0, 0)
    for path, start, *after in rows:
        if path != before:
            before, state = path, (0, 0)
        out[path, start] = state
        state = (after[2 * state[0]], state[1] + after[2 * state[0] + 1])
    return out


def records(spark: SparkSession, path: str, form: Form) -> DataFrame:
    """value, path, start, seq: all records, with their place. seq is 0 for the first of a split."""
    parts = pieces(spark, path, form)
    known = spark.sparkContext.broadcast(beginnings(parts, form))
    separator, step, base = form.separator, form.step, form.base

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[str] = []
        split, state, opened, seq, size = None, base, True, 0, 0

        def rest() -> None:
            if held:
                out.append((separator.join(held), *split, seq, HEAD if opened else MIDDLE))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()))], ["value", "path", "start", "seq", "kind"])
            out.clear()
            return batch

        for now, value in _by_split(batches):
            if now != split:
                rest()
                held.clear()
                split, state, seq = now, known.value[now], 0
                opened = state == base or now[1] == 0  # else its first piece belongs to a record of an earlier split
            state = step(value, state)
            held.append(value)
            if state == base:
                out.append((separator.join(held), *split, seq, WHOLE if opened else TAIL))
                size += sum(map(len, held))
                held.clear()
                opened, seq = True, seq + 1
                if size > 1 << 22 or len(out) >= 10_000:
                    yield flush()
                    size = 0
        rest()
        if out:
            yield flush()

    found = parts.mapInArrow(run, "value string, path string, start long, seq long, kind int")
    whole = found.where(F.col("kind") == WHOLE).drop("kind")
    # at most two pieces a split
    number = F.sum((F.col("kind") == HEAD).cast("int")).over(W.partitionBy("path").orderBy("start", "seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    across = found.where(F.col("kind") != WHOLE).withColumn("_n", number).groupBy("path", "_n")
    joined = across.agg(F.sort_array(F.collect_list(F.struct("start", "seq", "value"))).alias("all"))
    text = F.array_join(F.transform("all", lambda p: p["value"]), separator)
    return whole.unionByName(joined.select(text.alias("value"), "path", F.col("all")[0]["start"].alias("start"), F.col("all")[0]["seq"].alias("seq")))
