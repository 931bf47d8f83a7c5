"""Operator 5 [native]: lines that many documents share lose all their copies.

A levelled store of sorted runs in the shared folder holds (line hash, number of documents). All runs are bucketed by the hash in the same way,
so joins and merges of runs read bucket by bucket, without a shuffle. Each batch of documents is reduced to one run; it is merge-joined
with the settled runs (hashes that already reached the threshold): what is found there goes on counting beside the levels, and the rest, which
the join leaves unmatched, becomes a level-0 run. When a level holds FANOUT runs they are merged into one run of the next level, and
hashes that reach the threshold move to the settled runs, which are compacted in the same way. Every line of every batch is counted exactly once.

Defined results: null and empty texts are one empty line; keys shorter than `min_chars` code points are never dropped; a line
counts once for each row of docs (a repeated row is a document of its own); an empty table gives an empty result; a text whose
lines all go becomes empty. Rows are told apart by a 128-bit hash of id and text, so null and repeated ids do no harm. Other
columns are carried whatever their names, except that n_lines and n_dropped take the place of columns with these names.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, hash128, join_hot, scratch

MIN_DOCS, MIN_CHARS, FANOUT, BATCHES = 10, 1, 2, 4


def raw_lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def keys(text: str = "text") -> Column:
    """The keys of a text's lines; lower-cased in one go before the split."""
    lines = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n", -1)
    return F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))


def distinct_keys(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """A row for each document and distinct key: hash of the row (_r1, _r2), hash of the key (_k1, _k2)."""
    r1, r2 = hash128(F.col(doc_id), F.col(text))
    each = docs.select(r1.alias("_r1"), r2.alias("_r2"), F.explode(F.array_distinct(keys(text))).alias("_key"))
    if min_chars > 1:
        each = each.where(F.char_length("_key") >= min_chars)
    else:
        each = each.where(F.col("_key") != "")
    k1, k2 = hash128(F.col("_key"))
    return each.select("_r1", "_r2", k1.alias("_k1"), k2.alias("_k2"))


KEYS = ["_k1", "_k2"]


class LineRuns:
    """Levelled sorted runs of (_k1, _k2, n) in one shared folder, all in the same buckets."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder, self.made = scratch(spark), 0
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _run(self, df: DataFrame, kind: str) -> DataFrame:
        """df as a bucketed and sorted table. Its name is known to the catalogue for a moment only: the files stay in the shared folder."""
        self.made += 1
        name = f"tidemark_{uuid.uuid4().hex}"
        rows = df.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", f"{self.folder}/{kind}-{self.made}").option("compression", "none")
        rows.saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return run

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """The sums of runs, by merge joins of their buckets."""
        out = runs[0]
        for run in runs[1:]:
            both = out.join(run.withColumnRenamed("n", "m").hint("merge"), KEYS, "full_outer")
            out = both.select(*KEYS, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def add(self, lines: DataFrame) -> None:
        """Adds a batch: a row for each document and distinct key."""
        self._add(lines.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).repartition(self.buckets, *KEYS), False)

    def add_all(self, lines: DataFrame, batches: int) -> None:
        """Adds many batches whose rows are read once: a row for each document and distinct key, with _batch. Their counts are written together, in the
        buckets of the runs; each batch is a filter on that table."""
        counts = self._run(lines.groupBy("_batch", *KEYS).agg(F.count(F.lit(1)).alias("n")).repartition(self.buckets, *KEYS), "batches")
        for k in range(batches):
            self._add(counts.where(F.col("_batch") == k).drop("_batch"), True)

    def _add(self, new: DataFrame, written: bool) -> None:
        if self.settled:
            known = self._merged(self.settled).select(*KEYS, F.lit(True).alias("known")).hint("merge")
            # one merge join says of each key whether it is settled; both parts are written together
            new = self._run(new.join(known, KEYS, "left"), "run")
            self.settled.append(new.where("known").drop("known"))
            self.levels[0].append(new.where("known is null").drop("known"))
        else:
            self.levels[0].append(new if written else self._run(new, "run"))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)
        if len(self.settled) > self.fanout:
            self.settled = [self._run(self._merged(self.settled), "settled")]

    def _compact(self, level: int) -> None:
        merged = self._run(self._merged(self.levels[level]), "merge")
        self.levels[level] = []
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(merged.where(F.col("n") < self.min_docs))
        self.settled.append(merged.where(F.col("n") >= self.min_docs))

    def shared(self) -> tuple[DataFrame, int]:
        """Keys found in at least min_docs documents with their number of documents, and the sum of all keys' numbers."""
        runs = self.settled + [run for level in self.levels for run in level]
        sums = [run.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")) for run in runs]
        total = functools.reduce(DataFrame.unionAll, sums).agg(F.sum("n")).first()[0]
        return self._run(self._merged(runs).where(F.col("n") >= self.min_docs), "shared"), total


def in_batches(docs: DataFrame, batches: int = BATCHES, text: str = "text", doc_id: str = "doc_id") -> Iterable[DataFrame]:
    """docs dealt by a hash of the row, whatever it is read from; docs is read once for each batch."""
    for k in range(batches):
        yield docs.where(F.pmod(F.xxhash64(doc_id, text), F.lit(batches)) == k)


def shared_lines(batches: Iterable[DataFrame], spark: SparkSession, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, int]:
    runs = LineRuns(spark, min_docs)
    for batch in batches:
        runs.add(distinct_keys(batch, text, doc_id, min_chars))
    return runs.shared()


def shared_lines_of(docs: DataFrame, batches: int = BATCHES, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, int]:
    """shared_lines of docs dealt to batches by a hash of the row; docs is read once."""
    runs = LineRuns(docs.sparkSession, min_docs)
    lines = distinct_keys(docs, text, doc_id, min_chars)
    runs.add_all(lines.select(F.pmod("_r1", F.lit(batches)).cast("int").alias("_batch"), *KEYS), batches)
    return runs.shared()


def drop_shared_lines(docs: DataFrame, shared: DataFrame, total: int, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with `text` cut down to the lines that stay, and n_lines, n_dropped (in place of columns with these names).

    Only (row, place, key) of lines and the few hashes that go are shuffled by key; a key in more than one line of 10,000 is looked up by
    broadcast (never more than 10,000 of those). Texts are shuffled once, by row, to meet the places of their dropped lines; the places that
    stay are a difference of two arrays, in time that grows with the lines.
    """
    r1, r2 = hash128(F.col(doc_id), F.col(text))
    k1, k2 = hash128(F.col("_key"))
    each = docs.select(r1.alias("_r1"), r2.alias("_r2"), F.posexplode(keys(text)).alias("_at", "_key"))
    each = each.where(F.char_length("_key") >= min_chars if min_chars > 1 else F.col("_key") != "").select("_r1", "_r2", "_at", k1.alias("_k1"), k2.alias("_k2"))
    hit = join_hot(each, shared, KEYS, "n", total).where("n is not null")
    drops = hit.groupBy("_r1", "_r2").agg(F.collect_set("_at").alias("_gone"))
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_row"), F.col(text).alias("_text"), r1.alias("_r1"), r2.alias("_r2"))
    rows = rows.join(drops, ["_r1", "_r2"], "left").withColumn("_lines", raw_lines("_text"))
    # a row that is there twice has its places once, since they are a set
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.col("_lines")[i]))
    rows = rows.withColumn("_kept", kept)
    return rows.select(
        *[F.array_join("_kept", "\n").alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in kept_columns],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )
