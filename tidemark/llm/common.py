"""What the text operators share: shared scratch folder, skew-proof key lookup, survivor bitmaps, hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bitmaps import MAX_BITS, bits_for, mark_survivors, survivor_bitmap  # noqa: F401

#: A key counts as hot if it holds more than one row in HOT; so there are never more than HOT hot keys.
HOT = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as the contracts define it: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared spark.checkpoint.dir. Only in local mode, where that is unset, a temporary one takes its place;
    on a cluster that is an error, since executors don't share such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_compact(df: DataFrame, folder: str, name: str) -> DataFrame:
    """stored for tables of hashes: few files, and no codec, since hashes don't shrink and codecs hold memory outside the heap."""
    path = f"{folder}/{name}"
    few_tasks(df).write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_tasks(df: DataFrame) -> DataFrame:
    """df in at most three tasks a core; partitions are read one after another, not gathered."""
    return df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes from different seeds."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of left with right, which has one row a key and the number of left rows of that key in `weight`.

    Hot keys (more than one row in HOT) are at most HOT rows of right, whatever the input, and are broadcast; left rows of
    such keys get a hash of their own as a second key, so they spread evenly over the shuffle that looks up all other keys (there
    the second key is the hash of the first). total is the number of left rows, or more. keys aren't null.
    """
    values = [c for c in right.columns if c not in keys]
    hot = F.col(weight) * F.lit(HOT) > F.lit(int(total))
    heavy = right.where(hot).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_is_hot"))
    light = right.where(~hot).withColumn("_salt", F.xxhash64(*keys))
    # the spread follows from the row, so a task that runs again deals its rows the same way
    plain = [c for c, kind in left.dtypes if kind in ("bigint", "int", "string", "date", "timestamp")]
    marked = left.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_is_hot"), F.xxhash64(F.lit("spread"), *plain)).otherwise(F.xxhash64(*keys)))
    both = marked.join(light, [*keys, "_salt"], "left")
    return both.select(*[F.col(c) for c in left.columns], *[F.when(F.col("_is_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def bitmap_bits(keys: int) -> int:
    return bits_for(keys, MAX_BITS)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many documents in an Arrow batch of this session: batches lie outside the heap, in the executor and in its Python workers."""
    if int(spark.conf.get(BATCH)) > rows or int(spark.conf.get(BATCH)) <= 0:
        spark.conf.set(BATCH, str(rows))


def give_back() -> None:
    """Memory that a Python worker has freed but still holds goes back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def tidy(f: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """f, which gives memory back at its end."""

    @wraps(f)
    def run(batches: Iterable) -> Iterator:
        yield from f(batches)
        give_back()

    return run
