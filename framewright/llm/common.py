"""Shared helpers: text kernels, shared-folder checkpoints and skew-proof ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from framewright.operators.storage import checkpoint, partitions, remove, shuffle_partitions, written  # noqa: F401  for the operators
from framewright.operators.storage import new_path as shared  # noqa: F401

#: A word is a run of anything but ASCII space and 0x09-0x0D, which is what bytes.split() yields.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest doc_id stands for a null one, so that null ids sort last.
NULL_ID = np.iinfo(np.int64).max
#: Words handled at once inside a Python worker; bounds its memory.
BATCH_WORDS = 400_000
BATCH_BYTES = 3_000_000


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches hold 8 MB at most: 10,000 long texts at once would cost
    several times their size in buffers of the JVM and of each worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if now == "67108864b":  # Spark's own value; what a user has set stays
        spark.conf.set(name, "8m")


def rows_of(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of equally named columns."""
    out = None
    for n in names:
        c = left[n].eqNullSafe(right[n])
        out = c if out is None else out & c
    return out


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row in its group, with no group in one task.

    Rows are range-partitioned by (group, order), ranked inside each partition, and shifted by
    the group's rows in earlier partitions. What is counted is one row per partition and group. Range
    partitioning reads df twice, once for its bounds; write a costly one first. Columns that start
    with two underscores must not be in df. Equal rows are ranked in any order.
    """
    cut = checkpoint(df.repartitionByRange(*group, *order).withColumn("__pid", F.spark_partition_id()))
    per = cut.groupBy("__pid", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("__pid").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__pid", *group).orderBy(*order)
    here = cut.withColumn("__at", F.row_number().over(inside) - 1)
    on = here["__pid"] == per["__p"]
    for i, c in enumerate(group):
        on = on & here[c].eqNullSafe(per[f"__g{i}"])
    keep = [c for c in cut.columns if c != "__pid"]
    return here.join(per, on).select(*keep, (F.col("__base") + F.col("__at")).cast("long").alias(name))


def ids_of(column: pa.Array) -> np.ndarray:
    """Long ids as an array, nulls as NULL_ID."""
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def bytes_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of about `most` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        cut = np.cumsum(lengths) // most
        edges = np.flatnonzero(np.diff(cut, prepend=-1))
        for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


class WordHash(dict):
    """64-bit hash of each distinct word, computed once; emptied when large. Words over LONGEST bytes
    are hashed each time, so that what is kept is bounded in bytes too."""

    MOST, LONGEST = 200_000, 64

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = h
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n successive word hashes (empty if there are fewer)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    if n <= 8:
        out = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            out *= mul
            out += words[k : len(words) - n + 1 + k]
        return mix64(out)
    # binary lifting: hash of 2m words = hash(first m) * mul**m + hash(next m)
    have, at, acc, block, size = 0, words, None, words, 1
    rest = n
    power = mul
    while rest:
        if rest & 1:
            if acc is None:
                acc, have = block, size
            else:
                m = len(words) - (have + size) + 1
                acc = acc[:m] * power + block[have : have + m]
                have += size
        rest >>= 1
        if rest:
            m = len(words) - 2 * size + 1
            block = block[:m] * power + block[size : size + m]
            power = np.uint64(int(power) ** 2 % 2**64)
            size *= 2
    return mix64(acc[: len(words) - n + 1])
