"""What outlives a job: checkpoints and folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROWS_A_FILE = 5_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: spark.checkpoint.dir, or a temporary one where it is unset and
    driver and executors are one process. Elsewhere an unset folder is an error, as executors
    would write to disks that no other can read."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """What runs inside has n shuffle partitions; then the session has its own number again."""
    name, own = "spark.sql.shuffle.partitions", partitions(spark)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written to the shared folder; what follows survives lost executors without its lineage.

    `rows` says how many it has at most: where that is little for the session's shuffle partitions,
    fewer tasks write fewer and larger files, of ROWS_A_FILE each at least."""
    shared_folder(df.sparkSession)
    if rows is not None:
        n = max(1, -(-rows // ROWS_A_FILE))
        if n < partitions(df.sparkSession):
            df = df.coalesce(n)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
    """df, written as Parquet to the shared folder, and its path, which the caller removes.

    For loops: a checkpoint keeps the planner's estimate of its size, and that of a join is a product, so
    after some rounds the planner multiplies numbers of millions of digits. A table has the size
    of its files."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "round")
    n = max(1, -(-rows // ROWS_A_FILE)) if rows is not None else partitions(spark)
    (df.coalesce(n) if n < partitions(spark) else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that it is in; a missing one is fine."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
