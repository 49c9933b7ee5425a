"""Session-level settings the jobs rely on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session, else one below ``spark.sql.warehouse.dir``.

    A local warehouse counts only on a local master. Neither is made up here: a folder of one machine would hide what executors write from the driver and from each other.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not folder and not warehouse:
        raise ValueError("set spark.checkpoint.dir (or spark.sql.warehouse.dir) to a folder that the driver and all executors share")
    if not folder and not re.match(r"local(\[|$)", spark.conf.get("spark.master", None) or "local") and re.match(r"file:|/", warehouse):
        raise ValueError("set spark.checkpoint.dir: the warehouse is a local folder, which the machines of a cluster do not share")
    folder = (folder or f"{warehouse.rstrip('/')}/_checkpoints").rstrip("/")
    if not plain(spark.sparkContext.getCheckpointDir() or "").startswith(plain(folder)):
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def plain(path: str) -> str:
    """A path of the local file system without its scheme, which Spark writes in more than one way."""
    return re.sub(r"^file:/+", "/", path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store an iteration's result on reliable storage, so later iterations do not recompute it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Partitions for a compute-heavy Python step.

    Adaptive execution merges shuffle partitions by bytes, which can leave hours of Python work in one task; a fixed
    count keeps every core busy. A following ``groupBy`` on the same columns needs no further shuffle.
    """
    spark = df.sparkSession
    count = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(count, *cols)


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """As :func:`spread`, in four times as many partitions and by an exchange of its own.

    Spark leaves out an exchange where the rows lie by the same columns in as many partitions already, and then merges those by bytes. A
    few heavy rows need many partitions so that they do not meet.
    """
    spark = df.sparkSession
    return df.repartition(4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *cols)


#: Bytes of rows that a Python task takes at a time, but for a single row.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Python steps whose rows hold blocks of frames take a few of them at a time, whatever their number in a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
