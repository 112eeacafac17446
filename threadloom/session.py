"""Session helpers shared by every operator: table access, parallelism, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and holds no more rows than this.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, which may be a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out over the cluster when the scan has fewer partitions than there are cores.

    A large input already has a split per 128 MB and is left alone; a single small file would otherwise keep one core busy.
    With ``keys`` the deal is by hash (repeatable after a lost executor), else round robin.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *keys) if keys else df.repartition(2 * cores)


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where none is named (local tests) a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
    return named or os.path.join(tempfile.gettempdir(), "threadloom-checkpoint")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, *parts: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder, for results too wide to be kept as a checkpoint: columns are
    compressed and read one by one, in folders by ``parts``. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_shared_folder(spark)}/{uuid.uuid4()}")
    df.write.partitionBy(*parts).parquet(path.toString())
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` was counted and is small; a larger side is joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
