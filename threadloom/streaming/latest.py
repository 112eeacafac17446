"""The append-only label log as a stream: the latest label of each inquiry, kept up to date batch by batch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.labels import latest_labels

#: Parts of the state by hash of the key. A batch reads and writes only the parts its keys are in.
BUCKETS = 64


def label_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New files of a label folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def _parts(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, tuple[int, str]]:
    """The newest (version, path) of each bucket, from folder names alone; only versions before ``before``, if it is given."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, tuple[int, str]] = {}
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/bucket=*")) or []:
        path = status.getPath().toString()
        m = re.search(r"version=(\d+)/bucket=(\d+)$", path)
        version, bucket = int(m[1]), int(m[2])
        if (before is None or version < before) and version >= newest.get(bucket, (-1, ""))[0]:
            newest[bucket] = (version, path)
    return newest


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def keep_latest(labels: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest label of every inquiry seen so far, in ``buckets`` parts by hash of the inquiry.

    A batch merges the parts that its keys are in with itself, reduced to the latest rows, and writes them as a new version;
    the others stay as they are. What a version replaced is deleted once the next batch has begun, so readers of the newest
    parts are never cut off, and a batch that is replayed after a failure starts from the same parts and rewrites its own
    version: the result is exact. Late rows lose by their stamp as in the batch operator. Read it with ``current``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("bucket", F.pmod(F.xxhash64("inquiry_id"), F.lit(buckets)).cast("int"))
        touched = {r[0] for r in keyed.select("bucket").distinct().collect()}  # no more than ``buckets``
        parts = _parts(spark, folder, number)
        for path in {p for _, p in _parts(spark, folder).values()} - {p for _, p in parts.values()}:
            _drop(spark, path)  # of an earlier try of this batch
        rows = batch
        if held := [parts[b][1] for b in touched if b in parts]:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*held))
        last = latest_labels(rows).withColumn("bucket", F.pmod(F.xxhash64("inquiry_id"), F.lit(buckets)).cast("int"))
        last.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{folder}/version={number}")
        superseded(spark, folder, number - 1)

    return labels.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def superseded(spark: SparkSession, folder: str, number: int) -> None:
    """Delete parts that a version up to ``number`` replaced."""
    newest = _parts(spark, folder, number + 1)
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/bucket=*")
    for status in root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []:
        path = status.getPath().toString()
        m = re.search(r"version=(\d+)/bucket=(\d+)$", path)
        if int(m[1]) < newest.get(int(m[2]), (-1, ""))[0]:
            _drop(spark, path)


def current(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The latest label of every inquiry as of the newest version of each part."""
    paths = [p for _, p in sorted(_parts(spark, folder).values())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
