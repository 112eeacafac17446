"""Sinks: append only what is new, rewrite only what changed, log rows, thread files, validation of a migration."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.labels import changed_rows, new_rows


def append_new(stored: DataFrame, incoming: DataFrame, key: str, path: str) -> int:
    """Append the rows whose key isn't stored to a parquet table; the number of rows written."""
    fresh = new_rows(stored, incoming, key)
    seen = fresh.agg(F.count("*")).first()[0]
    fresh.write.mode("append").parquet(path)
    return seen


def modified(spark: SparkSession, path: str) -> float:
    """When a table's files were last written, in seconds; an error if it is missing or empty."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    stamps = []
    while files.hasNext():
        stamps.append(files.next().getModificationTime() / 1000)
    if not stamps:
        raise FileNotFoundError(f"no files in {path}")
    return max(stamps)


def require_backup(spark: SparkSession, table: str, backup: str, most_seconds: float = 86_400, now: float | None = None) -> None:
    """An error unless the backup is there, no older than ``most_seconds``, and no older than the table it is a copy of."""
    copied = modified(spark, backup)
    if copied < modified(spark, table) or (time.time() if now is None else now) - copied > most_seconds:
        raise RuntimeError(f"the backup {backup} is out of date: nothing was written")


def rewrite_changed(before: DataFrame, after: DataFrame, key: str, column: str, path: str, dry_run: bool = False) -> DataFrame:
    """(n_rows, n_changed) of a rewrite; the changed rows go to ``path`` unless it is a dry run. Call ``require_backup`` first."""
    changed = changed_rows(before, after, key, column)
    if not dry_run:
        changed.write.mode("overwrite").parquet(path)
    counts = after.agg(F.count("*").alias("n_rows"))
    return counts.join(F.broadcast(changed.agg(F.count("*").alias("n_changed"))), on=F.lit(True), how="inner")


def rewrite_status(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """(status, n): how many rows a rewrite leaves as they are, changes, or can't make (null)."""
    old = before.select(F.col(key).alias("_k"), F.col(column).alias("_old"))
    status = F.when(F.col(column).isNull() & F.col("_old").isNotNull(), "errored").when(F.col(column).eqNullSafe(F.col("_old")), "unchanged").otherwise("changed")
    return after.join(old, F.col(key) == F.col("_k")).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def append_csv(rows: DataFrame, path: str) -> None:
    """Append rows to a CSV log with a header in each part file."""
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)


def write_threads(threads: DataFrame, path: str) -> None:
    """(thread_id, text) as one table keyed by thread id, sorted within its files so that a lookup reads few row groups."""
    threads.select("thread_id", "text").repartitionByRange("thread_id").sortWithinPartitions("thread_id").write.mode("overwrite").parquet(path)


def write_report(lines: DataFrame, path: str, *order: str) -> None:
    """A text report, one row of ``line`` per line in ``order``."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def reconcile(before: DataFrame, after: DataFrame, key: str, parents: DataFrame | None = None, parent_key: str | None = None) -> DataFrame:
    """(n_before, n_after, n_lost, n_added, n_orphans): whether a rebuilt table holds what the old one did."""
    b, a = before.select(F.col(key).alias("k")), after.select(F.col(key).alias("k"))
    sides = b.withColumn("s", F.lit(-1)).unionByName(a.withColumn("s", F.lit(1))).groupBy("k").agg(F.count(F.when(F.col("s") < 0, 1)).alias("b"), F.count(F.when(F.col("s") > 0, 1)).alias("a"))
    out = sides.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_before"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_after"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("b") - F.col("a"))), F.lit(0)).alias("n_lost"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("a") - F.col("b"))), F.lit(0)).alias("n_added"),
    )
    if parents is None:
        return out.withColumn("n_orphans", F.lit(0).cast("long"))
    lost = after.join(parents.select(parent_key), parent_key, "left_anti").agg(F.count("*").alias("n_orphans"))
    return out.join(F.broadcast(lost), on=F.lit(True), how="inner")


def draft_valid(draft, most: int = 20_000):
    """Whether a draft may be sent on: 1 to ``most`` characters."""
    return F.coalesce(F.length(draft).between(1, most), F.lit(False))
