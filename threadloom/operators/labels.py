"""Reads of the append-only label log: latest row per key, work queues, integrity, counts, relabelling."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut

EXCLUDED = "EXCLUDE_FROM_EVAL%"


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order`` (largest first, nulls last). One row per key, also for repeated rows.

    Aggregated with map-side combine, so that a key with a third of all rows is reduced before the shuffle. Spark aggregates
    strings by sorting each partition, so give it the columns that are needed only. Rows with a null key form one key of their own.
    """
    # equal order values are told apart by the whole row; maps can't be ordered and so can't be columns here
    rest = [c for c in df.columns if c not in (key, *order)]
    last = F.max(F.struct(*order, F.struct(*rest).alias("_rest"))).alias("_last")
    return df.groupBy(key).agg(last).select(key, *[f"_last.{c}" for c in order], "_last._rest.*").select(df.columns)


def latest_with_ties(df: DataFrame, key: str, order: str) -> DataFrame:
    """All rows of a key that share its largest ``order`` value; a key with none but null values keeps no row."""
    top = df.groupBy(key).agg(F.max(order).alias("_top"))
    return df.join(top.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_top"))).select(df.columns)


def latest_labels(labels: DataFrame) -> DataFrame:
    return latest_per_key(labels, "inquiry_id", "labeled_at", "label_id")


def not_excluded(reason: Column) -> Column:
    """True unless the reason opens with the exclusion marker, in any case, ``_`` standing for any character."""
    return ~F.coalesce(reason, F.lit("")).ilike(EXCLUDED)


def gradeable(labels: DataFrame, inquiries: DataFrame) -> DataFrame:
    """Latest labels of known inquiries that aren't excluded. Exclusion looks at the latest row only, so it comes after it."""
    known = labels.join(inquiries.select("inquiry_id").distinct(), "inquiry_id", "left_semi")
    return latest_labels(known).where(not_excluded(F.col("edge_case_reason")))


def clean_inbounds(labels: DataFrame, inquiries: DataFrame) -> DataFrame:
    """Gradeable labels without the edge-case flag."""
    return gradeable(labels, inquiries).where("edge_case_flag = 0")


def unlabelled(inquiries: DataFrame, labels: DataFrame, status: str = "verified") -> DataFrame:
    """Inquiries of a redaction status that have no label."""
    return inquiries.where(F.col("redaction_status") == status).join(labels.select("inquiry_id"), "inquiry_id", "left_anti")


def orphans(rows: DataFrame, parents: DataFrame, key: str = "inquiry_id") -> DataFrame:
    """Rows whose key has no parent; a null key has none."""
    return rows.join(parents.select(key), key, "left_anti")


def relabelled(labels: DataFrame) -> DataFrame:
    """All label rows of inquiries that have more than one."""
    more = labels.groupBy("inquiry_id").count().where("count > 1").select("inquiry_id")
    return labels.join(more, "inquiry_id", "left_semi")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct): rows of each value and their percentage with two decimals, most frequent first. Null is a value."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_all"))  # one row
    return n.join(F.broadcast(total), on=F.lit(True), how="inner").select("value", "n", F.round(100.0 * F.col("n") / F.col("_all"), 2).alias("pct")).orderBy(F.desc("n"), "value")


def summary_sets(df: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n): all rows, and rows of each value of each column, in one aggregation over the exploded pairs."""
    pairs = [F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value"))]
    pairs += [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def search_columns(df: DataFrame, key: str, columns: list[str], needle: str) -> DataFrame:
    """(key, column_name, value) of cells that contain ``needle`` in any case. ``%`` and ``_`` in it are wildcards."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(key, F.inline(cells)).where(F.col("value").ilike(f"%{needle}%"))


def dense_ids(df: DataFrame, order: list[str], name: str, start: Column) -> DataFrame:
    """Number rows from ``start`` + 1 in ``order``: sorted by range partitions, each numbered on its own and shifted by the
    rows before it, so that no task holds them all. ``start`` is a literal or a column of one value.
    """
    # the cut fixes which row lies in which partition before partitions are counted
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part")
    before = parts.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = before.withColumn("__before", F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    numbered = parts.withColumn("__at", F.row_number().over(own.orderBy(*order)))
    return numbered.join(F.broadcast(before), "__part").withColumn(name, start + F.col("__before") + F.col("__at")).drop("__part", "__rows", "__before", "__at")


def now_stamp() -> str:
    """The present second as an ISO stamp in UTC, the form of stored stamps."""
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def copy_forward(labels: DataFrame, overrides: dict[str, Column], where: Column, labeled_at: str | None, labeled_by: str, batch_id: str) -> DataFrame:
    """New label rows that repeat the latest row of each matching inquiry with some columns overridden; stamped now unless
    ``labeled_at`` is given.

    Ids go on from the largest one in inquiry order. Inquiries that the batch relabelled already are left out, so that a
    second run adds nothing. The result is to be appended; stored rows are never changed.
    """
    done = labels.where(F.col("batch_id") == batch_id).select("inquiry_id")
    rows = latest_labels(labels).where(where).join(done, "inquiry_id", "left_anti").drop("label_id")
    rows = rows.withColumns({**overrides, "labeled_at": F.lit(labeled_at or now_stamp()), "labeled_by": F.lit(labeled_by), "batch_id": F.lit(batch_id)})
    top = labels.agg(F.coalesce(F.max("label_id"), F.lit(0)).alias("_top"))
    with_top = rows.join(F.broadcast(top), on=F.lit(True), how="inner")
    return dense_ids(with_top, ["inquiry_id"], "label_id", F.col("_top")).select(labels.columns)


def new_rows(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't stored yet, one of each key (the first by all columns)."""
    fresh = incoming.join(stored.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(F.struct(*[c for c in fresh.columns if c != key])).alias("_r")).select(key, "_r.*").select(incoming.columns)


def changed_rows(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of ``after`` whose ``column`` differs from the stored one (null-safe): what a conditional rewrite has to write."""
    old = before.select(F.col(key).alias("_k"), F.col(column).alias("_old"))
    joined = after.join(old, F.col(key) == F.col("_k"))
    return joined.where(~F.col(column).eqNullSafe(F.col("_old"))).select(after.columns)


def latest_of(df: DataFrame, key: str, value, *order: str) -> DataFrame:
    """The last row of one key: filtered before anything is compared, then the top row; empty if there is none."""
    return df.where(F.col(key) == value).orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(1)


def by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """(key, found, ...): a row of ``df`` for each distinct id of ``ids`` (one column of that name), with nulls where there is none."""
    return ids.select(key).distinct().join(df.withColumn("_found", F.lit(True)), key, "left").select(key, F.coalesce("_found", F.lit(False)).alias("found"), *[c for c in df.columns if c != key])


def joinable(labels: DataFrame, inquiries: DataFrame) -> DataFrame:
    """(n_labels, n_joinable, n_orphans): labels with and without an inquiry."""
    known = inquiries.select("inquiry_id", F.lit(True).alias("_k")).distinct()
    return labels.select("inquiry_id").join(known, "inquiry_id", "left").agg(F.count("*").alias("n_labels"), F.count("_k").alias("n_joinable"), F.count_if(F.col("_k").isNull()).alias("n_orphans"))


def relabel_mismatches(labels: DataFrame, expected: DataFrame) -> DataFrame:
    """(inquiry_id, field, expected, actual) where the latest row isn't as a relabelling expects it: (inquiry_id, field, expected)
    rows, values as text. An inquiry without a label differs in every field. Empty means that the batch may be written."""
    fields = [c for c in labels.columns if c not in ("inquiry_id",)]
    last = latest_labels(labels).select("inquiry_id", F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(c).cast("string") for c in fields])).alias("_now"))
    joined = expected.join(last, "inquiry_id", "left").withColumn("actual", F.try_element_at("_now", F.col("field")))
    return joined.where(F.col("_now").isNull() | ~F.col("actual").eqNullSafe(F.col("expected"))).select("inquiry_id", "field", "expected", "actual")


def guarded_relabel(labels: DataFrame, inquiries: DataFrame, expected: DataFrame, rows: DataFrame, batch_id: str) -> DataFrame:
    """The rows of a relabelling after its guards, else an error and nothing to write: the batch is new, the latest rows are as
    expected, and appending loses no gradeable inquiry and keeps every id unique. ``rows`` come from ``copy_forward``."""
    if labels.where(F.col("batch_id") == batch_id).limit(1).count():
        raise ValueError(f"batch {batch_id} was written already")
    if wrong := relabel_mismatches(labels, expected).limit(5).collect():
        raise ValueError(f"latest rows differ from what is expected: {[tuple(r) for r in wrong]}")
    new = cut(rows)
    after = labels.unionByName(new)
    lost = gradeable(labels, inquiries).join(gradeable(after, inquiries), "inquiry_id", "left_anti").limit(1).count()
    if lost or after.groupBy("label_id").count().where("count > 1").limit(1).count():
        raise ValueError("the batch would lose gradeable inquiries or repeat an id")
    return new


def heads(df: DataFrame, group: str, item: str, n: int = 4) -> DataFrame:
    """(group, n_items, shown): the first ``n`` distinct items of each group in order, and ``(+k more)`` where there are more.

    Only the first items of a group travel: each task keeps its own ``n`` smallest.
    """
    ranked = df.select(group, item).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(item)))
    total = df.groupBy(group).agg(F.count_distinct(item).alias("n_items"))
    first = ranked.where(F.col("_r") <= n).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("_s"))
    more = F.when(F.col("n_items") > n, F.concat(F.lit(" (+"), (F.col("n_items") - n).cast("string"), F.lit(" more)"))).otherwise("")
    return total.join(first, total[group].eqNullSafe(first[group]), "left").select(total[group], "n_items", F.concat(F.coalesce("_s", F.lit("")), more).alias("shown"))
