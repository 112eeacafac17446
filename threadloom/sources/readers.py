"""Sources: thread files, line lists, CSV logs, settings, binary contents with skip rules, and the catalogue."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.schema import TALLY

# Endings of files that aren't text, and the sizes used by the skip rules.
SKIPPED_ENDINGS = (".db", ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".pyc", ".lock", ".zip", ".ico", ".woff", ".woff2")
NUL_WITHIN, MAX_BYTES = 1024, 2_000_000


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def thread_files(spark: SparkSession, *folders: str, recursive: bool = False) -> DataFrame:
    """(path, text) of the ``.md`` files of folders, each read whole; what isn't UTF-8 is left out, as are missing folders."""
    there = [f for f in folders if _exists(spark, f)]
    if not there:
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", recursive).load(there)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null")


def single_text(spark: SparkSession, raw: bytes) -> DataFrame:
    """(text): one row of a body handed in as UTF-8 bytes; none where nothing was. Broken bytes become U+FFFD."""
    text = raw.decode("utf-8", "replace")
    return spark.createDataFrame([(text,)] if text.strip() else [], "text string")


def list_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a list, blank ones and ``#`` comments skipped; a missing file is an empty list."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def tally_csv(spark: SparkSession, path: str) -> DataFrame:
    """The usefulness log, all strings, quoted fields over several lines; a missing file is an empty log."""
    if not _exists(spark, path):
        return spark.createDataFrame([], TALLY)
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {"timestamp": "timestamp_text"}
    return raw.select(*[F.col(f"`{c}`").cast("string").alias(names.get(c, c)) for c in raw.columns])


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``KEY=value`` lines, split at the first ``=``; byte-order mark, blanks and comments ignored."""
    line = F.trim(F.regexp_replace("value", "^﻿", ""))
    rows = spark.read.text(path).select(line.alias("l")).where(F.col("l").contains("=") & ~F.col("l").startswith("#"))
    return rows.select(F.trim(F.substring_index("l", "=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace("l", "^[^=]*=", "")), "^[\"']|[\"']$", "").alias("value"))


def text_contents(spark: SparkSession, folder: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, content_id, text) of the text files below a folder: skipped are known endings, larger files, contents with a NUL
    byte near their start, and what isn't UTF-8. Equal contents share their id.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    name = F.lower("path")
    files = files.where(~F.greatest(*[name.endswith(e) for e in SKIPPED_ENDINGS]))
    head = F.substring(F.col("content"), 1, NUL_WITHIN)
    files = files.where(~F.contains(head, F.lit(b"\x00")))
    return files.select("path", F.sha2("content", 256).alias("content_id"), F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null")


def matching_columns(df: DataFrame, part: str) -> list[str]:
    """Columns whose name holds ``part`` in any case."""
    return [c for c in df.columns if part.lower() in c.lower()]


def table_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, type) of a set of tables, from their schemas alone."""
    rows = [(t, i, c, kind) for t, df in sorted(tables.items()) for i, (c, kind) in enumerate(df.dtypes)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def is_slash_date(c: Column) -> Column:
    """Whether a date argument has the form ``YYYY/MM/DD``."""
    return c.rlike(r"^\d{4}/\d{2}/\d{2}$")


def mail_window(headers: DataFrame, after: str | None, before: str | None, excluded_senders: list[str], excluded_text: tuple[str, ...] = ()) -> DataFrame:
    """(..., sender, subject, sent_at) messages sent from ``after`` (inclusive) to ``before`` (exclusive), whose sender holds none
    of the excluded addresses and whose subject none of the base exclusions.

    The bounds are ``YYYY/MM/DD`` and become predicates of the scan; another form is an error, None is no bound.
    """
    rows = headers
    for bound, keep in ((after, lambda d: F.col("sent_at") >= d), (before, lambda d: F.col("sent_at") < d)):
        if bound is not None:
            if not re.fullmatch(r"\d{4}/\d{2}/\d{2}", bound):
                raise ValueError(f"not a date YYYY/MM/DD: {bound}")
            rows = rows.where(keep(F.to_timestamp(F.lit(bound), "yyyy/MM/dd")))
    for c, words in (("sender", excluded_senders), ("subject", excluded_text)):
        for w in words:
            rows = rows.where(~F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w.lower())))
    return rows


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` newest rows by ``order``, largest first, at most: the source boundary of a list call."""
    return rows.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)


def pick(rows: DataFrame, i: int, *order: str) -> DataFrame:
    """The i-th newest row, counted from 0; one that isn't there is an error."""
    got = newest(rows, i + 1, *order)
    if i < 0 or got.count() <= i:
        raise IndexError(f"there is no row {i}")
    return got.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(1)


def landed_threads(spark: SparkSession, path: str) -> DataFrame:
    """(thread_id, message_no, labels, payload) of threads landed as JSON lines ``{id, messages: [{labelIds, payload}]}``; the
    payload stays JSON for ``flatten_mime``, as no schema holds its recursion. Malformed lines give no rows."""
    lines = spark.read.text(path)
    count = F.json_array_length(F.get_json_object("value", "$.messages"))
    rows = lines.where(count > 0).select("value", F.get_json_object("value", "$.id").alias("thread_id"), F.explode(F.sequence(F.lit(1), count)).alias("message_no"))
    part = lambda name: F.expr(f"get_json_object(value, concat('$.messages[', message_no - 1, '].{name}'))")
    return rows.select("thread_id", "message_no", F.from_json(part("labelIds"), "array<string>").alias("labels"), part("payload").alias("payload"))


def tree_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """(..., mode, content_id, path) of the lines ``mode blob id<tab>path`` of a tree listing; other lines and files that aren't text are left out."""
    m = lambda i: F.regexp_extract(column, r"^(\d+) blob ([0-9a-f]+)\t(.*)$", i)
    rows = lines.where(m(2) != "").select(*[c for c in lines.columns if c != column], m(1).alias("mode"), m(2).alias("content_id"), m(3).alias("path"))
    return rows.where(~F.greatest(*[F.lower("path").endswith(e) for e in SKIPPED_ENDINGS]))


def commit_messages(log: DataFrame, column: str = "value") -> DataFrame:
    """(label, text) of a log of records ``id NUL message RS``, and of ref names and tag messages in the same form."""
    record = F.explode(F.split(column, "\x1e")).alias("r")
    rows = log.select(record).where(F.contains("r", F.lit("\0")))
    return rows.select(F.trim(F.regexp_replace(F.substring_index("r", "\0", 1), r"\s+", "")).alias("label"), F.expr("substring(r, instr(r, '\\0') + 1)").alias("text"))
