"""How often every distinct term occurs, in how many records, and whether it is too rare or too common.

Each record first yields its own term counts (a term repeated in a record is one row with its count), these are combined
by hash on the map side (Spark's partial aggregation), and only the combined counts are shuffled by (field, term). A hot
term therefore crosses the shuffle once per map task, whatever its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE_ROWS = 2
COMMON_SHARE = 0.3


def normal_term(c: Column) -> Column:
    """Trimmed, lower-cased, each run of blanks, ``-`` or ``_`` written as one ``_``; null for what is left empty."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.nullif(F.regexp_replace(F.lower(trimmed), r"(?U)[\s\-_]+", "_"), F.lit(""))


def json_terms(cell: Column) -> Column:
    """Elements of a cell that is a JSON array; an empty array for null, for other JSON and for what isn't JSON."""
    array = F.from_json(cell, "array<string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    looks = cell.rlike(r"(?s)^\s*\[.*\]\s*$")
    return F.coalesce(F.when(looks, array), F.array().cast("array<string>"))


def piece_terms(cell: Column) -> Column:
    """Pieces of a cell between semicolons; an empty array for null."""
    return F.coalesce(F.split(cell, ";"), F.array().cast("array<string>"))


def record_counts(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field_name, term, n) for each distinct term of each record and field. Repeated rows each count; empty terms don't."""
    clean = F.filter
    per_field = [F.struct(F.lit(name).alias("field_name"), clean(F.transform(terms, normal_term), lambda t: t.isNotNull()).alias("terms")) for name, terms in fields.items()]
    rows = df.select(F.inline(F.array(*per_field)))
    return rows.select("field_name", "terms", F.explode(F.array_distinct("terms")).alias("term")).select(
        "field_name", "term", F.size(F.filter("terms", lambda t: t == F.col("term"))).cast("long").alias("n")
    )


def term_frequencies(df: DataFrame, fields: dict[str, Column], rare_rows: int = RARE_ROWS, common_share: float = COMMON_SHARE) -> DataFrame:
    """(field_name, term, n_occurrences, n_rows, n_table_rows, is_rare, is_common) of every term of every field.

    Every stored row counts, also rows with null or malformed cells, which hold no term. An empty table gives no rows. In a
    table of six rows or fewer a term can be both rare and common.
    """
    counted = record_counts(df, fields).groupBy("field_name", "term").agg(F.sum("n").alias("n_occurrences"), F.count("*").alias("n_rows"))
    total = df.agg(F.count("*").alias("n_table_rows"))  # one row
    return counted.join(F.broadcast(total), how="inner", on=F.lit(True)).select(
        "*", (F.col("n_rows") <= rare_rows).alias("is_rare"), (F.col("n_rows") > common_share * F.col("n_table_rows")).alias("is_common")
    )


def tag_frequencies(labels: DataFrame, tally: DataFrame) -> DataFrame:
    """``term_frequencies`` of language_patterns and friction_points of labels and of failure_tag of usefulness_tally."""
    of_labels = term_frequencies(labels, {f: json_terms(F.col(f)) for f in ("language_patterns", "friction_points")})
    return of_labels.unionByName(term_frequencies(tally, {"failure_tag": piece_terms(F.col("failure_tag"))}))


def marked_tags(labels: DataFrame, tally: DataFrame) -> DataFrame:
    """(field_name, term, mark) of the tags that are ``rare`` or ``common``."""
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), "rare"), F.when(F.col("is_common"), "common")))
    return tag_frequencies(labels, tally).select("field_name", "term", F.explode(marks).alias("mark"))
