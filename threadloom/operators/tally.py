"""The usefulness log: canonical rows and rejects, roll-up per source, next live id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.patterns import strip_all

# Sources in the order they are reported, and scores.
SOURCES = ("cold", "recall")
SCORES = ("Advances", "Salvageable", "Stalls")


def canonical(tally: DataFrame) -> DataFrame:
    """Add source_name and score_name in canonical spelling (null if unknown) and ``refused``, the first rule a row breaks."""
    source = F.lower(strip_all(F.col("source")))
    score = F.coalesce(*[F.when(F.lower(strip_all(F.col("score"))) == s.lower(), s) for s in SCORES])
    rows = tally.withColumns({"source_name": F.when(source.isin(*SOURCES), source), "score_name": score})
    empty = F.coalesce(strip_all(F.col("why")), F.lit("")) == ""
    return rows.withColumn("refused", F.when(F.col("source_name").isNull(), "source").when(F.col("score_name").isNull(), "score").when(empty, "why"))


def rollup(tally: DataFrame) -> DataFrame:
    """(source, n, n_advances, n_salvageable, n_stalls, n_saved, pct_saved) of each source, also of one without rows."""
    rows = canonical(tally).where("source_name is not null")
    count = lambda s: F.count(F.when(F.col("score_name") == s, 1))
    sums = rows.groupBy("source_name").agg(F.count("*").alias("n"), *[count(s).alias(f"n_{s.lower()}") for s in SCORES])
    every = tally.sparkSession.createDataFrame([(s,) for s in SOURCES], "source string")
    full = every.join(sums, F.col("source") == F.col("source_name"), "left").drop("source_name").na.fill(0)
    saved = F.col("n_advances") + F.col("n_salvageable")
    return full.withColumns({"n_saved": saved, "pct_saved": F.round(F.coalesce(F.try_divide(100.0 * saved, F.col("n")), F.lit(0.0)), 4)})


def next_live_id(tally: DataFrame) -> DataFrame:
    """(next_id): one more than the largest N of the ids ``live-N``; gaps and other ids don't count; live-1 for none."""
    n = F.regexp_extract("inquiry_id", r"^live-(\d+)$", 1).try_cast("long")
    return tally.agg(F.coalesce(F.max(n), F.lit(0)).alias("n")).select(F.concat(F.lit("live-"), (F.col("n") + 1).cast("string")).alias("next_id"))


def tags(cell: Column) -> Column:
    """Trimmed, non-empty pieces of a ``;``-joined cell."""
    return F.filter(F.transform(F.split(cell, ";"), strip_all), lambda t: t != "")
