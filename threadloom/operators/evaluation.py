"""Predictions against labels: pairs, confusion, per-class precision, recall and F1, accuracy, and stub predictors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.labels import gradeable, latest_per_key
from threadloom.schema import normal_status
from threadloom.session import cut

#: Pairs from which an evaluation may gate a release.
GATING_ROWS = 100
ERROR = "ERROR"


def prediction_pairs(labels: DataFrame, inquiries: DataFrame, outputs: DataFrame) -> DataFrame:
    """(inquiry_id, agent_version, truth, pred): latest label against the latest output; a missing decision is ``ERROR``."""
    narrow = labels.select("inquiry_id", "labeled_at", "label_id", "edge_case_reason", "qualification_decision")
    truth = gradeable(narrow, inquiries).select("inquiry_id", normal_status(F.col("qualification_decision")).alias("truth"))
    last = latest_per_key(outputs.select("inquiry_id", "agent_version", "qualification_decision", "created_at", "output_id"), "inquiry_id", "created_at", "output_id")
    pred = last.select("inquiry_id", "agent_version", F.coalesce(normal_status(F.col("qualification_decision")), F.lit(ERROR)).alias("pred"))
    return truth.where("truth is not null").join(pred, "inquiry_id")


def confusion_counts(pairs: DataFrame) -> DataFrame:
    """(truth, pred, n) of the pairs that occur. At most classes squared rows; everything below starts from it."""
    return pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def classes(counts: DataFrame) -> DataFrame:
    """(class): every class that occurs as truth or prediction."""
    return counts.select(F.explode(F.array("truth", "pred")).alias("class")).distinct()


def confusion_long(pairs: DataFrame) -> DataFrame:
    """(truth, pred, n) for every combination of the classes that occur, zero where there is no pair."""
    counts = cut(confusion_counts(pairs))  # a handful of rows, used three times
    # a grid over the handful of classes, not over rows
    names = classes(counts)
    grid = names.select(F.col("class").alias("truth")).join(F.broadcast(names.select(F.col("class").alias("pred"))), on=F.lit(True), how="inner")
    return grid.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per truth, one column per listed class, zero-filled. Naming the classes saves the pass that looks for them."""
    return confusion_counts(pairs).groupBy("truth").pivot("pred", columns).agg(F.sum("n")).na.fill(0)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1); ratios with denominator 0 are 0. No pairs give no rows."""
    counts = confusion_counts(pairs)
    role = F.array(
        F.struct(F.col("truth").alias("class"), F.when(F.col("truth") == F.col("pred"), "tp").otherwise("fn").alias("role")),
        F.struct(F.col("pred").alias("class"), F.when(F.col("truth") != F.col("pred"), "fp").alias("role")),
    )
    each = counts.select("n", F.inline(role))
    total = lambda name: F.coalesce(F.sum(F.when(F.col("role") == name, F.col("n"))), F.lit(0))
    sums = each.groupBy("class").agg(total("tp").alias("tp"), total("fp").alias("fp"), total("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("class", "tp", "fp", "fn", (tp + fn).alias("support"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def accuracy(pairs: DataFrame, *by: str) -> DataFrame:
    """(..., n, n_correct, accuracy, gating): accuracy 0 without pairs; gating from ``GATING_ROWS`` pairs on."""
    right = F.coalesce(F.sum(F.when(F.col("truth") == F.col("pred"), 1).otherwise(0)), F.lit(0))
    sums = (pairs.groupBy(*by) if by else pairs).agg(F.count("*").alias("n"), right.alias("n_correct"))
    return sums.select(*by, "n", "n_correct", _ratio(F.col("n_correct"), F.col("n")).alias("accuracy"), F.when(F.col("n") >= GATING_ROWS, "GATING").otherwise("DIAGNOSTIC").alias("gating"))


def oracle_pairs(truth: DataFrame) -> DataFrame:
    """The predictor that copies the truth: every metric must be 1."""
    return truth.withColumns({"pred": F.col("truth"), "fit_score": F.lit(90), "confidence": F.lit(1.0)})


def fixed_pairs(truth: DataFrame, value: str = "human_review") -> DataFrame:
    """The predictor that always says the same."""
    return truth.withColumns({"pred": F.lit(value), "fit_score": F.lit(50), "confidence": F.lit(0.5)})


def random_pairs(truth: DataFrame, values: list[str], seed: int = 0) -> DataFrame:
    """A prediction, fit (0 to 100) and confidence (two decimals) drawn by hash of the inquiry and a seed: the same on any cluster
    and in any order, which a generator's sequence over sorted rows isn't."""
    draw = lambda k, n: F.pmod(F.xxhash64("inquiry_id", F.lit(seed), F.lit(k)), F.lit(n))
    return truth.withColumns(
        {"pred": F.try_element_at(F.array(*map(F.lit, values)), (draw(0, len(values)) + 1).cast("int")), "fit_score": draw(1, 101).cast("int"), "confidence": F.round(draw(2, 101) / 100, 2)}
    )


def two_stages(draft: Callable[[str], str], classify: Callable[[str, str], str]) -> Callable[[str], str]:
    """A model of two calls: a reply to the inquiry, then a decision forced from inquiry and reply."""
    return lambda text: classify(text, draft(text))


def predict(rows: DataFrame, text: str, make_model: Callable[[], Callable[[str], str]], attempts: int = 3, pause: float = 2.0) -> DataFrame:
    """Add ``pred`` from an injected model, made once per task. Connection errors (and their kinds, such as time-outs) are tried
    again, after ``pause`` seconds, then twice that, and so on; a failure after ``attempts`` of them, or any other error, is
    ``ERROR``, which stays in the denominator. Null text is ``ERROR``.
    """
    schema = rows.withColumn("pred", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()

        def one(value: str | None) -> str:
            for attempt in range(attempts):
                try:
                    return ERROR if value is None else model(value)
                except (ConnectionError, TimeoutError):
                    if attempt + 1 < attempts:
                        time.sleep(pause * 2**attempt)
                except Exception:
                    return ERROR
            return ERROR

        for batch in batches:
            yield batch.assign(pred=[one(v) for v in batch[text]])

    return rows.mapInPandas(run, schema)
