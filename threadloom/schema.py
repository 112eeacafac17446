"""Table schemas, allowed values, and validation as a query: each broken rule of each row is one result row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind.rstrip("?")], kind.endswith("?")) for name, kind in (x.split(":") for x in text.split())])


INQUIRIES = _struct(
    "inquiry_id:string thread_id:string source_path:string subject_redacted:string? message_count:int? date_range_start:string? date_range_end:string? "
    "thread_text_redacted:string redaction_status:string redaction_findings:string? ingested_at:string"
)
LABELS = _struct(
    "label_id:long inquiry_id:string schema_version:string received_at:string? channel:string inquiry_type:string language:string? group_size:int? lead_time_days:int? "
    "date_specificity:string budget_signal:string budget_amount:int? budget_basis:string? menu_tier_fit:string qualification_decision:string decision_reasoning:string? "
    "response_sent:string? response_latency_hours:int? outcome:string friction_points:string language_patterns:string edge_case_flag:int edge_case_reason:string? "
    "unresolved_fields:string labeled_at:string labeled_by:string batch_id:string?"
)
AGENT_OUTPUTS = _struct(
    "output_id:long inquiry_id:string run_id:string agent_version:string qualification_decision:string? decision_reasoning:string? response_draft:string? confidence:string? created_at:string"
)
TALLY = _struct("timestamp_text:string? source:string? inquiry_id:string? score:string? failure_tag:string? why:string?")
AGENT_RESULT = T.StructType().add("fit_score", "integer").add("status", "string").add("draft_response", "string").add("confidence", "double").add(
    "edge_flags", T.ArrayType(T.StructType().add("tag", "string").add("reason", "string"))
)

# The values each coded column allows.
DOMAINS = {
    "redaction_status": ("pending", "verified", "flagged", "names_unredacted", "model_failed"),
    "channel": ("direct_email", "typeform", "web_form", "phone_followup", "referral", "other", "unknown"),
    "inquiry_type": ("catering", "private_event", "general", "not_an_inquiry", "unknown"),
    "language": ("en", "es", "mixed"),
    "date_specificity": ("firm_date", "flexible", "no_date"),
    "budget_signal": ("explicit", "implied", "absent"),
    "budget_basis": ("per_person", "total", "unspecified"),
    "menu_tier_fit": ("entry", "mid", "premium", "mixed", "unknown"),
    "qualification_decision": ("qualified", "needs_info", "declined", "human_review"),
    "outcome": ("booked", "no_response", "declined_by_lead", "cancelled", "unknown"),
    "confidence": ("high", "moderate", "low", "unknown"),
}


def broken_rules(df: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """(key, rule, value) for each value outside its domain, null in a required column, and flagged row without a reason.

    One pass without a shuffle. Columns of ``schema`` that ``df`` lacks are skipped, further columns ignored.
    """
    rules: list[tuple[str, Column, Column]] = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        c = F.col(f.name)
        if not f.nullable:
            rules.append((f"{f.name} is null", c.isNull(), c))
        if f.name in DOMAINS:
            rules.append((f"{f.name} not allowed", c.isNotNull() & ~c.isin(*DOMAINS[f.name]), c))
    if {"edge_case_flag", "edge_case_reason"} <= set(df.columns):
        rules.append(("edge_case_reason missing", (F.col("edge_case_flag") != 0) & F.col("edge_case_reason").isNull(), F.col("edge_case_flag")))
    broken = F.array(*[F.when(bad, F.struct(F.lit(name).alias("rule"), value.cast("string").alias("value"))) for name, bad, value in rules])
    return df.select(F.col(key), F.inline(F.filter(broken, lambda r: r.isNotNull())))


def agent_result(raw: Column) -> Column:
    """Struct (result, valid) of an agent's JSON answer: aliases resolved, edge_flags [] where missing, ranges checked."""
    parsed = F.from_json(raw, AGENT_RESULT)
    status = normal_status(parsed["status"])
    result = F.struct(
        parsed["fit_score"].alias("fit_score"), status.alias("status"), parsed["draft_response"].alias("draft_response"), parsed["confidence"].alias("confidence"),
        F.coalesce(parsed["edge_flags"], F.from_json(F.lit("[]"), AGENT_RESULT["edge_flags"].dataType)).alias("edge_flags"),
    )
    valid = reduce(lambda a, b: a & b, [parsed["fit_score"].between(0, 100), parsed["confidence"].between(0, 1), status.isNotNull(), parsed["draft_response"].isNotNull()])
    return F.struct(result.alias("result"), F.coalesce(valid, F.lit(False)).alias("valid"))


# Spellings of the four decisions.
STATUS_ALIASES = {
    "qualified": "qualified", "needs_info": "needs_info", "needs-info": "needs_info", "declined": "declined", "decline-recommended": "declined",
    "decline_recommended": "declined", "human_review": "human_review", "human-review": "human_review",
}


def normal_status(raw: Column) -> Column:
    """Canonical decision of a trimmed, lower-cased spelling; null for anything else (``checked_status`` fails there)."""
    known = F.create_map(*[F.lit(x) for kv in STATUS_ALIASES.items() for x in kv])
    return F.try_element_at(known, F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")))


def checked_status(raw: Column) -> Column:
    """``normal_status``; a spelling that isn't known ends the query, a null stays null."""
    status = normal_status(raw)
    return F.when(raw.isNotNull() & status.isNull(), F.raise_error(F.concat(F.lit("unknown status: "), raw)).cast("string")).otherwise(status)
