"""Registered queries of the core operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import schema
from threadloom.functions import checks, cleaning, patterns
from threadloom.operators import evaluation, labels, redaction, tally, termscan, threads, timestamps
from threadloom.session import table, spread
from threadloom.sources import readers, writers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: What sender lines of the house hold.
HOUSE = "Corvanne"
_LABEL_COLUMNS = ["label_id", "inquiry_id", "language", "qualification_decision", "outcome", "edge_case_flag", "edge_case_reason", "labeled_at"]


def query(sql: str | None = None):
    """Register a query by its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inquiry_id ORDER BY labeled_at DESC, label_id DESC) AS rn FROM labels) WHERE rn = 1)"
_KNOWN = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inquiry_id ORDER BY labeled_at DESC, label_id DESC) AS rn FROM labels WHERE inquiry_id IN (SELECT inquiry_id FROM inquiries)) WHERE rn = 1)"
_COLS = ", ".join(_LABEL_COLUMNS)
_GRADEABLE = f"(SELECT * FROM {_KNOWN} WHERE COALESCE(edge_case_reason, '') NOT ILIKE 'EXCLUDE_FROM_EVAL%')"


@query()
def p1_found(spark, d):
    dates = timestamps.normalise_dates(table(spark, d, "inquiries"), table(spark, d, "mailboxes"))
    return dates.where("utc_micros is not null").select("inquiry_id", "field_name", "utc_micros").distinct()


@query()
def p1_resolution(spark, d):
    return timestamps.normalise_dates(table(spark, d, "inquiries"), table(spark, d, "mailboxes"))


#: Written forms with a numeric offset: those of mail headers and of ISO 8601.
_OFFSET_FORMS = {"%a, %d %b %Y %H:%M:%S %z": r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", "%Y-%m-%dT%H:%M:%S%z": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:?\d{2}$"}


@query(
    "SELECT inquiry_id, field_name, written, epoch_us(CASE " + " ".join(f"WHEN regexp_matches(written, '{p}') THEN try_strptime(written, '{f}')" for f, p in _OFFSET_FORMS.items())
    + " END) AS utc_micros FROM (SELECT inquiry_id, 'start' AS field_name, date_range_start AS written FROM inquiries UNION ALL SELECT inquiry_id, 'end', date_range_end FROM inquiries) WHERE "
    + " OR ".join(f"regexp_matches(written, '{p}')" for p in _OFFSET_FORMS.values())
)
def p1_offset_forms(spark, d):
    forms = [F.col("written").rlike(p) for p in _OFFSET_FORMS.values()]
    return p1_resolution(spark, d).where(forms[0] | forms[1]).select("inquiry_id", "field_name", "written", "utc_micros")


@query(f"SELECT {_COLS} FROM {_LATEST}")
def latest_labels(spark, d):
    return labels.latest_labels(table(spark, d, "labels").select(_LABEL_COLUMNS))


@query("SELECT label_id, inquiry_id, labeled_at FROM labels l WHERE labeled_at = (SELECT max(labeled_at) FROM labels m WHERE m.inquiry_id = l.inquiry_id)")
def latest_label_ties(spark, d):
    return labels.latest_with_ties(table(spark, d, "labels").select("label_id", "inquiry_id", "labeled_at"), "inquiry_id", "labeled_at")


@query(f"SELECT {_COLS} FROM {_GRADEABLE}")
def gradeable_labels(spark, d):
    return labels.gradeable(table(spark, d, "labels").select(_LABEL_COLUMNS), table(spark, d, "inquiries"))


@query(f"SELECT {_COLS} FROM {_GRADEABLE} WHERE edge_case_flag = 0")
def clean_inbound_labels(spark, d):
    return labels.clean_inbounds(table(spark, d, "labels").select(_LABEL_COLUMNS), table(spark, d, "inquiries"))


@query("SELECT inquiry_id, ingested_at FROM inquiries i WHERE redaction_status = 'verified' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.inquiry_id = i.inquiry_id)")
def unlabelled_queue(spark, d):
    return labels.unlabelled(table(spark, d, "inquiries"), table(spark, d, "labels")).select("inquiry_id", "ingested_at")


@query(
    "SELECT inquiry_id, ingested_at FROM inquiries i WHERE redaction_status = 'verified' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.inquiry_id = i.inquiry_id) ORDER BY ingested_at, inquiry_id LIMIT 1"
)
def next_unlabelled(spark, d):
    return unlabelled_queue(spark, d).orderBy("ingested_at", "inquiry_id").limit(1)


@query("SELECT label_id, inquiry_id FROM labels WHERE inquiry_id NOT IN (SELECT inquiry_id FROM inquiries)")
def orphan_labels(spark, d):
    return labels.orphans(table(spark, d, "labels").select("label_id", "inquiry_id"), table(spark, d, "inquiries"))


@query("SELECT output_id, inquiry_id FROM agent_outputs WHERE inquiry_id NOT IN (SELECT inquiry_id FROM inquiries)")
def orphan_outputs(spark, d):
    return labels.orphans(table(spark, d, "agent_outputs").select("output_id", "inquiry_id"), table(spark, d, "inquiries"))


@query("SELECT label_id, inquiry_id, labeled_at FROM labels WHERE inquiry_id IN (SELECT inquiry_id FROM labels GROUP BY inquiry_id HAVING count(*) > 1)")
def relabelled_rows(spark, d):
    return labels.relabelled(table(spark, d, "labels").select("label_id", "inquiry_id", "labeled_at"))


@query(
    "SELECT (SELECT count(*) FROM inquiries) AS n_inquiries, (SELECT count(*) FROM inquiries WHERE redaction_status = 'flagged') AS n_flagged, "
    "(SELECT count(*) FROM inquiries WHERE redaction_status = 'verified') AS n_verified, (SELECT count(*) FROM labels) AS n_labels, (SELECT count(DISTINCT inquiry_id) FROM labels) AS n_labelled"
)
def store_counts(spark, d):
    status = lambda s: F.count(F.when(F.col("redaction_status") == s, 1))
    a = table(spark, d, "inquiries").agg(F.count("*").alias("n_inquiries"), status("flagged").alias("n_flagged"), status("verified").alias("n_verified"))
    b = table(spark, d, "labels").agg(F.count("*").alias("n_labels"), F.count_distinct("inquiry_id").alias("n_labelled"))
    return a.join(F.broadcast(b), on=F.lit(True), how="inner")


@query("SELECT redaction_status AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM inquiries GROUP BY 1")
def status_distribution(spark, d):
    return labels.distribution(table(spark, d, "inquiries"), "redaction_status")


@query(f"SELECT outcome AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM {_LATEST} GROUP BY 1")
def outcome_distribution(spark, d):
    return labels.distribution(labels.latest_labels(table(spark, d, "labels").select("inquiry_id", "labeled_at", "label_id", "outcome")), "outcome")


@query(
    f"SELECT CASE WHEN grouping(inquiry_type) = 0 THEN 'inquiry_type' WHEN grouping(qualification_decision) = 0 THEN 'qualification_decision' ELSE 'all' END AS dimension, "
    f"COALESCE(inquiry_type, qualification_decision) AS value, count(*) AS n FROM {_GRADEABLE} GROUP BY GROUPING SETS ((), (inquiry_type), (qualification_decision))"
)
def gradeable_summary(spark, d):
    rows = table(spark, d, "labels").select("inquiry_id", "labeled_at", "label_id", "inquiry_type", "qualification_decision", "edge_case_reason")
    return labels.summary_sets(labels.gradeable(rows, table(spark, d, "inquiries")), "inquiry_type", "qualification_decision")


@query(
    "SELECT label_id, column_name, value FROM (UNPIVOT (SELECT label_id, edge_case_reason, decision_reasoning, friction_points, response_sent FROM labels) "
    "ON edge_case_reason, decision_reasoning, friction_points, response_sent INTO NAME column_name VALUE value) WHERE value ILIKE '%EXCLUDE%'"
)
def exclusion_search(spark, d):
    return labels.search_columns(table(spark, d, "labels"), "label_id", ["edge_case_reason", "decision_reasoning", "friction_points", "response_sent"], "EXCLUDE")


@query(
    f"SELECT (SELECT max(label_id) FROM labels) + row_number() OVER (ORDER BY inquiry_id) AS label_id, inquiry_id, 'mixed' AS language, qualification_decision, '2026-06-30T00:00:00+00:00' AS labeled_at, 'batch_fix' AS batch_id "
    f"FROM {_LATEST} WHERE COALESCE(language, '') IN ('', 'und') AND inquiry_id NOT IN (SELECT inquiry_id FROM labels WHERE batch_id = 'batch_fix')"
)
def relabel_copy_forward(spark, d):
    odd = F.coalesce("language", F.lit("")).isin("", "und")
    rows = labels.copy_forward(table(spark, d, "labels"), {"language": F.lit("mixed")}, odd, "2026-06-30T00:00:00+00:00", "fixer", "batch_fix")
    return rows.select("label_id", "inquiry_id", "language", "qualification_decision", "labeled_at", "batch_id")


def _violations_sql(name: str, shape, key: str, flagged: bool = False) -> str:
    out = [
        f"SELECT {key}, '{f.name} not allowed' AS rule, {f.name} AS value FROM {name} WHERE {f.name} IS NOT NULL AND {f.name} NOT IN ({', '.join(repr(v) for v in schema.DOMAINS[f.name])})"
        for f in shape.fields
        if f.name in schema.DOMAINS
    ]
    out += [f"SELECT {key}, '{f.name} is null', NULL FROM {name} WHERE {f.name} IS NULL" for f in shape.fields if not f.nullable]
    if flagged:
        out.append(f"SELECT {key}, 'edge_case_reason missing', CAST(edge_case_flag AS VARCHAR) FROM {name} WHERE edge_case_flag <> 0 AND edge_case_reason IS NULL")
    return " UNION ALL ".join(out)


@query(_violations_sql("labels", schema.LABELS, "label_id", flagged=True))
def label_violations(spark, d):
    return schema.broken_rules(table(spark, d, "labels"), schema.LABELS, "label_id")


@query(_violations_sql("inquiries", schema.INQUIRIES, "inquiry_id"))
def inquiry_violations(spark, d):
    return schema.broken_rules(table(spark, d, "inquiries"), schema.INQUIRIES, "inquiry_id")


@query(_violations_sql("agent_outputs", schema.AGENT_OUTPUTS, "output_id"))
def output_violations(spark, d):
    return schema.broken_rules(table(spark, d, "agent_outputs"), schema.AGENT_OUTPUTS, "output_id")


@query(
    "SELECT output_id, inquiry_id, agent_version, confidence, created_at FROM (SELECT *, row_number() OVER (PARTITION BY inquiry_id ORDER BY created_at DESC, output_id DESC) AS rn FROM agent_outputs) WHERE rn = 1"
)
def latest_outputs(spark, d):
    rows = table(spark, d, "agent_outputs").select("output_id", "inquiry_id", "agent_version", "confidence", "created_at")
    return labels.latest_per_key(rows, "inquiry_id", "created_at", "output_id")


@query("SELECT agent_version, confidence, count(*) AS n, count(DISTINCT inquiry_id) AS n_inquiries, count(*) FILTER (response_draft IS NULL) AS n_withheld FROM agent_outputs GROUP BY 1, 2")
def output_counts(spark, d):
    return table(spark, d, "agent_outputs").groupBy("agent_version", "confidence").agg(
        F.count("*").alias("n"), F.count_distinct("inquiry_id").alias("n_inquiries"), F.count_if(F.col("response_draft").isNull()).alias("n_withheld")
    )


@query("SELECT inquiry_id, count(*) AS n FROM labels GROUP BY 1 HAVING count(*) > 1")
def relabel_counts(spark, d):
    return table(spark, d, "labels").groupBy("inquiry_id").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT i.inquiry_id, EXISTS (SELECT 1 FROM labels l WHERE l.inquiry_id = i.inquiry_id) AS labelled FROM inquiries i")
def labelled_flags(spark, d):
    known = table(spark, d, "labels").select("inquiry_id").distinct().withColumn("labelled", F.lit(True))
    return table(spark, d, "inquiries").select("inquiry_id").join(known, "inquiry_id", "left").select("inquiry_id", F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query()
def redaction_changes(spark, d):
    rows = redacted_threads(spark, d).join(table(spark, d, "inquiries").select("inquiry_id", "thread_text_redacted"), "inquiry_id")
    changed = cleaning.changed_lines(F.col("thread_text_redacted"), F.col("safe_text"))
    return rows.groupBy("redaction_status").agg(F.count("*").alias("n"), F.count_if(F.col("safe_text") != F.col("thread_text_redacted")).alias("n_changed"), F.sum(changed).alias("n_changed_lines"))


@query("SELECT tag, count(*) AS n FROM (SELECT trim(unnest(string_split(failure_tag, ';'))) AS tag FROM usefulness_tally) WHERE tag <> '' GROUP BY 1")
def tally_tags(spark, d):
    return table(spark, d, "usefulness_tally").select(F.explode(tally.tags(F.col("failure_tag"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def _pairs(spark, d):
    return evaluation.prediction_pairs(table(spark, d, "labels"), table(spark, d, "inquiries"), table(spark, d, "agent_outputs"))


_ALIAS = "CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schema.STATUS_ALIASES.items()) + " END"
_PAIRS = f"""
    (SELECT inquiry_id, agent_version, truth, pred FROM
        (SELECT inquiry_id, {_ALIAS.format(c='qualification_decision')} AS truth FROM {_GRADEABLE}) t JOIN
        (SELECT inquiry_id, agent_version, COALESCE({_ALIAS.format(c='qualification_decision')}, 'ERROR') AS pred FROM
            (SELECT *, row_number() OVER (PARTITION BY inquiry_id ORDER BY created_at DESC, output_id DESC) AS r FROM agent_outputs) WHERE r = 1) p USING (inquiry_id)
     WHERE truth IS NOT NULL)"""
_CLASSES = f"(SELECT truth AS class FROM {_PAIRS} UNION SELECT pred FROM {_PAIRS})"


@query(f"SELECT inquiry_id, agent_version, truth, pred FROM {_PAIRS}")
def prediction_pairs(spark, d):
    return _pairs(spark, d)


@query(f"SELECT a.class AS truth, b.class AS pred, count(p.inquiry_id) AS n FROM {_CLASSES} a CROSS JOIN {_CLASSES} b LEFT JOIN {_PAIRS} p ON p.truth = a.class AND p.pred = b.class GROUP BY 1, 2")
def confusion_long(spark, d):
    return evaluation.confusion_long(_pairs(spark, d))


@query(f"SELECT truth, {', '.join(f'count(*) FILTER (pred = {v!r}) AS {v}' for v in (*schema.DOMAINS['qualification_decision'], 'ERROR'))} FROM {_PAIRS} GROUP BY 1")
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(_pairs(spark, d), [*schema.DOMAINS["qualification_decision"], evaluation.ERROR])


@query(
    f"SELECT class, tp, fp, fn, tp + fn AS support, COALESCE(tp / NULLIF(tp + fp, 0), 0.0)::DOUBLE AS precision, COALESCE(tp / NULLIF(tp + fn, 0), 0.0)::DOUBLE AS recall, COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0)::DOUBLE AS f1 FROM "
    f"(SELECT class, count(*) FILTER (truth = class AND pred = class) AS tp, count(*) FILTER (pred = class AND truth <> class) AS fp, count(*) FILTER (truth = class AND pred <> class) AS fn FROM {_CLASSES} JOIN {_PAIRS} ON truth = class OR pred = class GROUP BY class)"
)
def class_metrics(spark, d):
    return evaluation.class_metrics(_pairs(spark, d))


@query(f"SELECT agent_version, count(*) AS n, count(*) FILTER (truth = pred) AS n_correct, count(*) FILTER (truth = pred) / count(*) AS accuracy, CASE WHEN count(*) >= 100 THEN 'GATING' ELSE 'DIAGNOSTIC' END AS gating FROM {_PAIRS} GROUP BY 1")
def accuracy_by_version(spark, d):
    return evaluation.accuracy(_pairs(spark, d), "agent_version")


@query(f"SELECT count(*) AS n, count(*) AS n_correct, 1.0::DOUBLE AS accuracy, CASE WHEN count(*) >= 100 THEN 'GATING' ELSE 'DIAGNOSTIC' END AS gating FROM {_PAIRS}")
def oracle_stub_accuracy(spark, d):
    return evaluation.accuracy(evaluation.oracle_pairs(_pairs(spark, d)))


@query(f"SELECT count(*) AS n, count(*) FILTER (truth = 'declined') AS n_correct, count(*) FILTER (truth = 'declined') / count(*) AS accuracy, CASE WHEN count(*) >= 100 THEN 'GATING' ELSE 'DIAGNOSTIC' END AS gating FROM {_PAIRS}")
def fixed_stub_accuracy(spark, d):
    return evaluation.accuracy(evaluation.fixed_pairs(_pairs(spark, d), "declined"))


@query()
def random_stub_metrics(spark, d):
    return evaluation.class_metrics(evaluation.random_pairs(_pairs(spark, d), list(schema.DOMAINS["qualification_decision"])))


@query(
    "SELECT inquiry_id, len(regexp_extract_all(t, '(?m)^## Message \\d+')) AS n_messages, s[1] AS first_sender, e[1] AS first_date, e[-1] AS last_date, len(list_filter(s, lambda x: contains(lower(x), 'corvanne'))) > 0 AS house_replied FROM "
    "(SELECT inquiry_id, thread_text_redacted AS t, regexp_extract_all(thread_text_redacted, '(?m)^\\*\\*From:\\*\\* ?([^\\r\\n]*)', 1) AS s, regexp_extract_all(thread_text_redacted, '(?m)^\\*\\*Date:\\*\\* ?([^\\r\\n]*)', 1) AS e FROM inquiries)"
)
def thread_summary(spark, d):
    return threads.thread_summary(table(spark, d, "inquiries"), HOUSE)


@query(
    "SELECT count(*) AS n_exported, count(*) FILTER (r) AS n_with_reply, count(*) FILTER (NOT r) AS n_without_reply FROM (SELECT len(list_filter(regexp_extract_all(thread_text_redacted, '(?m)^\\*\\*From:\\*\\* ?([^\\r\\n]*)', 1), lambda x: contains(lower(x), 'corvanne'))) > 0 AS r "
    "FROM inquiries WHERE regexp_matches(thread_text_redacted, '(?m)^## Message \\d+'))"
)
def export_totals(spark, d):
    return threads.reply_totals(threads.thread_summary(table(spark, d, "inquiries"), HOUSE))


_WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


_BLOCKS = "(SELECT inquiry_id, unnest(string_split(regexp_replace(replace(thread_text_redacted, chr(13) || chr(10), chr(10)), '(?m)^## Message (\\d+)[ \\t]*$', chr(1) || '\\1', 'g'), chr(1))[2:]) AS b FROM inquiries)"
_BODY = _strip("regexp_replace(b, '^\\d+\\n?(?:\\*\\*(?:From|Date|To|Cc|Subject):\\*\\*[^\\n]*(?:\\n|$))*', '')")
_MESSAGES = (
    "(SELECT inquiry_id, CAST(regexp_extract(b, '^(\\d+)', 1) AS INTEGER) AS message_no, regexp_extract(b, '(?m)^\\*\\*From:\\*\\*[ \\t]*(.*?)[ \\t]*$', 1) AS sender, "
    f"regexp_extract(b, '(?m)^\\*\\*Date:\\*\\*[ \\t]*(.*?)[ \\t]*$', 1) AS sent, {_BODY} AS body FROM {_BLOCKS})"
)


@query(f"SELECT * FROM {_MESSAGES}")
def thread_messages(spark, d):
    return threads.messages(table(spark, d, "inquiries"))


_FIRST = f"(SELECT inquiry_id, COALESCE(list_filter(string_split(replace(replace(thread_text_redacted, chr(13) || chr(10), chr(10)), '## Message', chr(1) || '## Message'), chr(1)), lambda x: regexp_matches(x, '[^\\s]'))[1], '') AS f FROM inquiries)"
_AFTER = "(?s)^.*?\\*\\*From:\\*\\*[^\\n]*\\n(?:[^\\n]*[^\\s][^\\n]*\\n)*[ \\t\\r\\f\\v]*\\n(.*)$"


@query(
    f"SELECT inquiry_id, {_strip('r')} AS body FROM (SELECT inquiry_id, CASE WHEN regexp_matches(f, '{_AFTER}') THEN regexp_extract(f, '{_AFTER}', 1) "
    f"ELSE regexp_replace(f, '(?m)^(?:## Message[^\\n]*|\\*\\*(?:From|To|Date|Subject|Cc):\\*\\*[^\\n]*)\\n?', '', 'g') END AS r FROM {_FIRST})"
)
def first_message_bodies(spark, d):
    return table(spark, d, "inquiries").select("inquiry_id", threads.first_message_body(F.col("thread_text_redacted")).alias("body"))


@query("SELECT inquiry_id, trim(regexp_extract(substring(thread_text_redacted, 1, 250), '\\*\\*From:\\*\\*([^\\r\\n]*)', 1)) AS sender FROM inquiries")
def first_senders(spark, d):
    return table(spark, d, "inquiries").select("inquiry_id", threads.sender_line(F.col("thread_text_redacted")).alias("sender"))


@query(
    "SELECT format, count(*) AS n FROM (SELECT CASE WHEN starts_with(r, '\"') AND contains(r, '<') THEN 'quoted_bracket' WHEN starts_with(r, '\"') THEN 'quoted' WHEN contains(r, '<') THEN 'bare_bracket' WHEN contains(r, '{email}') THEN 'bare_token' ELSE 'bare' END AS format "
    "FROM (SELECT trim(unnest(regexp_extract_all(thread_text_redacted, '(?m)^\\*\\*From:\\*\\*([^\\r\\n]*)', 1))) AS r FROM inquiries)) GROUP BY 1"
)
def sender_formats(spark, d):
    lines = table(spark, d, "inquiries").select(F.explode(F.regexp_extract_all("thread_text_redacted", F.lit(r"(?m)^\*\*From:\*\*([^\r\n]*)"), F.lit(1))).alias("r"))
    return lines.select(checks.from_line_format(F.trim("r")).alias("format")).groupBy("format").agg(F.count("*").alias("n"))


def _tokens_sql(c: str) -> str:
    marks = "[.,;:\"''()<>\\[\\]]"
    return f"list_filter(list_transform(regexp_split_to_array(lower({c}), '[\\s,]+'), lambda w: regexp_replace(regexp_replace(w, '[''’]', '', 'g'), '^{marks}+|{marks}+$', '', 'g')), lambda w: w <> '')"


_ENTRIES = f"(SELECT DISTINCT {_tokens_sql('entry')} AS w FROM allow_terms WHERE kind IN ('staff_name', 'organisation') AND entry IS NOT NULL)"
_COVERED = (
    "list_reduce(list_prepend(tokens, phrases), lambda acc, p: CASE WHEN len(list_filter(p, lambda t: NOT list_contains(acc, t))) = 0 THEN list_filter(acc, lambda t: NOT list_contains(p, t)) ELSE acc END)"
)


@query(
    f"SELECT inquiry_id, slot FROM (SELECT inquiry_id, slot, tokens, singles, {_COVERED} AS rest FROM (SELECT inquiry_id, slot, {_tokens_sql('slot')} AS tokens, (SELECT list(w ORDER BY len(w) DESC) FROM {_ENTRIES} WHERE len(w) > 1) AS phrases, "
    f"(SELECT list(w[1]) FROM {_ENTRIES} WHERE len(w) = 1) AS singles FROM (SELECT inquiry_id, "
    "trim(regexp_replace(trim(unnest(regexp_extract_all(thread_text_redacted, '(?m)^\\*\\*From:\\*\\*([^\\r\\n]*)', 1))), '\\s*<[^>]*>\\s*$', '')) AS slot FROM inquiries) WHERE slot <> '' AND regexp_replace(slot, '^[\"'']+|[\"'']+$', '', 'g') NOT IN ('{name}', '{email}', '{url}', '{phone}'))) "
    "WHERE len(tokens) = 0 OR len(list_filter(rest, lambda t: NOT list_contains(singles, t))) > 0"
)
def sender_leaks(spark, d):
    return redaction.sender_leaks(table(spark, d, "inquiries"), redaction.allow_list(table(spark, d, "allow_terms")))


@query()
def redacted_threads(spark, d):
    rows = spread(table(spark, d, "inquiries").select("inquiry_id", "thread_text_redacted"), "inquiry_id")
    return redaction.redact_threads(rows, "thread_text_redacted", redaction.allow_list(table(spark, d, "allow_terms"))).select("inquiry_id", "safe_text", "redaction_status", F.size("findings").alias("n_findings"))


@query("SELECT output_id, regexp_replace(response_draft, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '{email}', 'g') AS text FROM agent_outputs")
def draft_emails_redacted(spark, d):
    return table(spark, d, "agent_outputs").select("output_id", patterns.redact_patterns(F.col("response_draft"), ("email",)).alias("text"))


def _patterns_sql(column: str) -> str:
    """RE2 has no look-around: the digits that may not stand beside a number are matched and put back, twice for neighbours."""
    out = f"regexp_replace({column}, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b', '{{email}}', 'g')"
    out = f"regexp_replace({out}, '(?i)\\bhttps?://[^\\s\\p{{Z}})>\\]]+', '{{url}}', 'g')"
    phone = "(?:\\+?1[\\s\\p{Z}.-]?)?\\(?\\p{Nd}{3}\\)?[\\s\\p{Z}.-]?\\p{Nd}{3}[\\s\\p{Z}.-]?\\p{Nd}{4}"
    for kind, pattern in (("payment", "(?:\\p{Nd}[ -]?){13,16}"), ("phone", phone)):
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[^\\p{{Nd}}]){pattern}([^\\p{{Nd}}]|$)', '\\1{{{kind}}}\\2', 'g')"
    return out


@query(f"SELECT output_id, {_patterns_sql('response_draft')} AS text FROM agent_outputs")
def draft_patterns_redacted(spark, d):
    return table(spark, d, "agent_outputs").select("output_id", patterns.redact_patterns(F.col("response_draft")).alias("text"))


@query(
    "SELECT kind, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM (SELECT f->>'kind' AS kind, CAST(f->'match_span'->1 AS INT) - CAST(f->'match_span'->0 AS INT) AS n_chars FROM (SELECT unnest(CAST(redaction_findings AS JSON[])) AS f FROM inquiries WHERE redaction_findings IS NOT NULL AND json_valid(redaction_findings))) GROUP BY 1"
)
def stored_finding_counts(spark, d):
    return redaction.stored_findings(table(spark, d, "inquiries")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


_RE2_EMOJI = checks.EMOJI


@query(
    f"SELECT output_id, len(regexp_extract_all(response_draft, '—')) AS n_em_dash, len(regexp_extract_all(response_draft, '–')) AS n_en_dash, len(regexp_extract_all(response_draft, '--')) AS n_double_hyphen, len(regexp_extract_all(response_draft, '{_RE2_EMOJI}')) AS n_emoji, "
    f"len(regexp_extract_all(response_draft, '—')) = 0 AND len(regexp_extract_all(response_draft, '{_RE2_EMOJI}')) = 0 AS passed FROM agent_outputs"
)
def draft_typography(spark, d):
    return table(spark, d, "agent_outputs").select("output_id", *checks.dashes_and_emoji(F.col("response_draft")))


@query(
    "SELECT output_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS n_emails, len(regexp_extract_all(t, '(?:\\+?1[\\s.\\-]?)?(?:\\(\\d{3}\\)|\\d{3})[\\s.\\-]?\\d{3}[\\s.\\-]?\\d{4}')) AS n_phones "
    "FROM (SELECT output_id, regexp_replace(response_draft, '(?i)\\{[a-z_]+\\}', '', 'g') AS t FROM agent_outputs)"
)
def draft_leaks(spark, d):
    return table(spark, d, "agent_outputs").select("output_id", *checks.leak_counts(F.col("response_draft")))


@query(
    f"SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(response_draft, '(?i)\\{{[a-z_]+\\}}', '', 'g'), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][a-z]{{2,}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1))) AS word FROM agent_outputs) WHERE word NOT IN ({', '.join(repr(w) for w in checks.EXPECTED_WORDS)}) GROUP BY 1"
)
def draft_name_shaped_words(spark, d):
    return table(spark, d, "agent_outputs").select(F.explode(checks.name_shaped_words(F.col("response_draft"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT inquiry_id, '{k}' AS carrier FROM inquiries WHERE regexp_matches(thread_text_redacted, '{p}')" for k, p in checks.CARRIERS.items()))
def body_artifacts(spark, d):
    return table(spark, d, "inquiries").select("inquiry_id", F.explode(checks.carriers(F.col("thread_text_redacted"))).alias("carrier"))


@query(
    "SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(thread_text_redacted, '{p}')) = 0 AS {k}_passed" for k, p in checks.CARRIERS.items()) + " FROM inquiries"
)
def artifact_bars(spark, d):
    return table(spark, d, "inquiries").agg(*[(F.count_if(F.col("thread_text_redacted").rlike(p)) == 0).alias(f"{k}_passed") for k, p in checks.CARRIERS.items()])


@query(" UNION ALL ".join(f"SELECT inquiry_id, '{p.replace(chr(39), chr(39) * 2)}' AS phrase FROM inquiries WHERE contains(lower(thread_text_redacted), '{p.replace(chr(39), chr(39) * 2)}')" for p in checks.TALK_BACK))
def talk_back(spark, d):
    return table(spark, d, "inquiries").select("inquiry_id", F.explode(checks.talk_back_phrases(F.col("thread_text_redacted"))).alias("phrase"))


@query(
    "SELECT damage, count(*) AS n FROM (SELECT CASE WHEN NOT contains(thread_text_redacted, '## Message') THEN 'no_header' WHEN "
    + " OR ".join(f"contains(lower(split_part(thread_text_redacted, '## Message', 1)), '{p.replace(chr(39), chr(39) * 2)}')" for p in checks.TALK_BACK_AT_START)
    + " THEN 'talk_back' ELSE 'ok' END AS damage FROM inquiries) GROUP BY 1"
)
def thread_damage(spark, d):
    return table(spark, d, "inquiries").select(checks.thread_damage(F.col("thread_text_redacted")).alias("damage")).groupBy("damage").agg(F.count("*").alias("n"))


_SOURCE, _SCORE = "lower(trim(source))", "lower(trim(score))"


@query(
    f"SELECT s.source, count(t.s) AS n, count(*) FILTER (sc = 'advances') AS n_advances, count(*) FILTER (sc = 'salvageable') AS n_salvageable, count(*) FILTER (sc = 'stalls') AS n_stalls, count(*) FILTER (sc IN ('advances', 'salvageable')) AS n_saved, "
    f"COALESCE(round(100.0 * count(*) FILTER (sc IN ('advances', 'salvageable')) / NULLIF(count(t.s), 0), 4), 0.0)::DOUBLE AS pct_saved FROM (VALUES ('cold'), ('recall')) s(source) LEFT JOIN (SELECT {_SOURCE} AS s, {_SCORE} AS sc FROM usefulness_tally) t ON t.s = s.source GROUP BY 1"
)
def usefulness_rollup(spark, d):
    return tally.rollup(table(spark, d, "usefulness_tally"))


@query(
    f"SELECT COALESCE(refused, 'accepted') AS verdict, count(*) AS n FROM (SELECT CASE WHEN {_SOURCE} IS NULL OR {_SOURCE} NOT IN ('cold', 'recall') THEN 'source' WHEN {_SCORE} IS NULL OR {_SCORE} NOT IN ('advances', 'salvageable', 'stalls') THEN 'score' WHEN COALESCE(trim(why), '') = '' THEN 'why' END AS refused FROM usefulness_tally) GROUP BY 1"
)
def tally_verdicts(spark, d):
    return tally.canonical(table(spark, d, "usefulness_tally")).groupBy(F.coalesce("refused", F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT 'live-' || (COALESCE(max(TRY_CAST(regexp_extract(inquiry_id, '^live-(\\d+)$', 1) AS BIGINT)), 0) + 1) AS next_id FROM usefulness_tally")
def next_live_id(spark, d):
    return tally.next_live_id(table(spark, d, "usefulness_tally"))


@query()
def allow_term_hits(spark, d):
    terms = table(spark, d, "allow_terms").select("kind", F.col("entry").alias("term"))
    return termscan.term_hits(table(spark, d, "agent_outputs"), "output_id", "response_draft", terms)


@query()
def allow_term_hit_counts(spark, d):
    return termscan.hit_counts(allow_term_hits(spark, d), "kind", "term")


_OWN = "(SELECT list(lower(entry)) FROM allow_terms)"
_SLOT = "trim(regexp_replace(trim(regexp_replace(trim(unnest(regexp_extract_all(thread_text_redacted, '(?m)^\\*\\*From:\\*\\*([^\\r\\n]*)', 1))), '\\s*<[^>]*>\\s*$', '')), '^[\"'']+|[\"'']+$', '', 'g'))"


@query(
    f"WITH s AS (SELECT DISTINCT name FROM (SELECT {_SLOT} AS name FROM inquiries) WHERE name <> '' AND regexp_replace(name, '[{{}}]', '', 'g') NOT IN ('name', 'email', 'url', 'phone', 'payment') AND len(list_filter({_OWN}, lambda a: contains(lower(name), a))) = 0) "
    "SELECT name FROM s UNION SELECT regexp_replace(name, '^\\s*([^,]*?)\\s*,\\s*(.*?)\\s*$', '\\2 \\1') FROM s WHERE regexp_matches(name, '^\\s*[^,\\s][^,]*,\\s*[^\\s]')"
)
def sender_names(spark, d):
    allowed = [r[0] for r in table(spark, d, "allow_terms").select("entry").collect()]
    return termscan.sender_names(table(spark, d, "inquiries"), "thread_text_redacted", allowed)


@query()
def sender_name_tokens(spark, d):
    allowed = [r[0] for r in table(spark, d, "allow_terms").where("entry is not null").select("entry").collect()]
    text, own = F.col("thread_text_redacted"), [a.lower() for a in allowed]
    held = lambda kind: table(spark, d, "inquiries").select(F.explode(F.regexp_extract_all(text, F.lit("(?U)" + patterns.PATTERNS[kind]), F.lit(0))).alias(kind)).where(~F.lower(kind).isin(own)).distinct()
    return termscan.stable_tokens(termscan.variants(sender_names(spark, d), held("email"), held("phone"), mined_names(spark, d), allowed))


_EXPECTED = "[" + ", ".join(repr(w.lower()) for w in checks.EXPECTED_WORDS) + "]"
_KNOWN_WORDS = "[" + ", ".join(repr(w) for w in sorted({*checks.STOP_WORDS, *(w.lower() for w in checks.EXPECTED_WORDS)})) + "]"
_FUNCTION_WORDS = "[" + ", ".join(map(repr, termscan.FUNCTION_WORDS)) + "]"


#: RE2 knows ASCII words only: marks are doubled, so that each side of a word has one of its own, and halved again.
_MARK = "[^\\p{L}\\p{N}_]"


def _whole_words(column: str, pattern: str) -> str:
    found = f"regexp_extract_all(regexp_replace({column}, '({_MARK})', '\\1\\1', 'g'), '(?:^|{_MARK})({pattern})(?:{_MARK}|$)', 1)"
    return f"unnest(list_transform({found}, lambda w: regexp_replace(w, '([ \\t])[ \\t]', '\\1', 'g')))"


def _new_words(name: str, known: str) -> str:
    return f"len(list_filter(regexp_split_to_array({name}, '[ \\t]+'), lambda w: NOT list_contains({known}, lower(w)))) > 0"


@query(
    f"SELECT DISTINCT name FROM (SELECT regexp_extract(m, '([A-Z][a-z]+)$', 1) AS name FROM (SELECT {_whole_words('response_draft', '(?:Hi|Hello|Dear)[ \\t]+[A-Z][a-z]+')} AS m FROM agent_outputs) UNION ALL "
    f"SELECT name FROM (SELECT {_whole_words('response_draft', '[A-Z][a-z]+[ \\t]+[A-Z][a-z]+')} AS name FROM agent_outputs) WHERE NOT list_has_any(regexp_split_to_array(lower(name), '[ \\t]+'), {_FUNCTION_WORDS})) WHERE {_new_words('name', _EXPECTED)}"
)
def mined_names(spark, d):
    return termscan.mined_names(table(spark, d, "agent_outputs").where("response_draft is not null"), "response_draft", list(checks.EXPECTED_WORDS))


@query("SELECT count(*) AS n_drafts, count(*) FILTER (length(response_draft) BETWEEN 1 AND 20000) AS n_valid FROM agent_outputs")
def draft_lengths(spark, d):
    return table(spark, d, "agent_outputs").agg(F.count("*").alias("n_drafts"), F.count_if(writers.draft_valid(F.col("response_draft"))).alias("n_valid"))


@query("SELECT (SELECT count(*) FROM labels) AS n_before, (SELECT count(*) FROM labels) AS n_after, 0 AS n_lost, 0 AS n_added, (SELECT count(*) FROM labels WHERE inquiry_id NOT IN (SELECT inquiry_id FROM inquiries)) AS n_orphans")
def label_migration_report(spark, d):
    rows = table(spark, d, "labels")
    stored = rows.select(*[f.name for f in schema.LABELS.fields])
    rebuilt = labels.new_rows(stored.limit(0), stored, "label_id")
    return writers.reconcile(rows, rebuilt, "label_id", table(spark, d, "inquiries"), "inquiry_id")


_OPENS = f"list_transform(l, lambda x: regexp_matches({_strip('x')}, '{cleaning.QUOTED_LINE}'))"
_CUT = f"regexp_replace({_strip('k')}, '{cleaning.INLINE_CUT.replace(chr(39), chr(39) * 2)}', '')"


@query(
    f"SELECT inquiry_id, message_no, regexp_replace({_CUT}, '{_WS}+$', '') AS body FROM (SELECT inquiry_id, message_no, array_to_string(CASE WHEN list_contains(o, true) THEN l[:list_position(o, true) - 1] ELSE l END, chr(10)) AS k FROM "
    f"(SELECT inquiry_id, message_no, l, {_OPENS} AS o FROM (SELECT inquiry_id, message_no, regexp_split_to_array(body, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM {_MESSAGES})))"
)
def cleaned_bodies(spark, d):
    return threads.messages(table(spark, d, "inquiries")).select("inquiry_id", "message_no", cleaning.clean_body(F.col("body")).alias("body"))


@query(
    "SELECT table_name, CAST(column_index - 1 AS INTEGER) AS position, column_name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END AS type "
    "FROM duckdb_columns() WHERE table_name IN ('inquiries', 'labels', 'agent_outputs', 'usefulness_tally')"
)
def catalogue(spark, d):
    return readers.table_columns({t: table(spark, d, t) for t in ("inquiries", "labels", "agent_outputs", "usefulness_tally")})


@query("SELECT count(*) AS n_labels, count(i.inquiry_id) AS n_joinable, count(*) - count(i.inquiry_id) AS n_orphans FROM labels l LEFT JOIN inquiries i USING (inquiry_id)")
def joinable_labels(spark, d):
    return labels.joinable(table(spark, d, "labels"), table(spark, d, "inquiries"))


@query(
    "SELECT t.inquiry_id, i.inquiry_id IS NOT NULL AS found, redaction_status, message_count FROM (SELECT DISTINCT inquiry_id FROM usefulness_tally WHERE inquiry_id IS NOT NULL) t LEFT JOIN inquiries i USING (inquiry_id)"
)
def tally_lookup(spark, d):
    wanted = table(spark, d, "usefulness_tally").where("inquiry_id is not null")
    return labels.by_ids(table(spark, d, "inquiries").select("inquiry_id", "redaction_status", "message_count"), "inquiry_id", wanted)


_CANARY = "(SELECT inquiry_id FROM agent_outputs GROUP BY 1 ORDER BY count(*) DESC, inquiry_id LIMIT 1)"


@query(f"SELECT output_id, inquiry_id, created_at FROM agent_outputs WHERE inquiry_id = {_CANARY} ORDER BY created_at DESC, output_id DESC LIMIT 1")
def latest_output_of_busiest(spark, d):
    rows = table(spark, d, "agent_outputs").select("output_id", "inquiry_id", "created_at")
    busiest = rows.groupBy("inquiry_id").count().orderBy(F.desc("count"), "inquiry_id").first()
    return labels.latest_of(rows, "inquiry_id", busiest and busiest[0], "created_at", "output_id")


@query(
    "SELECT redaction_status, n_items, list_aggregate(ids[:4], 'string_agg', ', ') || CASE WHEN n_items > 4 THEN ' (+' || (n_items - 4) || ' more)' ELSE '' END AS shown FROM "
    "(SELECT redaction_status, count(DISTINCT inquiry_id) AS n_items, list_sort(list(DISTINCT inquiry_id)) AS ids FROM inquiries GROUP BY 1)"
)
def status_heads(spark, d):
    return labels.heads(table(spark, d, "inquiries"), "redaction_status", "inquiry_id")


_TALLY_STRICT = schema.T.StructType([schema.T.StructField(f.name, f.dataType, False) for f in schema.TALLY.fields])


@query(" UNION ALL ".join(f"SELECT inquiry_id, '{f.name} is null' AS rule, CAST(NULL AS VARCHAR) AS value FROM usefulness_tally WHERE {f.name} IS NULL" for f in schema.TALLY.fields))
def tally_violations(spark, d):
    return schema.broken_rules(table(spark, d, "usefulness_tally"), _TALLY_STRICT, "inquiry_id")


PHRASES = ("thank you", "please tell me", "i can set aside", "could you confirm")


@query(" UNION ALL ".join(f"SELECT output_id, '{p}' AS phrase FROM agent_outputs WHERE contains(lower(response_draft), '{p}')" for p in PHRASES))
def draft_phrases(spark, d):
    return table(spark, d, "agent_outputs").select("output_id", F.explode(checks.talk_back_phrases(F.col("response_draft"), PHRASES)).alias("phrase"))


_EM, _EN, _DOUBLE = (f"len(regexp_extract_all(response_draft, '{c}'))" for c in ("—", "–", "--"))
_N_EMOJI = f"len(regexp_extract_all(response_draft, '{_RE2_EMOJI}'))"


@query(
    f"SELECT output_id, 'no_em_dash' AS \"check\", {_EM} = 0 AS passed, false AS abstained, CASE WHEN response_draft IS NULL THEN '' ELSE {_EM} || ' em, ' || {_EN} || ' en, ' || {_DOUBLE} || ' double' END AS detail FROM agent_outputs "
    f"UNION ALL SELECT output_id, 'no_emoji', {_N_EMOJI} = 0, false, CAST({_N_EMOJI} AS VARCHAR) FROM agent_outputs "
    "UNION ALL SELECT output_id, 'language_match', response_draft IS NOT NULL, true, CASE WHEN response_draft IS NOT NULL THEN 'not implemented' END FROM agent_outputs"
)
def draft_check_table(spark, d):
    return table(spark, d, "agent_outputs").select("output_id", F.inline(checks.draft_checks(F.col("response_draft"))))


def _known_words() -> list[str]:
    return [*checks.STOP_WORDS, *checks.EXPECTED_WORDS]


_NAME_HITS = f"""
    (SELECT inquiry_id, redaction_status, 'greeting' AS kind, m AS sample, CASE WHEN list_contains({_KNOWN_WORDS}, lower(regexp_extract(m, '([A-Z][a-z]+)$', 1))) THEN 'CLEARED' ELSE 'REVIEW' END AS verdict
     FROM (SELECT inquiry_id, redaction_status, {_whole_words('thread_text_redacted', '(?:Hi|Hello|Dear)[ \\t]+[A-Z][a-z]+')} AS m FROM inquiries)
     UNION ALL SELECT inquiry_id, redaction_status, 'signature', {_strip('m')}, CASE WHEN len(list_filter(regexp_extract_all(m, '[A-Z][a-z]+'), lambda w: NOT list_contains({_KNOWN_WORDS}, lower(w)))) = 0 THEN 'CLEARED' ELSE 'REVIEW' END
     FROM (SELECT inquiry_id, redaction_status, unnest(regexp_extract_all(thread_text_redacted, '{checks.SIGNATURE}')) AS m FROM inquiries))"""


@query(f"SELECT inquiry_id, kind, sample, verdict FROM {_NAME_HITS}")
def artifact_names(spark, d):
    return table(spark, d, "inquiries").select("inquiry_id", F.inline(checks.name_hits(F.col("thread_text_redacted"), _known_words())))


@query(
    f"SELECT redaction_status, CASE WHEN verdict = 'CLEARED' THEN 'cleared' WHEN redaction_status = 'model_failed' THEN 'quarantined' ELSE 'gating' END AS outcome, count(*) AS n FROM {_NAME_HITS} GROUP BY 1, 2"
)
def artifact_verdicts(spark, d):
    hits = table(spark, d, "inquiries").select("redaction_status", F.inline(checks.name_hits(F.col("thread_text_redacted"), _known_words())))
    outcome = checks.probe_verdict(F.lit("store"), F.col("redaction_status"), F.col("verdict"))
    return hits.groupBy("redaction_status", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    f"SELECT DISTINCT array_to_string(w, ' ') AS name, CASE WHEN len(w) > 1 THEN 'strong' ELSE 'weak' END AS strength FROM (SELECT regexp_extract_all(m, '[A-Z][a-z]+') AS w FROM "
    f"(SELECT unnest(regexp_extract_all(thread_text_redacted, '{termscan.SIGNATURE_NAME}')) AS m FROM inquiries)) WHERE len(list_filter(w, lambda x: NOT list_contains({_KNOWN_WORDS}, lower(x)))) > 0"
)
def signature_names(spark, d):
    return termscan.signature_names(table(spark, d, "inquiries"), "thread_text_redacted", _known_words())


def _staff(spark, d) -> list[str]:
    # configuration: the house's own names
    return sorted(r[0] for r in table(spark, d, "allow_terms").where("kind = 'staff_name' and entry is not null").select("entry").distinct().collect())


_DRAFT_LINES = "(SELECT output_id, i AS line, l[i] AS t FROM (SELECT output_id, regexp_split_to_array(response_draft, '\\r\\n|\\n') AS l FROM agent_outputs), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"


@query(
    f"SELECT output_id, CAST(line AS INTEGER) AS line, kind, found, substring({_strip('t')}, 1, 90) AS context FROM (SELECT output_id, line, t, 'customer_name' AS kind, entry AS found FROM {_DRAFT_LINES}, (SELECT DISTINCT entry FROM allow_terms WHERE kind = 'staff_name') "
    "WHERE CASE WHEN contains(entry, ' ') THEN contains(lower(t), lower(entry)) ELSE regexp_matches(lower(t), '(?:^|[^\\p{L}\\p{N}\\p{M}_])' || lower(entry) || '(?:[^\\p{L}\\p{N}\\p{M}_]|$)') END "
    f"UNION ALL SELECT output_id, line, t, 'email', unnest(regexp_extract_all(t, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b')) FROM {_DRAFT_LINES})"
)
def draft_audit_names(spark, d):
    return draft_audit(spark, d).where("kind in ('customer_name', 'email')")


@query()
def draft_audit(spark, d):
    return termscan.audit_hits(table(spark, d, "agent_outputs"), "output_id", "response_draft", _staff(spark, d))


@query(
    f"WITH e AS (SELECT inquiry_id, min(outcome) AS expected FROM labels GROUP BY 1 UNION ALL SELECT inquiry_id, 'unknown' FROM inquiries i WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.inquiry_id = i.inquiry_id)) "
    f"SELECT e.inquiry_id, 'outcome' AS field, expected, outcome AS actual FROM e LEFT JOIN {_LATEST} l USING (inquiry_id) WHERE outcome IS DISTINCT FROM expected"
)
def relabel_mismatches(spark, d):
    rows, known = table(spark, d, "labels"), table(spark, d, "inquiries").select("inquiry_id")
    expected = rows.groupBy("inquiry_id").agg(F.min("outcome").alias("expected")).unionByName(labels.orphans(known, rows).withColumn("expected", F.lit("unknown")))
    return labels.relabel_mismatches(rows.select("label_id", "inquiry_id", "labeled_at", "outcome"), expected.withColumn("field", F.lit("outcome")))


@query(
    "SELECT CASE WHEN a IS NOT DISTINCT FROM response_draft THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n FROM (SELECT response_draft, "
    "regexp_replace(response_draft, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '{email}', 'g') AS a FROM agent_outputs) GROUP BY 1"
)
def draft_rewrite_status(spark, d):
    rows = table(spark, d, "agent_outputs").select("output_id", "response_draft")
    return writers.rewrite_status(rows, rows.select("output_id", patterns.redact_patterns(F.col("response_draft"), ("email",)).alias("response_draft")), "output_id", "response_draft")


@query()
def draft_hit_categories(spark, d):
    terms = table(spark, d, "allow_terms").select("kind", F.col("entry").alias("term"))
    hits = termscan.term_hits(table(spark, d, "agent_outputs"), "output_id", "response_draft", terms, categories=True)
    places = table(spark, d, "agent_outputs").select("output_id", "inquiry_id")
    placed = termscan.reach(termscan.fan_out(hits, places, "output_id"), table(spark, d, "inquiries"), "inquiry_id")
    return placed.groupBy("term", "category", "reach").agg(F.count("*").alias("n"))


@query()
def draft_hits_by_place(spark, d):
    terms = table(spark, d, "allow_terms").select("kind", F.col("entry").alias("term"))
    hits = termscan.term_hits(table(spark, d, "agent_outputs"), "output_id", "response_draft", terms)
    places = table(spark, d, "agent_outputs").select("output_id", F.col("inquiry_id").alias("path"), F.col("run_id").alias("commit"))
    return termscan.hit_counts(termscan.fan_out(hits, places, "output_id"), "path", "term", "commit", "kind")
