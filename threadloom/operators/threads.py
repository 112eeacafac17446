"""Threads as text: front matter, messages, senders, and summaries per thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import cleaning
from threadloom.functions.patterns import strip_all
from threadloom.operators.redaction import AllowList, redacted

FRONT = r"(?s)^---[^\S\n]*\r?\n(.*?)\r?\n---[^\S\n]*(?:\r?\n(.*))?$"


def front_matter(text: Column) -> Column:
    """Map of the ``key: value`` lines between the leading rulers; the later of a repeated key wins; empty without any."""
    head = F.regexp_extract(text, FRONT, 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.contains(":"))
    keys = F.transform(pairs, lambda x: strip_all(F.substring_index(x, ":", 1)))
    values = F.transform(pairs, lambda x: strip_all(F.regexp_replace(x, r"^[^:]*:", "")))
    last = F.filter(F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))), lambda i: (i <= F.size(keys)) & ~F.array_contains(F.slice(keys, i + 1, F.size(keys)), F.try_element_at(keys, i)))
    return F.map_from_arrays(F.transform(last, lambda i: F.element_at(keys, i)), F.transform(last, lambda i: F.element_at(values, i)))


def thread_body(text: Column) -> Column:
    """What follows the front matter; the whole text without any."""
    return F.when(text.rlike(FRONT), F.regexp_extract(text, FRONT, 2)).otherwise(text)


def thread_fields(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(inquiry_id, thread_id, source_path, subject, message_count, date_range_start, date_range_end, body) of thread files.

    The thread id falls back to the file's stem; the count must be all digits; a range without ``/`` has no end.
    """
    got = files.select(F.col(path).alias("source_path"), front_matter(F.col(text)).alias("_f"), thread_body(F.col(text)).alias("body"))
    get = lambda k: F.try_element_at("_f", F.lit(k))
    stem = F.regexp_extract("source_path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    span = F.coalesce(get("date_range"), F.concat_ws(" / ", get("first_message_date"), get("last_message_date")))
    part = lambda i: F.nullif(F.trim(F.get(F.split(span, "/"), F.lit(i))), F.lit(""))
    return got.select(
        F.coalesce(get("thread_id"), stem).alias("inquiry_id"), F.coalesce(get("thread_id"), stem).alias("thread_id"), "source_path", get("subject").alias("subject"),
        F.when(get("message_count").rlike("^[0-9]+$"), get("message_count").try_cast("int")).alias("message_count"),
        part(0).alias("date_range_start"), part(1).alias("date_range_end"), "body",
    )


def merge_date_lines(text: Column) -> Column:
    """Front matter with ``first_message_date`` and ``last_message_date`` lines merged to one ``date_range: a / b`` line; idempotent."""
    first, last = F.regexp_extract(text, r"(?m)^first_message_date:[ \t]*(.*?)[ \t]*$", 1), F.regexp_extract(text, r"(?m)^last_message_date:[ \t]*(.*?)[ \t]*$", 1)
    done = F.regexp_replace(F.regexp_replace(text, r"(?m)^last_message_date:.*\r?\n", ""), r"(?m)^first_message_date:.*$", "\u0000")
    merged = F.replace(done, F.lit("\u0000"), F.concat(F.lit("date_range: "), first, F.lit(" / "), last))
    return F.when((first != "") & (last != ""), merged).otherwise(text)


def message_blocks(text: Column) -> Column:
    """array<struct<message_no, sender, sent, body>> of the ``## Message N`` blocks; text before the first belongs to none."""
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    blocks = F.filter(F.split(plain, r"(?m)(?=^## Message \d+[ \t]*$)"), lambda b: b.rlike(r"^## Message \d+[ \t]*(?:\n|\z)"))
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_extract(b, r"^## Message (\d{1,9})", 1).try_cast("int").alias("message_no"),
            F.regexp_extract(b, r"(?m)^\*\*From:\*\*[ \t]*(.*?)[ \t]*$", 1).alias("sender"),
            F.regexp_extract(b, r"(?m)^\*\*Date:\*\*[ \t]*(.*?)[ \t]*$", 1).alias("sent"),
            strip_all(F.regexp_replace(b, r"^## Message [^\n]*\n?(?:\*\*(?:From|Date|To|Cc|Subject):\*\*[^\n]*(?:\n|\z))*", "")).alias("body"),
        ),
    )


def messages(inquiries: DataFrame) -> DataFrame:
    """(inquiry_id, message_no, sender, sent, body) of every message. Null threads and threads without blocks give no rows."""
    return inquiries.select("inquiry_id", F.inline(message_blocks(F.col("thread_text_redacted"))))


def first_message_body(text: Column) -> Column:
    """The first piece at a message header (also a preamble before the first one): what follows the first blank line after its
    sender line, or the piece without its header lines; stripped.
    """
    pieces = F.filter(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?=## Message)"), lambda p: strip_all(p) != "")
    first = F.coalesce(F.try_element_at(pieces, F.lit(1)), F.lit(""))
    after = r"(?s)^.*?\*\*From:\*\*[^\n]*\n(?:[^\n]*\S[^\n]*\n)*[^\S\n]*\n(.*)$"
    bare = F.regexp_replace(first, r"(?m)^(?:## Message[^\n]*|\*\*(?:From|To|Date|Subject|Cc):\*\*[^\n]*)\n?", "")
    return strip_all(F.when(first.rlike(after), F.regexp_extract(first, after, 1)).otherwise(bare))


def sender_line(text: Column, within: int = 250) -> Column:
    """The first sender line in the first ``within`` characters, without its label; empty without any."""
    return F.trim(F.regexp_extract(F.substring(text, 1, within), r"\*\*From:\*\*([^\r\n]*)", 1))


def thread_summary(inquiries: DataFrame, house: str) -> DataFrame:
    """(inquiry_id, n_messages, first_sender, first_date, last_date, house_replied) of each thread, without a shuffle.

    house: what sender lines of the house hold, in any case.
    """
    text = F.col("thread_text_redacted")
    found = lambda label: F.regexp_extract_all(text, F.lit(rf"(?m)^\*\*{label}:\*\* ?([^\r\n]*)"), F.lit(1))
    rows = inquiries.select("inquiry_id", found("From").alias("s"), found("Date").alias("d"), F.regexp_count(text, F.lit(r"(?m)^## Message \d+")).alias("n_messages"))
    return rows.select(
        "inquiry_id", "n_messages", F.try_element_at("s", F.lit(1)).alias("first_sender"), F.try_element_at("d", F.lit(1)).alias("first_date"),
        F.try_element_at("d", F.lit(-1)).alias("last_date"), F.exists("s", lambda x: F.contains(F.lower(x), F.lit(house.lower()))).alias("house_replied"),
    )


def reply_totals(summary: DataFrame) -> DataFrame:
    """(n_exported, n_with_reply, n_without_reply) over ``thread_summary``; threads without messages weren't exported."""
    replied = F.coalesce("house_replied", F.lit(False))
    return summary.where("n_messages > 0").agg(F.count("*").alias("n_exported"), F.count_if(replied).alias("n_with_reply"), F.count_if(~replied).alias("n_without_reply"))


def message_block() -> Column:
    """``## Message N`` with its headers and body; a remark counts the attachments by their extensions, as names may be personal."""
    n = F.size(F.coalesce("extensions", F.array().cast("array<string>")))
    held = F.concat(n.cast("string"), F.lit(" attachment(s): "), F.array_join("extensions", ", "), F.lit(")_"))
    text = F.coalesce(F.col("body"), F.lit(""))
    body = F.when(text != "", F.when(n > 0, F.concat(text, F.lit("\n_("), held)).otherwise(text)).when(n > 0, F.concat(F.lit("_(no text body; "), held)).otherwise("_(no body extracted)_")
    blank = F.lit("")
    return F.concat(F.lit("## Message "), F.col("message_no").cast("string"), F.lit("\n**From:** "), F.coalesce("sender", blank), F.lit("\n**Date:** "), F.coalesce("sent", blank), F.lit("\n\n"), body, F.lit("\n"))


def exported_threads(messages: DataFrame, allowed: AllowList, operator: str) -> DataFrame:
    """(thread_id, n_messages, operator_replied, text) of (thread_id, message_no, sender, sent, subject, body, extensions, labels) rows.

    The text is front matter, of which only the subject is redacted (an id of many digits must stay whole), and the blocks of
    all messages in order, redacted in one pass over the joined text, where sender lines have the form that redaction looks
    for. operator: what a sender line of the operator holds, in any case. Messages of one thread are few; threads are many.
    """
    each = messages.select("thread_id", F.struct("message_no", "sender", "sent", "subject", "labels", message_block().alias("block")).alias("m"))
    rows = each.groupBy("thread_id").agg(F.sort_array(F.collect_list("m")).alias("_m"))
    first, last = F.get("_m", F.lit(0)), F.element_at("_m", -1)
    replied = F.exists("_m", lambda m: F.contains(F.lower(F.coalesce(m["sender"], F.lit(""))), F.lit(operator.lower())))
    rows = rows.select(
        "thread_id", F.size("_m").alias("n_messages"), replied.alias("operator_replied"), F.coalesce(first["subject"], F.lit("")).alias("_subject"), first["sent"].alias("_first"), last["sent"].alias("_last"),
        F.coalesce(first["labels"], F.array().cast("array<string>")).alias("_labels"), F.array_join(F.transform("_m", lambda m: m["block"]), "\n").alias("_blocks"),
    )
    done = redacted(redacted(rows, "_subject", allowed, "_subject"), "_blocks", allowed, "_blocks")
    text = lambda c: F.coalesce(c, F.lit(""))
    listed = F.concat(F.lit("["), F.array_join(F.transform("_labels", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    lines = [
        F.lit("---"), F.concat(F.lit("thread_id: "), text(F.col("thread_id"))), F.concat(F.lit("subject: "), F.col("_subject")), F.concat(F.lit("message_count: "), F.col("n_messages").cast("string")),
        F.concat(F.lit("date_range: "), text(F.col("_first")), F.lit(" / "), text(F.col("_last"))), F.concat(F.lit("labels: "), listed), F.concat(F.lit("operator_replied: "), F.when(F.col("operator_replied"), "True").otherwise("False")), F.lit("---"), F.lit(""), F.col("_blocks"),
    ]
    return done.select("thread_id", "n_messages", "operator_replied", F.concat_ws("\n", *lines).alias("text"))


def mail_messages(payloads: DataFrame, thread_id: str = "thread_id", message_no: str = "message_no", payload: str = "payload", labels: str = "labels") -> DataFrame:
    """The rows ``exported_threads`` takes, from MIME payloads as JSON: headers by name, the body chosen and cleaned of quotes."""
    m = payloads.withColumn("_m", cleaning.flatten_mime(payload))
    head = lambda name: cleaning.header_value(F.col("_m.headers"), name)
    return m.select(
        F.col(thread_id).alias("thread_id"), F.col(message_no).alias("message_no"), head("From").alias("sender"), head("Date").alias("sent"), head("Subject").alias("subject"),
        cleaning.clean_body(F.col("_m.body")).alias("body"), cleaning.attachment_extensions(F.col("_m.parts")).alias("extensions"), F.col(labels).alias("labels"),
    )
