"""Redaction of threads: patterns, sender slots with an allow-list, verification, and the status that follows.

The allow-list is configuration (a table of entries), not code. A slot is allowed when its words are covered by allowed
phrases, as multisets and longest first, and every word left over is an allowed single word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.patterns import PATTERNS, redact_patterns

_MARKS = ".,;:\"'()<>[]"
#: bold label with any white space after it, the slot, and the bracket that ends it
_SLOT = re.compile(r"(\*\*(?:From|To):\*\*\s*)(.+?)(\s*<)")


class AllowList:
    """Allowed single words and phrases, built from entries such as staff names and organisations."""

    def __init__(self, entries: list[str]) -> None:
        split = [self.words(e) for e in entries if e]
        self.single = {w[0] for w in split if len(w) == 1}
        self.phrases = sorted((Counter(w) for w in split if len(w) > 1), key=lambda c: -sum(c.values()))

    @staticmethod
    def words(text: str) -> list[str]:
        parts = (re.sub("['’]", "", w.lower()).strip(_MARKS) for w in re.split(r"[\s,]+", text))
        return [w for w in parts if w]

    def covers(self, slot: str) -> bool:
        left = Counter(self.words(slot))
        if not left:
            return False
        for phrase in self.phrases:  # each once: what a repeated phrase leaves over has to be allowed by itself
            if all(left[w] >= n for w, n in phrase.items()):
                left -= phrase
        return all(w in self.single for w in left)

    def redact_slots(self, text: str) -> str:
        keep = lambda slot: slot.strip() == "{name}" or self.covers(slot)
        return _SLOT.sub(lambda m: m[0] if keep(m[2]) else m[1] + "{name}" + m[3], text)


def allow_list(allow_terms: DataFrame, kinds: tuple[str, ...] = ("staff_name", "organisation")) -> AllowList:
    """From the allow-list table, a small configuration table; null entries are skipped."""
    return AllowList([r[0] for r in allow_terms.where(F.col("kind").isin(*kinds) & F.col("entry").isNotNull()).select("entry").distinct().collect()])


def redacted(df: DataFrame, text: str, allowed: AllowList, into: str = "redacted") -> DataFrame:
    """Add the text with addresses, links, numbers and sender slots redacted. Applying it twice changes nothing more."""

    @F.pandas_udf(T.StringType())
    def slots(part: pd.Series) -> pd.Series:
        return part.map(lambda t: None if t is None else allowed.redact_slots(t))

    return df.withColumn(into, slots(redact_patterns(F.col(text))))


FINDINGS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}


def survivors(text: str) -> list[dict]:
    """Matches of the four patterns that are left, grouped email, phone, payment, url; offsets in code points, end exclusive."""
    return [{"kind": k, "start": m.start(), "end": m.end()} for k in ("email", "phone", "payment", "url") for m in _COMPILED[k].finditer(text)]


def redact_threads(df: DataFrame, text: str, allowed: AllowList, redactor: Callable[[str], str] | None = None) -> DataFrame:
    """Add ``safe_text``, ``findings`` and ``redaction_status`` to rows with a raw text.

    ``redactor`` is an injected model call, made per row in Arrow batches; its exceptions give model_failed, and an answer
    longer than max(1.2 x length, length + 200) is taken for a hallucination: flagged, and the raw text is what gets
    redacted. Without one, names stay (names_unredacted) and no text goes to Python for it. Patterns are replaced in the JVM;
    slots and what survives are one more Arrow pass. Status: flagged > model_failed > names_unredacted > verified.
    Null text stays null and is model_failed.
    """

    @F.pandas_udf(T.StructType().add("stage", "string").add("failed", "boolean").add("grown", "boolean"))
    def call(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for t in raw:
            if t is None or not t.strip():
                rows.append((t, t is None, False))
                continue
            try:
                answer = redactor(t) or t
                grown = len(answer) > max(1.2 * len(t), len(t) + 200)
                rows.append((t if grown else answer, False, grown))
            except Exception:
                rows.append((t, True, False))
        return pd.DataFrame(rows, columns=["stage", "failed", "grown"])

    @F.pandas_udf(T.StructType().add("safe_text", "string").add("findings", FINDINGS))
    def finish(part: pd.Series) -> pd.DataFrame:
        safe = [None if t is None else allowed.redact_slots(t) for t in part]
        return pd.DataFrame({"safe_text": safe, "findings": [[] if t is None else survivors(t) for t in safe]})

    raw = F.col(text)
    staged = df.withColumn("_s", F.struct(raw.alias("stage"), raw.isNull().alias("failed"), F.lit(False).alias("grown")) if redactor is None else call(raw))
    done = staged.withColumn("_f", finish(redact_patterns(F.col("_s.stage")))).withColumns({"safe_text": F.col("_f.safe_text"), "findings": F.col("_f.findings")})
    status = (
        F.when(F.col("_s.grown") | (F.size("findings") > 0), "flagged").when(F.col("_s.failed"), "model_failed").when(F.lit(redactor is None), "names_unredacted").otherwise("verified")
    )
    return done.withColumn("redaction_status", status).drop("_s", "_f")


def stored_findings(inquiries: DataFrame) -> DataFrame:
    """(inquiry_id, kind, n_chars) of the findings stored as JSON with each inquiry; malformed cells hold none."""
    kind = T.ArrayType(T.StructType().add("kind", "string").add("match_span", T.ArrayType(T.IntegerType())))
    rows = inquiries.select("inquiry_id", F.explode(F.from_json("redaction_findings", kind)).alias("f"))
    return rows.select("inquiry_id", F.col("f.kind").alias("kind"), (F.get("f.match_span", F.lit(1)) - F.get("f.match_span", F.lit(0))).alias("n_chars"))


def sender_leaks(inquiries: DataFrame, allowed: AllowList) -> DataFrame:
    """(inquiry_id, slot) of sender lines whose display name is neither a placeholder nor allowed."""

    @F.pandas_udf(T.BooleanType())
    def covered(slot: pd.Series) -> pd.Series:
        return slot.map(lambda s: s is not None and allowed.covers(s))

    lines = inquiries.select("inquiry_id", F.explode(F.regexp_extract_all("thread_text_redacted", F.lit(r"(?m)^\*\*From:\*\*([^\r\n]*)"), F.lit(1))).alias("line"))
    slots = lines.select("inquiry_id", F.trim(F.regexp_replace(F.trim("line"), r"\s*<[^>]*>\s*$", "")).alias("slot"))
    bare = F.regexp_replace("slot", "^[\"']+|[\"']+$", "")
    open_ = slots.where((F.col("slot") != "") & ~bare.isin("{name}", "{email}", "{url}", "{phone}"))
    return open_.where(~covered("slot"))
