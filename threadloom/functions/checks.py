"""Checks of texts: typography, leaks, artifacts of mail clients, replies of a model instead of content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.patterns import LOOSE_PHONE, PATTERNS, PLACEHOLDER, strip_all

# Emoji ranges, carriers of mail-client residue, phrases of a model that talks back, words a greeting may hold.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{FE00}-\x{FE0F}]"
CARRIERS = {
    "attribution": r"(?s)\bOn\b.{0,80}\bwrote:",
    "entity": r"&(?:nbsp|lt|gt|amp|#\d+|quot|apos);",
    "angle_entity": r"&lt;|&gt;",
    "device": r"Sent from my iP",
    "forwarded": r"Forwarded message",
}
TALK_BACK = (
    "i need the", "i'm ready to", "i am ready to", "please provide", "appears to be just", "appears to be a subject", "not a complete email", "i cannot",
    "i'll process it", "according to my instructions", "according to the rules",
)
TALK_BACK_AT_START = (
    "i need the", "i'm ready", "i am ready", "i cannot process", "please provide", "the input you provided", "the text you provided", "i'll process",
    "according to my instructions",
)
EXPECTED_WORDS = (
    "Hi", "Hello", "Dear", "Best", "Thanks", "Thank", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March",
    "April", "May", "June", "July", "August", "September", "October", "November", "December",
)
GREETING = r"(?U)\b(?:Hi|Hello|Dear)[ \t]+([A-Z][a-z]+)\b"
#: a line of one or two capitalised words; the white space between them may be a line end
SIGNATURE = r"(?m)^\s*([A-Z][a-z]+)(?:\s+([A-Z][a-z]+))?\s*$"
# Words of greetings and closings that are no names.
STOP_WORDS = (
    "best", "thanks", "thank", "cheers", "hi", "hello", "regards", "kind", "sincerely", "the", "warm", "warmest", "later", "dear", "all", "good", "morning", "afternoon",
    "evening", "and", "or", "to", "of", "for",
)


def dashes_and_emoji(text: Column) -> list[Column]:
    """n_em_dash (a failure), n_en_dash and n_double_hyphen (notes), n_emoji (a failure), passed."""
    em, emoji = F.regexp_count(text, F.lit("—")), F.regexp_count(text, F.lit(EMOJI))
    return [
        em.alias("n_em_dash"), F.regexp_count(text, F.lit("–")).alias("n_en_dash"), F.regexp_count(text, F.lit("--")).alias("n_double_hyphen"),
        emoji.alias("n_emoji"), ((em == 0) & (emoji == 0)).alias("passed"),
    ]


def leak_counts(text: Column) -> list[Column]:
    """n_emails and n_phones in a text whose placeholders were taken out first."""
    bare = F.regexp_replace(text, PLACEHOLDER, "")
    email = PATTERNS["email"].replace(r"\b", "")
    return [F.regexp_count(bare, F.lit(email)).alias("n_emails"), F.regexp_count(bare, F.lit(LOOSE_PHONE)).alias("n_phones")]


def name_shaped_words(text: Column, expected: tuple[str, ...] = EXPECTED_WORDS) -> Column:
    """Distinct capitalised words of three letters or more in order of appearance, without the expected ones."""
    words = F.regexp_extract_all(F.regexp_replace(text, PLACEHOLDER, ""), F.lit(r"\b([A-Z][a-z]{2,})\b"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, expected)).cast("array<string>"))


def carriers(text: Column) -> Column:
    """Names of the mail-client residues in a text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in CARRIERS.items()]))


def talk_back_phrases(text: Column, phrases: tuple[str, ...] = TALK_BACK) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(p), F.lit(p)) for p in phrases]))


def thread_damage(text: Column) -> Column:
    """``no_header`` without any message header, ``talk_back`` with a model's phrase before the first one, else ``ok``."""
    head = F.lower(F.substring_index(text, "## Message", 1))
    talks = F.exists(F.array(*map(F.lit, TALK_BACK_AT_START)), lambda p: F.contains(head, p))
    return F.when(~text.contains("## Message"), "no_header").when(talks, "talk_back").otherwise("ok")


def from_line_format(rest: Column) -> Column:
    """How a sender line is written, from what follows its label, trimmed."""
    quoted, bracket = rest.startswith('"'), rest.contains("<")
    return (
        F.when(quoted & bracket, "quoted_bracket").when(quoted, "quoted").when(bracket, "bare_bracket").when(rest.contains("{email}"), "bare_token").otherwise("bare")
    )


def name_hits(text: Column, known: list[str]) -> Column:
    """array<struct<kind, sample, verdict>> of greeted names and signature lines: CLEARED if every word is known, else REVIEW."""
    common = F.array(*[F.lit(w) for w in sorted({k.lower() for k in known})]).cast("array<string>")
    cleared = lambda words: F.forall(words, lambda w: F.array_contains(common, F.lower(w)))
    hit = lambda kind, sample, words: F.struct(F.lit(kind).alias("kind"), sample.alias("sample"), F.when(cleared(words), "CLEARED").otherwise("REVIEW").alias("verdict"))
    whole = lambda p, i: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    greeted = F.zip_with(whole(GREETING, 0), whole(GREETING, 1), lambda m, w: hit("greeting", m, F.array(w)))
    lines = F.zip_with(whole(SIGNATURE, 0), F.zip_with(whole(SIGNATURE, 1), whole(SIGNATURE, 2), lambda a, b: F.array_remove(F.array(a, b), "")), lambda m, ws: hit("signature", strip_all(m), ws))
    return F.concat(greeted, lines)


def probe_verdict(surface: Column, status: Column, verdict: Column) -> Column:
    """What a hit means: a REVIEW of a stored row gates unless the row is quarantined (model_failed); files are only reported."""
    return F.when(verdict == "CLEARED", "cleared").when(surface != "store", "reported").when(status.eqNullSafe(F.lit("model_failed")), "quarantined").otherwise("gating")


def draft_checks(text: Column) -> Column:
    """array<struct<check, passed, abstained, detail>>: dashes, emoji, and language, which has no implementation and abstains."""
    em, en, double, emoji, _ = dashes_and_emoji(text)
    one = lambda name, passed, abstained, detail: F.struct(F.lit(name).alias("check"), passed.alias("passed"), F.lit(abstained).alias("abstained"), detail.alias("detail"))
    dashes = F.concat_ws(", ", F.concat(em.cast("string"), F.lit(" em")), F.concat(en.cast("string"), F.lit(" en")), F.concat(double.cast("string"), F.lit(" double")))
    return F.array(
        one("no_em_dash", em == 0, False, dashes), one("no_emoji", emoji == 0, False, emoji.cast("string")),
        one("language_match", text.isNotNull(), True, F.when(text.isNotNull(), "not implemented")),
    )


def is_uuid(c: Column) -> Column:
    return c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def is_slash_date(c: Column) -> Column:
    return c.rlike(r"^\d{4}/\d{2}/\d{2}$")
