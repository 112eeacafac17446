"""Patterns of addresses, links and numbers, and their replacement and counting as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four patterns, in the order they are applied; the syntax is common to Java and Python.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "url": r"(?i)\bhttps?://[^\s)>\]]+",
    "payment": r"(?<!\d)(?:\d[ -]?){13,16}(?!\d)",
    "phone": r"(?<!\d)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)",
}
#: Java's classes are ASCII unless told otherwise; Python's never are.
_UNICODE = "(?U)"
#: A phone without digit guards, for leak scans: it also matches inside longer runs.
LOOSE_PHONE = r"(?:\+?1[\s.\-]?)?(?:\(\d{3}\)|\d{3})[\s.\-]?\d{3}[\s.\-]?\d{4}"
PLACEHOLDER = r"(?i)\{[a-z_]+\}"


def redact_patterns(text: Column, kinds: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """Each match replaced by its ``{kind}``. The order matters: an address inside a link goes first, long digit runs before phones."""
    for kind in kinds:
        text = F.regexp_replace(text, _UNICODE + PATTERNS[kind], "{" + kind + "}")
    return text


def strip_all(text: Column | str) -> Column:
    """Unicode white space gone from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines at any Unicode line end; one that ends the text adds no empty line."""
    return F.split(F.regexp_replace(text, r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
