"""Mail bodies: quoted replies cut, HTML to text, MIME payloads flattened."""

from __future__ import annotations

import base64
import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.patterns import lines, strip_all

# Line starts after which a plain body is quoted history, and markers that cut a body anywhere.
QUOTED_LINE = r"(?s)^(?:>+|On .*wrote:|From: |Sent: |To: |Subject: |-{5,}\s*Forwarded message\s*-{3,})"
_DATED = r"On (?:[A-Z][a-z]{2}, )?[A-Z][a-z]{2} \d{1,2}, \d{4},? at \d{1,2}:\d{2}[^\n]{0,120}?wrote:"
_DEVICE = r"Sent from my (?:iPhone|iPad)"
_RULER = r"-{5,}\s*Forwarded message\s*-{3,}"
INLINE_CUT = rf"(?s)(?:{_DATED}|{_DEVICE}|{_RULER}).*\z"


def strip_quoted_replies(body: Column) -> Column:
    """The lines before the first one that, stripped, opens quoted history; ends stripped. Null stays null."""
    all_lines = lines(body)
    opens = F.transform(all_lines, lambda x: strip_all(x).rlike(QUOTED_LINE))
    first = F.array_position(opens, True)
    kept = F.when(first > 0, F.slice(all_lines, F.lit(1), F.greatest(first.cast("int") - 1, F.lit(0)))).otherwise(all_lines)
    return strip_all(F.array_join(kept, "\n"))


def strip_inline_quotes(body: Column) -> Column:
    """The text before the earliest dated attribution, device line or forwarding ruler. A date without ``wrote:`` cuts nothing."""
    return F.regexp_replace(F.regexp_replace(body, INLINE_CUT, ""), r"(?U)\s+\z", "")


def clean_body(body: Column) -> Column:
    return strip_inline_quotes(strip_quoted_replies(body))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities resolved once; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else html.unescape(t))


# Tags that end a line, tags, and characters that leave no trace.
_BREAK = re.compile(r"(?i)<\s*br\s*/?\s*>|</\s*(?:p|div|tr|li|h[1-6]|blockquote)\s*>")
_TAG = re.compile(r"<[^>]+>")
_TRACELESS = {0xA0: " ", 0xFEFF: None, 0x200B: None, 0x200C: None, 0x200D: None}


def text_of_html(source: str) -> str:
    """Breaks and closing blocks to line ends, tags gone, then entities, odd spaces and runs of blank lines. Script bodies stay."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", source))).translate(_TRACELESS)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(T.StringType())
def html_to_text(source: pd.Series) -> pd.Series:
    """``text_of_html`` of a column: one pass, as entities need Python anyway. Null stays null."""
    return source.map(lambda t: None if t is None else text_of_html(t))


def html_to_text_simple(source: Column) -> Column:
    """The plainer conversion: scripts and styles dropped, ``<br>`` one and ``</p>`` two line ends, no clean-up of spaces."""
    text = F.regexp_replace(source, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"(?i)</p\s*>", "\n\n")
    return unescape(F.regexp_replace(text, r"<[^>]+>", ""))


def decode_base64url(data: Column) -> Column:
    """Base64url, padding optional, to text; invalid bytes become U+FFFD. Null and undecodable input give null."""
    plain = F.rtrim(F.translate(data, "-_=", "+/"))
    padded = F.concat(plain, F.repeat(F.lit("="), (4 - F.length(plain) % 4) % 4))
    return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


_PART = T.StructType().add("mime", "string").add("filename", "string").add("data", "string")
MIME_PARTS = T.StructType().add("headers", T.MapType(T.StringType(), T.StringType())).add("parts", T.ArrayType(_PART)).add("body", "string")


def _decoded(node: dict) -> str:
    data = (node.get("body") or {}).get("data")
    try:
        return base64.urlsafe_b64decode(data + "===").decode("utf-8", "replace") if data else ""
    except ValueError:  # no base64: no text
        return ""


def _body_of(root: dict) -> str:
    """The first text that isn't empty: a text/plain part is taken as it is, another one by its parts, then by itself if HTML."""
    stack = [(root, False)]
    while stack:
        node, seen = stack.pop()
        if node.get("mimeType") == "text/plain":
            text = _decoded(node)
        elif not seen:
            stack += [(node, True), *((x, False) for x in reversed(node.get("parts") or []))]
            continue
        else:
            text = text_of_html(_decoded(node)) if node.get("mimeType") == "text/html" else ""
        if text:
            return text
    return ""


@F.pandas_udf(MIME_PARTS)
def flatten_mime(payload: pd.Series) -> pd.DataFrame:
    """Headers (first of a name, lower-cased), parts in document order and body text of a recursive MIME payload as JSON.

    Recursion is what a Spark schema cannot express; everything after this is array functions. Malformed JSON gives nulls.
    """

    def flat(text: str | None) -> tuple:
        try:
            root = json.loads(text)
            headers: dict[str, str] = {}
            for h in root.get("headers") or []:
                headers.setdefault(str(h.get("name", "")).lower(), h.get("value"))
            parts, stack = [], [root]
            while stack:
                node = stack.pop()
                parts.append({"mime": node.get("mimeType"), "filename": node.get("filename") or "", "data": (node.get("body") or {}).get("data")})
                stack += reversed(node.get("parts") or [])
            return headers, parts, _body_of(root)
        except (TypeError, ValueError, AttributeError):
            return None, None, None

    return pd.DataFrame([flat(t) for t in payload], columns=["headers", "parts", "body"])


def header_value(headers: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(headers, F.lit(name.lower())), F.lit(""))


def attachment_extensions(parts: Column) -> Column:
    """Lower-cased extension, from the last dot on, of each named part; ``(no extension)`` without a dot."""
    ext = lambda p: F.regexp_extract(F.lower(p["filename"]), r"(?s)\.[^.]*\z", 0)
    return F.transform(F.filter(parts, lambda p: p["filename"] != ""), lambda p: F.when(ext(p) == "", "(no extension)").otherwise(ext(p)))


def changed_lines(before: Column, after: Column) -> Column:
    """Positions at which both texts have a line and the lines differ."""
    a, b = lines(before), lines(after)
    n = F.least(F.size(a), F.size(b))
    return F.size(F.filter(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y), lambda d: d))


def preview(text: Column, n: int = 2000) -> Column:
    """Stripped text, cut after ``n`` characters with a note of how many follow."""
    t = strip_all(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(" [+"), (F.length(t) - n).cast("string"), F.lit(" chars]"))).otherwise(t)


def list_preview(text: Column, n: int = 70) -> Column:
    """One line of a list: line ends as blanks, the first ``n`` characters."""
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, n)
