"""One character form for text that looks the same: confusables skeleton, class form, and which records need it.

``skeleton`` decomposes a text, replaces every character by its prototype from the look-alike table, and decomposes again;
two texts that look equal have equal skeletons, and originals are grouped by it. A class of equal skeletons has one plain
member, its *class form*: the same text with ordinary characters in place of those that stand in for another one, of
invisible characters, disguised spaces and accented letters in parts. Emoji, typographic quotes and dashes and words wholly
in another script are ordinary. A record needs normalising where it differs from the class form of its own skeleton.

The table is the public confusables data of Unicode as shipped with the session's ICU library, with the compatibility
decompositions of the Unicode database and small capitals (by their names) added by rule. It is read once on the driver
(half a second) and sent to the tasks; its size is that of the standard, whatever the data. Plain ASCII text never leaves
the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import cut, spread

_SPACES = "   -   　"
_UNSEEN = "­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿"
_SPACE = re.compile(f"[{_SPACES}]")
_INVISIBLE = re.compile(f"[{_UNSEEN}]+")
#: scripts in which joiners change how a word is written
_JOINING = re.compile("[֐-῿]")
_IN_WORD = re.compile(f"(?<=\\w)[{_UNSEEN}]+(?=\\w)")
_EMOJI = re.compile("[←-⯿️\U0001f000-\U0001faff\U000e0020-\U000e007f]")
_WORD = re.compile("[^\\W_](?:[^\\W_]|[\u0300-\u036f])*")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
#: Records from which a group of look-alikes counts as hot, and the keys its rows are dealt over.
HOT_RECORDS, SALTS = 1_000_000, 64
#: letters that only Turkish and its relatives have beside the dotless i
_TURKISH = re.compile("[ĞğİŞş]")
# Prototypes of the table that are letters of no language of the mail, and how they read.
_READS = {"ĸ": "k", "ʜ": "h", "ᴛ": "t"}
#: Java class of ordinary characters besides ASCII: composed Latin letters, marks of typography.
_ORDINARY = [*range(0xA1, 0xAD), *range(0xAE, 0x250), 0x2013, 0x2014, *range(0x2018, 0x2020), 0x2022, 0x2026, 0x20AC]


def _stand_ins() -> dict[int, str]:
    blocks = [(0xFF01, 0xFFEF), (0x1D400, 0x1D800), (0x2100, 0x2150), (0x2160, 0x2180), (0x2460, 0x2500), (0xFB00, 0xFB07), (0x1F110, 0x1F14A), (0x1FBF0, 0x1FBFA)]
    out = {}
    for a, b in blocks:
        for cp in range(a, b):
            tag = unicodedata.decomposition(chr(cp)).split(" ")[0]
            plain = unicodedata.normalize("NFKC", chr(cp))
            if tag in ("<wide>", "<narrow>", "<font>", "<circle>") or (tag == "<compat>" and (0xFB00 <= cp < 0xFB07 or 0x2160 <= cp < 0x2180)):
                if plain != chr(cp):
                    out[cp] = plain
    return out


def _small_capitals() -> dict[int, str]:
    """Small capital letters by their names: a letter of the Latin alphabet each."""
    named = ((cp, unicodedata.name(chr(cp), "")) for cp in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800)))
    return {cp: n[-1].lower() for cp, n in named if re.fullmatch(r"LATIN LETTER SMALL CAPITAL [A-Z]", n)}


def _runs(cps: Iterable[int]) -> list[tuple[int, int]]:
    """Code points as ranges, which patterns test faster than many single ones."""
    out: list[tuple[int, int]] = []
    for cp in sorted(cps):
        out[-1:] = [(out[-1][0], cp)] if out and cp == out[-1][1] + 1 else [*out[-1:], (cp, cp)]
    return out


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


class Forms:
    """Skeletons and class forms by a table of prototypes: {code point: prototype} of decomposed characters."""

    def __init__(self, prototypes: dict[int, str]) -> None:
        self.prototypes = prototypes

    @cached_property
    def _stand(self) -> dict[int, str]:
        return _stand_ins()

    @cached_property
    def _reads(self) -> dict[int, str]:
        """Ordinary Latin letters or digits that characters stand in for in a word: the readable side of the table."""
        small = _small_capitals()
        out = dict(small)
        for cp, look in self.prototypes.items():
            c = chr(cp)
            if cp < 0x80 or cp in self._stand or unicodedata.category(c)[0] not in "LN":
                continue
            plain = _READS.get(look) or (small.get(ord(look)) if len(look) == 1 else None) or look
            if not (plain.isascii() and plain.isalnum()) or (len(plain) > 1 and cp < 0x250):
                continue  # æ and œ are letters of their own
            if unicodedata.category(c) == "Lu":  # prototypes are what a character looks like: a capital that looks like l is an I
                plain = "I" if plain == "l" else plain.upper()
            out[cp] = plain
        return out

    @cached_property
    def _strict(self) -> frozenset[str]:
        """Characters that look exactly like a Latin letter: a word wholly made of them is taken for a Latin one."""
        return frozenset(chr(cp) for cp, plain in self._reads.items() if self.prototypes.get(cp, "").isascii() and plain.isalpha())

    @cached_property
    def _foreign(self) -> re.Pattern:
        return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _runs(self._reads)) + "]")

    def suspect(self) -> str:
        """Java class of characters that can make a text differ from its class form."""
        runs = _runs(cp for cp in _ORDINARY if cp not in self._reads)
        # an intersection, so that ASCII, most of any text, is told by its first part
        return "[[^\\x00-\\x7f]&&[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]]"

    def _genuine(self, word: str, script: str) -> bool:
        """Whether a word is wholly in a script, with letters that no Latin one looks like."""
        return bool(word) and all(_script(c) == script for c in word if c.isalpha()) and not all(c in self._strict for c in word)

    def _disguised(self, m: re.Match) -> bool:
        """Whether letters of a word stand in for Latin ones: beside Latin letters, or making up the whole word. A word
        that looks Latin by chance stands beside other words of its script."""
        word = m[0]
        held = self._foreign.findall(word)
        if not held:
            return False
        if _LATIN.search(word.replace("ı", "")):
            return set(held) != {"ı"} or not _TURKISH.search(m.string)
        letters = [c for c in word if c.isalpha()]
        if not letters or not all(c in self._strict for c in letters) or (len(word) == 1 and word.islower() and _script(word) == "GREEK"):
            return False  # a Greek letter alone is a symbol
        text, script = m.string, _script(word[0])
        before, after = re.search(r"([^\W\d_]+)[^\w\n]*\Z", text[max(0, m.start() - 40) : m.start()]), re.match(r"[^\w\n]*([^\W\d_]+)", text[m.end() : m.end() + 40])
        return not any(self._genuine(x[1], script) for x in (before, after) if x)

    def class_form(self, text: str) -> tuple[str, list[str]]:
        """The plain text of the same skeleton, and what differed: any of stand_in, invisible, space, accent, in this order."""
        if text.isascii():
            return text, []
        found = []
        seen = _INVISIBLE.sub(_unveil, text)
        hidden = any(_unveil(m) == "" for m in _IN_WORD.finditer(text))
        plain = self._plainly(seen)
        composed = unicodedata.normalize("NFC", plain)
        spaced = _SPACE.sub(" ", composed)
        done = spaced
        if self._foreign.search(spaced):
            done = unicodedata.normalize("NFC", _WORD.sub(lambda m: m[0].translate(self._reads) if self._disguised(m) else m[0], spaced))
        if plain != seen or done != spaced:
            found.append("stand_in")
        if hidden:
            found.append("invisible")
        if spaced != composed:
            found.append("space")
        if composed != plain:
            found.append("accent")
        return done, found

    def skeleton(self, text: str) -> str:
        """Decompose, drop what can't be seen, replace every character by its prototype, decompose again."""
        seen = text if text.isascii() else self._plainly(_INVISIBLE.sub(_unveil, text))
        return unicodedata.normalize("NFD", unicodedata.normalize("NFD", _SPACE.sub(" ", seen)).translate(self._looks))

    @cached_property
    def _looks(self) -> dict[int, str]:
        """The prototypes; characters whose readable side isn't of their prototype's class, such as small capitals, have its prototype."""
        look = lambda plain: "".join(self.prototypes.get(ord(c), c) for c in plain)
        return self.prototypes | {cp: look(plain) for cp, plain in self._reads.items() if look(plain) != self.prototypes.get(cp)}

    @cached_property
    def _stands(self) -> re.Pattern:
        return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _runs(self._stand)) + "]")

    def _plainly(self, text: str) -> str:
        """The text without compatibility forms of characters."""
        return text.translate(self._stand) if self._stands.search(text) else text

    def differs(self, text: str) -> list[str]:
        """What makes a text differ from the class form of its skeleton; empty where it is the class form itself."""
        plain, found = self.class_form(text)
        return found if found and self.skeleton(plain) == self.skeleton(text) else []


def _unveil(m: re.Match) -> str:
    before, after = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
    keep = "‌" in m[0] or "‍" in m[0]
    if keep and (_EMOJI.match(before or " ") or _EMOJI.match(after or " ") or (_JOINING.match(before or " ") and _JOINING.match(after or " "))):
        return m[0]
    return ""


_FORMS: dict[int, Forms] = {}


def forms(spark: SparkSession) -> Forms:
    """The table of the session's ICU library, read once: its skeleton of each assigned character that doesn't decompose."""
    key = id(spark.sparkContext)
    if key not in _FORMS:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        cps = [cp for cp in range(0x20, 0x110000) if unicodedata.category(chr(cp)) not in ("Cc", "Cf", "Cn", "Co", "Cs") and unicodedata.normalize("NFD", chr(cp)) == chr(cp)]
        # a line each: line ends are their own prototypes, and keep combining marks apart
        looks = checker.getSkeleton("\n".join(map(chr, cps))).split("\n")
        _FORMS.clear()
        _FORMS[key] = Forms({cp: look for cp, look in zip(cps, looks, strict=True) if look != chr(cp)})
    return _FORMS[key]


def text_fields(inquiries: DataFrame, outputs: DataFrame) -> DataFrame:
    """(field_name, record_id, text) of thread_text_redacted and response_draft; nulls are left out."""
    threads = inquiries.select(F.lit("thread_text_redacted").alias("field_name"), F.col("inquiry_id").cast("string").alias("record_id"), F.col("thread_text_redacted").alias("text"))
    drafts = outputs.select(F.lit("response_draft").alias("field_name"), F.col("output_id").cast("string").alias("record_id"), F.col("response_draft").alias("text"))
    return threads.unionByName(drafts).where("text is not null")


def _ascii_skeleton(text: Column, table: Forms) -> Column:
    """``skeleton`` of ASCII text as JVM expressions."""
    looks = {chr(cp): look for cp, look in table.prototypes.items() if cp < 0x80}
    single = {c: look for c, look in looks.items() if len(look) == 1 and look not in looks}
    out = F.translate(text, "".join(single), "".join(single.values()))
    for c, look in looks.items():
        if c not in single:
            out = F.replace(out, F.lit(c), F.lit(look))
    return out


def character_forms(fields: DataFrame) -> DataFrame:
    """Add normal_text, skeleton_id and found to rows with ``text``; rows with equal skeleton_id look the same.

    ASCII texts are their own class form, and get their skeleton in the JVM. Null text gives null results, empty text is its
    own form.
    """
    table = forms(fields.sparkSession)
    shared = fields.sparkSession.sparkContext.broadcast(table.prototypes)

    @F.pandas_udf(T.StructType().add("normal_text", "string").add("skeleton", "string").add("found", T.ArrayType(T.StringType())))
    def both(text: pd.Series) -> pd.DataFrame:
        own = _local(shared)
        rows = [(None, None, None) if t is None else (own.class_form(t)[0], own.skeleton(t), own.differs(t)) for t in text]
        return pd.DataFrame(rows, columns=["normal_text", "skeleton", "found"])

    rows = spread(fields).withColumn("_f", F.when(F.col("text").rlike("[^\\x00-\\x7f]"), both("text")))
    return rows.select(
        *fields.columns,
        F.coalesce("_f.normal_text", "text").alias("normal_text"),
        F.xxhash64(F.coalesce("_f.skeleton", _ascii_skeleton(F.col("text"), table))).alias("skeleton_id"),
        F.when(F.col("text").isNotNull(), F.coalesce("_f.found", F.array().cast("array<string>"))).alias("found"),
    )


_LOCAL: list = []


def _local(shared) -> Forms:
    """The table of a task, made once a worker."""
    if not _LOCAL or _LOCAL[0] is not shared.value:
        _LOCAL[:] = [shared.value, Forms(shared.value)]
    return _LOCAL[1]


def disguised_records(fields: DataFrame) -> DataFrame:
    """(field_name, record_id, found) of the records that differ from the class form of their skeleton.

    The scan drops texts of ordinary characters, which are class forms, inside the JVM; of the others one Arrow pass takes
    class form and skeletons. Repeated rows stay.
    """
    table = forms(fields.sparkSession)
    shared = fields.sparkSession.sparkContext.broadcast(table.prototypes)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(text: pd.Series) -> pd.Series:
        own = _local(shared)
        return text.map(lambda t: [] if t is None else own.differs(t))

    hit = spread(fields.where(F.col("text").rlike(table.suspect()))).withColumn("found", found("text"))
    return hit.where(F.size("found") > 0).select("field_name", "record_id", "found")


def look_alike_groups(fields: DataFrame) -> DataFrame:
    """(field_name, record_id, skeleton_id, n_records, n_texts): each record with the size of its look-alike group.

    One row per record with its class id, never pairs. Sizes are counted from narrow hashes on the map side, so a group that
    holds a third of all rows costs one partial row per task. Only groups of several records meet the rows again in a join;
    there a hot class is dealt over ``SALTS`` keys, its one size row repeated for each.
    """
    rows = cut(character_forms(fields).select("field_name", "record_id", "skeleton_id", F.xxhash64("text").alias("_t")))  # counts and rows both need them
    distinct = rows.groupBy("skeleton_id", "_t").agg(F.count("*").alias("n"))
    sizes = distinct.groupBy("skeleton_id").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_texts")).where("n_records > 1")
    dealt = sizes.withColumn("_salt", F.explode(F.when(F.col("n_records") > HOT_RECORDS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    hot = F.broadcast(sizes.where(F.col("n_records") > HOT_RECORDS).select("skeleton_id", F.lit(True).alias("_hot")))  # at most rows / HOT_RECORDS
    keyed = rows.join(hot, "skeleton_id", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("field_name", "record_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    joined = keyed.join(dealt, ["skeleton_id", "_salt"], "left")
    one = lambda c: F.coalesce(c, F.lit(1).cast("long")).alias(c)
    return joined.select("field_name", "record_id", "skeleton_id", one("n_records"), one("n_texts"))
