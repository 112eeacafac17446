"""Long exact spans shared between records, by sliding runs of sentences.

A text is cut into sentences and clauses; each run of consecutive ones that reaches ``RUN_CHARS`` is hashed, and the hashes
are joined over the whole corpus. Matching runs of a pair of texts on one diagonal are merged to islands, which are equal
character by character, and an island shorter than the wanted span is extended into the clauses cut at its ends.

No span is missed: clauses have at most ``CLAUSE_CHARS`` characters and break at equal places in equal text, so both texts have
a boundary within the first 60 characters of a shared span of 300, and the run from there ends within 160 + 60 more, before
the last 20, where the texts around the span could make a difference.

Pairs are made where pairs are asked for. What a document shares with any other, first and later occurrences and the share of
the text they cover come from windows instead: those around shared runs are hashed and grouped, and each document is marked by
its own, so that a passage in very many documents costs no pairs.

Exact copies are one class with one representative before anything is joined; what is found for representatives holds for
all members. Classes and runs come from one pass over the texts, whose narrow rows are written once; texts are read again only
where a span's ends have to be looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import cut, small_side, spread, written

MIN_CHARS = 300
RUN_CHARS = 160
#: Longest clause; twice this and RUN_CHARS stay below MIN_CHARS.
CLAUSE_CHARS = 60
#: Classes of exact copies up to this size are written out as pairs; of larger ones, pairs hold the representative and
#: ``copy_classes`` holds the members.
EXPAND_COPIES = 64
_END = re.compile(r"[.!?…;,:\n]+[\s)\]\"'”’]*")
_GAP = re.compile(r"\s+")
#: Masks of the word keys, step by step.
_STEPS = (7, 3, 1, 0)


def clauses(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and clauses of a text, without gaps, none longer than ``CLAUSE_CHARS``.

    Longer ones are broken step by step, and only as far as needed: after words whose letters give a multiple of 8, of 4, of
    2, after any word, after characters with a multiple of 8, after any character. Every step looks at the text alone, so
    equal stretches of two texts break at equal places but for the clauses at their ends.
    """
    out: list[tuple[int, int]] = []

    def refine(a: int, b: int, level: int, stops: list[int], keys: list[int]) -> None:
        if b - a <= CLAUSE_CHARS:
            out.append((a, b))
            return
        if level < len(_STEPS):
            cuts = [stops[i] for i in range(bisect_right(stops, a), bisect_left(stops, b)) if not keys[i] & _STEPS[level]]
        else:
            cuts = [p for p in range(a + 1, b) if level > len(_STEPS) or not ord(text[p - 1]) & 7]
        for p in (*cuts, b):
            refine(a, p, level + 1, stops, keys)
            a = p

    at = 0
    for m in [*_END.finditer(text), None]:
        end = len(text) if m is None else m.end()
        if end - at > CLAUSE_CHARS:
            stops, keys, start = [], [], at
            for g in _GAP.finditer(text, at, end):
                stop = g.start()
                if stop > start:
                    stops.append(g.end())
                    keys.append(ord(text[start]) + 3 * ord(text[stop - 1]) + 5 * (stop - start))
                start = g.end()
            refine(at, end, 0, stops, keys)
        elif end > at:
            out.append((at, end))
        at = max(at, end)
    return out


def sentence_runs(text: str, run_chars: int = RUN_CHARS) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the shortest run of consecutive clauses from each clause on that reaches ``run_chars``."""
    parts, out, j = clauses(text), [], 0
    for start, _ in parts:
        while j < len(parts) and parts[j][1] - start < run_chars:
            j += 1
        if j == len(parts):
            break
        end = parts[j][1]
        out.append((xxhash.xxh3_64_intdigest(text[start:end]) - (1 << 63), start, end))
    return out


class Scanned(NamedTuple):
    classes: DataFrame  #: (doc_id, class_id, n_copies, n_chars) of every document with a text
    runs: DataFrame  #: (h, doc_id, k, a, b), the k-th run of a text, of the first document of each class


def scan(documents: DataFrame, min_chars: int = MIN_CHARS) -> Scanned:
    """Classes of exact copies, and the runs of their first members, in one pass over the texts. An id names one text; rows without an id belong to
    no class and share nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"]):
                digest = blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                rows.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), d, -1, -1, len(t)))
                if len(t) >= min_chars:
                    rows += [(h, None, d, k, a, b) for k, (h, a, b) in enumerate(sentence_runs(t))]
            found = pd.DataFrame(rows, columns=["h", "h2", "doc_id", "k", "a", "b"])
            yield found.astype({"h": "int64", "h2": "Int64", "doc_id": "int64", "k": "int32", "a": "int32", "b": "int32"})

    texts = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"), "doc_id")
    scanned = texts.mapInPandas(run, "h long, h2 long, doc_id long, k int, a int, b int")
    rows = written(scanned.withColumn("is_text", F.col("a") < 0), "is_text")
    keyed = rows.where("is_text").select("h", "h2", "doc_id", F.col("b").alias("n_chars"))
    # digests are combined on the map side; members get their class by a join on the digest
    sizes = keyed.groupBy("h", "h2").agg(F.min("doc_id").alias("class_id"), F.count_distinct("doc_id").alias("n_copies"))
    copied = sizes.where("n_copies > 1")
    members = cut(keyed.distinct().join(small_side(copied), ["h", "h2"], "left"))
    classes = members.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), "n_chars")
    later = small_side(classes.where("doc_id > class_id").select("doc_id"))  # few in most corpora
    return Scanned(classes, rows.where("not is_text").drop("h2", "is_text").join(later, "doc_id", "left_anti"))


def copy_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_copies): class_id is the smallest id with exactly the same text. Null texts belong to no class.

    Only ids and digests are shuffled; the grouping is combined on the map side.
    """
    return scan(documents).classes.select("doc_id", "class_id", "n_copies")


@F.pandas_udf(T.StructType().add("before", "integer").add("after", "integer"))
def _extend(left_a: pd.Series, left_b: pd.Series, right_a: pd.Series, right_b: pd.Series) -> pd.DataFrame:
    """Characters by which two equal spans go on equally before and after."""

    def common(x: str, y: str) -> int:
        n = 0
        for c, d in zip(x, y):
            if c != d:
                break
            n += 1
        return n

    return pd.DataFrame({"before": [common(x[::-1], y[::-1]) for x, y in zip(left_a, left_b)], "after": [common(x, y) for x, y in zip(right_a, right_b)]}, dtype="int32")


def shared_chains(scanned: Scanned) -> DataFrame:
    """(doc_id, h, a, b): the runs that several texts hold, with those that always follow each other joined to one chain.

    If every text that holds a run goes on with the same next one, and every text that holds that one comes from the first,
    a pair of texts that matches in one matches in both, at the same distance. So only the first run of a chain, h, has to
    meet in a join of pairs: a passage in n texts gives its pairs once, not once for each of its runs.
    """
    # a run of one text only can't match: sieve before anything else, by a count combined on the map side
    held = scanned.runs.groupBy("h").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo < _hi").select("h")
    shared = scanned.runs.join(held, "h", "left_semi").distinct()
    order = Window.partitionBy("doc_id").orderBy("k")  # a text's runs are no more than its clauses
    beside = lambda f, step: F.when(f("k").over(order) == F.col("k") + step, f("h").over(order))
    placed = cut(shared.withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1)}))
    only = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    ways = placed.groupBy("h").agg(only("before").alias("_b"), F.min("before").alias("before"), only("after").alias("_a"), F.min("after").alias("after"))
    led, leads = ways.where("_b").select("h", "before"), ways.where("_a").select(F.col("h").alias("before"), F.col("after").alias("h"))
    follows = led.join(leads, ["h", "before"]).select("h", F.lit(True).alias("_follows"))
    chained = placed.join(follows, "h", "left").withColumn("_chain", F.count_if(F.col("_follows").isNull()).over(order))
    return chained.groupBy("doc_id", "_chain").agg(F.max(F.when(F.col("_follows").isNull(), F.col("h"))).alias("h"), F.min("a").alias("a"), F.max("b").alias("b")).drop("_chain")


def shared_spans(documents: DataFrame, scanned: Scanned, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id_a, doc_id_b, from_a, from_b, n_chars): maximal equal spans of at least ``min_chars`` between distinct texts.

    Each distinct text stands for its copies; a row stored twice changes nothing. Offsets are code points. Texts shorter than
    ``min_chars`` share nothing.
    """
    x, y = (c := cut(shared_chains(scanned))).alias("x"), c.alias("y")
    matched = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select(
        F.col("x.doc_id").alias("doc_id_a"), F.col("y.doc_id").alias("doc_id_b"), F.col("x.a").alias("a"), F.col("x.b").alias("b"), (F.col("y.a") - F.col("x.a")).alias("shift")
    )
    diagonal = Window.partitionBy("doc_id_a", "doc_id_b", "shift").orderBy("a", "b")
    reached = F.max("b").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        matched.withColumn("_new", F.when(F.col("a") <= reached, 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(diagonal))
        .groupBy("doc_id_a", "doc_id_b", "shift", "_island")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
    )
    spans = cut(islands.withColumn("n", F.col("b") - F.col("a")))
    # only texts with an island are looked at again
    ids = spans.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("doc_id")).distinct()
    texts = documents.select("doc_id", "text").where("text is not null")
    near = texts.join(small_side(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    around = lambda side: [
        F.expr(f"substring(text, greatest(1, p - {min_chars} + 1), least({min_chars}, p))").alias(f"left_{side}"),
        F.expr(f"substring(text, p + n + 1, {min_chars})").alias(f"right_{side}"),
    ]
    with_a = spans.withColumn("p", F.col("a")).join(near.withColumnRenamed("doc_id", "doc_id_a"), "doc_id_a").select(*spans.columns, *around("a"))
    with_b = with_a.withColumn("p", F.col("a") + F.col("shift")).join(near.withColumnRenamed("doc_id", "doc_id_b"), "doc_id_b")
    wide = with_b.select(*spans.columns, "left_a", "right_a", *around("b")).withColumn("_e", _extend("left_a", "left_b", "right_a", "right_b"))
    # an extension stops at min_chars, which is enough to decide; spans that meet there stay separate rows
    n = F.col("n") + F.col("_e.before") + F.col("_e.after")
    return wide.where(n >= min_chars).select("doc_id_a", "doc_id_b", (F.col("a") - F.col("_e.before")).alias("from_a"), (F.col("a") + F.col("shift") - F.col("_e.before")).alias("from_b"), n.alias("n_chars"))


def span_pairs(documents: DataFrame, min_chars: int = MIN_CHARS, expand_copies: int = EXPAND_COPIES) -> DataFrame:
    """Distinct (doc_id_a, doc_id_b), a < b, of documents that share a span of at least ``min_chars``.

    Links between different texts are complete. Exact copies stand for each other: classes of up to ``expand_copies``
    members are written out, of a larger class its representative stands in the links and is linked with each member, so
    that the rows stay in proportion to the documents; ``copy_classes`` gives the membership for the rest.
    """
    scanned = scan(documents, min_chars)
    links = shared_spans(documents, scanned, min_chars).select("doc_id_a", "doc_id_b").distinct()
    members = scanned.classes.where((F.col("n_copies") > 1) & (F.col("n_chars") >= min_chars)).select("class_id", F.col("doc_id").alias("member"), "n_copies")
    small = members.where(F.col("n_copies") <= expand_copies).select("class_id", "member")
    for side in ("doc_id_a", "doc_id_b"):
        joined = links.join(small.withColumnRenamed("class_id", side), side, "left")
        links = joined.withColumn(side, F.coalesce("member", side)).drop("member")
    inside = small.alias("x").join(small.alias("y"), "class_id").where("x.member < y.member").select(F.col("x.member").alias("doc_id_a"), F.col("y.member").alias("doc_id_b"))
    stars = members.where((F.col("n_copies") > expand_copies) & (F.col("class_id") < F.col("member"))).select(F.col("class_id").alias("doc_id_a"), F.col("member").alias("doc_id_b"))
    both = links.unionByName(inside).unionByName(stars)
    return both.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b")).distinct()


def _shared_windows(documents: DataFrame, scanned: Scanned, min_chars: int) -> DataFrame:
    """(doc_id, s, later, n_holders): where a window of ``min_chars`` characters starts that another text holds too.

    later: a text of smaller id holds it; n_holders: how many distinct texts do. No pairs are made, so a passage that many
    texts hold costs its length in each of them. A shared window has a shared run that starts in its first ``CLAUSE_CHARS``
    characters, so only windows before one are hashed; each distinct text stands for its copies.
    """
    held = scanned.runs.groupBy("h").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo < _hi").select("h")
    # run starts of one text: no more than its clauses
    starts = cut(scanned.runs.join(held, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("a").alias("starts")))
    texts = documents.select("doc_id", "text").where("text is not null")
    near = texts.join(small_side(starts.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).join(starts, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, t, begins in zip(batch["doc_id"], batch["text"], batch["starts"]):
                at, done = [], -1
                for a in sorted(begins):
                    at += range(max(a - CLAUSE_CHARS + 1, done + 1, 0), min(a, len(t) - min_chars) + 1)
                    done = max(a, done)
                hashes = [xxhash.xxh3_128_digest(t[s : s + min_chars]) for s in at]
                if not at:
                    continue
                two = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
                once = np.zeros(len(at), dtype="int32")  # a window that a text holds twice counts as one of its
                once[list({x: i for i, x in enumerate(hashes)}.values())] = 1
                yield pd.DataFrame({"h": two[:, 0], "h2": two[:, 1], "doc_id": np.int64(d), "s": np.array(at, dtype="int32"), "once": once})

    windows = written(near.mapInPandas(run, "h long, h2 long, doc_id long, s int, once int"))
    several = windows.groupBy("h", "h2").agg(F.min("doc_id").alias("_lo"), F.sum("once").alias("n_holders")).where("n_holders > 1")
    return windows.join(several, ["h", "h2"]).select("doc_id", "s", (F.col("_lo") < F.col("doc_id")).alias("later"), "n_holders")


def document_spans(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (doc_id, from_char, to_char, is_first): the stretches of a document that other texts hold too, in code points.

    Every character of a stretch lies in ``min_chars`` or more that one other text holds as they are. is_first is false where a
    text of smaller id does. A text with exact copies is a span as a whole in each of them; its inner spans stand with the
    first copy only, so that the rows stay in proportion to the documents.
    """
    scanned = scan(documents, min_chars)
    windows = _shared_windows(documents, scanned, min_chars)
    # windows that start one after the other are one stretch; a text's windows are no more than its characters
    order = Window.partitionBy("doc_id", "later").orderBy("s")
    ranked = windows.select("doc_id", "later", "s").withColumn("_run", F.col("s") - F.row_number().over(order))
    inner = ranked.groupBy("doc_id", "later", "_run").agg(F.min("s").alias("a"), (F.max("s") + min_chars).alias("b")).drop("_run")
    long = scanned.classes.where((F.col("n_copies") > 1) & (F.col("n_chars") >= min_chars))
    whole = long.select("doc_id", (F.col("doc_id") != F.col("class_id")).alias("later"), F.lit(0).alias("a"), F.col("n_chars").alias("b"))
    spans = inner.unionByName(whole).groupBy("doc_id", "a", "b").agg(F.max("later").alias("later"))
    return spans.select("doc_id", F.col("a").alias("from_char"), F.col("b").alias("to_char"), (~F.col("later")).alias("is_first"))


def without_repeats(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_removed, clean_text) of every stored document: its text without the spans that an earlier text holds too.

    n_removed is ``repeated_chars`` of ``shared_share``. The first occurrence of a span stays; null texts stay null.
    """
    later = cut(document_spans(documents, min_chars).where("not is_first").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("from_char", "to_char"))).alias("_later")))
    kept = F.expr(
        "aggregate(_later, struct('' AS out, 0 AS at), (acc, s) -> struct(concat(acc.out, substring(text, acc.at + 1, greatest(0, s.from_char - acc.at))) AS out, greatest(acc.at, s.to_char) AS at),"
        " acc -> concat(acc.out, substring(text, acc.at + 1)))"
    )
    joined = spread(documents.select("doc_id", "text"), "doc_id").join(small_side(later), "doc_id", "left")
    clean = joined.select("doc_id", "text", F.when(F.col("_later").isNull(), F.col("text")).otherwise(kept).alias("clean_text"))
    return clean.select("doc_id", F.coalesce(F.length("text") - F.length("clean_text"), F.lit(0)).alias("n_removed"), "clean_text")


def shared_share(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, class_id, n_copies, n_holders, shared_chars, repeated_chars) of every document.

    n_holders is the largest number of distinct texts that hold one of its spans, itself included, 0 without any; shared_chars
    are covered by spans shared with any other text (all of them where the document has a copy of at least ``min_chars``),
    repeated_chars by spans that an earlier text (smaller id) holds too: what removing every non-first occurrence would take.
    Null and empty texts share nothing. An id names one text: rows stored twice count once.
    """
    scanned = scan(documents, min_chars)
    windows = _shared_windows(documents, scanned, min_chars)

    def covered(which: str):
        """Characters under windows in order of their starts: what the window before doesn't hold."""
        last = lambda acc, s: F.struct((acc["n"] + F.least(F.lit(min_chars), s - acc["s"])).alias("n"), s.alias("s"))
        return F.aggregate(F.array_sort(which), F.struct(F.lit(0).alias("n"), F.lit(-min_chars).alias("s")), last, lambda acc: acc["n"])

    # a text's windows are no more than its characters
    each = windows.groupBy("doc_id").agg(F.max("n_holders").alias("n_holders"), F.collect_list("s").alias("_all"), F.collect_list(F.when(F.col("later"), F.col("s"))).alias("_later"))
    per = each.select("doc_id", "n_holders", covered("_all").alias("shared"), covered("_later").alias("repeated"))
    textless = documents.where("text is null or doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("n_copies"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    rows = scanned.classes.unionByName(textless).distinct().join(per.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
    copied = (F.col("n_copies") > 1) & (F.col("n_chars") >= min_chars)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "doc_id", "n_chars", "class_id", "n_copies", zero("n_holders").alias("n_holders"),
        F.when(copied, F.col("n_chars")).otherwise(zero("shared")).alias("shared_chars"),
        F.when(copied & (F.col("doc_id") != F.col("class_id")), F.col("n_chars")).otherwise(zero("repeated")).alias("repeated_chars"),
    )
