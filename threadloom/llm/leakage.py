"""Evaluation texts inside a corpus, found with an FM-index per shard of the corpus.

Each task walks its partition, collects documents to a shard of bounded size, and builds the shard's FM-index over words:
suffix array by prefix doubling, Burrows-Wheeler transform, wavelet tree with constant-time ranks, and suffix positions
sampled every few words. Words that no test item has part phrases as the end of a document does, so stretches between them
that are shorter than a phrase can hold none and are left out of the index. All test phrases (every window of ``MIN_WORDS`` words of every item) are searched backwards at
once, the ranges found are located through the sampled positions, and the located words are merged to removal spans.

The test items are the stated query set: they are sent to every task, each shard is indexed once, and the windows are searched
in blocks of bounded size. The corpus is never shuffled, so no key of it can be hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import spread

MIN_WORDS = 12
#: Indexed words in a shard, windows searched at once, and characters of test items sent to the tasks in one pass over the corpus.
SHARD_WORDS, WINDOW_BLOCK, ITEM_CHARS = 400_000, 200_000, 64_000_000
SAMPLE_EVERY = 16
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Longest runs of letters or digits, each lower-cased; as many, at the same places, as in the text."""
    if "İ" in text or "Σ" in text:  # the letters whose small form depends on more than themselves
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


class _Bits:
    """A bit vector with rank in constant time: packed 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.packed = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)))

    def rank1(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.packed[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class _WaveletTree:
    """Wavelet tree in level order: at each level the symbols are parted by their next bit, zeros first."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros, now = [], [], symbols
        for level in range(self.depth - 1, -1, -1):
            bits = (now >> level) & 1
            self.levels.append(_Bits(bits.astype(np.uint8)))
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate((now[bits == 0], now[bits == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros_like(at), at
        for i, level in enumerate(range(self.depth - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.levels[i].rank1(low), self.levels[i].rank1(high)
            low = np.where(one, self.zeros[i] + a, low - a)
            high = np.where(one, self.zeros[i] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for i in range(self.depth):
            one = self.levels[i].get(at).astype(bool)
            before = self.levels[i].rank1(at)
            at = np.where(one, self.zeros[i] + before, at - before)
            symbol = symbol * 2 + one
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in sorted order, by prefix doubling; a suffix that ends sorts first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step if step < n else 0] += rank[step:] + 1
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location of word patterns in one shard.

    Symbol 0 ends the shard, 1 parts the documents and stands for words of no pattern; neither is in a pattern.
    """

    def __init__(self, text: np.ndarray, sigma: int, sample_every: int = SAMPLE_EVERY) -> None:
        order = suffix_array(text)
        bwt = text[order - 1]  # position -1 wraps around to the last symbol
        self.n = len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.tree = _WaveletTree(bwt, sigma)
        sampled = order % sample_every == 0
        self.marked = _Bits(sampled.astype(np.uint8))
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range [low, high) of suffixes that start with each row of ``patterns``, all rows at once from their last word. Rows
        that no suffix can match any more are left behind."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            symbol = column[alive]
            low[alive] = self.first[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = np.maximum(low[alive], self.first[symbol] + self.tree.rank(symbol, high[alive]))
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back word by word to a sampled one."""
        found, steps, open_ = np.full(len(at), -1, dtype=np.int64), 0, np.arange(len(at))
        at = at.copy()
        while len(open_):
            here = at[open_]
            hit = self.marked.get(here).astype(bool)
            found[open_[hit]] = self.samples[self.marked.rank1(here[hit])] + steps
            open_ = open_[~hit]
            here = at[open_]
            symbol = self.tree.access(here)
            at[open_] = self.first[symbol] + self.tree.rank(symbol, here)
            steps += 1
        return found


class _Windows:
    """Every window of ``width`` words of every item, as positions in the items' words."""

    def __init__(self, items: list[tuple[int, str]], width: int) -> None:
        self.width, self.vocabulary, codes, starts, owners, at = width, {}, [], [], [], 0
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text or "")]
            if len(words) >= width:
                codes += words
                n = len(words) - width + 1
                starts.append(np.arange(at, at + n))
                owners.append(np.full(n, item, dtype=np.int64))
                at += len(words)
        self.codes = np.array(codes, dtype=np.int64)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(patterns, owners) of windows, ``WINDOW_BLOCK`` at a time."""
        for i in range(0, len(self), WINDOW_BLOCK):
            starts = self.starts[i : i + WINDOW_BLOCK]
            yield self.codes[starts[:, None] + np.arange(self.width)], self.owners[i : i + WINDOW_BLOCK]


def _stretches(coded: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The stretches of ``width`` or more words of items, each with a parting word behind it, and where each word stood."""
    parts = np.flatnonzero(coded == 1)
    begins, ends = np.concatenate(([0], parts + 1)), np.concatenate((parts, [len(coded)]))
    long = ends - begins >= width
    if not long.any():
        return None
    where = np.concatenate([np.arange(a, b + 1) for a, b in zip(begins[long], ends[long])])
    return np.append(coded, 1)[where], where


def _search_shard(docs: list[tuple[int, str, np.ndarray]], codes: list[np.ndarray], windows: _Windows) -> pd.DataFrame:
    """(item_id, doc_id, word_from, word_to, char_from, char_to): merged spans of one shard of (id, text, places of its words)."""
    text = np.concatenate([*codes, [0]]).astype(np.int64)
    starts = np.cumsum([0] + [len(c) for c in codes])
    index = FMIndex(text, len(windows.vocabulary) + 2)
    items, at = [], []
    for patterns, owners in windows.blocks():
        low, high = index.search(patterns)
        n = high - low
        items.append(np.repeat(owners, n))
        at.append(index.locate(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)))
    item, position = np.concatenate(items), np.concatenate(at)
    doc = np.searchsorted(starts, position, side="right") - 1
    spans: list[list[int]] = []
    for k in np.lexsort((position, doc, item)):
        own, d = int(item[k]), int(doc[k])
        a = int(docs[d][2][position[k] - starts[d]])
        if spans and spans[-1][0] == own and spans[-1][1] == d and a <= spans[-1][3]:
            spans[-1][3] = max(spans[-1][3], a + windows.width)
        else:
            spans.append([own, d, a, a + windows.width])
    rows, offsets = [], {}
    for own, d, a, b in sorted(spans, key=lambda x: x[1]):
        if d not in offsets:
            offsets = {d: [m.span() for m in _WORD.finditer(docs[d][1])]}
        rows.append((own, docs[d][0], a, b, offsets[d][a][0], offsets[d][b - 1][1]))
    return pd.DataFrame(rows, columns=["item_id", "doc_id", "word_from", "word_to", "char_from", "char_to"])


def _passes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The stated query set in parts of ``ITEM_CHARS`` characters; its bound is the number of test items, not of documents."""
    part, size = [], 0
    for item, text in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        part.append((item, text))
        size += len(text)
        if size >= ITEM_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def leaked_spans(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, doc_id, word_from, word_to, char_from, char_to): each place where a document has ``min_words`` or more
    consecutive words of an item, with the end exclusive; offsets in words and in code points of the stored text.

    Null and empty texts, rows without an id, and items shorter than ``min_words`` give no rows. Rows of ``items`` with a repeated id are searched
    under that id; repeated documents each give their rows.
    """
    corpus = spread(documents.select("doc_id", "text").where("text is not null and doc_id is not null"), "doc_id")
    schema = "item_id long, doc_id long, word_from long, word_to long, char_from long, char_to long"
    sc = documents.sparkSession.sparkContext

    def run_over(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            windows = _Windows(shared.value, min_words)
            if not len(windows):
                return
            vocabulary, docs, codes, size = windows.vocabulary, [], [], 0
            for batch in batches:
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    coded = np.fromiter((vocabulary.get(w, 1) for w in words_of(text)), dtype=np.int64)
                    if (kept := _stretches(coded, min_words)) is not None:
                        docs.append((doc, text, kept[1]))
                        codes.append(kept[0])
                        size += len(kept[0])
                    if size >= SHARD_WORDS:
                        yield _search_shard(docs, codes, windows)
                        docs, codes, size = [], [], 0
            if docs:
                yield _search_shard(docs, codes, windows)

        return run

    parts = [corpus.mapInPandas(run_over(sc.broadcast(part)), schema) for part in _passes(items)]
    return reduce(DataFrame.unionByName, parts) if parts else documents.sparkSession.createDataFrame([], schema)


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct (item_id, doc_id) of ``leaked_spans``."""
    return leaked_spans(documents, items, min_words).select("item_id", "doc_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_items, spans) of each document that leaks: the spans of all items merged, as (char_from, char_to) in order.

    A document's spans are at most as many as its words.
    """
    at = F.struct("char_from", "char_to")
    held = leaked_spans(documents, items, min_words).groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.sort_array(F.collect_set(at)).alias("s"))
    none = F.array().cast("array<struct<char_from:bigint,char_to:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["char_from"].alias("char_from"), F.greatest(last(acc)["char_to"], x["char_to"]).alias("char_to"))))
    merged = F.aggregate("s", none, lambda acc, x: F.when((F.size(acc) > 0) & (x["char_from"] <= F.try_element_at(acc, F.lit(-1))["char_to"]), grown(acc, x)).otherwise(F.concat(acc, F.array(x))))
    return held.select("doc_id", "n_items", merged.alias("spans"))


def removal_counts(spans: DataFrame) -> DataFrame:
    """(doc_id, n_items, n_spans, removed_chars) of ``removal_spans``."""
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["char_to"] - x["char_from"])
    return spans.select("doc_id", "n_items", F.size("spans").cast("long").alias("n_spans"), chars.alias("removed_chars"))
