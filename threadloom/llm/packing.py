"""Documents packed into containers of fixed token capacity with best-two-fit.

Token counts come from a public tokenizer, one Arrow pass over whole texts. Documents are dealt by hash into shards of
bounded size, independent of any column that could be hot, and each shard packs its own containers: at most the last
container of a shard is poorly filled, so the waste from sharding vanishes with the shard size. Only (id, size) pairs
are shuffled.

Within a shard containers are filled greedily, largest fitting document first; then a container's smallest document is
replaced by two unpacked documents that fit its expanded gap more tightly. A document larger than the capacity is split
into full containers and a remainder, which is packed like any other item.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut, small_side, spread

#: A public byte-level BPE vocabulary, and its pre-tokenization pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents in a shard, about.
SHARD_DOCS = 20_000


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document that has an id; null and empty texts have 0 tokens. Special-token strings are ordinary text.

    The vocabulary file (about 1 MB) is read on the driver and broadcast.
    """
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": pd.Series(n, dtype="int32")})

    return spread(documents.select("doc_id", "text").where("doc_id is not null"), "doc_id").mapInPandas(run, "doc_id long, n_tokens int")


class _Pool:
    """Unpacked items by size. The sizes present are bits of one integer, so the largest one within a bound is a shift away."""

    def __init__(self) -> None:
        self.items: dict[int, list] = defaultdict(list)
        self.mask = 0

    def add(self, size: int, item: object) -> None:
        self.items[size].append(item)
        self.mask |= 1 << size

    def take(self, size: int) -> object:
        item = self.items[size].pop()
        if not self.items[size]:
            self.mask &= ~(1 << size)
        return item

    def largest(self, bound: int) -> int:
        """Largest size present that is no more than ``bound``; 0 if there is none."""
        return max(0, (self.mask & ((1 << (bound + 1)) - 1)).bit_length() - 1) if bound > 0 else 0

    def two(self, bound: int, over: int) -> tuple[int, int] | None:
        """Two items with the largest sum within ``bound``, if it is more than ``over``."""
        best, pair, x = over, None, self.largest(bound - 1)
        while x and 2 * x > best:
            y = self.largest(min(x, bound - x))
            if y == x and len(self.items[x]) < 2:
                y = self.largest(x - 1)
            if y and x + y > best:
                best, pair = x + y, (x, y)
                if best == bound:
                    break
            x = self.largest(x - 1)
        return pair


def best_two_fit(sizes: list[tuple[object, int]], capacity: int) -> list[list[tuple[object, int]]]:
    """Containers as lists of (item, size). Every size is between 1 and ``capacity``."""
    pool = _Pool()
    for item, size in sizes:
        pool.add(size, item)
    bins = []
    while pool.mask:
        gap, held = capacity, []
        while size := pool.largest(gap):
            held.append((pool.take(size), size))
            gap -= size
        while gap and held:
            item, size = held[-1]  # filled from large to small; replacements keep that order below
            pair = pool.two(gap + size, size)
            if pair is None:
                break
            held.pop()
            held += [(pool.take(x), x) for x in pair]
            pool.add(size, item)
            gap += size - sum(pair)
            held.sort(key=lambda h: -h[1])
        bins.append(held)
    return bins


def _pack_shard(capacity: int, docs: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(container, doc_id, piece_no, token_from, token_to), containers numbered from 0."""
    number, rest, empty = 0, [], []
    for doc, n in sorted(docs, reverse=True):
        full, left = divmod(n, capacity)
        for piece in range(full):
            yield number, doc, piece, piece * capacity, (piece + 1) * capacity
            number += 1
        if left:
            rest.append(((doc, full, full * capacity), left))
        elif not full:
            empty.append(doc)
    for held in best_two_fit(rest, capacity):
        for (doc, piece, start), size in held:
            yield number, doc, piece, start, start + size
        number += 1
    for doc in empty:  # nothing to place: any container holds it
        yield 0, doc, 0, 0, 0


def pack_documents(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(limit_id, capacity_tokens, container_id, doc_id, piece_no, token_from, token_to): where each document lies.

    Every document, also a repeated id, is placed once for each limit with a positive capacity; other limits give no rows, nor
    do documents without an id, which nothing could refer to.
    Documents of no tokens lie in a container without using it. Only documents above the capacity have several pieces.
    """
    counts = cut(token_counts(documents, tokenizer))
    n_shards = -(-counts.count() // shard_docs) or 1
    sizes = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int"))
    wanted = limits.where("capacity_tokens > 0").select("limit_id", "capacity_tokens").distinct()
    each = sizes.join(small_side(wanted), on=F.lit(True), how="inner")
    schema = "limit_id int, capacity_tokens int, container_id long, doc_id long, piece_no int, token_from int, token_to int"

    def run(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        limit, capacity, number = int(key[0]), int(key[1]), int(key[2])
        rows = [(limit, capacity, (number << 32) + c, d, p, a, b) for c, d, p, a, b in _pack_shard(capacity, list(zip(shard["doc_id"].tolist(), shard["n_tokens"].tolist())))]
        return pd.DataFrame(rows, columns=["limit_id", "capacity_tokens", "container_id", "doc_id", "piece_no", "token_from", "token_to"])

    return each.groupBy("limit_id", "capacity_tokens", "shard").applyInPandas(run, schema)


def packing_report(packed: DataFrame) -> DataFrame:
    """(limit_id, capacity_tokens, n_containers, n_tokens, n_least, fill): how well the containers are used.

    n_least is the number of full containers that the tokens would need if texts could be cut anywhere: no packing has fewer.
    """
    used = F.col("token_to") - F.col("token_from")
    per = packed.groupBy("limit_id", "capacity_tokens", "container_id").agg(F.sum(used).alias("n"))
    total = per.groupBy("limit_id", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return total.select("*", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("n_least"), F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"))
