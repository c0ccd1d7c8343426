"""Encoding of a corpus with a public byte-level BPE vocabulary.

Each pre-token is merged with a rank queue held in a hierarchical bitmap: a bucket per merge rank
holds positions of a linked list of symbols, find-first-set picks the lowest rank that has any, and
entries that no longer hold are skipped. The cost is linear in the symbols but for the sorting of
buckets, so a pre-token of megabytes is no problem.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE_ENTRIES = 200_000
CACHED_CHARS = 48


class RankQueue:
    """Ranks 0..n-1, each with a bucket of positions; three levels of 64-bit words find the lowest."""

    def __init__(self, n: int) -> None:
        leaves = (n + 63) >> 6
        self.leaf = [0] * leaves
        self.mid = [0] * ((leaves + 63) >> 6)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.bucket.get(rank)
        if held is not None:
            held.append(position)
            return
        self.bucket[rank] = [position]
        w = rank >> 6
        self.leaf[w] |= 1 << (rank & 63)
        self.mid[w >> 6] |= 1 << (w & 63)
        self.top |= 1 << (w >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with its positions in text order; None when the queue is empty."""
        top = self.top
        if not top:
            return None
        t = (top & -top).bit_length() - 1
        mid = self.mid[t]
        w = (t << 6) | ((mid & -mid).bit_length() - 1)
        leaf = self.leaf[w]
        rank = (w << 6) | ((leaf & -leaf).bit_length() - 1)
        leaf &= leaf - 1
        self.leaf[w] = leaf
        if not leaf:
            mid &= mid - 1
            self.mid[t] = mid
            if not mid:
                self.top = top & (top - 1)
        held = self.bucket.pop(rank)
        held.sort()
        return rank, held


class BytePairEncoder:
    def __init__(self, path: str = BYTE_BPE_50K, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.first = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.queue = RankQueue(self.size)

    def _rank(self, left: int, right: int) -> int:
        key = left * self.size + right
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            r = self.pairs[key] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return r

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        first, rank_of, queue = self.first, self._rank, self.queue
        ids = [first[b] for b in data]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        held = [-1] * n  # rank of the pair that begins at a position; an entry of another rank is stale
        for i in range(n - 1):
            r = rank_of(ids[i], ids[i + 1])
            if r >= 0:
                held[i] = r
                queue.push(r, i)
        while (got := queue.pop()) is not None:
            rank, positions = got
            for i in positions:
                if held[i] != rank:
                    continue
                j = after[i]
                k = after[j]
                ids[i] = rank
                ids[j] = -1
                held[j] = -1
                after[i] = k
                if k < n:
                    before[k] = i
                    r = rank_of(rank, ids[k])
                    held[i] = r
                    if r >= 0:
                        queue.push(r, i)
                else:
                    held[i] = -1
                h = before[i]
                if h >= 0:
                    r = rank_of(ids[h], rank)
                    if r != held[h]:
                        held[h] = r
                        if r >= 0:
                            queue.push(r, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens, whose strings are ordinary text; none for null and empty."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode("utf-8", "replace")))
                if len(piece) <= CACHED_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)
        return out


@lru_cache(maxsize=4)
def encoder(path: str = BYTE_BPE_50K) -> BytePairEncoder:
    """The encoder of a vocabulary file, loaded once per Python process."""
    return BytePairEncoder(path)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(id_col, ids array<int>) of every row, in any order; rows are kept as they come.

    A null and an empty text have an empty list, a blank text the ids of its blanks; a null id stays
    null; repeated rows are repeated; texts of any length are encoded whole; an empty table gives an
    empty result; other columns are ignored. ``path`` must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", path: str = BYTE_BPE_50K, name: str = "n_tokens") -> DataFrame:
    """``keep`` columns and the number of tokens of each text (0 for null and empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            n = pa.array([len(bpe.encode(t)) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], [*keep, name])

    rows = df.select(F.col(text_col).alias("_text_"), *(F.col(f"`{c}`") for c in keep))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[1:]), f"`{name}` long"])
    return rows.mapInArrow(run, schema)
