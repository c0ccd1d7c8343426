"""Near-duplicate records with small edits: Order MinHash candidates, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import shingles as sh
from quillspan.operators.graph import components
from quillspan.session import materialize

SKETCHES = 28
KMERS = 3
HOT_BUCKET = 96
BAND = 24
#: Ids of candidate texts that are sent to every executor to pick the texts before they are shuffled: 16 MB.
BROADCAST_IDS = 2_000_000
#: Bytes of text a Python worker takes at once: its arrays have some ten times as much.
SLICE_BYTES = 4_000_000


def _slices(batch: pa.RecordBatch, texts: list[int], rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and ``SLICE_BYTES`` in its columns ``texts``; a row of more is a part of its own."""
    ends = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts))
    at = 0
    while at < batch.num_rows:
        room = (ends[at - 1] if at else 0) + SLICE_BYTES
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, room, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def _sketch(df: DataFrame, id_col: str, content_col: str, k: int, sketches: int, kmers: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, [1], 4000):
                ids, texts = part.columns
                words, offsets = sh.word_hashes(texts)
                h, to = sh.shingle_hashes(words, offsets, k)
                n = np.diff(to)
                some = n > 0
                own = np.concatenate([[0], np.cumsum(n[some])]).astype(np.int64)
                k1, k2, d = (np.zeros(len(n), x) for x in (np.uint64, np.uint64, np.int64))
                sk = np.zeros((0, sketches), np.uint64)
                size = np.where(some, sketches, 0)
                if some.any():
                    k1[some], k2[some] = sh.sequence_keys(h, own)
                    labelled, d[some] = sh.occurrence_labelled(h, own)
                    sk = sh.order_minhash(labelled, own, sketches, kmers)
                    again = n[some] > d[some]
                    if again.any():  # repeated runs: texts are compared as sets, so sketches of the first occurrences are added
                        first, to_first = sh.first_occurrences(h, own)
                        keep = np.repeat(again, np.diff(to_first))
                        more = sh.order_minhash(first[keep], np.concatenate([[0], np.cumsum(d[some][again])]).astype(np.int64), sketches, kmers)
                        sk = np.insert(sk, np.flatnonzero(again) + 1, more, axis=0)
                        size[np.flatnonzero(some)[again]] = 2 * sketches
                if not some.all():  # too short for a run of k words: only the content as it is can be equal
                    raw = texts.filter(pa.array(~some))
                    k1[~some] = pd.util.hash_array(np.asarray(raw.to_pandas(), dtype=object), categorize=False)
                    k2[~some] = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.uint64)
                lists = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                arrays = [
                    ids, pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(d),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(sk.ravel().view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "k1", "k2", "n", "sk"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(run, "id long, k1 long, k2 long, n long, sk array<long>")


def banded_matches(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, band: int = BAND) -> np.ndarray:
    """Length of the longest common subsequence within a band around the diagonal, of many pairs at
    once. a, b: (pairs, length) of hashes, of which the first la / lb of a row count."""
    width = 2 * band + 1
    steps = int(la.max(initial=0))
    right = np.zeros((len(b), max(steps, b.shape[1]) + width), np.uint64)
    valid = np.zeros(right.shape, bool)
    right[:, band : band + b.shape[1]] = b
    valid[:, band : band + b.shape[1]] = np.arange(b.shape[1]) < lb[:, None]
    cur = np.zeros((len(a), width), np.int32)
    for i in range(steps):
        same = (right[:, i : i + width] == a[:, i : i + 1]) & valid[:, i : i + width] & (i < la)[:, None]
        nxt = cur + same
        np.maximum(nxt[:, :-1], cur[:, 1:], out=nxt[:, :-1])
        cur = np.maximum.accumulate(nxt, axis=1)
    return cur.max(axis=1) if len(a) else np.zeros(0, np.int32)


def _padded(h: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offsets)[rows]
    out = np.zeros((len(rows), int(n.max(initial=0))), np.uint64)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(rows)), n), at] = h[np.repeat(offsets[rows], n) + at]
    return out, n


def band_matches_of(a: list[int], b: list[int], band: int) -> int:
    """The same for one pair: bit-parallel, a whole row of the table at a time."""
    where: dict[int, int] = {}
    bit = 1
    for x in b:
        where[x] = where.get(x, 0) | bit
        bit <<= 1
    full = bit - 1
    window = (1 << (2 * band + 1)) - 1
    v = full
    get = where.get
    for i, x in enumerate(a):
        m = get(x)
        if m:
            u = v & m & (window << (i - band) if i >= band else window >> (band - i))
            if u:
                v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


LONG = 4000


def similar(left: pa.Array, right: pa.Array, k: int, threshold: float, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """(whether the sets of runs of k words of each pair of texts have an intersection of at least
    ``threshold`` of their union, matched runs of the banded alignment).

    Aligned runs, less the repeated ones, bound the intersection from below; a pair this bound settles
    is taken, any other (moved blocks, long insertions) is decided on the sets themselves."""
    (ha, oa), (hb, ob) = (sh.shingle_hashes(*sh.word_hashes(x), k) for x in (left, right))
    na, nb = np.diff(oa), np.diff(ob)
    matched = np.zeros(len(na), np.int64)
    good = np.zeros(len(na), bool)
    wide = np.flatnonzero(np.minimum(na, nb) > LONG)
    for i in wide:
        a, la = _padded(ha, oa, np.array([i]))
        b, lb = _padded(hb, ob, np.array([i]))
        matched[i] = banded_matches(a, b, la, lb, band)[0]
    la, lb = ha.tolist(), hb.tolist()
    for i in range(len(na)):
        x, y = la[oa[i] : oa[i + 1]], lb[ob[i] : ob[i + 1]]
        sx, sy = set(x), set(y)
        if na[i] <= LONG or nb[i] <= LONG:
            matched[i] = band_matches_of(x, y, band)
        least = matched[i] - max(len(x) - len(sx), len(y) - len(sy))
        total = len(sx) + len(sy)
        good[i] = least > 0 and least >= threshold * (total - least) - 1e-9
        if not good[i]:
            both = len(sx & sy)
            good[i] = both > 0 and both >= threshold * (total - both) - 1e-9
    return good, matched


def _runs(texts: DataFrame, k: int) -> DataFrame:
    """(id, k1, k2, h) of each text (id, text) with runs of k words: its key and the set of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, [1], 1000):
                ids, body = part.columns
                h, to = sh.shingle_hashes(*sh.word_hashes(body), k)
                some = np.diff(to) > 0
                own = np.concatenate([[0], np.cumsum(np.diff(to)[some])]).astype(np.int64)
                k1 = k2 = first = np.zeros(0, np.uint64)
                if some.any():
                    k1, k2 = sh.sequence_keys(h, own)
                    first, own = sh.first_occurrences(h, own)
                sets = pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(first.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(some)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), sets], ["id", "k1", "k2", "h"])

    return texts.select("id", "text").mapInArrow(run, "id long, k1 long, k2 long, h array<long>")


def prefix_pairs(runs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of ``runs`` (id, k1, k2, h) with every pair whose sets reach the threshold, by a prefix filter.

    The runs of each text are put in order of how many texts have them, the rarest first. Of two sets at the
    threshold the first n - ceil(threshold * n) + 1 runs have one in common, and from the first they share on
    enough are left of both; numbers of runs too far apart can't reach it."""
    runs = materialize(runs.withColumn("n", F.size("h")), "near-runs")
    each = runs.select("id", "k1", "k2", "n", F.explode("h").alias("key"))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    sets = each.join(common, "key").groupBy("id", "k1", "k2", "n").agg(F.array_sort(F.collect_set(F.struct("c", "key"))).alias("s"))
    first = F.slice("s", F.lit(1), F.col("n") - F.ceil(threshold * F.col("n") - 1e-6).cast("int") + 1)
    rows = sets.select("id", "n", F.posexplode(first).alias("at", "e")).filter("e.c > 1").select("id", "n", "at", F.col("e.key").alias("key"))
    rows = materialize(rows, "near-prefixes")
    a, b = (rows.select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}"), (F.col("n") - F.col("at")).alias(f"left_{x}")) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-6)
    enough = F.least("left_a", "left_b") >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6
    return a.join(b, "key").filter(near & enough).select("a", "b").distinct()


def candidate_pairs(texts: DataFrame, threshold: float, runs: Callable[[DataFrame], DataFrame], hot: int = HOT_BUCKET) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``texts`` (id, n, sk) that share a sketch and could reach the
    threshold by their numbers of runs.

    Sketches only one text has are dropped by a join with the counts of the others, which splits a key that
    holds many rows where a window would keep it in one task. The texts of buckets of more than ``hot`` texts
    don't meet there but in an exact join of their sets of runs (``runs`` gives those of a table of ids), so
    that no pair of a crowded bucket is lost."""
    buckets = texts.select("id", "n", F.explode(F.array_distinct("sk")).alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    hits = materialize(buckets.join(shared, "key"), "near-hits")
    few = hits.filter(F.col("c") <= hot)
    a = few.select("key", F.col("id").alias("a"), F.col("n").alias("na"))
    b = few.select("key", F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
    out = pairs.select("a", "b")
    crowded = hits.filter(F.col("c") > hot)
    if not crowded.isEmpty():
        out = out.unionByName(prefix_pairs(runs(materialize(crowded.select("id").distinct(), "near-crowded")), threshold))
    return out.distinct()


def _verify(both: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, aligned) of the pairs (a, b, ta, tb) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in _slices(batch, [2, 3], 2000):
                good, matched = similar(p.column(2), p.column(3), k, threshold)
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([p.column(0).filter(keep), p.column(1).filter(keep), pa.array(matched[good])], ["a", "b", "aligned"])

    return both.mapInArrow(run, "a long, b long, aligned long")


class NearDuplicates:
    """Near-duplicate search over (id, content).

    Texts are compared as sets of runs of ``k`` words (words are separated by white space); ids whose
    texts have the same sequence of words form one class, of which one member is compared with others.
    Texts of fewer than k words have no runs and are alike only if their contents are equal. Rows with a
    null id or content take no part; repeated rows count once; an id with two contents takes part with
    both; an empty table gives no pairs; other columns are ignored.

    Results: ``links`` pairs (a, b) of class representatives, ``members`` (id, rep) for every id."""

    def __init__(self, df: DataFrame, id_col: str = "id", content_col: str = "content", k: int = 5, threshold: float = 0.8, sketches: int = SKETCHES, kmers: int = KMERS, hot: int = HOT_BUCKET) -> None:
        sketched = materialize(_sketch(df, id_col, content_col, k, sketches, kmers), "near-sketch")
        keys = ["k1", "k2", "n"]
        reps = sketched.filter("n > 0").groupBy(*keys).agg(F.min(F.struct("id", "sk")).alias("m")).select(F.col("m.id").alias("id"), "n", F.col("m.sk").alias("sk"))
        least = sketched.groupBy(*keys).agg(F.min("id").alias("rep"))
        self.members = sketched.select("id", *keys).join(least, keys).select("id", "rep").distinct()
        body = df.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("text")).filter("id is not null and text is not null")

        def texts_of(ids: DataFrame) -> DataFrame:
            if ids.count() <= BROADCAST_IDS:  # else the texts are shuffled to the ids
                ids = F.broadcast(ids)
            return body.join(ids, "id", "left_semi")

        found = materialize(candidate_pairs(reps, threshold, lambda ids: _runs(texts_of(ids), k), hot), "near-candidates")
        wanted = materialize(found.select(F.col("a").alias("id")).union(found.select(F.col("b"))).distinct(), "near-wanted")
        chosen = texts_of(wanted)
        left, right = (chosen.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        self.links = _verify(found.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), k, threshold)

    def pairs(self) -> DataFrame:
        """All pairs (a, b), a < b, of different ids: links expanded to the members of both classes,
        and the pairs within a class."""
        m = materialize(self.members, "near-members")
        crowd = m.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("rep")
        links = materialize(self.links.select("a", "b").distinct(), "near-links")
        ma, mb = m.select(F.col("rep").alias("a"), F.col("id").alias("ia")), m.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
        across = links.join(ma, "a").join(mb, "b").select("ia", "ib")
        group = m.join(crowd, "rep", "left_semi")
        within = group.select("rep", F.col("id").alias("ia")).join(group.select("rep", F.col("id").alias("ib")), "rep").filter("ia < ib")
        out = across.union(within.select("ia", "ib")).filter("ia <> ib")
        return out.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()

    def groups(self) -> DataFrame:
        """(id, group, links) of every id: the least id of its connected group, and how many links its class
        has to other classes; a text like no other is a group of its own."""
        links = materialize(self.links.select("a", "b").distinct(), "near-links")
        whole = components(links)
        degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        m = self.members.join(whole.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
        return m.select("id", F.coalesce("component", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
