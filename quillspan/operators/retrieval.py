"""Ranked retrieval: BM25 over postings, exact and inverted-file vector search, sparse search, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.sampling import bounded_sample
from quillspan.session import materialize

K1, B = 1.2, 0.75
WORD = r"[^\p{L}\p{N}]+"

#: Weights of keyword, semantic, symbol and sparse lists by type of query, and their
#: multipliers by intent.
LIST_WEIGHTS = {"symbol": (0.8, 0.5, 1.5, 0.6), "keyword": (1.0, 1.0, 1.0, 1.0), "natural_language": (0.6, 1.3, 0.8, 0.8), "mixed": (0.9, 1.1, 1.2, 0.9)}
INTENT_WEIGHTS = {
    "debug": (1.2, 0.9, 1.2), "edit": (1.2, 0.9, 1.2), "explain": (0.8, 1.3, 0.9), "data_flow": (0.8, 1.3, 0.9),
    "dependency": (0.7, 0.8, 1.5), "refactor": (1.0, 1.2, 1.1), "test_coverage": (1.3, 0.8, 1.0),
}
RRF_K = 60


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), WORD), lambda w: w != "")


def _weighted(field: str, weight: float) -> Column:
    """(t, x) of every word of a field; the inner function takes one argument, a second would be the index."""
    return F.transform(F.coalesce(words(F.col(field)), F.array().cast("array<string>")), lambda w: F.struct(w.alias("t"), F.lit(weight).alias("x")))


def postings(docs: DataFrame, id_col: str, fields: dict[str, float]) -> DataFrame:
    """(id, len, term, tf): weighted term frequencies of the fields and the length of each document in words."""
    every = F.concat(*(F.coalesce(words(F.col(f)), F.array().cast("array<string>")) for f in fields))
    t = docs.select(F.col(id_col).alias("id"), F.size(every).alias("len"), F.explode(F.concat(*(_weighted(f, x) for f, x in fields.items()))).alias("e"))
    return t.groupBy("id", "len", F.col("e.t").alias("term")).agg(F.sum("e.x").alias("tf"))


def bm25(docs: DataFrame, id_col: str, fields: dict[str, float], queries: DataFrame, limit: int = 10, require_all: bool = True) -> DataFrame:
    """(query, id, score, rank) of the best documents for each query (query, term).

    Only postings of query terms are made: documents are cut down to the terms asked for before anything is
    grouped. With ``require_all`` a document needs every term; queries that then have none are tried again
    with any term. idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    q = queries.select("query", F.lower("term").alias("term")).distinct()
    every = F.concat(*(F.coalesce(words(F.col(f)), F.array().cast("array<string>")) for f in fields))
    sized = docs.select(F.col(id_col).alias("id"), F.size(every).alias("len"), *fields)
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    term = F.concat(*(_weighted(f, x) for f, x in fields.items()))
    t = sized.select("id", "len", F.explode(term).alias("e")).select("id", "len", F.col("e.t").alias("term"), F.col("e.x").alias("x"))
    t = t.join(q.select("term").distinct(), "term", "left_semi").groupBy("id", "len", "term").agg(F.sum("x").alias("tf"))
    t = materialize(t, "bm25")
    df = t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = t.join(df, "term").join(F.broadcast(stats), how="cross")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    per = w.select("id", "term", score.alias("s")).join(q, "term").groupBy("query", "id").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("hits"))
    if require_all:
        size = q.groupBy("query").agg(F.count(F.lit(1)).alias("terms"))
        per = materialize(per.join(size, "query"), "bm25-hits")
        whole = per.filter("hits = terms").select("query").distinct()
        per = per.join(whole.withColumn("strict", F.lit(True)), "query", "left").filter("strict is null or hits = terms")
    win = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")  # sums differ in their last digits by order
    return per.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= limit).select("query", "id", "score", "rank")


# ---------------------------------------------------------------- vectors

BLOCK_BYTES = 32_000_000


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids and vectors in blocks of at most 32 MB."""
    ids: list[int] = []
    rows: list[list[float]] = []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(rows) * len(r[1]) * 8 >= BLOCK_BYTES:
            yield np.array(ids), np.array(rows, dtype=np.float64)
            ids, rows = [], []
    if rows:
        yield np.array(ids), np.array(rows, dtype=np.float64)


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        return -((q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)[None, :])
    return q @ v.T


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the right size, which rows those are)."""
    lists = column.to_pylist()
    ok = np.array([x is not None and len(x) == dim for x in lists], bool)
    return np.array([x for x, k in zip(lists, ok, strict=True) if k], dtype=np.float64).reshape(-1, dim), ok


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "dot", exclude_self: bool = True) -> DataFrame:
    """(query, id, score, rank) of the k best vectors (id, vector) for each query (id, vector); exact.

    A block of queries meets all vectors as a matrix product per batch; each batch sends on k rows per query,
    ranked in a shuffle by query. Cosine and dot are the plain inner product, euclidean the negative squared
    distance; vectors of another size than the queries take no part; ties go to the lower id."""
    spark = vectors.sparkSession
    parts = []
    for ids, q in _query_blocks(queries):
        sent = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qi, qm = sent.value
            for b in batches:
                m, ok = _matrix(b.column(1), qm.shape[1])
                vid = b.column(0).to_numpy(zero_copy_only=False)[ok]
                if not len(vid):
                    continue
                s = _scores(qm, m, metric)
                if exclude_self:
                    s[qi[:, None] == vid[None, :]] = -np.inf
                top = min(k, s.shape[1])
                best = np.argpartition(-s, top - 1, axis=1)[:, :top]
                edge = np.take_along_axis(s, best, 1).min(1)
                take = s >= edge[:, None]  # all that tie with the last one
                r, c = np.nonzero(take & np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(vid[c]), pa.array(s[r, c])], ["query", "id", "score"])

        parts.append(vectors.select("id", "vector").mapInArrow(run, "query long, id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query long, id long, score double, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Cells of an inverted file at most: their centroids go to every executor.
MOST_CELLS = 4096
#: Vectors of the sample that are searched to measure how many cells must be probed, and the part of their
#: neighbours that the cells must hold.
MEASURED, HELD = 400, 0.95


class InvertedFile:
    """Vectors by their nearest centroid. Centroids come from about ``sample`` vectors at most, chosen by hash
    (unit length, cosine); every vector is indexed. A search probes the ``probe`` nearest cells of each query: by
    default as many as hold HELD of the ten nearest of vectors of the sample, measured when the index is built."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample: int = 50_000, rounds: int = 12, seed: int = 7) -> None:
        self.spark = vectors.sparkSession
        n = vectors.count()
        rows = sorted(bounded_sample(vectors.filter("vector is not null").select("id", "vector"), sample, "id").collect(), key=lambda r: r[0])
        x = np.array([r[1] for r in rows], dtype=np.float64)
        self.cells = min(cells or max(1, int(np.sqrt(n))), max(1, len(x)), MOST_CELLS)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), self.cells, replace=False)] if len(x) else np.zeros((1, 1))

        def nearest(v: np.ndarray) -> np.ndarray:
            return np.concatenate([(v[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(v), 2048)])

        for _ in range(rounds if len(x) else 0):
            near = nearest(x)
            for j in range(self.cells):
                own = x[near == j]
                if len(own):
                    c[j] = own.mean(0)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        self.probe = self.cells
        if len(x) > 10:
            asked = np.linspace(0, len(x) - 1, min(MEASURED, len(x))).astype(int)
            s = x[asked] @ x.T
            s[np.arange(len(asked)), asked] = -np.inf
            best = np.argpartition(-s, 9, axis=1)[:, :10]
            place = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1), axis=1)  # of each cell among those of the query
            need = np.sort(np.take_along_axis(place, nearest(x)[best], 1).ravel())
            self.probe = int(need[min(len(need) - 1, int(np.ceil(HELD * len(need))))]) + 1
        self.centroids = c
        sent = self.spark.sparkContext.broadcast(c)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, ok = _matrix(b.column(1), sent.value.shape[1])
                cell = np.full(b.num_rows, -1, np.int32)
                if len(m):
                    cell[ok] = (m @ sent.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["id", "vector", "cell"])

        self.rows = materialize(vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(assign, "id long, vector array<double>, cell int"), "ivf")

    def search(self, queries: DataFrame, k: int = 10, probe: int | None = None) -> DataFrame:
        """(query, id, score, rank) by cosine of unit vectors; a join on the cell, so queries are never broadcast."""
        probe = min(probe or self.probe, self.cells)
        sent = self.spark.sparkContext.broadcast(self.centroids)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, ok = _matrix(b.column(1), sent.value.shape[1])
                if not len(m):
                    continue
                near = np.argsort(-(m @ sent.value.T), axis=1)[:, :probe]
                at = np.repeat(np.flatnonzero(ok), near.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], ["query", "q", "cell"])

        asked = queries.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(cells, "query long, q array<double>, cell int")
        dot = F.aggregate(F.zip_with("vector", "q", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
        met = asked.join(self.rows, "cell").filter("query <> id").select("query", "id", dot.alias("score"))
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
        return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Vectors up to which a search looks at all of them.
EXACT_VECTORS = 5_000


def best_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, id, score, rank): exact up to ``EXACT_VECTORS`` vectors, by an inverted file beyond."""
    if vectors.count() < EXACT_VECTORS:
        return knn(vectors, queries, k)
    return InvertedFile(vectors).search(queries, k)


def until_poor(scored: DataFrame, batch: int, least: float) -> DataFrame:
    """(query, id, rank, score) of (query, id, rank, s): batches of a list are scored in order up to and with the
    first whose best score is below ``least``; the scores of the rest are null."""
    rows = scored.withColumn("batch", F.floor((F.col("rank") - 1) / batch))
    best = rows.groupBy("query", "batch").agg(F.max("s").alias("m")).filter(F.col("m") < least)
    poor = best.groupBy("query").agg(F.min("batch").alias("poor"))
    return rows.join(poor, "query", "left").select("query", "id", "rank", F.when(F.col("poor").isNull() | (F.col("batch") <= F.col("poor")), F.col("s")).alias("score"))


def calibrated(feedback: DataFrame, slope: float = 1.0, offset: float = 0.0, rounds: int = 100, rate: float = 0.01, least: int = 5) -> DataFrame:
    """One row (slope, offset, samples): logistic calibration of (score, useful) by gradient descent. Scores are
    counted in steps of 1e-4, clipped to +-30, so the driver gets bins, never rows; fewer samples than ``least``
    leave the calibration as it was."""
    x = F.round(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("score"))), 4)
    bins = feedback.groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("useful").cast("double")).alias("y")).collect()
    v, n, y = (np.array([r[c] for r in bins], float) for c in ("x", "n", "y"))
    total = n.sum()
    for _ in range(rounds if total >= least else 0):
        wrong = n / (1 + np.exp(-(slope * v + offset))) - y
        slope, offset = slope - rate * float((wrong * v).sum() / total), offset - rate * float(wrong.sum() / total)
    return feedback.sparkSession.createDataFrame([(float(slope), float(offset), int(total))], "slope double, offset double, samples long")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: part of the true (query, id) pairs that were found."""
    hit = truth.select("query", "id").join(found.select("query", "id").withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def sparse_search(rows: DataFrame, query: DataFrame, limit: int = 10, positive: bool = False) -> DataFrame:
    """(query, id, score, rank) by the inner product of sparse vectors: rows (id, token, weight), query
    (query, token, weight)."""
    q = query.select("query", "token", F.col("weight").alias("qw"))
    s = rows.join(q, "token").groupBy("query", "id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))
    if positive:
        s = s.filter("score > 0")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(query, id, score) by weighted reciprocal rank fusion of lists (query, id, rank)."""
    every = None
    for df, weight in lists:
        p = df.select("query", "id", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("s"))
        every = p if every is None else every.unionByName(p)
    return every.groupBy("query", "id").agg(F.sum("s").alias("score"))


def list_weights(query_type: str, intent: str) -> tuple[float, float, float, float]:
    kw, sem, sym, sparse = LIST_WEIGHTS[query_type]
    a, b, c = INTENT_WEIGHTS.get(intent, (1.0, 1.0, 1.0))
    return kw * a, sem * b, sym * c, sparse


def normalised(rows: DataFrame, value: str, group: str = "query") -> DataFrame:
    """``norm``: (value - min) / (max - min) within the group, over 1 if all are equal."""
    g = rows.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return rows.join(g, group).withColumn("norm", (F.col(value) - F.col("_lo")) / span).drop("_lo", "_hi")


def blend(rows: DataFrame, fused: float = 0.35, reranked: float = 0.65) -> DataFrame:
    """Score of rows (score, norm or null): both weighed, or half the fused score where no reranker saw it."""
    return rows.withColumn("score", F.when(F.col("norm").isNotNull(), F.col("score") * fused + F.col("norm") * reranked).otherwise(F.col("score") * 0.5))


def graph_boost(rows: DataFrame) -> Column:
    """1 plus what degree, distance, open files, bugs, rank, freshness and the branch add; missing features
    (columns in_degree, distance, open, bug, bug_scale, percentile, freshness, branch) count as neutral."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (
        F.lit(1.0) + F.lit(0.05) * F.least(zero("in_degree"), F.lit(20.0)) + F.when(F.col("distance") == 1, 0.3).when(F.col("distance") == 2, 0.1).otherwise(0.0)
        + F.when(F.col("open"), 0.3).otherwise(0.0) + (F.coalesce("bug", F.lit(1.0)) - 1) * F.col("bug_scale") + F.lit(0.2) * zero("percentile")
        + F.lit(0.15) * zero("freshness") + F.when(F.col("branch"), 0.25).otherwise(0.0)
    )


def freshness(rows: DataFrame, ts: str, half_life_hours: float = 168.0) -> DataFrame:
    """``freshness`` = exp(-ln 2 / half-life * age in hours), the age from the newest row."""
    newest = rows.agg(F.max(ts).alias("_newest"))
    age = (F.unix_micros(F.col("_newest").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / F.lit(3.6e9)
    return rows.join(F.broadcast(newest), how="cross").withColumn("freshness", F.exp(F.lit(-float(np.log(2))) / half_life_hours * age)).drop("_newest")
