"""Putting ranked pieces of code together under a budget of tokens.

The greedy passes depend on the order of the rows of one query (or of one file), never on the corpus:
they run in ``applyInPandas`` groups of one ranked list."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Worth of a priority in packing, and what compression leaves of an entry.
PRIORITY_WORTH = {"critical": 4.0, "high": 2.0, "medium": 1.0, "low": 0.5}
COMPRESSION = {"critical": 0.0, "high": 0.1, "medium": 0.3, "low": 0.6}
MANY_ENTRIES = 300


def budget_prefix(rows: DataFrame, budget: int, group: str = "query", order: list[Column] | None = None) -> DataFrame:
    """Rows in order while the running sum of token_count fits; nothing after the first that doesn't."""
    w = Window.partitionBy(group).orderBy(*(order or [F.col("rank")])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("running", F.sum("token_count").over(w)).withColumn("over", F.max((F.col("running") > budget).cast("int")).over(w))
    return run.filter("over = 0").drop("over")


def greedy_pack(rows: DataFrame, budget: int, group: str = "query") -> DataFrame:
    """Rows by score while they fit, those that don't fit skipped; ties by id."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        left, keep = budget, []
        for t in pdf["token_count"]:
            keep.append(t <= left)
            left -= t if keep[-1] else 0
        return pdf[keep]

    return rows.groupBy(group).applyInPandas(pack, rows.schema)


def merge_adjacent(rows: DataFrame, group: list[str]) -> DataFrame:
    """Runs of rows (line_start, line_end, score, token_count, content) of a group where a row begins at most
    one line after all before it ended, as one row: longest end, best score, sum of tokens, contents in
    order with line feeds."""
    order = [F.col("line_start"), F.col("line_end"), F.col("id")]
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.when(F.col("line_start") <= F.max("line_end").over(before) + 1, 0).otherwise(1)
    r = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(upto))
    return r.groupBy(*group, "_run").agg(
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.max("score").alias("score"), F.sum("token_count").alias("token_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "line_end", "id", "content"))), lambda s: s["content"]), "\n").alias("content"),
        F.count(F.lit(1)).alias("merged"),
    ).drop("_run")


def overlap_dedup(rows: DataFrame, group: str = "query", most: float = 0.5) -> DataFrame:
    """Rows by score, without those that share more than ``most`` of the shorter range with a kept row of the
    same file."""

    def dedup(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        kept: dict[int, list[tuple[int, int]]] = {}
        keep = []
        for f, a, b in zip(pdf["file_id"], pdf["line_start"], pdf["line_end"], strict=True):
            own = kept.setdefault(f, [])
            bad = any(min(b, y) - max(a, x) + 1 > most * min(b - a + 1, y - x + 1) for x, y in own)
            keep.append(not bad)
            if not bad:
                own.append((a, b))
        return pdf[keep]

    return rows.groupBy(group).applyInPandas(dedup, rows.schema)


def expand_files(hits: DataFrame, chunks: DataFrame, least: int = 3, factor: float = 0.9) -> DataFrame:
    """(query, id, score): files with ``least`` hits give all their chunks at the mean score * factor, other
    hits stay as they are."""
    many = hits.groupBy("query", "file_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg")).filter(F.col("n") >= least)
    whole = many.join(chunks.select("id", "file_id"), "file_id").select("query", "id", (F.col("avg") * factor).alias("score"))
    rest = hits.join(many.select("query", "file_id"), ["query", "file_id"], "left_anti").select("query", "id", "score")
    return whole.unionByName(rest)


def neighbour_union(hits: DataFrame, neighbours: DataFrame, factor: float = 0.5) -> DataFrame:
    """Hits (query, id, score) and the neighbours (id, near, strength) of them that are no hits, at the query's
    best score * factor * min(strength, 1)."""
    top = hits.groupBy("query").agg(F.max("score").alias("top"))
    near = hits.join(neighbours, "id").groupBy("query", F.col("near").alias("id")).agg(F.max("strength").alias("g"))
    near = near.join(hits.select("query", "id"), ["query", "id"], "left_anti").join(top, "query")
    return hits.select("query", "id", "score").unionByName(near.select("query", "id", (F.col("top") * factor * F.least("g", F.lit(1.0))).alias("score")))


def knapsack(rows: DataFrame, budget: int, group: str = "query") -> DataFrame:
    """Rows (id, score, priority, token_count) whose total worth, score * worth of the priority, is largest
    within the budget: 0/1 dynamic programming for up to 300 rows of a list, greedy by worth above that.
    Budgets over 50 000 are counted in units of 4 tokens."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        worth = (pdf["score"] * pdf["priority"].map(PRIORITY_WORTH).fillna(0.5)).to_numpy()
        unit = 4 if budget > 50_000 else 1
        size = [-(-int(t) // unit) for t in pdf["token_count"]]
        cap = budget // unit
        if len(pdf) > MANY_ENTRIES or cap > 200_000:
            left, keep = cap, set()
            for i in sorted(range(len(pdf)), key=lambda i: (-worth[i], pdf["id"][i])):
                if size[i] <= left:
                    keep.add(i)
                    left -= size[i]
            return pdf.iloc[sorted(keep)]
        import numpy as np

        best = np.zeros(cap + 1)
        took = np.zeros((len(pdf), cap + 1), bool)
        for i in range(len(pdf)):
            if size[i] > cap:
                continue
            w = np.full(cap + 1, -1.0)
            w[size[i] :] = best[: cap + 1 - size[i]] + worth[i]
            took[i] = w > best
            best = np.maximum(best, w)
        keep, c = [], cap
        for i in range(len(pdf) - 1, -1, -1):
            if took[i, c]:
                keep.append(i)
                c -= size[i]
        return pdf.iloc[sorted(keep)]

    return rows.groupBy(group).applyInPandas(pack, rows.schema)


def compress(content: Column, doc: Column, priority: Column) -> Column:
    """Content by priority: whole, six lines, signature and documentation, or the signature alone."""
    lines = F.split(content, "\n")
    signature = F.coalesce(F.element_at(F.filter(lines, lambda l: (F.trim(l) != "") & ~l.rlike(r"^\s*(?://|#|/\*|\*|@)")), 1), F.lit(""))
    return (
        F.when(priority == "critical", content).when(priority == "high", F.array_join(F.slice(lines, 1, 6), "\n"))
        .when(priority == "medium", F.concat_ws("\n", doc, signature)).otherwise(signature)
    )


def render(rows: DataFrame, group: str = "query") -> DataFrame:
    """(query, text): entries in order, each file under a line with its path."""
    entry = F.concat(F.lit("// file: "), F.coalesce("path", F.lit("?")), F.lit("\n"), F.coalesce("content", F.lit("")))
    r = rows.withColumn("e", F.struct("position", entry.alias("t")))
    return r.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda s: s["t"]), "\n\n").alias("text"))


def deduplicate(chunks: DataFrame, k: int = 3, threshold: float = 0.7) -> DataFrame:
    """Ids (id, rep) of chunks under the least id with the same content, white space aside."""
    from quillspan.functions.code import content_key

    keyed = chunks.select("id", content_key(F.col("content")).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("rep")), "key").select("id", "rep")


def contained(chunks: DataFrame) -> DataFrame:
    """Ids of chunks whose lines lie within those of a longer chunk of the file (or of an equal one with a
    lower id): chunks in order of start, the farthest end so far decides, so no pairs are made."""
    order = [F.col("line_start"), F.col("line_end").desc(), F.col("id")]
    before = Window.partitionBy("file_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("_far", F.max("line_end").over(before)).filter("line_end <= _far").select("id")


def causal_order(entries: DataFrame, both: DataFrame, hops: int = 3) -> DataFrame:
    """Entries (query, id, file_id, line_start, score) with ``position``: files by their distance in ``both``
    (source_id, target_id) from the file of the best entry, unreachable ones last, then by their best score;
    entries of a file by line."""
    from quillspan.operators.graph import reach

    top = entries.groupBy("query").agg(F.max_by("file_id", F.struct("score", (-F.col("id")).alias("i"))).alias("top"))
    near = reach(both, top.select(F.col("top").alias("node")).distinct(), hops).select(F.col("start").alias("top"), F.col("node").alias("file_id"), "distance")
    best = entries.groupBy("query", "file_id").agg(F.max("score").alias("best"))
    e = entries.join(top, "query").join(near, ["top", "file_id"], "left").join(best, ["query", "file_id"])
    far = F.when(F.col("file_id") == F.col("top"), 0).otherwise(F.coalesce("distance", F.lit(hops + 1)))
    w = Window.partitionBy("query").orderBy(far, F.round("best", 9).desc(), "file_id", F.col("line_start").asc_nulls_first(), "id")
    return e.withColumn("position", F.row_number().over(w))
