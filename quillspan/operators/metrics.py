"""Evaluation of rankings: results (query, item, rank) against judgements (query, item, relevance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _gain(rel: str, rank: str):  # noqa: ANN202
    return (F.pow(F.lit(2.0), F.col(rel)) - 1) / F.log2(F.col(rank) + F.lit(1.0))


def evaluate(results: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query, dcg, ndcg, reciprocal_rank, recall, precision) at k, for every judged query."""
    j = judged.filter("relevance > 0")
    hit = results.filter(F.col("rank") <= k).join(j, ["query", "item"])
    ideal = j.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("relevance").desc(), "item"))).filter(F.col("r") <= k)
    ideal = ideal.groupBy("query").agg(F.sum(_gain("relevance", "r")).alias("idcg"))
    per = hit.groupBy("query").agg(F.sum(_gain("relevance", "rank")).alias("dcg"), F.min("rank").alias("first"), F.count(F.lit(1)).alias("hits"))
    size = j.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))
    back = results.groupBy("query").agg(F.least(F.lit(k).cast("long"), F.count(F.lit(1))).alias("returned"))
    x = size.join(per, "query", "left").join(ideal, "query", "left").join(back, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.select(
        "query", zero(F.col("dcg")).alias("dcg"), zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"), zero(1 / F.col("first")).alias("reciprocal_rank"),
        zero(F.col("hits") / F.col("relevant")).alias("recall"), zero(F.when(F.col("returned") > 0, F.col("hits") / F.col("returned"))).alias("precision"),
    )
