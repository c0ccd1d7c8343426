"""Evaluation metrics (reference section 2.13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators.metrics import evaluate
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.sources.tables import table

q = Book()
QUERIES, SQL = q.queries, q.sql

_ROWS = [
    "rs AS (SELECT user_id AS query, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 20)",
    "jd AS (SELECT user_id AS query, event_id AS item, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END)::INT AS relevance FROM events WHERE event_type IN ('purchase','signup','click'))",
]


def _results(s, d):
    e = table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    r = e.select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.row_number().over(w).alias("rank")).filter("rank <= 20")
    j = e.filter(F.col("event_type").isin("purchase", "signup", "click")).select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1).alias("relevance"))
    return r, j


@q(
    "evl01_ranking_metrics",
    sql(
        *_ROWS,
        "h AS (SELECT rs.query, sum((power(2.0, relevance) - 1) / log2(rank + 1)) AS dcg, min(rank) AS first, count(*) AS hits FROM rs JOIN jd USING (query, item) WHERE rank <= 10 GROUP BY 1)",
        "i AS (SELECT query, sum((power(2.0, relevance) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, item) AS r FROM jd) WHERE r <= 10 GROUP BY 1)",
        "n AS (SELECT query, count(*) AS rel FROM jd GROUP BY 1)",
        """SELECT n.query, round(coalesce(dcg, 0)::DOUBLE, 6) AS dcg, round(coalesce(dcg / idcg, 0)::DOUBLE, 6) AS ndcg, round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS reciprocal_rank,
        round(coalesce(hits / rel::DOUBLE, 0), 6) AS recall, round(coalesce(hits / least(10, (SELECT count(*) FROM rs WHERE rs.query = n.query))::DOUBLE, 0), 6) AS precision FROM n LEFT JOIN h USING (query) LEFT JOIN i USING (query)""",
    ),
)
def _(s, d):
    r, j = _results(s, d)
    e = evaluate(r, j, 10)
    return e.select("query", *(F.round(c, 6).alias(c) for c in ("dcg", "ndcg", "reciprocal_rank", "recall", "precision")))


@q("evl08_benchmark_summary", sql(*_ROWS, "h AS (SELECT rs.query, min(rank) AS first FROM rs JOIN jd USING (query, item) WHERE rank <= 10 GROUP BY 1)", "SELECT count(*)::BIGINT AS queries, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM (SELECT DISTINCT query FROM jd) LEFT JOIN h USING (query)"))
def _(s, d):
    r, j = _results(s, d)
    return evaluate(r, j, 10).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
