"""Single counts and metrics, and texts as vectors (reference sections 2.4, 2.9, 2.12 and 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import embedding as V
from quillspan.plans import aggregates, evaluation
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.plans.retrieval import QUESTIONS
from quillspan.session import materialize
from quillspan.sources import model as M

q = Book()
QUERIES, SQL = q.queries, q.sql


@q("agg03_chunk_count", sql("ch", "SELECT count(*)::BIGINT AS chunks FROM ch"))
def _(s, d):
    return M.chunks(s, d).agg(F.count(F.lit(1)).alias("chunks"))


@q("agg04_symbol_count", sql("sy", "SELECT count(*)::BIGINT AS symbols FROM sy"))
def _(s, d):
    return M.symbols(s, d).agg(F.count(F.lit(1)).alias("symbols"))


@q("agg06_embedded_chunks", sql("ch", "SELECT count(*)::BIGINT AS embedded FROM ch WHERE vector_id IS NOT NULL"))
def _(s, d):
    return M.chunks(s, d, "vector_id").filter("vector_id is not null").agg(F.count(F.lit(1)).alias("embedded"))


def _metric(name: str, module, base: str, key: str, value: str):  # noqa: ANN001, ANN202
    """One metric of those that are computed together; the others are pruned from the plan."""

    @q(name, f"SELECT {key}, {value} FROM ({module.SQL[base]})")
    def _(s, d):
        return module.QUERIES[base](s, d).select(key, value)


for _name, _module, _base, _key, _value in (
    ("agg22_mean_places", aggregates, "agg21_feedback_rates", "intent", "mrr"), ("agg23_usage_rates", aggregates, "agg21_feedback_rates", "intent", "usage"), ("agg24_neighbour_rates", aggregates, "agg21_feedback_rates", "intent", "gar_rate"),
    ("evl02_ndcg", evaluation, "evl01_ranking_metrics", "query", "ndcg"), ("evl03_reciprocal_ranks", evaluation, "evl01_ranking_metrics", "query", "reciprocal_rank"), ("evl04_recalls", evaluation, "evl01_ranking_metrics", "query", "recall"),
    ("evl05_precisions", evaluation, "evl01_ranking_metrics", "query", "precision"),
):
    _metric(_name, _module, _base, _key, _value)


@q("evl06_mean_ndcg", f"SELECT round(avg(ndcg), 5) AS ndcg, count(*)::BIGINT AS queries FROM ({evaluation.SQL['evl01_ranking_metrics']})")
def _(s, d):
    return evaluation.QUERIES["evl01_ranking_metrics"](s, d).agg(F.round(F.avg("ndcg"), 5).alias("ndcg"), F.count(F.lit(1)).alias("queries"))


@q("evl07_queries_by_ndcg", f"SELECT CASE WHEN ndcg >= 0.7 THEN 'good' WHEN ndcg > 0 THEN 'fair' ELSE 'none' END AS grade, count(*)::BIGINT AS queries FROM ({evaluation.SQL['evl01_ranking_metrics']}) GROUP BY 1")
def _(s, d):
    e = evaluation.QUERIES["evl01_ranking_metrics"](s, d)
    return e.groupBy(F.when(F.col("ndcg") >= 0.7, "good").when(F.col("ndcg") > 0, "fair").otherwise("none").alias("grade")).agg(F.count(F.lit(1)).alias("queries"))


# ---------------------------------------------------------------- texts as vectors


def _flaky(texts: list[str]) -> list[list[float]]:
    if any(len(t) % 11 == 0 for t in texts):
        raise ValueError("the model refuses a text")
    return V.hashed_words(texts)


@q("ret37_embedded_chunks")
def _(s, d):
    return V.embed(M.chunks(s, d, "content"), text_col="content")


@q("ret40_embedded_with_retries", sql("ch", "SELECT id, true AS embedded FROM ch WHERE content IS NOT NULL"))
def _(s, d):
    """A model that refuses some texts, whole batches at first, then each alone; those are tried with another one."""
    c = M.chunks(s, d, "content").filter("content is not null")
    found = materialize(V.embed(c, _flaky, text_col="content"), "vectors")
    return V.retried(found, c, text_col="content").select("id", F.col("vector").isNotNull().alias("embedded"))


@q("ret41_embedded_questions")
def _(s, d):
    asked = s.createDataFrame(list(enumerate(QUESTIONS.values())), "id long, text string")
    return V.embed(asked)


@q("ret42_sparse_weights", sql("ch", r"w AS (SELECT id, list_filter(regexp_split_to_array(lower(doc_comment), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM ch WHERE doc_comment IS NOT NULL)", "e AS (SELECT id, len(w) AS n, unnest(w) AS token FROM w)", "c AS (SELECT id, token, count(*) / any_value(n)::DOUBLE AS weight FROM e GROUP BY id, token)", "SELECT id, count(*)::BIGINT AS tokens, round(max(weight), 6) AS most FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, token) AS rn FROM c WHERE weight >= 0.01) WHERE rn <= 128 GROUP BY id"))
def _(s, d):
    v = V.sparse_weights(M.chunks(s, d, "doc_comment"), text_col="doc_comment")
    return v.select("id", F.size("tokens").cast("long").alias("tokens"), F.round(F.col("tokens")[0]["weight"], 6).alias("most"))


@q("stm07_missing_vectors_retried", sql("ch", "SELECT count(*)::BIGINT AS retried FROM ch WHERE vector_id IS NULL AND content IS NOT NULL"))
def _(s, d):
    """Chunks without a vector, embedded again."""
    c = M.chunks(s, d, "content", "vector_id").filter("vector_id is null and content is not null")
    return V.embed(c, text_col="content").filter("vector is not null").agg(F.count(F.lit(1)).alias("retried"))
