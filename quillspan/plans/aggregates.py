"""Aggregations and window-shaped passes (reference sections 2.4, 2.5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.operators import graph as G
from quillspan.operators import retrieval as T
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.sources import model as M
from quillspan.sources.tables import table

q = Book()
QUERIES, SQL = q.queries, q.sql


@q("agg01_language_distribution", sql("fl", "SELECT language, count(*)::BIGINT AS files FROM fl GROUP BY language"))
def _(s, d):
    return M.files(s, d).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@q("agg08_statistics", sql("fl", "ch", "sy", "SELECT (SELECT count(*) FROM fl)::BIGINT AS files, (SELECT count(*) FROM ch)::BIGINT AS chunks, (SELECT count(*) FROM (SELECT DISTINCT fqn FROM sy))::BIGINT AS symbols"))
def _(s, d):
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return one(M.files(s, d), "files").join(one(M.chunks(s, d), "chunks"), how="cross").join(one(M.symbols(s, d), "symbols"), how="cross")


@q("agg05_dependency_count", sql("dp", "SELECT count(*)::BIGINT AS edges, count(DISTINCT source_id)::BIGINT AS sources FROM dp"))
def _(s, d):
    return M.dependencies(s, d).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source_id").alias("sources"))


@q("agg07_embedding_coverage", sql("ch", "SELECT count(vector_id)::BIGINT AS embedded, round(100.0::DOUBLE * count(vector_id) / count(*), 6) AS coverage FROM ch"))
def _(s, d):
    return M.chunks(s, d, "vector_id").agg(F.count("vector_id").alias("embedded"), F.round(F.lit(100.0) * F.count("vector_id") / F.count(F.lit(1)), 6).alias("coverage"))


@q("agg09_edges_by_type", sql("fe", "SELECT t AS edge_type, count(fe.edge_type)::BIGINT AS edges FROM (SELECT unnest(['imports','inherits','calls','instantiates','historical_co_change','unused']) AS t) LEFT JOIN fe ON fe.edge_type = t GROUP BY t"))
def _(s, d):
    types = s.createDataFrame([(t,) for t in (*M.EDGE_TYPES, "unused")], "edge_type string")
    return types.join(M.file_edges(s, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges")), "edge_type", "left").fillna(0)


@q(
    "agg10_graph_statistics",
    sql(
        "dp",
        "n AS (SELECT count(*) AS n FROM (SELECT source_id FROM dp UNION SELECT target_id FROM dp))",
        "SELECT n::BIGINT AS nodes, (SELECT count(*) FROM dp)::BIGINT AS edges, round((SELECT count(*) FROM dp) / n::DOUBLE, 6) AS per_node, round((SELECT count(*) FROM dp) / (n * (n - 1.0))::DOUBLE, 9) AS density FROM n",
    ),
)
def _(s, d):
    e = M.dependencies(s, d)
    n = e.select("source_id").union(e.select("target_id")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    m = e.agg(F.count(F.lit(1)).alias("edges"))
    x = n.join(m, how="cross")
    nn = F.col("nodes").cast("double")
    return x.select("nodes", "edges", F.round(F.col("edges") / nn, 6).alias("per_node"), F.round(F.col("edges") / (nn * (nn - 1)), 9).alias("density"))


@q("agg11_in_degree", sql("dp", "SELECT target_id AS node, count(*)::BIGINT AS in_degree FROM dp GROUP BY target_id"))
def _(s, d):
    return M.dependencies(s, d).groupBy(F.col("target_id").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))


@q(
    "agg17_coverage_risk",
    sql(
        "dp",
        "x AS (SELECT node, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT target_id AS node, 1 AS i, 0 AS o FROM dp UNION ALL SELECT source_id, 0, 1 FROM dp) GROUP BY node)",
        "SELECT node, round(greatest(0.0, least(1.0, 2.0 / (1 + exp(-((i * 3 + o) / 4.0::DOUBLE) / 5.0)) - 1)), 6) AS risk, CASE WHEN i > 50 THEN 'critical' WHEN i > 20 THEN 'high' WHEN i > 5 THEN 'medium' ELSE 'low' END AS level FROM x",
    ),
)
def _(s, d):
    e = M.dependencies(s, d)
    x = e.select(F.col("target_id").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("source_id", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return x.select("node", F.round(code.coverage_risk(F.col("i"), F.col("o")), 6).alias("risk"), code.risk_level(F.col("i")).alias("level"))


@q("agg18_test_files", sql("fl", "SELECT count(DISTINCT path)::BIGINT AS n FROM fl WHERE len(list_intersect(string_split(lower(path), '/'), ['tests','test'])) > 0"))
def _(s, d):
    return M.files(s, d).filter(F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(F.lit("tests"), F.lit("test")))).agg(F.countDistinct("path").alias("n"))


@q(
    "agg21_feedback_rates",
    """WITH x AS (SELECT event_type AS intent, count(*)::BIGINT AS queries, sum((value > 20)::INT)::BIGINT AS used, sum(CASE WHEN value > 20 THEN event_id % 10 + 1 ELSE 0 END)::BIGINT AS positions,
    sum((value > 20 AND user_id % 3 = 0)::INT)::BIGINT AS gar FROM events GROUP BY 1)
    SELECT intent, queries, used, round(used / positions::DOUBLE, 6) AS mrr, round(used / queries::DOUBLE, 6) AS usage, round(gar / used::DOUBLE, 6) AS gar_rate FROM x""",
)
def _(s, d):
    u = F.col("value") > 20
    x = table(s, d, "events").groupBy(F.col("event_type").alias("intent")).agg(
        F.count(F.lit(1)).alias("queries"), F.sum(u.cast("int")).alias("used"), F.sum(F.when(u, F.col("event_id") % 10 + 1).otherwise(0)).alias("positions"), F.sum((u & (F.col("user_id") % 3 == 0)).cast("int")).alias("gar")
    )
    r = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return x.select("intent", "queries", "used", r("used", "positions").alias("mrr"), r("used", "queries").alias("usage"), r("gar", "used").alias("gar_rate"))


@q(
    "agg25_latency_percentiles",
    """WITH l AS (SELECT value, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS age FROM events), x AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM l WHERE age <= 1000)
    SELECT p, value FROM x, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS p) WHERE i = round((n - 1) * p)""",
)
def _(s, d):
    last = table(s, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1000).select("value")
    w = Window.orderBy("value")
    x = last.withColumn("i", F.row_number().over(w) - 1).join(last.agg(F.count(F.lit(1)).alias("n")), how="cross").withColumn("p", F.explode(F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))))
    return x.filter(F.col("i") == F.round((F.col("n") - 1) * F.col("p"))).select("p", "value")


_PATTERNS = {
    "result_returns": ("content", "%-> Result<%"),
    "unwraps": ("content", "%.unwrap()%"),
    "log_calls": ("content", "%log%"),
    "underscored_names": ("name", "%_%"),
}


@q(
    "agg26_code_patterns",
    sql(
        "ch",
        """x AS (SELECT kind, content, doc_comment, string_split(symbol_path, '::')[-1] AS name FROM ch)""",
        """SELECT pattern, n::BIGINT AS n, of_n::BIGINT AS of_n, round(least(1.0, n / nullif(of_n, 0)::DOUBLE), 6) AS ratio FROM (
        SELECT 'result_returns' AS pattern, count(*) FILTER (kind = 'function' AND content LIKE '%-> Result<%') AS n, count(*) FILTER (kind = 'function') AS of_n FROM x
        UNION ALL SELECT 'unwraps', count(*) FILTER (kind = 'function' AND content LIKE '%.unwrap()%'), count(*) FILTER (kind = 'function') FROM x
        UNION ALL SELECT 'logging', count(*) FILTER (kind = 'function' AND lower(content) LIKE '%log%'), count(*) FILTER (kind = 'function') FROM x
        UNION ALL SELECT 'naming', count(*) FILTER (kind = 'function' AND name LIKE '%_%'), count(*) FILTER (kind = 'function') FROM x
        UNION ALL SELECT 'testing', count(*) FILTER (kind = 'test'), count(*) FILTER (kind = 'function') FROM x
        UNION ALL SELECT 'documented', count(*) FILTER (kind IN ('function','class','trait') AND doc_comment IS NOT NULL), count(*) FILTER (kind IN ('function','class','trait')) FROM x)""",
    ),
)
def _(s, d):
    from quillspan.operators.patterns import code_patterns

    return code_patterns(M.chunks(s, d, "kind", "content", "doc_comment", "symbol_path"))


@q(
    "agg32_module_map",
    sql(
        "sy", "fl",
        """SELECT regexp_replace(fl.path, '/[^/]*$', '') AS directory, count(DISTINCT fl.path)::BIGINT AS files, count(*) FILTER (sy.kind = 'function')::BIGINT AS functions,
        count(*) FILTER (sy.kind IN ('class','trait'))::BIGINT AS types FROM sy JOIN fl ON fl.id = sy.file_id WHERE len(string_split(fl.path, '/')) <= 6 GROUP BY 1""",
    ),
)
def _(s, d):
    y = M.symbols(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id").filter(F.size(F.split("path", "/")) <= 6)
    return y.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("directory")).agg(
        F.countDistinct("path").alias("files"), F.count(F.when(F.col("kind") == "function", 1)).alias("functions"), F.count(F.when(F.col("kind").isin("class", "trait"), 1)).alias("types")
    )


@q("agg33_top_directories", sql("fl", "SELECT DISTINCT string_split(path, '/')[1] AS directory FROM fl"))
def _(s, d):
    return M.files(s, d).select(F.substring_index("path", "/", 1).alias("directory")).distinct()


@q("agg02_repository_sizes", sql("fl", "SELECT string_split(path, '/')[1] AS repo, count(*)::BIGINT AS files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM fl GROUP BY 1"))
def _(s, d):
    return M.files(s, d).groupBy(F.substring_index("path", "/", 1).alias("repo")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@q("win02_pagerank_percentiles", sql("dp", "x AS (SELECT node, count(*) AS r FROM (SELECT target_id AS node FROM dp UNION ALL SELECT source_id FROM dp) GROUP BY node)", "SELECT node, round((row_number() OVER (ORDER BY r, node) - 1) / (count(*) OVER ())::DOUBLE, 6) AS percentile FROM x"))
def _(s, d):
    e = M.dependencies(s, d)
    x = e.select(F.col("target_id").alias("node")).union(e.select("source_id")).groupBy("node").agg(F.count(F.lit(1)).alias("r"))
    return G.percentile(x, "r").select("node", F.round("percentile", 6).alias("percentile"))


@q(
    "win04_budget_prefix",
    sql("ch", "x AS (SELECT file_id, id, sum(token_count) OVER (PARTITION BY file_id ORDER BY id) AS running FROM ch)", "SELECT file_id, id, running::BIGINT AS running FROM x WHERE running <= 600"),
)
def _(s, d):
    from quillspan.operators.context import budget_prefix

    return budget_prefix(M.chunks(s, d, "file_id", "token_count"), 600, "file_id", [F.col("id")]).select("file_id", "id", "running")


@q(
    "win08_freshness",
    sql("fl", "SELECT id, round(exp(-ln(2) / 168.0::DOUBLE * (epoch_us((SELECT max(indexed_at) FROM fl)) - epoch_us(indexed_at)) / 3.6e9), 6) AS freshness FROM fl WHERE indexed_at IS NOT NULL"),
)
def _(s, d):
    return T.freshness(M.files(s, d).filter("indexed_at is not null"), "indexed_at").select("id", F.round("freshness", 6).alias("freshness"))


@q(
    "win09_approximate_epoch",
    sql("cm", "SELECT hash, round(((year(ts) - 2000) * 365.25 + (month(ts) - 1) * 30.44 + (day(ts) - 1))::DOUBLE, 4) AS days FROM cm WHERE ts IS NOT NULL"),
)
def _(s, d):
    t = F.col("ts")
    return M.commits(s, d).filter("ts is not null").select("hash", F.round((F.year(t) - 2000) * F.lit(365.25) + (F.month(t) - 1) * F.lit(30.44) + (F.dayofmonth(t) - 1), 4).alias("days"))


@q(
    "win10_min_max_normalised",
    sql("ch", "SELECT id, round(CASE WHEN hi > lo THEN (token_count - lo) / (hi - lo)::DOUBLE ELSE 0 END, 6) AS norm FROM (SELECT id, token_count, min(token_count) OVER (PARTITION BY file_id) AS lo, max(token_count) OVER (PARTITION BY file_id) AS hi FROM ch)"),
)
def _(s, d):
    return T.normalised(M.chunks(s, d, "file_id", "token_count"), "token_count", "file_id").select("id", F.round("norm", 6).alias("norm"))


@q("win11_last_per_symbol", sql("ch", "SELECT symbol_path, max(id) AS id FROM ch WHERE symbol_path IS NOT NULL GROUP BY 1"))
def _(s, d):
    return M.chunks(s, d, "symbol_path").filter("symbol_path is not null").groupBy("symbol_path").agg(F.max("id").alias("id"))


@q("stm15_last_latencies", "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 1000 GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(s, d, "events").withColumn("age", F.row_number().over(w)).filter("age <= 1000").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@q("xtr57_stats_per_key", "SELECT user_id AS key, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@q("xtr49_hit_rates", "SELECT round(count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view','click'))::DOUBLE, 6) AS hit_rate, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate FROM events")
def _(s, d):
    c = lambda *t: F.count(F.when(F.col("event_type").isin(*t), 1))
    return table(s, d, "events").agg(F.round(c("view") / c("view", "click"), 6).alias("hit_rate"), F.round(c("error") / F.count(F.lit(1)), 6).alias("error_rate"))
