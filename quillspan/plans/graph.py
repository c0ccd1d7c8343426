"""Graph queries (reference section 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.operators import graph as G
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.sources import model as M

q = Book()
QUERIES, SQL = q.queries, q.sql

#: Walks start at every node of the graph.
_STARTS = "st AS (SELECT source_id AS node FROM dp UNION SELECT target_id FROM dp)"


def _starts(e):
    return e.select(F.col("source_id").alias("node")).union(e.select("target_id")).distinct()


def _walk(source: str, target: str, depth: int) -> str:
    return f"""w AS (SELECT node AS start, node AS cur, 0 AS hop FROM st
        UNION SELECT w.start, e.{target}, w.hop + 1 FROM w JOIN dp e ON e.{source} = w.cur WHERE w.hop < {depth})"""


@q("gra02_upstream", sql("dp", _STARTS, _walk("source_id", "target_id", 2), "SELECT start, cur AS node, min(hop)::BIGINT AS distance FROM w WHERE hop > 0 GROUP BY ALL", recursive=True))
def _(s, d):
    e = M.dependencies(s, d)
    return G.upstream(e, _starts(e), 2)


@q("gra03_downstream", sql("dp", _STARTS, _walk("target_id", "source_id", 2), "SELECT start, cur AS node, min(hop)::BIGINT AS distance FROM w WHERE hop > 0 GROUP BY ALL", recursive=True))
def _(s, d):
    e = M.dependencies(s, d)
    return G.downstream(e, _starts(e), 2)


@q("gra05_blast_radius", sql("dp", _STARTS, _walk("target_id", "source_id", 3), "SELECT start, count(DISTINCT cur)::BIGINT AS affected FROM w WHERE hop > 0 AND cur <> start GROUP BY start", recursive=True))
def _(s, d):
    e = M.dependencies(s, d)
    return G.blast_radius(e, _starts(e), 3).groupBy("start").agg(F.count(F.lit(1)).alias("affected"))


@q("ctx31_breaking_changes", sql("dp", _STARTS, _walk("target_id", "source_id", 3), "SELECT start, count(DISTINCT cur)::BIGINT AS affected, CASE WHEN count(DISTINCT cur) > 50 THEN 'critical' WHEN count(DISTINCT cur) > 20 THEN 'high' ELSE 'medium' END AS level FROM w WHERE hop > 0 AND cur <> start GROUP BY start HAVING count(DISTINCT cur) > 10", recursive=True))
def _(s, d):
    e = M.dependencies(s, d)
    n = G.blast_radius(e, _starts(e), 3).groupBy("start").agg(F.count(F.lit(1)).alias("affected")).filter("affected > 10")
    return n.withColumn("level", code.risk_level(F.col("affected")))


@q(
    "gra06_undirected_distance",
    sql(
        "dp", _STARTS,
        "bo AS (SELECT source_id AS a, target_id AS b FROM dp UNION SELECT target_id, source_id FROM dp)",
        "w AS (SELECT node AS start, node AS cur, 0 AS hop FROM st UNION SELECT w.start, bo.b, w.hop + 1 FROM w JOIN bo ON bo.a = w.cur WHERE w.hop < 3)",
        "SELECT start, cur AS node, min(hop)::BIGINT AS distance FROM w GROUP BY ALL", recursive=True,
    ),
)
def _(s, d):
    e = M.dependencies(s, d)
    return G.distance(e, _starts(e), 3)


@q("gra09_edges_of_symbols", sql("dp", "SELECT source_id AS symbol, target_id AS other, kind, 'out' AS direction FROM dp UNION ALL SELECT target_id, source_id, kind, 'in' FROM dp"))
def _(s, d):
    e = M.dependencies(s, d)
    out = e.select(F.col("source_id").alias("symbol"), F.col("target_id").alias("other"), "kind", F.lit("out").alias("direction"))
    return out.union(e.select("target_id", "source_id", "kind", F.lit("in")))


def _rank_sql(iterations: int, damping: float, dangling: bool) -> list[str]:
    parts = [
        "nd AS MATERIALIZED (SELECT source_id AS node FROM dp UNION SELECT target_id FROM dp)",
        "nn AS (SELECT count(*)::DOUBLE AS n FROM nd)",
        "od AS MATERIALIZED (SELECT source_id AS node, count(*)::DOUBLE AS o FROM dp GROUP BY 1)",
        "r0 AS MATERIALIZED (SELECT node, 1.0 / n AS r FROM nd, nn)",
    ]
    for i in range(1, iterations + 1):
        lost = f"coalesce((SELECT sum(r) FROM r{i - 1} WHERE node NOT IN (SELECT node FROM od)), 0)" if dangling else "0"
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT nd.node, (1 - {damping}::DOUBLE) / n + {damping}::DOUBLE * {lost} / n + {damping}::DOUBLE * coalesce(x.i, 0) AS r FROM nd CROSS JOIN nn"
            f" LEFT JOIN (SELECT dp.target_id AS node, sum(p.r / od.o) AS i FROM dp JOIN r{i - 1} p ON p.node = dp.source_id JOIN od ON od.node = dp.source_id GROUP BY 1) x ON x.node = nd.node)"
        )
    return parts


@q("gra12_pagerank", sql("dp", *_rank_sql(30, 0.85, True), "SELECT node, round(r, 9) AS rank FROM r30"))
def _(s, d):
    return G.pagerank(M.dependencies(s, d)).select("node", F.round("rank", 9).alias("rank"))


@q("gra15_file_importance", sql("dp", *_rank_sql(10, 0.85, False), "SELECT 'src/part_' || node || '.rs' AS path, round(r, 9) AS importance FROM r10"))
def _(s, d):
    r = G.pagerank(M.file_edges(s, d), iterations=10, source="source_path", target="target_path", dangling=False)
    return r.select(F.col("node").alias("path"), F.round("rank", 9).alias("importance"))


@q("topk04_most_important_files", sql("dp", *_rank_sql(10, 0.85, False), "SELECT 'src/part_' || node || '.rs' AS path FROM r10 ORDER BY round(r, 9) DESC, 'src/part_' || node || '.rs' LIMIT 15"))
def _(s, d):
    r = G.pagerank(M.file_edges(s, d), iterations=10, source="source_path", target="target_path", dangling=False)
    return r.orderBy(F.round("rank", 9).desc(), "node").limit(15).select(F.col("node").alias("path"))


@q(
    "gra13_neighbour_files",
    sql(
        "fe", "st AS (SELECT source_path AS node FROM fe UNION SELECT target_path FROM fe)",
        "bo AS (SELECT source_path AS a, target_path AS b FROM fe UNION SELECT target_path, source_path FROM fe)",
        "w AS (SELECT node AS start, node AS cur, 0 AS hop FROM st UNION SELECT w.start, bo.b, w.hop + 1 FROM w JOIN bo ON bo.a = w.cur WHERE w.hop < 2)",
        "SELECT start, cur AS node, min(hop)::BIGINT AS distance FROM w WHERE cur <> start GROUP BY ALL", recursive=True,
    ),
)
def _(s, d):
    e = M.file_edges(s, d)
    both = G.both_ways(e, "source_path", "target_path")
    st = e.select(F.col("source_path").alias("node")).union(e.select("target_path")).distinct()
    return G.reach(both, st, 2, "source_path", "target_path").filter("node <> start")


@q(
    "topk05_related_files",
    sql(
        "fe", "st AS (SELECT source_path AS node FROM fe UNION SELECT target_path FROM fe)",
        "bo AS (SELECT source_path AS a, target_path AS b FROM fe UNION SELECT target_path, source_path FROM fe)",
        "w AS (SELECT node AS start, node AS cur, 0 AS hop FROM st UNION SELECT w.start, bo.b, w.hop + 1 FROM w JOIN bo ON bo.a = w.cur WHERE w.hop < 2)",
        "ds AS (SELECT start, cur AS node, min(hop) AS distance FROM w WHERE cur <> start GROUP BY ALL)",
        "SELECT start, node, rn::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY distance, node) AS rn FROM ds) WHERE rn <= 5", recursive=True,
    ),
)
def _(s, d):
    from pyspark.sql import Window

    e = M.file_edges(s, d)
    st = e.select(F.col("source_path").alias("node")).union(e.select("target_path")).distinct()
    r = G.reach(G.both_ways(e, "source_path", "target_path"), st, 2, "source_path", "target_path").filter("node <> start")
    return r.withColumn("position", F.row_number().over(Window.partitionBy("start").orderBy("distance", "node"))).filter("position <= 5").select("start", "node", "position")


@q("gra08_cycles")
def _(s, d):
    """Strongly connected components; the closure SQL needs is quadratic, so tests compare with brute force."""
    return G.strong_components(M.dependencies(s, d))


@q("gra07_has_cycles")
def _(s, d):
    e = M.dependencies(s, d)
    loops = e.filter("source_id = target_id").limit(1).select(F.col("source_id").alias("node"))
    return G.strong_components(e).select("node").union(loops).agg((F.count(F.lit(1)) > 0).alias("cyclic"))


@q("gra17_circular_files")
def _(s, d):
    e = M.file_edges(s, d).filter("edge_type <> 'historical_co_change'")
    return G.strong_components(e, "source_path", "target_path")


@q("gra19_communities")
def _(s, d):
    return G.communities(M.dependencies(s, d))


@q("agg19_modularity")
def _(s, d):
    e = M.dependencies(s, d)
    return G.modularity(e, G.communities(e))


@q("agg20_community_sizes")
def _(s, d):
    return G.communities(M.dependencies(s, d)).groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first"))


def _least_label(rounds: int) -> list[str]:
    """Every node takes the least label around it, again and again."""
    parts = ["bo AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM dp UNION SELECT target_id, source_id FROM dp)", "l0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS c FROM bo)"]
    for i in range(1, rounds + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT p.node, least(p.c, min(n.c)) AS c FROM l{i - 1} p JOIN bo ON bo.a = p.node JOIN l{i - 1} n ON n.node = bo.b GROUP BY p.node, p.c)")
    return parts


@q("gra20_components", sql("dp", *_least_label(40), "SELECT node, c AS component FROM l40"))
def _(s, d):
    return G.components(M.dependencies(s, d), "source_id", "target_id")


@q(
    "gra18_attention",
    sql(
        "dp",
        "ed AS MATERIALIZED (SELECT DISTINCT source_id AS s, target_id AS t FROM dp WHERE kind <> 'historical_co_change')",
        "nd AS MATERIALIZED (SELECT node, (row_number() OVER (ORDER BY node) - 1) / (count(*) OVER ())::DOUBLE AS pct FROM (SELECT s AS node FROM ed UNION SELECT t FROM ed))",
        "dg AS MATERIALIZED (SELECT node, pct, coalesce((SELECT count(*) FROM ed WHERE t = node), 0)::DOUBLE AS i, coalesce((SELECT count(*) FROM ed WHERE s = node), 0)::DOUBLE AS o FROM nd)",
        "x AS MATERIALIZED (SELECT node, i + o + 1 AS deg, i / (SELECT greatest(max(i), 1) FROM dg) AS x0, o / (SELECT greatest(max(o), 1) FROM dg) AS x1, pct AS x2 FROM dg)",
        "a AS MATERIALIZED (SELECT s, t, 1 / sqrt(p.deg * r.deg) AS w FROM ed JOIN x p ON p.node = s JOIN x r ON r.node = t WHERE s <> t UNION ALL SELECT node, node, 1 / deg FROM x)",
        "g1 AS MATERIALIZED (SELECT t AS node, sum(w * x0) AS g0, sum(w * x1) AS g1, sum(w * x2) AS g2 FROM a JOIN x ON x.node = s GROUP BY t)",
        "h AS MATERIALIZED (SELECT node, " + ", ".join(f"greatest(0.0::DOUBLE, g0 * {G.W1[0][j]}::DOUBLE + g1 * {G.W1[1][j]}::DOUBLE + g2 * {G.W1[2][j]}::DOUBLE) AS h{j}" for j in range(8)) + " FROM g1)",
        "g2 AS (SELECT t AS node, " + ", ".join(f"sum(w * h{j}) AS k{j}" for j in range(8)) + " FROM a JOIN h ON h.node = s GROUP BY t)",
        "SELECT node, round(1 / (1 + exp(-(" + " + ".join(f"k{j} * {G.W2[j]}::DOUBLE" for j in range(8)) + "))), 6) AS attention FROM g2",
    ),
)
def _(s, d):
    e = M.dependencies(s, d).filter("kind <> 'historical_co_change'").select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).distinct()
    nodes = e.select(F.col("s").alias("node")).union(e.select("t")).distinct()
    pct = G.percentile(nodes.withColumn("v", F.lit(1.0)), "v")
    return G.attention(e, pct).select("node", F.round("attention", 6).alias("attention"))


@q("gra21_reasoning_neighbourhood")
def _(s, d):
    e = M.dependencies(s, d)
    return G.reasoning(e, _starts(e), 3, 20).select("start", "node", "hops", F.round("score", 6).alias("score"))


@q("gra22_impact")
def _(s, d):
    e = M.dependencies(s, d)
    hits = G.reasoning(e, _starts(e), 3, 100)
    return G.impact(hits).select("start", "node", F.round("score", 6).alias("score"))


@q("gra23_data_flows_to", sql("dp", _STARTS, "w AS (SELECT node AS start, node AS cur, 0 AS hop FROM st UNION SELECT w.start, e.target_id, w.hop + 1 FROM w JOIN dp e ON e.source_id = w.cur AND e.kind = 'data_flow' WHERE w.hop < 4)", "SELECT start, cur AS node, min(hop)::BIGINT AS distance FROM w WHERE hop > 0 GROUP BY ALL", recursive=True))
def _(s, d):
    e = M.dependencies(s, d)
    return G.upstream(e.filter("kind = 'data_flow'"), _starts(e), 4)


@q("gra24_data_flows_from", sql("dp", _STARTS, "w AS (SELECT node AS start, node AS cur, 0 AS hop FROM st UNION SELECT w.start, e.source_id, w.hop + 1 FROM w JOIN dp e ON e.target_id = w.cur AND e.kind = 'data_flow' WHERE w.hop < 4)", "SELECT start, cur AS node, min(hop)::BIGINT AS distance FROM w WHERE hop > 0 GROUP BY ALL", recursive=True))
def _(s, d):
    e = M.dependencies(s, d)
    return G.downstream(e.filter("kind = 'data_flow'"), _starts(e), 4)


@q("gra25_error_handled_by", sql("dp", _STARTS, "w AS (SELECT node AS start, node AS cur, 0 AS hop FROM st UNION SELECT w.start, e.target_id, w.hop + 1 FROM w JOIN dp e ON e.source_id = w.cur AND e.kind = 'error_flow' WHERE w.hop < 4)", "SELECT start, cur AS node, min(hop)::BIGINT AS distance FROM w WHERE hop > 0 GROUP BY ALL", recursive=True))
def _(s, d):
    e = M.dependencies(s, d)
    return G.upstream(e.filter("kind = 'error_flow'"), _starts(e), 4)


@q(
    "gra28_transitive_flows",
    sql(
        "dp", "cl AS (SELECT DISTINCT source_id, target_id FROM dp WHERE kind = 'calls')", "st AS (SELECT DISTINCT source_id AS node FROM cl)",
        "w AS (SELECT node AS start, node AS cur, 0 AS hop FROM st UNION SELECT w.start, e.target_id, w.hop + 1 FROM w JOIN cl e ON e.source_id = w.cur WHERE w.hop < 3)",
        "SELECT start AS source, cur AS target, min(hop)::BIGINT AS hops, round(power(0.8::DOUBLE, min(hop)), 6) AS confidence FROM w WHERE hop > 0 AND cur <> start GROUP BY ALL HAVING min(hop) >= 2", recursive=True,
    ),
)
def _(s, d):
    e = M.dependencies(s, d)
    calls = e.filter("kind = 'calls'")
    t = G.transitive_flows(e, calls.select(F.col("source_id").alias("node")).distinct())
    return t.select("source", "target", "hops", F.round("confidence", 6).alias("confidence"))


@q(
    "gra29_pattern_flows",
    sql(
        "sy",
        r"m AS (SELECT ch.id, unnest(regexp_extract_all(ch.content, '\.([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS name, generate_subscripts(regexp_extract_all(ch.content, '\.([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), 1) AS pos FROM ch WHERE content IS NOT NULL)",
        "p AS (SELECT id, name, lead(name) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM m)",
        "wo AS (SELECT name, arg_min(id, (fqn, id)) AS sid FROM sy GROUP BY name)",
        "SELECT DISTINCT a.sid AS source_id, b.sid AS target_id FROM p JOIN wo a ON a.name = p.name JOIN wo b ON b.name = p.nxt WHERE a.sid <> b.sid",
    ),
)
def _(s, d):
    from pyspark.sql import Window

    c = M.chunks(s, d, "content").filter("content is not null")
    m = c.select("id", F.posexplode(F.regexp_extract_all("content", F.lit(r"\.([A-Za-z_][A-Za-z0-9_]*)\s*\("))).alias("pos", "name"))
    p = m.withColumn("nxt", F.lead("name").over(Window.partitionBy("id").orderBy("pos"))).filter("nxt is not null").select("name", "nxt").distinct()
    wo = M.symbols(s, d).groupBy("name").agg(F.min(F.struct("fqn", "id")).alias("m")).select("name", F.col("m.id").alias("sid"))
    a, b = wo.withColumnRenamed("sid", "source_id"), wo.select(F.col("name").alias("nxt"), F.col("sid").alias("target_id"))
    return p.join(a, "name").join(b, "nxt").filter("source_id <> target_id").select("source_id", "target_id").distinct()


@q("gra30_deduplicated_flows", sql("dp", "SELECT source_id, target_id, round(max(c), 6) AS confidence FROM (SELECT source_id, target_id, ((source_id * 13 + target_id) % 100) / 100.0::DOUBLE AS c FROM dp UNION ALL SELECT source_id, target_id, ((source_id + target_id * 7) % 100) / 100.0::DOUBLE FROM dp) GROUP BY ALL HAVING max(c) >= 0.3"))
def _(s, d):
    e = M.dependencies(s, d)
    a, b = F.col("source_id"), F.col("target_id")
    f = e.select(a, b, ((a * 13 + b) % 100 / 100.0).alias("c")).union(e.select(a, b, ((a + b * 7) % 100 / 100.0)))
    return f.groupBy("source_id", "target_id").agg(F.max("c").alias("c")).filter("c >= 0.3").select("source_id", "target_id", F.round("c", 6).alias("confidence"))


@q("gra33_call_graph", sql("dp", "SELECT source_id, string_agg(target_id::VARCHAR, ',' ORDER BY target_id) AS callees FROM dp WHERE kind = 'calls' GROUP BY source_id"))
def _(s, d):
    c = M.dependencies(s, d).filter("kind = 'calls'").groupBy("source_id").agg(F.array_sort(F.collect_list("target_id")).alias("t"))
    return c.select("source_id", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("callees"))


@q(
    "join24_return_to_argument_flows",
    sql(
        "dp", "p AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS pos FROM dp WHERE kind IN ('calls','data_flow','uses_type'))",
        "SELECT a.target_id AS source, b.target_id AS target, round(max(0.7 / (b.pos - a.pos))::DOUBLE, 6) AS confidence FROM p a JOIN p b ON a.source_id = b.source_id AND b.pos > a.pos AND b.pos - a.pos <= 2 GROUP BY ALL",
    ),
)
def _(s, d):
    from pyspark.sql import Window

    p = M.dependencies(s, d).filter(F.col("kind").isin("calls", "data_flow", "uses_type"))
    p = p.withColumn("next", F.collect_list("target_id").over(Window.partitionBy("source_id").orderBy("target_id").rowsBetween(1, 2)))
    f = p.select(F.col("target_id").alias("source"), F.posexplode("next").alias("i", "target"))
    return f.groupBy("source", "target").agg(F.round(F.max(F.lit(0.7) / (F.col("i") + 1)), 6).alias("confidence"))
