"""Stages of search, graph features and context assembly, one by one (reference sections 2.3 to 2.11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.functions import expansion as X
from quillspan.operators import context as C
from quillspan.operators import graph as G
from quillspan.operators import patterns as P
from quillspan.operators import retrieval as T
from quillspan.plans import aggregates, context, further, graph, history
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.plans.retrieval import _FIELDS, _FUSE, _SPARSE, _SPL, _SYM, _TERMS, QUESTIONS, _bm25_sql, features, fused, question_terms, sparse, symbol_list, vectors
from quillspan.session import materialize
from quillspan.sources import model as M
from quillspan.sources.tables import table

q = Book()
QUERIES, SQL = q.queries, q.sql

_KW20 = _bm25_sql("ch", _FIELDS, 20, True)


def keyword(s, d, limit: int = 20):
    return T.bm25(M.chunks(s, d, "content", "doc_comment", "symbol_path"), "id", _FIELDS, question_terms(s), limit)


# ---------------------------------------------------------------- lists and their union


@q("win01_keyword_ranks", sql("ch", *_KW20, "SELECT query, id, rnk::INT AS rank, round(0.6::DOUBLE / (60 + rnk), 8) AS part FROM kw"))
def _(s, d):
    return keyword(s, d).select("query", "id", "rank", F.round(code.rrf(F.col("rank"), 0.6), 8).alias("part"))


@q(
    "join08_merged_signals",
    sql(
        "sy", *_KW20, _SYM, _SPARSE, _SPL,
        "al AS (SELECT query, id, 'kw' AS s, rnk FROM kw UNION ALL SELECT query, id, 'sm', rnk FROM sm UNION ALL SELECT query, id, 'sp', rnk FROM sp)",
        "SELECT query, id, max(rnk) FILTER (s = 'kw')::INT AS keyword_rank, max(rnk) FILTER (s = 'sm')::INT AS symbol_rank, max(rnk) FILTER (s = 'sp')::INT AS sparse_rank, count(*)::BIGINT AS signals FROM al GROUP BY query, id",
    ),
)
def _(s, d):
    """Rank lists merged on the chunk: one row per chunk with its place in each list, null where it has none."""
    asked = question_terms(s).select("query", F.col("term").alias("token"), F.lit(1.0).alias("weight"))
    lists = {"keyword": keyword(s, d), "symbol": symbol_list(s, d), "sparse": T.sparse_search(sparse(s, d), asked, 20)}
    every = None
    for name, rows in lists.items():
        part = rows.select("query", "id", F.lit(name).alias("s"), "rank")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query", "id").agg(*(F.max(F.when(F.col("s") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists), F.count(F.lit(1)).alias("signals"))


@q("ret23_sparse_postings", sql("ch", _SPARSE, _TERMS, "SELECT query, id, round(score, 6) AS score FROM (SELECT query, id, sum(weight * length(token))::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY sum(weight * length(token)) DESC, id) AS rn FROM sv JOIN qt ON qt.term = sv.token GROUP BY query, id) WHERE rn <= 15"))
def _(s, d):
    """Postings of the tokens asked for, weighed by the query, negative scores kept."""
    asked = question_terms(s).select("query", F.col("term").alias("token"), F.length("term").cast("double").alias("weight"))
    return T.sparse_search(sparse(s, d), asked, 15).select("query", "id", F.round("score", 6).alias("score"))


@q("topk08_final_limit", sql("sy", *_KW20, _SYM, _SPARSE, _SPL, _FUSE, "SELECT query, id FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rn FROM fu) WHERE rn <= least(7, 100)"))
def _(s, d):
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")
    return fused(s, d).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= min(7, 100)).select("query", "id")


@q("set01_repositories_united", sql("ch", *_KW20, "SELECT 'first' AS repo, query, kw.id, round(score, 6) AS score FROM kw JOIN ch ON ch.id = kw.id WHERE file_id % 2 = 0 UNION ALL SELECT 'second', query, kw.id, round(score * 0.8, 6) FROM kw JOIN ch ON ch.id = kw.id WHERE file_id % 2 = 1"))
def _(s, d):
    """Results of two repositories, those of the second at its priority of 0.8."""
    r = materialize(keyword(s, d).join(M.chunks(s, d, "file_id"), "id"), "results")
    part = lambda name, rest, priority: r.filter(F.col("file_id") % 2 == rest).select(F.lit(name).alias("repo"), "query", "id", F.round(F.col("score") * priority, 6).alias("score"))
    return part("first", 0, 1.0).unionByName(part("second", 1, 0.8))


_NB = "nb AS (SELECT source_id AS id, target_id AS near FROM dp UNION SELECT target_id, source_id FROM dp)"


@q(
    "set03_neighbourhood_appended",
    sql(
        "ch", *_KW20, "dp", _NB,
        "h AS (SELECT query, id, 0 AS src, rnk AS pos FROM kw WHERE rnk <= 10)",
        "n AS (SELECT query, near AS id, 1 AS src, min(h.pos) * 100000 + near AS pos FROM h JOIN nb USING (id) WHERE (query, near) NOT IN (SELECT (query, id) FROM h) GROUP BY query, near)",
        "SELECT query, id, rn::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY src, pos) AS rn FROM (SELECT * FROM h UNION ALL SELECT * FROM n)) WHERE rn <= 16",
    ),
)
def _(s, d):
    """Direct hits in their order, then the neighbours of the best of them, sixteen in all."""
    h = materialize(keyword(s, d, 10).select("query", "id", F.lit(0).alias("src"), F.col("rank").cast("long").alias("pos")), "hits")
    near = G.both_ways(M.dependencies(s, d)).select(F.col("source_id").alias("id"), F.col("target_id").alias("near"))
    n = h.join(near, "id").groupBy("query", F.col("near").alias("id")).agg(F.min("pos").alias("p")).join(h.select("query", "id"), ["query", "id"], "left_anti")
    every = h.unionByName(n.select("query", "id", F.lit(1).alias("src"), (F.col("p") * 100000 + F.col("id")).alias("pos")))
    return every.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("src", "pos"))).filter("position <= 16").select("query", "id", "position")


@q("ret26_search_with_neighbours", sql("sy", *_KW20, _SYM, _SPARSE, _SPL, _FUSE, "dp", _NB, "SELECT query, near AS id, round(max(score), 6) AS score, count(*)::BIGINT AS anchors FROM fu JOIN nb USING (id) GROUP BY query, near"))
def _(s, d):
    """The neighbours of the results, each at the best score of the results it is a neighbour of."""
    near = G.both_ways(M.dependencies(s, d)).select(F.col("source_id").alias("id"), F.col("target_id").alias("near"))
    return fused(s, d).join(near, "id").groupBy("query", F.col("near").alias("id")).agg(F.round(F.max("score"), 6).alias("score"), F.count(F.lit(1)).alias("anchors"))


# ---------------------------------------------------------------- graph features of results

_ATT = "(" + graph.SQL["gra18_attention"] + ")"
_PCT = "(SELECT node, (row_number() OVER (ORDER BY rank, node) - 1) / count(*) OVER ()::DOUBLE AS percentile FROM (" + graph.SQL["gra12_pagerank"] + "))"
_BUG = "(" + history.SQL["agg16_bug_boost"] + ")"
_NEW = "(" + further.SQL["fil20_changed_lately"] + ")"
_FRS = "(" + aggregates.SQL["win08_freshness"] + ")"


@q("join06_attention_of_results", sql("ch", *_KW20, f"SELECT query, kw.id, coalesce(attention, 0)::DOUBLE AS attention FROM kw LEFT JOIN {_ATT} a ON a.node = kw.id"))
def _(s, d):
    a = graph.QUERIES["gra18_attention"](s, d).withColumnRenamed("node", "id")
    return keyword(s, d).select("query", "id").join(a, "id", "left").select("query", "id", F.coalesce("attention", F.lit(0.0)).alias("attention"))


_FEATURES = [
    "top AS (SELECT query, id FROM kw WHERE rnk = 1)", _NB,
    "w1 AS (SELECT DISTINCT query, top.id AS start, near AS id FROM top JOIN nb USING (id))", "w2 AS (SELECT DISTINCT query, start, nb.near AS id FROM w1 JOIN nb USING (id) WHERE nb.near <> start)",
    "ds AS (SELECT query, id, min(x) AS distance FROM (SELECT query, id, 1 AS x FROM w1 WHERE id <> start UNION ALL SELECT query, id, 2 FROM w2) GROUP BY ALL)",
    "dg AS (SELECT target_id AS id, count(*)::DOUBLE AS in_degree FROM dp GROUP BY 1)",
    f"ft AS (SELECT kw.query, kw.id, in_degree, percentile, distance, b.boost AS bug, freshness, changed AS branch FROM kw JOIN ch ON ch.id = kw.id LEFT JOIN fl ON fl.id = ch.file_id LEFT JOIN {_BUG} b ON b.path = fl.path LEFT JOIN {_FRS} f ON f.id = ch.file_id LEFT JOIN {_NEW} n ON n.id = ch.file_id LEFT JOIN dg ON dg.id = kw.id LEFT JOIN {_PCT} p ON p.node = kw.id LEFT JOIN ds ON ds.query = kw.query AND ds.id = kw.id)",
]


@q("join07_features_of_results", sql("ch", "fl", *_KW20, "dp", *_FEATURES, "SELECT query, id, coalesce(in_degree, 0)::DOUBLE AS in_degree, round(coalesce(percentile, 0), 6)::DOUBLE AS percentile, distance::BIGINT AS distance, coalesce(bug, 1)::DOUBLE AS bug, coalesce(branch, false) AS branch FROM ft"))
def _(s, d):
    """Features of results joined from their tables, those that are missing at their neutral value."""
    r = features(s, d, materialize(keyword(s, d).select("query", "id", "rank"), "results"))
    return r.select("query", "id", F.coalesce("in_degree", F.lit(0.0)).alias("in_degree"), F.round(F.coalesce("percentile", F.lit(0.0)), 6).alias("percentile"), "distance", F.coalesce("bug", F.lit(1.0)).alias("bug"), F.coalesce("branch", F.lit(False)).alias("branch"))


@q(
    "ret28_graph_boosts",
    sql(
        "ch", "fl", *_KW20, "dp", *_FEATURES,
        "SELECT query, id, round((1 + 0.05 * least(coalesce(in_degree, 0), 20) + CASE distance WHEN 1 THEN 0.3 WHEN 2 THEN 0.1 ELSE 0 END + (coalesce(bug, 1) - 1) * 0.3 + 0.2 * coalesce(percentile, 0) + 0.15 * coalesce(freshness, 0) + CASE WHEN branch THEN 0.25 ELSE 0 END)::DOUBLE, 4) AS boost FROM ft",
    ),
)
def _(s, d):
    r = features(s, d, materialize(keyword(s, d).select("query", "id", "rank"), "results"))
    return r.select("query", "id", F.round(T.graph_boost(r), 4).alias("boost"))


@q("win03_importance_percentiles", f"SELECT path, round((row_number() OVER (ORDER BY importance, path) - 1) / count(*) OVER ()::DOUBLE, 6) AS percentile FROM ({graph.SQL['gra15_file_importance']})")
def _(s, d):
    return G.percentile(graph.QUERIES["gra15_file_importance"](s, d), "importance", "path").select("path", F.round("percentile", 6).alias("percentile"))


@q("topk06_ordered_neighbours", f"SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY distance, importance DESC, node)::INT AS position FROM ({graph.SQL['gra13_neighbour_files']}) n LEFT JOIN ({graph.SQL['gra15_file_importance']}) i ON i.path = n.node WHERE start LIKE '%5.rs'")
def _(s, d):
    n = graph.QUERIES["gra13_neighbour_files"](s, d).filter("start like '%5.rs'")
    i = graph.QUERIES["gra15_file_importance"](s, d).withColumnRenamed("path", "node")
    w = Window.partitionBy("start").orderBy("distance", F.col("importance").desc_nulls_last(), "node")
    return n.join(i, "node", "left").withColumn("position", F.row_number().over(w)).select("start", "node", "position")


@q("gra04_collected_nodes", f"SELECT start, list(DISTINCT node ORDER BY node) AS nodes FROM ({graph.SQL['gra02_upstream']}) WHERE node <> start GROUP BY start")
def _(s, d):
    return graph.QUERIES["gra02_upstream"](s, d).filter("node <> start").groupBy("start").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


@q("gra16_file_blast_radius", f"SELECT start, count(*)::BIGINT AS files, max(distance)::BIGINT AS farthest FROM ({graph.SQL['gra13_neighbour_files']}) GROUP BY start")
def _(s, d):
    """Files near each file without regard to direction, as the file graph counts them."""
    return graph.QUERIES["gra13_neighbour_files"](s, d).groupBy("start").agg(F.count(F.lit(1)).alias("files"), F.max("distance").alias("farthest"))


@q("gra31_flows_as_edges", f"SELECT source_id, target_id, 'data_flow' AS kind FROM ({graph.SQL['gra30_deduplicated_flows']})")
def _(s, d):
    return graph.QUERIES["gra30_deduplicated_flows"](s, d).select("source_id", "target_id", F.lit("data_flow").alias("kind"))


_FLOWS = f"al AS (SELECT source, target, confidence FROM ({graph.SQL['gra28_transitive_flows']}) UNION ALL SELECT source_id, target_id, 0.5 FROM ({graph.SQL['gra29_pattern_flows']}) UNION ALL SELECT source, target, confidence FROM ({graph.SQL['join24_return_to_argument_flows']}))"


@q("xtr06_all_flows", sql(_FLOWS, "SELECT source, target, round(max(confidence), 6)::DOUBLE AS confidence FROM al WHERE source <> target GROUP BY ALL HAVING max(confidence) >= 0.3"))
def _(s, d):
    """Flows of the three extractors, the surest of each pair."""
    a = graph.QUERIES["gra28_transitive_flows"](s, d).select("source", "target", "confidence")
    b = graph.QUERIES["gra29_pattern_flows"](s, d).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.lit(0.5).alias("confidence"))
    c = graph.QUERIES["join24_return_to_argument_flows"](s, d).select("source", "target", "confidence")
    every = a.unionByName(b).unionByName(c).filter("source <> target").groupBy("source", "target").agg(F.max("confidence").alias("c"))
    return every.filter("c >= 0.3").select("source", "target", F.round("c", 6).alias("confidence"))


@q("gra26_filtered_walks")
def _(s, d):
    """Neighbourhoods over calls and data flows alone."""
    e = M.dependencies(s, d)
    starts = e.select(F.col("source_id").alias("node")).distinct().filter("node % 10 = 0")
    return G.reasoning(e, starts, 3, kinds=["calls", "data_flow"]).select("start", "node", "hops", F.round("score", 6).alias("score"))


@q("agg34_risk_levels", sql("dp", "SELECT target_id AS id, CASE WHEN count(*) > 50 THEN 'critical' WHEN count(*) > 20 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS risk FROM dp GROUP BY 1"))
def _(s, d):
    return M.dependencies(s, d).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).select("id", code.risk_level(F.col("n")).alias("risk"))


@q("agg36_results_by_file", sql("ch", *_KW20, "SELECT query, file_id, min(rnk)::INT AS first, list(kw.id ORDER BY rnk) AS ids FROM kw JOIN ch ON ch.id = kw.id GROUP BY ALL"))
def _(s, d):
    """Results grouped by file, files and entries in the order of the list."""
    r = keyword(s, d).join(M.chunks(s, d, "file_id"), "id")
    g = r.groupBy("query", "file_id").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("e"))
    return g.select("query", "file_id", "first", F.transform("e", lambda x: x["id"]).alias("ids"))


_X = "x AS (SELECT kind, content, doc_comment, string_split(symbol_path, '::')[-1] AS name FROM ch)"
_FN = "count(*) FILTER (kind = 'function')"
_HABITS = {
    "agg27_logging_habits": ("logging", "kind = 'function' AND lower(content) LIKE '%log%'", "kind = 'function'"),
    "agg28_naming_habits": ("naming", "kind = 'function' AND name LIKE '%_%'", "kind = 'function'"),
    "agg29_testing_habits": ("testing", "kind = 'test'", "kind = 'function'"),
    "agg30_documentation_habits": ("documented", "kind IN ('function','class','trait') AND doc_comment IS NOT NULL", "kind IN ('function','class','trait')"),
}


def _habit(name: str, pattern: str, hit: str, of: str):  # noqa: ANN202
    confidence = "least(1.0, 2 * n / nullif(of_n, 0)::DOUBLE)" if pattern == "testing" else "least(1.0, n / nullif(of_n, 0)::DOUBLE)"

    @q(name, sql("ch", _X, f"SELECT '{pattern}' AS pattern, n::BIGINT AS n, of_n::BIGINT AS of_n, round({confidence}, 6) AS confidence FROM (SELECT count(*) FILTER ({hit}) AS n, count(*) FILTER ({of}) AS of_n FROM x)"))
    def _(s, d):
        return P.confidences(P.code_patterns(M.chunks(s, d, "kind", "content", "doc_comment", "symbol_path"), [pattern]))


for _name, (_pattern, _hit, _of) in _HABITS.items():
    _habit(_name, _pattern, _hit, _of)


@q("agg31_habits_by_confidence", sql("ch", _X, "h AS (" + " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) FILTER ({h}) AS n, count(*) FILTER ({o}) AS of_n FROM x" for p, h, o in _HABITS.values()) + ")", "SELECT pattern, row_number() OVER (ORDER BY c DESC, pattern)::INT AS position FROM (SELECT pattern, round(least(1.0, CASE WHEN pattern = 'testing' THEN 2 ELSE 1 END * n / nullif(of_n, 0)::DOUBLE), 6) AS c FROM h)"))
def _(s, d):
    found = P.confidences(P.code_patterns(M.chunks(s, d, "kind", "content", "doc_comment", "symbol_path"), [p for p, *_ in _HABITS.values()]))
    return found.select("pattern", F.row_number().over(Window.orderBy(F.col("confidence").desc(), "pattern")).alias("position"))  # four rows


# ---------------------------------------------------------------- queries made wider

_QS = "qs(query, text) AS (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in QUESTIONS.items()) + ", ('q6', 'Parser::parse fails in async tests'), ('q7', 'login config'))"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def asked(s):
    return s.createDataFrame([*QUESTIONS.items(), ("q6", "Parser::parse fails in async tests"), ("q7", "login config")], "query string, text string")


_GROUPS_SQL = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words.split()) + " THEN [" + ", ".join(f"'{t}'" for t in terms.split()) + "] ELSE []::VARCHAR[] END" for words, terms in X.GROUPS)
_OWN = r"list_filter(list_transform(regexp_split_to_array(trim(text), '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}_:]+|[^\p{L}\p{N}_:]+$', '', 'g')), lambda w: length(w) > 2)"
_EXPANDED = f"ex AS (SELECT query, list_concat([text], {_GROUPS_SQL}, {_OWN}) AS l FROM qs)"


@q("str06_expanded_terms", sql(_QS, _EXPANDED, f"SELECT query, array_to_string({_FIRST.format('l')}, '|') AS terms FROM ex"))
def _(s, d):
    return asked(s).select("query", F.array_join(X.expanded_terms(F.col("text")), "|").alias("terms"))


@q("set08_terms_united", sql(_QS, _EXPANDED, f"SELECT term, count(*)::BIGINT AS queries FROM (SELECT query, unnest({_FIRST.format('l')}) AS term FROM ex) GROUP BY term"))
def _(s, d):
    return asked(s).select(F.explode(X.expanded_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("queries"))


BASES = ["cache", "parse", "test", "config", "index", "log", "update", "fix", "handle", "queue", "hash", "document", "use", "read"]
_BASES = "[" + ", ".join(f"'{x}'" for x in BASES) + "]"
_STRIP = "CASE " + " ".join(
    f"WHEN ends_with(w, '{x}') AND length(w) > {len(x) + 2} AND list_contains({_BASES}, left(w, length(w) - {len(x)})) THEN left(w, length(w) - {len(x)})"
    f" WHEN ends_with(w, '{x}') AND length(w) > {len(x) + 2} AND list_contains({_BASES}, left(w, length(w) - {len(x)}) || 'e') THEN left(w, length(w) - {len(x)}) || 'e'" for x in X.SUFFIXES
) + " ELSE w END"


@q("str05_base_forms", sql("cm", r"wd AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(message), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM cm WHERE message IS NOT NULL UNION SELECT unnest(['caching', 'parsed', 'tests', 'configuration', 'logger', 'hashes', 'handling', 'useless', 'ed', 'documentation']))", f"SELECT w AS word, {_STRIP} AS base FROM wd"))
def _(s, d):
    words = M.commits(s, d).select(F.explode(T.words(F.col("message"))).alias("word")).union(s.createDataFrame([(x,) for x in "caching parsed tests configuration logger hashes handling useless ed documentation".split()], "word string"))
    return words.distinct().select("word", X.base_form(F.col("word"), BASES).alias("base"))


_ENTITY = "(" + further.SQL["str12_primary_entities"] + ")"
_SHAPES = "CASE i " + " ".join("WHEN '" + k + "' THEN '" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for k, t in X.SHAPES.items()) + " END"


def _hyde(name: str, intent_sql: str, intent):  # noqa: ANN001, ANN202
    @q(name, f"SELECT hash, md5(replace(replace({_SHAPES}, '{{e}}', entity), '{{i}}', regexp_replace(lower(entity), '[^a-z0-9]+', '_', 'g'))) AS text FROM (SELECT *, {intent_sql} AS i FROM {_ENTITY}) WHERE entity <> ''")
    def _(s, d):
        e = further.QUERIES["str12_primary_entities"](s, d)
        return e.select("hash", F.md5(X.hypothetical(F.col("entity"), intent(F.col("hash")))).alias("text")).filter("text is not null")


_hyde("str10_hypothetical_documents", "'unknown'", lambda h: F.lit("unknown"))
_hyde(
    "str11_hypothetical_documents_by_intent",
    "CASE WHEN hash < '4' THEN 'debug' WHEN hash < '8' THEN 'test_coverage' WHEN hash < 'c' THEN 'explain' ELSE 'generate' END",
    lambda h: F.when(h < "4", "debug").when(h < "8", "test_coverage").when(h < "c", "explain").otherwise("generate"),
)


@q("str41_calibrated", "SELECT event_id, round(1 / (1 + exp(-(1.0 * value + 0.0)))::DOUBLE, 8) AS p FROM events WHERE value BETWEEN -30 AND 30")
def _(s, d):
    x = table(s, d, "events").filter("value between -30 and 30")
    return x.select("event_id", F.round(1 / (1 + F.exp(-(F.lit(1.0) * F.col("value") + F.lit(0.0)))), 8).alias("p"))


# ---------------------------------------------------------------- vectors

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"


def _dot(a: str, b: str):  # noqa: ANN202
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


@q("ret11_dot_products", sql(_V, "SELECT a.id, round(list_dot_product(a.e, b.e), 6) AS dot FROM v a JOIN v b ON b.id = a.id + 1"))
def _(s, d):
    v = vectors(s, d)
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("w")), "id").select("id", F.round(_dot("vector", "w"), 6).alias("dot"))


@q("ret13_cosines", sql(_V, "SELECT a.id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 2"))
def _(s, d):
    v = vectors(s, d)
    j = v.join(v.select((F.col("id") - 2).alias("id"), F.col("vector").alias("w")), "id")
    return j.select("id", F.round(_dot("vector", "w") / F.sqrt(_dot("vector", "vector") * _dot("w", "w")), 6).alias("cosine"))


@q("ret05_search_without_deleted", sql(_V, "k AS (SELECT a.id AS query, b.id, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.e, b.e) DESC, b.id) AS rn FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0)", "SELECT query, id FROM k WHERE rn <= 10 AND id % 6 <> 1"))
def _(s, d):
    """The ten nearest, those that are deleted left out afterwards, so that fewer may come back."""
    v = vectors(s, d)
    return T.knn(v, v.filter("id % 20 = 0"), 10).filter("id % 6 <> 1").select("query", "id")


@q("ret08_compacted_vectors", "SELECT vec_id AS id, len(embedding)::BIGINT AS size FROM embeddings WHERE vec_id % 6 <> 1")
def _(s, d):
    v = materialize(vectors(s, d), "vectors")
    gone = v.filter("id % 6 = 1").select("id")
    return v.join(F.broadcast(gone) if gone.count() <= M.BROADCAST_ROWS else gone, "id", "left_anti").select("id", F.size("vector").cast("long").alias("size"))


@q("ret10_vectors_replaced", "SELECT vec_id AS id, round(CASE WHEN vec_id % 4 = 0 THEN embedding[2] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings")
def _(s, d):
    """Vectors put again under their id replace the old ones; those of another size are refused."""
    from quillspan.operators.relational import upsert

    v = materialize(vectors(s, d), "vectors")
    new = v.filter("id % 4 = 0").select("id", F.concat(F.slice("vector", 2, 1), F.slice("vector", F.lit(2), F.size("vector") - 1)).alias("vector"))
    wrong = v.filter("id % 4 = 1").select("id", F.slice("vector", 1, 3).alias("vector"))
    size = v.agg(F.max(F.size("vector")).alias("n"))
    good = new.unionByName(wrong).join(F.broadcast(size), how="cross").filter(F.size("vector") == F.col("n")).select("id", "vector")
    return upsert(v, good, ["id"]).select("id", F.round(F.col("vector")[0], 6).alias("first"))


@q("ret07_index_by_size", "SELECT CASE WHEN count(*) < 5000 THEN 'exact' WHEN count(*) < 50000 THEN 'cells' ELSE 'cells' END AS index, count(*)::BIGINT AS vectors FROM embeddings")
def _(s, d):
    return vectors(s, d).agg(F.count(F.lit(1)).alias("vectors")).select(F.when(F.col("vectors") < T.EXACT_VECTORS, "exact").otherwise("cells").alias("index"), "vectors")


@q("ret06_best_search")
def _(s, d):
    """Exact search of few vectors, the inverted file for many."""
    v = vectors(s, d)
    return T.best_search(v, v.filter("id % 20 = 0"), 10).select("query", "id", F.round("score", 6).alias("score"))


@q("ret03_cells")
def _(s, d):
    return T.InvertedFile(vectors(s, d)).rows.groupBy("cell").agg(F.count(F.lit(1)).alias("vectors"))


@q("ret43_stale_vectors", "SELECT vec_id AS id, md5(label::VARCHAR) <> md5('3') AS stale FROM embeddings")
def _(s, d):
    """Vectors whose stored fingerprint of the model is not the present one."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.md5(F.col("label").cast("string")) != F.md5(F.lit("3"))).alias("stale"))


# ---------------------------------------------------------------- reranking by shared words

_LEX = r"lx AS (SELECT kw.query, kw.id, kw.rnk, (SELECT count(*) FROM qt WHERE qt.query = kw.query AND list_contains(regexp_split_to_array(lower(coalesce(content, '')), '[^\p{L}\p{N}]+'), qt.term)) / (SELECT count(*) FROM qt WHERE qt.query = kw.query)::DOUBLE AS s FROM kw JOIN ch ON ch.id = kw.id)"


def lexical(s, d):
    """(query, id, rank, s): the part of the query's words that each result has, the score of a reranker without a model."""
    r = keyword(s, d).select("query", "id", "rank").join(M.chunks(s, d, "content"), "id").withColumn("w", F.coalesce(T.words(F.col("content")), F.array().cast("array<string>")))
    t = question_terms(s).groupBy("query").agg(F.collect_set("term").alias("t"))
    return r.join(F.broadcast(t), "query").select("query", "id", "rank", (F.size(F.array_intersect("t", "w")) / F.size("t")).alias("s"))


@q("ret30_reranked", sql("ch", *_KW20, _LEX, "SELECT query, id, round(s, 6) AS score FROM lx"))
def _(s, d):
    return lexical(s, d).select("query", "id", F.round("s", 6).alias("score"))


@q("ret31_reranked_until_poor", sql("ch", *_KW20, _LEX, "b AS (SELECT query, (rnk - 1) // 4 AS batch, max(s) AS m FROM lx GROUP BY ALL)", "p AS (SELECT query, min(batch) AS poor FROM b WHERE m < 0.7 GROUP BY query)", "SELECT lx.query, id, round(CASE WHEN (rnk - 1) // 4 <= coalesce(poor, 1000) THEN s END, 6) AS score FROM lx LEFT JOIN p ON p.query = lx.query"))
def _(s, d):
    return T.until_poor(lexical(s, d), 4, 0.7).select("query", "id", F.round("score", 6).alias("score"))


@q("ret32_calibration_from_feedback")
def _(s, d):
    """Slope and offset of the calibration after a hundred rounds over feedback (score, whether it was of use)."""
    e = table(s, d, "events").filter("value is not null").select((F.col("value") / 100).alias("score"), (F.col("event_type") == "purchase").alias("useful"))
    return T.calibrated(e)


# ---------------------------------------------------------------- context


@q("ctx17_prioritised_entries", sql("ch", "fl", *_KW20, "SELECT query, kw.id, CASE WHEN regexp_matches(lower(fl.path), '(^|/)(tests?|__tests__|specs?)/') THEN 'high' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS priority FROM kw JOIN ch ON ch.id = kw.id JOIN fl ON fl.id = ch.file_id WHERE ch.kind <> 'test'"))
def _(s, d):
    """Results without the kinds that the strategy leaves out (tests), and their priority."""
    c = M.chunks(s, d, "file_id", "kind").filter("kind <> 'test'").join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id")
    r = keyword(s, d).join(c, "id")
    in_tests = F.lower("path").rlike(r"(?:^|/)(?:tests?|__tests__|specs?)/")
    return r.select("query", "id", code.priority(F.col("score"), F.lit(False), in_tests, F.lit(False)).alias("priority"))


@q("ctx20_packed_greedily")
def _(s, d):
    r = keyword(s, d).join(M.chunks(s, d, "token_count"), "id")
    return C.greedy_pack(r.select("query", "id", "score", "token_count"), 2000).select("query", "id")


@q("ctx25_rendered_window", sql("ch", "fl", *_KW20, "SELECT query, md5(string_agg('// file: ' || coalesce(fl.path, '?') || chr(10) || coalesce(ch.content, ''), chr(10) || chr(10) ORDER BY rnk)) AS text FROM kw JOIN ch ON ch.id = kw.id LEFT JOIN fl ON fl.id = ch.file_id GROUP BY query"))
def _(s, d):
    c = M.chunks(s, d, "file_id", "content").join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    return C.render(keyword(s, d).select("query", "id", F.col("rank").alias("position")).join(c, "id")).select("query", F.md5("text").alias("text"))


@q("xtr44_compression_factors", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in C.COMPRESSION.items()) + ") t(priority, factor)")
def _(s, d):
    p = s.createDataFrame([(k,) for k in C.COMPRESSION], "priority string")
    return p.select("priority", code.lookup(F.col("priority"), C.COMPRESSION).alias("factor"))


@q("xtr38_element_heads", sql("ch", r"SELECT id, list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '^\s*(@|#\[|//|#!|/\*|\*)'))[1] AS head FROM ch WHERE content IS NOT NULL AND kind IN ('function','class','trait')"))
def _(s, d):
    """The line that defines an element, annotations and comments before it left out."""
    line = F.get(F.filter(F.split("content", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(?:@|#\[|//|#!|/\*|\*)")), 0)
    return M.chunks(s, d, "kind", "content").filter("content is not null and kind in ('function', 'class', 'trait')").select("id", line.alias("head"))


_HEAD = "'// ' || fl.language || ' ' || fl.path || chr(10) || '// ' || ch.kind || ' ' || coalesce(symbol_path, '')"


def _headed(s, d):
    c = M.chunks(s, d, "file_id", "kind", "symbol_path", "content", "weight").filter("content is not null").join(M.files(s, d).select(F.col("id").alias("file_id"), "path", "language"), "file_id")
    head = F.concat(F.lit("// "), "language", F.lit(" "), "path", F.lit("\n// "), "kind", F.lit(" "), F.coalesce("symbol_path", F.lit("")))
    return c.withColumn("head", head)


@q("ctx04_headers", sql("ch", "fl", f"SELECT ch.id, {_HEAD} AS head FROM ch JOIN fl ON fl.id = ch.file_id WHERE content IS NOT NULL"))
def _(s, d):
    return _headed(s, d).select("id", "head")


@q("xtr40_chunks_with_headers", sql("ch", "fl", f"SELECT ch.id, md5({_HEAD} || chr(10) || content) AS content FROM ch JOIN fl ON fl.id = ch.file_id WHERE content IS NOT NULL"))
def _(s, d):
    return _headed(s, d).select("id", F.md5(F.concat("head", F.lit("\n"), "content")).alias("content"))


_PREFIX = "(" + context.SQL["ctx13_context_prefixes"] + ")"


@q("xtr41_chunks_with_prefixes", sql("ch", f"SELECT ch.id, md5(p.prefix || chr(10) || chr(10) || content) AS content FROM ch JOIN {_PREFIX} p USING (id) WHERE content IS NOT NULL"))
def _(s, d):
    p = context.QUERIES["ctx13_context_prefixes"](s, d)
    return M.chunks(s, d, "content").filter("content is not null").join(p, "id").select("id", F.md5(F.concat("prefix", F.lit("\n\n"), "content")).alias("content"))


@q("xtr60_graph_metrics", f"SELECT edge_type, edges FROM ({aggregates.SQL['agg09_edges_by_type']}) UNION ALL SELECT 'all', sum(edges)::BIGINT FROM ({aggregates.SQL['agg09_edges_by_type']})")
def _(s, d):
    e = materialize(aggregates.QUERIES["agg09_edges_by_type"](s, d), "edges-by-type").select("edge_type", "edges")
    return e.union(e.agg(F.lit("all").alias("edge_type"), F.sum("edges").alias("edges")))


@q("xtr61_module_map_json", f"SELECT '{{\"directory\":\"' || directory || '\",\"files\":' || files || ',\"functions\":' || functions || ',\"types\":' || types || '}}' AS json FROM ({aggregates.SQL['agg32_module_map']})")
def _(s, d):
    return aggregates.QUERIES["agg32_module_map"](s, d).select(F.to_json(F.struct("directory", "files", "functions", "types")).alias("json"))


@q("stm09_stale_tasks", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND ts < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def _(s, d):
    """The work in flight of each key that has been there for longer than twelve hours."""
    e = table(s, d, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id", "m.ts")
    return last.join(F.broadcast(e.agg(F.max("ts").alias("now"))), how="cross").filter("ts < now - interval 12 hours").select("user_id", "event_id")

