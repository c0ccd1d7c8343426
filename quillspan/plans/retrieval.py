"""Ranked retrieval (reference section 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.operators import context as C
from quillspan.operators import graph as G
from quillspan.operators import history as H
from quillspan.operators import retrieval as T
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.session import materialize
from quillspan.sources import model as M
from quillspan.sources.tables import table

q = Book()
QUERIES, SQL = q.queries, q.sql

QUESTIONS = {
    "q1": "rejects a snapshot that is larger than the report",
    "q2": "callers must hold the lock",
    "q3": "encoder inverse",
    "q4": "where is the queue configured",
    "q5": "oldest first ties by key",
}


def question_terms(s):
    rows = [(k, w) for k, t in QUESTIONS.items() for w in t.split() if w not in code.STOP_WORDS]
    return s.createDataFrame(rows, "query string, term string")


_TERMS = "qt(query, term) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, t in QUESTIONS.items() for w in t.split() if w not in code.STOP_WORDS) + ")"


def _bm25_sql(source: str, fields: dict[str, float], limit: int, strict: bool) -> list[str]:
    def ws(f: str) -> str:
        return rf"list_filter(regexp_split_to_array(lower(coalesce({f}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

    size = " + ".join(f"len({ws(f)})" for f in fields)
    tf = " UNION ALL ".join(f"SELECT id, unnest({ws(f)}) AS term, {x}::DOUBLE AS x FROM {source}" for f, x in fields.items())
    out = [
        _TERMS,
        f"sz AS (SELECT id, {size} AS len FROM {source})",
        "ss AS (SELECT count(*)::DOUBLE AS n, avg(len) AS av FROM sz)",
        f"tf AS (SELECT id, term, sum(x) AS tf FROM ({tf}) WHERE term IN (SELECT term FROM qt) GROUP BY ALL)",
        "df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term)",
        f"sc AS (SELECT qt.query, tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {T.K1 + 1}::DOUBLE / (tf + {T.K1}::DOUBLE * (1 - {T.B}::DOUBLE + {T.B}::DOUBLE * len / av))) AS score, count(*) AS hits FROM tf JOIN df USING (term) JOIN sz USING (id) JOIN qt USING (term) CROSS JOIN ss GROUP BY ALL)",
    ]
    if strict:
        out.append("tc AS (SELECT query, count(*) AS terms FROM qt GROUP BY query)")
        out.append("wh AS (SELECT DISTINCT query FROM sc JOIN tc USING (query) WHERE hits = terms)")
        out.append("se AS (SELECT sc.* FROM sc JOIN tc USING (query) WHERE query NOT IN (SELECT query FROM wh) OR hits = terms)")
    else:
        out.append("se AS (SELECT * FROM sc)")
    out.append(f"kw AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rnk FROM se QUALIFY rnk <= {limit})")
    return out


_FIELDS = {"content": 1.0, "doc_comment": 0.5, "symbol_path": 2.0}


@q("ret01_keyword_search", sql("ch", *_bm25_sql("ch", _FIELDS, 20, True), "SELECT query, id, round(score, 6) AS score FROM kw"))
def _(s, d):
    docs = M.chunks(s, d, "content", "doc_comment", "symbol_path")
    return T.bm25(docs, "id", _FIELDS, question_terms(s), 20).select("query", "id", F.round("score", 6).alias("score"))


@q("topk02_search_commits", sql("cm", "cd AS (SELECT hash AS id, message, summary, author FROM cm)", *_bm25_sql("cd", {"message": 1.0, "summary": 1.0, "author": 1.0}, 10, True), "SELECT query, id, round(score, 6) AS score FROM kw"))
def _(s, d):
    docs = M.commits(s, d).select(F.col("hash").alias("id"), "message", "summary", "author")
    return T.bm25(docs, "id", {"message": 1.0, "summary": 1.0, "author": 1.0}, question_terms(s), 10).select("query", "id", F.round("score", 6).alias("score"))


@q("ret35_search_documents", sql("dc AS (SELECT doc_id AS id, text FROM documents)", *_bm25_sql("dc", {"text": 1.0}, 10, False), "SELECT query, id, round(score, 6) AS score FROM kw"))
def _(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return T.bm25(docs, "id", {"text": 1.0}, question_terms(s), 10, require_all=False).select("query", "id", F.round("score", 6).alias("score"))


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"


def _knn_sql(score: str, k: int) -> str:
    return sql(_VEC, f"SELECT query, id, round(score, 6) AS score FROM (SELECT a.id AS query, b.id, {score} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {score} DESC, b.id) AS rn FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0) WHERE rn <= {k}")


@q("topk01_vector_search", _knn_sql("list_dot_product(a.e, b.e)", 10))
def _(s, d):
    v = vectors(s, d)
    return T.knn(v, v.filter("id % 20 = 0"), 10).select("query", "id", F.round("score", 6).alias("score"))


@q("ret12_euclidean_search", _knn_sql("-power(list_distance(a.e, b.e), 2)", 5))
def _(s, d):
    v = vectors(s, d)
    return T.knn(v, v.filter("id % 20 = 0"), 5, "euclidean").select("query", "id", F.round("score", 6).alias("score"))


@q("ret02_ivf_search")
def _(s, d):
    v = vectors(s, d)
    return T.InvertedFile(v).search(v.filter("id % 20 = 0"), 10).select("query", "id", F.round("score", 6).alias("score"))


@q("ret02_ivf_recall")
def _(s, d):
    v = vectors(s, d)
    asked = v.filter("id % 20 = 0")
    return T.recall(T.InvertedFile(v).search(asked, 10), T.knn(v, asked, 10))


@q("ret14_normalised_vectors", sql(_VEC, "SELECT id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM v"))
def _(s, d):
    dot = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
    return vectors(s, d).select("id", F.round(F.sqrt(dot), 6).alias("norm"), F.round(F.col("vector")[0] / F.sqrt(dot), 6).alias("first"))


_SPARSE = r"sv AS (SELECT id, term AS token, count(*)::DOUBLE AS weight FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(coalesce(doc_comment, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM ch) GROUP BY ALL)"


def sparse(s, d):
    c = M.chunks(s, d, "doc_comment").select("id", F.explode(T.words(F.col("doc_comment"))).alias("token"))
    return c.groupBy("id", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@q("ret21_sparse_search", sql("ch", _SPARSE, _TERMS, "SELECT query, id, score, rn::INT AS rank FROM (SELECT query, id, sum(weight)::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY sum(weight) DESC, id) AS rn FROM sv JOIN qt ON qt.term = sv.token GROUP BY query, id) WHERE rn <= 10"))
def _(s, d):
    asked = question_terms(s).select("query", F.col("term").alias("token"), F.lit(1.0).alias("weight"))
    return T.sparse_search(sparse(s, d), asked, 10, positive=True).select("query", "id", "score", "rank")


@q("ret22_sparse_index", sql("ch", _SPARSE, "SELECT token, count(*)::BIGINT AS postings, max(weight) AS most FROM sv GROUP BY token"))
def _(s, d):
    return sparse(s, d).groupBy("token").agg(F.count(F.lit(1)).alias("postings"), F.max("weight").alias("most"))


_SYM = "sm AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY hits DESC, len, id) AS rnk FROM (SELECT qt.query, sy.chunk_id AS id, count(*) AS hits, length(sy.fqn) AS len FROM sy JOIN qt ON contains(lower(sy.name), qt.term) WHERE length(qt.term) >= 4 GROUP BY ALL) QUALIFY rnk <= 20)"


def symbol_list(s, d):
    from pyspark.sql import Window

    t = F.broadcast(question_terms(s).filter("length(term) >= 4"))
    hit = M.symbols(s, d).join(t, F.lower("name").contains(F.col("term"))).groupBy("query", F.col("chunk_id").alias("id"), F.length("fqn").alias("len")).agg(F.count(F.lit(1)).alias("hits"))
    w = Window.partitionBy("query").orderBy(F.col("hits").desc(), "len", "id")
    return hit.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select("query", "id", "rank")


_SPL = "sp AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY sum(weight) DESC, id) AS rnk FROM sv JOIN qt ON qt.term = sv.token GROUP BY query, id QUALIFY rnk <= 20)"
_KW, _SEM, _SYMW, _SPW = T.list_weights("natural_language", "unknown")
_FUSE = f"fu AS (SELECT query, id, sum(s) AS score FROM (SELECT query, id, {_KW}::DOUBLE / (60 + rnk) AS s FROM kw UNION ALL SELECT query, id, {_SYMW}::DOUBLE / (60 + rnk) FROM sm UNION ALL SELECT query, id, {_SPW}::DOUBLE / (60 + rnk) FROM sp) GROUP BY ALL)"


def fused(s, d):
    kw = T.bm25(M.chunks(s, d, "content", "doc_comment", "symbol_path"), "id", _FIELDS, question_terms(s), 20).select("query", "id", "rank")
    asked = question_terms(s).select("query", F.col("term").alias("token"), F.lit(1.0).alias("weight"))
    sp = T.sparse_search(sparse(s, d), asked, 20).select("query", "id", "rank")
    return T.fuse([(kw, _KW), (symbol_list(s, d), _SYMW), (sp, _SPW)])


@q("ret24_fused_ranks", sql("sy", *_bm25_sql("ch", _FIELDS, 20, True), _SYM, _SPARSE, _SPL, _FUSE, "SELECT query, id, round(score, 6) AS score FROM fu"))
def _(s, d):
    return fused(s, d).select("query", "id", F.round("score", 6).alias("score"))


_W = "CASE ch.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in code.KIND_WEIGHT.items()) + " END"
_V = "CASE ch.visibility " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in code.VISIBILITY_WEIGHT.items()) + " END"


@q(
    "ret27_boosted_results",
    sql(
        "sy", "fl", *_bm25_sql("ch", _FIELDS, 20, True), _SYM, _SPARSE, _SPL, _FUSE,
        "fr AS (SELECT id AS file_id, exp(-ln(2) / 168.0::DOUBLE * (epoch_us((SELECT max(indexed_at) FROM fl)) - epoch_us(indexed_at)) / 3.6e9) AS f FROM fl WHERE indexed_at IS NOT NULL)",
        f"SELECT query, fu.id, round((fu.score * (0.4 + 0.6 * {_W} * {_V}) * (1 + 0.15 * coalesce(f, 0)))::DOUBLE, 6) AS score FROM fu JOIN ch ON ch.id = fu.id LEFT JOIN fr USING (file_id)",
    ),
)
def _(s, d):
    fr = T.freshness(M.files(s, d).filter("indexed_at is not null"), "indexed_at").select(F.col("id").alias("file_id"), "freshness")
    c = M.chunks(s, d, "file_id", "kind", "visibility")
    r = fused(s, d).join(c, "id").join(fr, "file_id", "left")
    boost = F.lit(1.0) + F.lit(0.15) * F.coalesce("freshness", F.lit(0.0))
    return r.select("query", "id", F.round(code.structural_boost(F.col("score"), F.col("kind"), F.col("visibility"), boost), 6).alias("score"))


def features(s, d, rows):
    """``rows`` (query, id, rank) with file, in-degree, rank percentile, distance to the best result of the query, bugs,
    freshness and whether the file changed lately; what is missing is null."""
    from quillspan.plans import aggregates, further, graph, history

    e = materialize(M.dependencies(s, d), "edges")
    degree = e.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("in_degree"))
    percent = G.percentile(graph.QUERIES["gra12_pagerank"](s, d), "rank").withColumnRenamed("node", "id")
    anchor = rows.filter("rank = 1").select("query", F.col("id").alias("start"))
    near = G.reach(G.both_ways(e), anchor.select(F.col("start").alias("node")).distinct(), 2)
    near = anchor.join(near, "start").filter("node <> start").select("query", F.col("node").alias("id"), "distance")
    f = M.files(s, d).select(F.col("id").alias("file_id"), "path")
    bugs = history.QUERIES["agg16_bug_boost"](s, d).withColumnRenamed("boost", "bug")
    fresh = aggregates.QUERIES["win08_freshness"](s, d).withColumnRenamed("id", "file_id")
    branch = further.QUERIES["fil20_changed_lately"](s, d).select(F.col("id").alias("file_id"), F.col("changed").alias("branch"))
    out = rows.join(M.chunks(s, d, "file_id", "kind", "visibility", "line_start", "line_end", "token_count"), "id").join(f, "file_id", "left").join(bugs, "path", "left")
    out = out.join(fresh, "file_id", "left").join(branch, "file_id", "left").join(degree, "id", "left").join(percent, "id", "left").join(near, ["query", "id"], "left")
    return out.withColumns({"open": F.lit(False), "bug_scale": F.lit(0.3)})


def asked(s):
    """(query, text, type, intent, depth, bug_scale) and the weight of each list, per question."""
    rows = s.createDataFrame(list(QUESTIONS.items()), "query string, text string").select("query", "text", code.query_type(F.col("text")).alias("type"), code.intent(F.col("text")).alias("intent"))
    names = ("keyword", "semantic", "symbol", "sparse")
    own = {n: code.lookup(F.col("type"), {k: v[i] for k, v in T.LIST_WEIGHTS.items()}, 1.0) for i, n in enumerate(names)}
    by_intent = {n: code.lookup(F.col("intent"), {k: v[i] for k, v in T.INTENT_WEIGHTS.items()}, 1.0) for i, n in enumerate(names[:3])}
    weights = {f"w_{n}": own[n] * by_intent.get(n, F.lit(1.0)) for n in names}
    depth = code.lookup(F.col("intent"), {k: v[5] for k, v in code.STRATEGY.items()}, 2)
    scale = F.when(F.col("intent").isin("debug", "edit"), 1.0).when(F.col("intent") == "refactor", 0.6).otherwise(0.3)
    return rows.withColumns({**weights, "depth": depth, "bug_scale": scale})


def semantic_list(s, d, hits, limit: int = 20):
    """(query, id, rank): chunks by the vectors stored for them. Without a model a question has no vector of its own: it
    gets the mean of those of its best keyword hits that have one."""
    own = M.chunks(s, d, "vector_id").filter("vector_id is not null").join(vectors(s, d).withColumnRenamed("id", "vector_id"), "vector_id").select("id", "vector")
    own = materialize(own, "chunk-vectors")
    parts = hits.join(own, "id").select("query", F.posexplode("vector").alias("i", "x")).groupBy("query", "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector")).withColumn("no", F.crc32(F.col("query").cast("binary")))
    mean = materialize(mean, "question-vectors")
    found = T.knn(own, mean.select(F.col("no").alias("id"), "vector"), limit, exclude_self=False)
    return found.withColumnRenamed("query", "no").join(F.broadcast(mean.select("no", "query")), "no").select("query", "id", "rank")


def search(s, d, limit: int = 10, budget: int = 4000):
    """The whole hybrid search: four lists, fusion by the type and intent of each question, attention, the neighbourhood
    of the best symbols, boosts by graph and history, budget, overlap, limit; (query, id, file_id, score, ...)."""
    from pyspark.sql import Window

    from quillspan.functions import expansion as X
    from quillspan.plans import graph

    ask = materialize(asked(s), "questions")
    kw = materialize(T.bm25(M.chunks(s, d, "content", "doc_comment", "symbol_path"), "id", _FIELDS, question_terms(s), 20).select("query", "id", "rank"), "keyword-list")
    tokens = ask.select("query", F.explode(X.expanded_terms(F.col("text"))).alias("t")).select("query", F.explode(T.words(F.col("t"))).alias("token")).distinct()
    stop = s.createDataFrame([(w,) for w in code.STOP_WORDS], "token string")
    sp = T.sparse_search(sparse(s, d), tokens.join(F.broadcast(stop), "token", "left_anti").withColumn("weight", F.lit(1.0)), 20)
    lists = {"keyword": kw, "semantic": semantic_list(s, d, kw.filter("rank <= 10")), "symbol": symbol_list(s, d), "sparse": sp}
    every = None
    for name, rows in lists.items():
        part = rows.select("query", "id", "rank").join(F.broadcast(ask.select("query", F.col(f"w_{name}").alias("w"))), "query")
        part = part.select("query", "id", (F.col("w") / (F.lit(T.RRF_K) + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    f = every.groupBy("query", "id").agg(F.sum("s").alias("score"))
    att = graph.QUERIES["gra18_attention"](s, d).withColumnRenamed("node", "id")
    f = f.join(att, "id", "left").select("query", "id", (F.col("score") * (1 + 0.25 * F.coalesce("attention", F.lit(0.0)))).alias("score"))
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")
    f = materialize(f.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 4 * limit), "search")
    symbols = M.symbols(s, d).select(F.col("chunk_id").alias("id"))
    first = Window.partitionBy("query").orderBy("place")
    anchors = f.filter("place <= 5").join(symbols, "id", "left_semi").withColumn("n", F.row_number().over(first)).filter("n <= 3").select("query", F.col("id").alias("start"))
    anchors = materialize(anchors.join(F.broadcast(ask.select("query", "depth")), "query"), "anchors")
    e = materialize(M.dependencies(s, d), "edges")
    gar = None
    for r in ask.select("depth").distinct().collect():  # at most as many as there are intents
        own = anchors.filter(F.col("depth") == r["depth"])
        near = G.reasoning(e, own.select(F.col("start").alias("node")).distinct(), r["depth"], 20)
        near = own.join(near, "start").select("query", F.col("node").alias("id"), F.col("score").alias("g"))
        gar = near if gar is None else gar.unionByName(near)
    gar = gar.groupBy("query", "id").agg(F.least(F.max("g"), F.lit(0.5)).alias("g"))
    f = f.join(gar, ["query", "id"], "left").select("query", "id", (F.col("score") * (1 + F.coalesce("g", F.lit(0.0)))).alias("score"))
    top = materialize(f.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 2 * limit), "search-top")
    r = features(s, d, top).drop("bug_scale").join(F.broadcast(ask.select("query", "bug_scale")), "query")
    r = r.withColumn("boosted", code.structural_boost(F.col("score"), F.col("kind"), F.col("visibility"), T.graph_boost(r)))
    r = C.budget_prefix(r, budget)
    r = r.select("query", "id", "file_id", F.least("line_start", "line_end").alias("line_start"), F.greatest("line_start", "line_end").alias("line_end"), "token_count", F.col("boosted").alias("score"))
    r = r.fillna({"line_start": 1, "line_end": 1, "file_id": -1})
    r = C.overlap_dedup(r)
    return r.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


@q("ret25_hybrid_search")
def _(s, d):
    return search(s, d).select("query", "position", "id", F.round("score", 6).alias("score"))


@q("ret29_rerank_blend", sql("sy", *_bm25_sql("ch", _FIELDS, 20, True), _SYM, _SPARSE, _SPL, _FUSE, "bl AS (SELECT fu.query, fu.id, fu.score, kw.score AS k FROM fu LEFT JOIN kw USING (query, id))", "SELECT query, id, round(CASE WHEN k IS NULL THEN score * 0.5 ELSE score * 0.35 + 0.65 * CASE WHEN hi > lo THEN (k - lo) / (hi - lo) ELSE 0 END END, 7) AS score FROM bl JOIN (SELECT query, min(score) AS lo, max(score) AS hi FROM kw GROUP BY query) USING (query)"))
def _(s, d):
    kw = T.bm25(M.chunks(s, d, "content", "doc_comment", "symbol_path"), "id", _FIELDS, question_terms(s), 20)
    n = T.normalised(kw, "score").select("query", "id", "norm")
    return T.blend(fused(s, d).join(n, ["query", "id"], "left")).join(kw.select("query").distinct(), "query", "left_semi").select("query", "id", F.round("score", 7).alias("score"))


@q("ret34_symbol_cards", sql("sy", "fl", "dp", "SELECT sy.fqn, fl.path, (SELECT count(*) FROM dp WHERE source_id = sy.id)::BIGINT AS up, (SELECT count(*) FROM dp WHERE target_id = sy.id)::BIGINT AS down FROM sy JOIN fl ON fl.id = sy.file_id"))
def _(s, d):
    e = M.dependencies(s, d)
    up, down = e.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("up")), e.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("down"))
    y = M.symbols(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id")
    return y.join(up, "id", "left").join(down, "id", "left").fillna(0, ["up", "down"]).select("fqn", "path", "up", "down")


@q("ret36_commits_of_symbol_files", sql("sy", "fl", "cm", "cf", "SELECT sy.fqn, cf.hash FROM sy JOIN fl ON fl.id = sy.file_id JOIN cf ON cf.path = fl.path JOIN cm ON cm.hash = cf.hash"))
def _(s, d):
    y = M.symbols(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id").select("fqn", "path")
    return y.join(M.commit_files(s, d), "path").join(M.commits(s, d).select("hash"), "hash").select("fqn", "hash")


@q("fil18_filtered_search", sql("sy", "fl", *_bm25_sql("ch", _FIELDS, 20, True), "SELECT query, kw.id FROM kw JOIN ch ON ch.id = kw.id JOIN fl ON fl.id = ch.file_id WHERE fl.language = 'rust' AND ch.kind = 'function' AND fl.path LIKE '%/src/%'"))
def _(s, d):
    hits = T.bm25(M.chunks(s, d, "content", "doc_comment", "symbol_path"), "id", _FIELDS, question_terms(s), 20).select("query", "id")
    c = M.chunks(s, d, "file_id", "kind").filter("kind = 'function'")
    f = M.files(s, d).filter(F.col("language").eqNullSafe("rust") & F.col("path").contains("/src/")).select(F.col("id").alias("file_id"))
    return hits.join(c, "id").join(f, "file_id", "left_semi").select("query", "id")


@q("set04_graph_augmented_results", sql("sy", *_bm25_sql("ch", _FIELDS, 20, True), "dp", "nb AS (SELECT source_id AS id, target_id AS near FROM dp UNION SELECT target_id, source_id FROM dp)", "SELECT query, id, round(score, 6) AS score FROM kw UNION ALL SELECT query, near, round(max(top) * 0.5::DOUBLE * 0.6::DOUBLE, 6) FROM kw JOIN nb USING (id) JOIN (SELECT query, max(score) AS top FROM kw GROUP BY query) USING (query) WHERE (query, near) NOT IN (SELECT (query, id) FROM kw) GROUP BY query, near"))
def _(s, d):
    hits = materialize(T.bm25(M.chunks(s, d, "content", "doc_comment", "symbol_path"), "id", _FIELDS, question_terms(s), 20).select("query", "id", "score"), "hits")
    near = G.both_ways(M.dependencies(s, d)).select(F.col("source_id").alias("id"), F.col("target_id").alias("near"), F.lit(0.6).alias("strength"))
    return C.neighbour_union(hits, near).select("query", "id", F.round("score", 6).alias("score"))
