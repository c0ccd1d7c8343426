"""Further operators of the reference, section by section."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.operators import chunking as K
from quillspan.operators import context as C
from quillspan.operators import graph as G
from quillspan.operators import history as H
from quillspan.operators import relational as R
from quillspan.operators import retrieval as T
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.plans.retrieval import QUESTIONS, question_terms, vectors
from quillspan.sources import model as M
from quillspan.sources import parse as P
from quillspan.sources.tables import table

q = Book()
QUERIES, SQL = q.queries, q.sql


@q("fil03_hash_by_path", sql("fl", "SELECT path, hash FROM fl"))
def _(s, d):
    return M.files(s, d).select("path", "hash")


@q("fil14_symbols_per_file", sql("sy", "SELECT file_id, count(*)::BIGINT AS n, min(line) AS first FROM sy GROUP BY file_id"))
def _(s, d):
    return M.symbols(s, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))


@q("fil20_changed_lately", sql("fl", "cm", "cf", "nw AS (SELECT hash FROM cm ORDER BY ts DESC NULLS LAST, hash LIMIT 200)", "SELECT fl.id, fl.path IN (SELECT cf.path FROM cf JOIN nw USING (hash)) AS changed FROM fl"))
def _(s, d):
    newest = M.commits(s, d).orderBy(F.col("ts").desc_nulls_last(), "hash").limit(200).select("hash")
    changed = M.commit_files(s, d).join(newest, "hash").select("path").distinct().withColumn("c", F.lit(True))
    return M.files(s, d).join(changed, "path", "left").select("id", F.coalesce("c", F.lit(False)).alias("changed"))


@q("fil26_outgoing_edges", sql("fe", "SELECT source_path, count(*)::BIGINT AS edges, count(DISTINCT edge_type)::BIGINT AS types FROM fe GROUP BY source_path"))
def _(s, d):
    return M.file_edges(s, d).groupBy("source_path").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("edge_type").alias("types"))


@q("fil30_semantic_edges", sql("dp", "SELECT source_id, target_id, kind, kind IN ('data_flow','error_flow','type_flow') AS flow FROM dp WHERE kind IN ('data_flow','error_flow','type_flow','historical_co_change')"))
def _(s, d):
    flow = F.col("kind").isin("data_flow", "error_flow", "type_flow")
    return M.dependencies(s, d).filter(flow | (F.col("kind") == "historical_co_change")).withColumn("flow", flow)


@q("join05_neighbour_boost", sql("dp", "nb AS (SELECT source_id AS id, target_id AS near, 0.6 AS g FROM dp UNION ALL SELECT target_id, source_id, 0.3 FROM dp)", "SELECT near AS id, round(max(g)::DOUBLE, 6) AS boost, count(*)::BIGINT AS anchors FROM nb GROUP BY near"))
def _(s, d):
    e = M.dependencies(s, d)
    n = e.select(F.col("target_id").alias("near"), F.lit(0.6).alias("g")).union(e.select("source_id", F.lit(0.3)))
    return n.groupBy(F.col("near").alias("id")).agg(F.round(F.max("g"), 6).alias("boost"), F.count(F.lit(1)).alias("anchors"))


@q(
    "join12_callee_files",
    sql(
        "sy", "fl",
        "df AS (SELECT DISTINCT sy.name, fl.path, regexp_replace(fl.path, '/[^/]*$', '') AS dir FROM sy JOIN fl ON fl.id = sy.file_id)",
        "SELECT name, caller, path FROM (SELECT a.name, a.path AS caller, b.path, row_number() OVER (PARTITION BY a.name, a.path ORDER BY (a.dir = b.dir) DESC, b.path) AS rn FROM df a JOIN df b ON a.name = b.name AND a.path <> b.path) WHERE rn = 1",
    ),
)
def _(s, d):
    df = M.symbols(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id").select("name", "path", F.regexp_replace("path", r"/[^/]*$", "").alias("dir")).distinct()
    # per name the two least files, and per name and folder the two least: enough to answer without the pairs
    world = df.groupBy("name").agg(F.slice(F.array_sort(F.collect_set("path")), 1, 2).alias("w"))
    local = df.groupBy("name", "dir").agg(F.slice(F.array_sort(F.collect_set("path")), 1, 2).alias("l"))
    j = df.join(world, "name").join(local, ["name", "dir"])
    return j.select("name", F.col("path").alias("caller"), F.coalesce(F.get(F.filter("l", lambda x: x != F.col("path")), 0), F.get(F.filter("w", lambda x: x != F.col("path")), 0)).alias("path")).filter("path is not null")


@q(
    "join21_co_change_symbols",
    sql(
        "sy", "fl", "co", "fs AS (SELECT file_id, arg_min(id, (line, id)) AS sid FROM sy GROUP BY file_id)",
        "SELECT DISTINCT a.sid AS source_id, b.sid AS target_id FROM co JOIN fl x ON x.path = path_a JOIN fl y ON y.path = path_b JOIN fs a ON a.file_id = x.id JOIN fs b ON b.file_id = y.id WHERE freq >= 3 AND a.sid <> b.sid",
    ),
)
def _(s, d):
    first = R.first_per(M.symbols(s, d).filter("line is not null"), "file_id", "line", "id").select("file_id", "id")
    own = M.files(s, d).select(F.col("id").alias("file_id"), "path").join(first, "file_id").select("path", F.col("id").alias("sid"))
    p = H.co_changes(M.commit_files(s, d)).filter("freq >= 3")
    a, b = own.select(F.col("path").alias("path_a"), F.col("sid").alias("source_id")), own.select(F.col("path").alias("path_b"), F.col("sid").alias("target_id"))
    return p.join(a, "path_a").join(b, "path_b").filter("source_id <> target_id").select("source_id", "target_id").distinct()


@q("set05_one_hop_fallback", sql("dp", "u AS (SELECT source_id AS id, target_id AS near, 0.5 AS f FROM dp UNION ALL SELECT target_id, source_id, 0.4 FROM dp)", "SELECT id, near, max(f)::DOUBLE AS factor FROM u GROUP BY id, near"))
def _(s, d):
    e = M.dependencies(s, d)
    u = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("near"), F.lit(0.5).alias("f")).union(e.select("target_id", "source_id", F.lit(0.4)))
    return u.groupBy("id", "near").agg(F.max("f").alias("factor"))


@q("topk10_repositories", sql("fl", "SELECT string_split(path, '/')[1] AS repo, count(*)::BIGINT AS files FROM fl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def _(s, d):
    return M.files(s, d).groupBy(F.substring_index("path", "/", 1).alias("repo")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.col("files").desc(), "repo").limit(20)


_STOP = "[" + ", ".join(f"'{w}'" for w in code.STOP_WORDS) + "]"


@q("str12_primary_entities", sql("cm", r"SELECT hash, array_to_string(list_filter(regexp_split_to_array(lower(trim(message)), '\s+'), lambda x: x <> '' AND NOT list_contains(" + _STOP + ", x))[1:3], '_') AS entity FROM cm WHERE message IS NOT NULL"))
def _(s, d):
    stop = F.array(*map(F.lit, code.STOP_WORDS))
    w = F.filter(F.split(F.lower(F.trim("message")), r"\s+"), lambda x: (x != "") & ~F.array_contains(stop, x))
    return M.commits(s, d).filter("message is not null").select("hash", F.array_join(F.slice(w, 1, 3), "_").alias("entity"))


SYNONYMS = {"fix": ["repair", "patch", "correct"], "bug": ["defect", "error"], "docs": ["documentation", "guide"], "bump": ["upgrade", "raise"]}


@q(
    "str04_synonyms",
    sql(
        "cm",
        "sn(word, syn, pos) AS (VALUES " + ", ".join(f"('{w}', '{x}', {i})" for w, xs in SYNONYMS.items() for i, x in enumerate(xs)) + ")",
        r"w AS (SELECT hash, lower(message) AS m, unnest(list_distinct(list_filter(regexp_split_to_array(lower(message), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS word FROM cm WHERE message IS NOT NULL)",
        "SELECT hash, count(*)::BIGINT AS synonyms, min(syn) AS first FROM w JOIN sn USING (word) WHERE NOT contains(m, syn) GROUP BY hash",
    ),
)
def _(s, d):
    sn = s.createDataFrame([(w, x) for w, xs in SYNONYMS.items() for x in xs], "word string, syn string")
    w = M.commits(s, d).filter("message is not null").select("hash", F.lower("message").alias("m"), F.explode(F.array_distinct(T.words(F.col("message")))).alias("word"))
    return w.join(F.broadcast(sn), "word").filter(~F.col("m").contains(F.col("syn"))).groupBy("hash").agg(F.count(F.lit(1)).alias("synonyms"), F.min("syn").alias("first"))


@q("str17_sanitised", sql("ch", r"SELECT id, md5(regexp_replace(content, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')) AS clean FROM ch WHERE content IS NOT NULL"))
def _(s, d):
    return M.chunks(s, d, "content").filter("content is not null").select("id", F.md5(F.regexp_replace("content", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")).alias("clean"))


@q("str30_known_kinds", sql("ch", "SELECT kind, visibility, count(*)::BIGINT AS n FROM ch GROUP BY ALL"))
def _(s, d):
    return M.chunks(s, d, "kind", "visibility").groupBy("kind", "visibility").agg(F.count(F.lit(1)).alias("n"))


@q("str37_reciprocal_ranks", "SELECT event_id, round(1.0::DOUBLE / (60 + rn) + CASE WHEN event_type = 'click' THEN 0.5::DOUBLE / (60 + rn) ELSE 0 END, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)")
def _(s, d):
    e = table(s, d, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("event_id", F.round(code.rrf(F.col("rn")) + F.when(F.col("event_type") == "click", code.rrf(F.col("rn"), 0.5)).otherwise(0.0), 8).alias("score"))


@q("gra14_architectural_context", sql("fe", "st AS (SELECT source_path AS node FROM fe UNION SELECT target_path FROM fe)", "bo AS (SELECT source_path AS a, target_path AS b FROM fe UNION SELECT target_path, source_path FROM fe)", "w AS (SELECT node AS start, node AS cur, 0 AS hop FROM st UNION SELECT w.start, bo.b, w.hop + 1 FROM w JOIN bo ON bo.a = w.cur WHERE w.hop < 2)", "SELECT start, count(DISTINCT cur)::BIGINT AS neighbours FROM w WHERE cur <> start GROUP BY start", recursive=True))
def _(s, d):
    e = M.file_edges(s, d)
    st = e.select(F.col("source_path").alias("node")).union(e.select("target_path")).distinct()
    return G.reach(G.both_ways(e, "source_path", "target_path"), st, 2, "source_path", "target_path").filter("node <> start").groupBy("start").agg(F.count(F.lit(1)).alias("neighbours"))


_KW = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in code.DEPENDENCY_WEIGHT.items()) + " END"


@q("gra27_kind_weights", sql("dp", f"SELECT source_id, round(sum({_KW})::DOUBLE, 6) AS weight FROM dp GROUP BY source_id"))
def _(s, d):
    return M.dependencies(s, d).groupBy("source_id").agg(F.round(F.sum(code.lookup(F.col("kind"), code.DEPENDENCY_WEIGHT, 0.3)), 6).alias("weight"))


@q("xtr20_first_cycles")
def _(s, d):
    g = G.strong_components(M.dependencies(s, d)).groupBy("component").agg(F.slice(F.array_sort(F.collect_list("node")), 1, 5).alias("nodes"), F.count(F.lit(1)).alias("size"))
    return g.orderBy("component").limit(3).select("component", "size", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


@q("xtr22_guide_text", sql("fl", "SELECT '- ' || language || ': ' || count(*) || ' files' AS line FROM fl GROUP BY language"))
def _(s, d):
    return M.files(s, d).groupBy("language").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("- "), "language", F.lit(": "), "n", F.lit(" files")).alias("line"))


@q("xtr35_file_freshness", sql("fl", "SELECT id, indexed_at FROM fl WHERE indexed_at IS NOT NULL"))
def _(s, d):
    return M.files(s, d).filter("indexed_at is not null").select("id", "indexed_at")


@q("xtr37_signatures", sql("ch", r"SELECT id, list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '^\s*(//|#|/\*|\*|@)'))[1] AS signature FROM ch WHERE content IS NOT NULL"))
def _(s, d):
    line = F.get(F.filter(F.split("content", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(?://|#|/\*|\*|@)")), 0)
    return M.chunks(s, d, "content").filter("content is not null").select("id", line.alias("signature"))


@q("xtr42_budgets_by_intent", "SELECT * FROM (VALUES " + ", ".join(f"('{i}', {code.BUDGET_FRACTION.get(i, 1.0)}::DOUBLE)" for i in code.INTENTS) + ") t(intent, fraction)")
def _(s, d):
    i = s.createDataFrame([(x,) for x in code.INTENTS], "intent string")
    return i.select("intent", code.lookup(F.col("intent"), code.BUDGET_FRACTION, 1.0).alias("fraction"))


@q("xtr46_label_centroids", sql("v AS (SELECT label, embedding::DOUBLE[] AS e FROM embeddings)", "x AS (SELECT label, e[1] / sqrt(list_dot_product(e, e)) AS a, e[2] / sqrt(list_dot_product(e, e)) AS b FROM v)", "SELECT label, round(avg(a), 6) AS first, round(avg(b), 6) AS second FROM x GROUP BY label"))
def _(s, d):
    v = table(s, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    unit = v.withColumn("n", F.sqrt(F.aggregate("e", F.lit(0.0), lambda t, y: t + y * y)))
    m = unit.groupBy("label").agg(F.avg(F.col("e")[0] / F.col("n")).alias("a"), F.avg(F.col("e")[1] / F.col("n")).alias("b"))
    return m.select("label", F.round("a", 6).alias("first"), F.round("b", 6).alias("second"))


@q("str09_nearest_centroids", sql("v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)", "ix AS (SELECT label, i, avg(e[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i)", "ct AS (SELECT label, list(m ORDER BY i) AS c FROM ix GROUP BY label)", "SELECT vec_id, arg_max(ct.label, (round(list_dot_product(e, c) / sqrt(list_dot_product(c, c)), 9), -ct.label)) AS nearest FROM v, ct GROUP BY vec_id"))
def _(s, d):
    v = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    m = v.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    j = v.select("vec_id", "e").join(F.broadcast(c), how="cross")  # ten labels
    best = j.groupBy("vec_id").agg(F.max(F.struct(F.round(dot("e", "c") / F.sqrt(dot("c", "c")), 9).alias("s"), (-F.col("label")).alias("l"))).alias("m"))
    return best.select("vec_id", (-F.col("m.l")).alias("nearest"))


@q("ret15_vector_memory", "SELECT count(*)::BIGINT AS vectors, sum(len(embedding) * 4 + 24 + 64)::BIGINT AS bytes FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.size("embedding") * 4 + 24 + 64).alias("bytes"))


@q("ret33_active_content", sql("ch", "SELECT id, token_count FROM ch UNION ALL SELECT 0, 7"))
def _(s, d):
    c = M.chunks(s, d, "token_count")
    return c.unionByName(s.createDataFrame([(0, 7)], "id long, token_count int"))


@q("xtr08_instantiations", sql("ch", r"SELECT DISTINCT id, unnest(regexp_extract_all(content, '\bnew\s+([A-Z][A-Za-z0-9_]*)\s*[(<]', 1)) AS class FROM ch WHERE content IS NOT NULL"))
def _(s, d):
    names = F.regexp_extract_all("content", F.lit(r"\bnew\s+([A-Z][A-Za-z0-9_]*)\s*[(<]"))
    return M.chunks(s, d, "content").filter("content is not null").select("id", F.explode(names).alias("class")).distinct()


@q("xtr16_relative_imports", sql("fl", "im AS (SELECT path AS source_path, regexp_replace(path, '\\.[^./]*$', '') AS base FROM fl)", "cd AS (SELECT source_path, base || x.ext AS path, x.pos FROM im, (VALUES ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4)) x(ext, pos))", "SELECT source_path, arg_min(fl.path, pos) AS target_path FROM cd JOIN fl USING (path) GROUP BY source_path"))
def _(s, d):
    f = M.files(s, d).select("path")
    tries = F.array(*(F.struct(F.lit(e).alias("ext"), F.lit(i).alias("pos")) for i, e in enumerate(("", ".ts", ".tsx", ".js", ".jsx"))))
    c = f.select(F.col("path").alias("source_path"), F.regexp_replace("path", r"\.[^./]*$", "").alias("base"), F.explode(tries).alias("t")).select("source_path", F.concat("base", "t.ext").alias("path"), "t.pos")
    return c.join(f, "path").groupBy("source_path").agg(F.min_by("path", "pos").alias("target_path"))


@q("ctx27_compact_window", sql("sy", "fl", "SELECT fl.path || ':' || coalesce(sy.line, 0) || ' ' || sy.kind || ' ' || sy.name AS line FROM sy JOIN fl ON fl.id = sy.file_id"))
def _(s, d):
    y = M.symbols(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id")
    return y.select(F.concat("path", F.lit(":"), F.coalesce("line", F.lit(0)), F.lit(" "), "kind", F.lit(" "), "name").alias("line"))


@q("ctx28_markdown_window", sql("sy", "fl", "SELECT fl.path, '## ' || fl.path || chr(10) || string_agg('- `' || sy.name || '`', chr(10) ORDER BY sy.line NULLS FIRST, sy.id) AS text FROM sy JOIN fl ON fl.id = sy.file_id GROUP BY fl.path"))
def _(s, d):
    y = M.symbols(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id")
    g = y.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "id", F.concat(F.lit("- `"), "name", F.lit("`")).alias("t")))).alias("s"))
    return g.select("path", F.concat(F.lit("## "), "path", F.lit("\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n")).alias("text"))


@q("ctx14_enriched_prefixes", sql("sy", "dp", "SELECT sy.id, 'This ' || kind || ' has ' || (SELECT count(*) FROM dp WHERE target_id = sy.id) || ' callers, impact ' || CASE WHEN (SELECT count(*) FROM dp WHERE target_id = sy.id) > 20 THEN 'critical' WHEN (SELECT count(*) FROM dp WHERE target_id = sy.id) > 10 THEN 'high' WHEN (SELECT count(*) FROM dp WHERE target_id = sy.id) > 5 THEN 'medium' ELSE 'low' END AS prefix FROM sy"))
def _(s, d):
    n = M.dependencies(s, d).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    y = M.symbols(s, d).join(n, "id", "left").fillna(0, ["n"])
    band = F.when(F.col("n") > 20, "critical").when(F.col("n") > 10, "high").when(F.col("n") > 5, "medium").otherwise("low")
    return y.select("id", F.concat(F.lit("This "), "kind", F.lit(" has "), "n", F.lit(" callers, impact "), band).alias("prefix"))


@q("ctx01_element_chunks")
def _(s, d):
    f = M.chunks(s, d, "file_id", "content").filter("content is not null").join(M.files(s, d).select(F.col("id").alias("file_id"), "path", "language"), "file_id")
    return K.chunk_elements(P.parse_code(f, "id", "content", "language"), f).select("id", "symbol_path", "kind", "line_start", "line_end", "token_count")


@q("ctx11_summary_chunks")
def _(s, d):
    return K.summaries(M.chunks(s, d, "file_id", "visibility", "line_start", "content", "kind").filter("file_id is not null and kind <> 'summary' and content is not null"))


@q("ctx30_plan_audit")
def _(s, d):
    """Steps of a plan with the files and symbols they touch and the sum of what depends on those."""
    plan = s.createDataFrame([(1, "Plan\n" + "\n".join(f"- {t}" for t in QUESTIONS.values()))], "id long, t string")
    steps = P.plan_steps(plan, "id", "t").select(F.concat(F.lit("s"), F.col("step").cast("string")).alias("query"), "text")
    terms = steps.select("query", F.explode(code.keyword_tokens(F.col("text"))).alias("term"))
    hits = T.bm25(M.chunks(s, d, "content", "doc_comment", "symbol_path"), "id", {"content": 1.0, "doc_comment": 0.5, "symbol_path": 2.0}, terms, 10).select("query", "id")
    hits = hits.join(M.chunks(s, d, "file_id", "symbol_path"), "id")
    e = M.dependencies(s, d)
    radius = G.blast_radius(e, hits.select(F.col("id").alias("node")).distinct(), 3).groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    g = hits.join(radius, "id", "left").groupBy("query").agg(F.countDistinct("file_id").alias("files"), F.countDistinct("symbol_path").alias("symbols"), F.coalesce(F.sum("n"), F.lit(0)).alias("affected"))
    return steps.join(g, "query", "left").withColumn("risk", code.risk_level(F.coalesce("affected", F.lit(0))))


@q("win12_causal_order")
def _(s, d):
    """Files in order of their distance from the best one of each question, entries by line within them."""
    kw = T.bm25(M.chunks(s, d, "content", "doc_comment", "symbol_path"), "id", {"content": 1.0, "doc_comment": 0.5, "symbol_path": 2.0}, question_terms(s), 10)
    e = kw.join(M.chunks(s, d, "file_id", "line_start"), "id")
    return C.causal_order(e, G.both_ways(M.dependencies(s, d))).select("query", "position", "id")


@q("xtr65_cosine_distances", sql("v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)", "SELECT label, round(avg(1 - list_cosine_similarity(e, f)), 6) AS mean FROM v JOIN (SELECT label AS l2, arg_min(e, vec_id) AS f FROM v GROUP BY label) c ON c.l2 = v.label GROUP BY label"))
def _(s, d):
    v = vectors(s, d).join(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    first = v.groupBy("label").agg(F.min_by("vector", "id").alias("f"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    cos = dot("vector", "f") / F.sqrt(dot("vector", "vector") * dot("f", "f"))
    return v.join(first, "label").groupBy("label").agg(F.round(F.avg(1 - cos), 6).alias("mean"))
