"""Context assembly (reference sections 2.5, 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.operators import context as C
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.plans.retrieval import search
from quillspan.sources import model as M

q = Book()
QUERIES, SQL = q.queries, q.sql

_RANGES = "rg AS (SELECT id, file_id, least(line_start, line_end) AS a, greatest(line_start, line_end) AS b, token_count FROM ch WHERE line_start IS NOT NULL AND line_end IS NOT NULL AND file_id IS NOT NULL)"


def ranges(s, d):
    c = M.chunks(s, d, "file_id", "line_start", "line_end", "token_count", "content").dropna(subset=["file_id", "line_start", "line_end"])
    return c.select("id", "file_id", F.least("line_start", "line_end").alias("line_start"), F.greatest("line_start", "line_end").alias("line_end"), "token_count", "content", ((F.col("id") * 37 % 1000) / 1000.0).alias("score"))


@q(
    "win05_merged_ranges",
    sql(
        "ch", _RANGES,
        "m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY file_id ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS nw FROM rg)",
        "r AS (SELECT *, sum(nw) OVER (PARTITION BY file_id ORDER BY a, b, id) AS run FROM m)",
        "SELECT file_id, min(a) AS line_start, max(b) AS line_end, sum(token_count)::BIGINT AS token_count, count(*)::BIGINT AS merged FROM r GROUP BY file_id, run",
    ),
)
def _(s, d):
    return C.merge_adjacent(ranges(s, d), ["file_id"]).select("file_id", "line_start", "line_end", "token_count", "merged")


@q("join28_contained_chunks", sql("ch", _RANGES, "SELECT DISTINCT y.id FROM rg x JOIN rg y ON x.file_id = y.file_id AND x.id <> y.id AND x.a <= y.a AND x.b >= y.b AND (x.a < y.a OR x.b > y.b OR x.id < y.id)"))
def _(s, d):
    return C.contained(ranges(s, d))


@q("win06_greedy_pack")
def _(s, d):
    return C.greedy_pack(ranges(s, d).select("id", "file_id", "token_count", "score"), 800, "file_id")


@q("win07_overlap_dedup")
def _(s, d):
    return C.overlap_dedup(ranges(s, d).select("id", "file_id", "line_start", "line_end", "score"), "file_id")


@q("join27_expanded_files", sql("ch", "hi AS (SELECT 'q' AS query, id, file_id, ((id * 37 % 1000) / 1000.0)::DOUBLE AS score FROM ch WHERE kind = 'function' AND file_id IS NOT NULL)", "mn AS (SELECT query, file_id, avg(score) AS a FROM hi GROUP BY ALL HAVING count(*) >= 3)", "SELECT query, ch.id, round(a * 0.9::DOUBLE, 9) AS score FROM mn JOIN ch USING (file_id) UNION ALL SELECT query, id, round(score, 9) FROM hi WHERE file_id NOT IN (SELECT file_id FROM mn)"))
def _(s, d):
    c = M.chunks(s, d, "file_id", "kind").filter("file_id is not null")
    hits = c.filter("kind = 'function'").select(F.lit("q").alias("query"), "id", "file_id", ((F.col("id") * 37 % 1000) / 1000.0).alias("score"))
    return C.expand_files(hits, c).select("query", "id", F.round("score", 9).alias("score"))


@q("ctx19_knapsack")
def _(s, d):
    c = M.chunks(s, d, "file_id", "kind", "token_count").filter("file_id is not null")
    p = code.priority((F.col("id") * 37 % 1000) / 1000.0, F.col("id") % 17 == 0, F.col("kind") == "test", F.lit(False))
    return C.knapsack(c.select("id", "file_id", "token_count", ((F.col("id") * 37 % 1000) / 1000.0).alias("score"), p.alias("priority")), 800, "file_id")


@q("ctx21_compressed_chunks", sql("ch", "SELECT id, length(array_to_string(string_split(content, chr(10))[1:6], chr(10)))::BIGINT AS size FROM ch WHERE content IS NOT NULL"))
def _(s, d):
    c = M.chunks(s, d, "content", "doc_comment").filter("content is not null")
    return c.select("id", F.length(C.compress(F.col("content"), F.col("doc_comment"), F.lit("high"))).cast("long").alias("size"))


@q("ctx32_file_outlines", sql("ch", "SELECT file_id, string_agg(coalesce(symbol_path, '?') || ':' || kind, chr(10) ORDER BY line_start NULLS FIRST, id) AS outline FROM ch WHERE file_id IS NOT NULL GROUP BY file_id"))
def _(s, d):
    c = M.chunks(s, d, "file_id", "symbol_path", "kind", "line_start").filter("file_id is not null")
    item = F.struct("line_start", "id", F.concat(F.coalesce("symbol_path", F.lit("?")), F.lit(":"), F.col("kind")).alias("t"))
    return c.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n").alias("outline"))


@q("ctx29_duplicate_chunks", sql("ch", r"k AS (SELECT id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS k FROM ch WHERE content IS NOT NULL)", "SELECT id, min(id) OVER (PARTITION BY k) AS rep FROM k"))
def _(s, d):
    return C.deduplicate(M.chunks(s, d, "content").filter("content is not null"))


@q("topk09_one_chunk_per_symbol", sql("ch", "SELECT symbol_path, arg_min(id, (-(abs(coalesce(line_end, 0) - coalesce(line_start, 0))), id)) AS id FROM ch WHERE symbol_path IS NOT NULL GROUP BY 1"))
def _(s, d):
    c = M.chunks(s, d, "symbol_path", "line_start", "line_end").filter("symbol_path is not null")
    span = F.abs(F.coalesce("line_end", F.lit(0)) - F.coalesce("line_start", F.lit(0)))
    return c.groupBy("symbol_path").agg(F.min(F.struct((-span).alias("s"), "id")).alias("m")).select("symbol_path", F.col("m.id").alias("id"))


@q("ctx12_graph_context", sql("dp", "SELECT source_id AS id, array_to_string(list_sort(list(target_id))[1:5], ',') AS callees FROM dp GROUP BY source_id"))
def _(s, d):
    g = M.dependencies(s, d).groupBy(F.col("source_id").alias("id")).agg(F.slice(F.array_sort(F.collect_list("target_id")), 1, 5).alias("c"))
    return g.select("id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("callees"))


@q("ctx13_context_prefixes", sql("sy", "fl", "SELECT sy.id, 'This ' || sy.kind || ' is in ' || fl.path || ' and is named ' || sy.name || '.' AS prefix FROM sy JOIN fl ON fl.id = sy.file_id"))
def _(s, d):
    y = M.symbols(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id")
    return y.select("id", F.concat(F.lit("This "), "kind", F.lit(" is in "), "path", F.lit(" and is named "), "name", F.lit(".")).alias("prefix"))


@q("ctx11_file_summaries", sql("ch", "SELECT file_id, count(*)::BIGINT AS leaves, count(*) FILTER (visibility = 'public')::BIGINT AS public, sum(token_count)::BIGINT AS tokens FROM ch WHERE file_id IS NOT NULL AND kind <> 'summary' GROUP BY file_id HAVING count(*) >= 3"))
def _(s, d):
    c = M.chunks(s, d, "file_id", "kind", "visibility", "token_count").filter("file_id is not null and kind <> 'summary'")
    return c.groupBy("file_id").agg(F.count(F.lit(1)).alias("leaves"), F.count(F.when(F.col("visibility") == "public", 1)).alias("public"), F.sum("token_count").alias("tokens")).filter("leaves >= 3")


@q("ctx24_shadow_headers", sql("sy", "fl", "dp", "SELECT sy.id, '// ' || fl.path || ' | up ' || (SELECT count(*) FROM dp WHERE source_id = sy.id) || ' | down ' || (SELECT count(*) FROM dp WHERE target_id = sy.id) AS header FROM sy JOIN fl ON fl.id = sy.file_id"))
def _(s, d):
    e = M.dependencies(s, d)
    up, down = e.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("up")), e.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("down"))
    y = M.symbols(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id").join(up, "id", "left").join(down, "id", "left").fillna(0, ["up", "down"])
    return y.select("id", F.concat(F.lit("// "), "path", F.lit(" | up "), "up", F.lit(" | down "), "down").alias("header"))


@q("ctx22_context_window")
def _(s, d):
    hits = search(s, d)
    c = M.chunks(s, d, "content").join(hits.select("id").distinct(), "id", "left_semi")
    f = M.files(s, d).select(F.col("id").alias("file_id"), "path")
    return C.render(hits.join(c, "id").join(f, "file_id", "left"))


@q("ctx23_packed_window")
def _(s, d):
    hits = search(s, d)
    rows = hits.join(M.chunks(s, d, "content").join(hits.select("id").distinct(), "id", "left_semi"), "id")
    merged = C.merge_adjacent(rows.select("query", "file_id", "id", "line_start", "line_end", "score", "token_count", "content"), ["query", "file_id"])
    packed = merged.withColumn("id", F.xxhash64("file_id", "line_start")).withColumn("token_count", F.col("token_count").cast("long"))
    return C.greedy_pack(packed, 3000).select("query", "file_id", "line_start", "line_end", "token_count", F.round("score", 6).alias("score"))


@q("ctx26_xml_window", sql("ch", "SELECT id, '<chunk id=\"' || id || '\" kind=\"' || kind || '\">' || md5(coalesce(content, '')) || '</chunk>' AS xml FROM ch"))
def _(s, d):
    c = M.chunks(s, d, "kind", "content")
    return c.select("id", F.concat(F.lit('<chunk id="'), "id", F.lit('" kind="'), "kind", F.lit('">'), F.md5(F.coalesce("content", F.lit(""))), F.lit("</chunk>")).alias("xml"))


@q("ctx33_status", sql("fl", "ch", "dp", "SELECT (SELECT count(*) FROM fl)::BIGINT AS files, (SELECT count(*) FROM ch)::BIGINT AS chunks, (SELECT count(DISTINCT language) FROM fl)::BIGINT AS languages, (SELECT count(*) FROM dp)::BIGINT AS edges"))
def _(s, d):
    one = lambda df, e, n: df.agg(e.alias(n))
    f = M.files(s, d)
    return (
        one(f, F.count(F.lit(1)), "files").join(one(M.chunks(s, d), F.count(F.lit(1)), "chunks"), how="cross")
        .join(one(f, F.countDistinct("language"), "languages"), how="cross").join(one(M.dependencies(s, d), F.count(F.lit(1)), "edges"), how="cross")
    )


@q("ctx34_context_map", sql("fl", "SELECT repo, '{\"repo\":\"' || repo || '\",\"files\":' || count(*) || ',\"languages\":' || count(DISTINCT language) || '}' AS json FROM (SELECT string_split(path, '/')[1] AS repo, language FROM fl) GROUP BY repo"))
def _(s, d):
    g = M.files(s, d).groupBy(F.substring_index("path", "/", 1).alias("repo")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("language").alias("languages"))
    return g.select("repo", F.to_json(F.struct("repo", "files", "languages")).alias("json"))
