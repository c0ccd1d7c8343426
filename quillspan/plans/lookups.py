"""Filters, point lookups, joins and set operations (reference sections 2.2, 2.3, 2.6, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.functions.paths import plain_path
from quillspan.operators import relational as R
from quillspan.operators.history import co_changes
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.sources import model as M
from quillspan.sources.tables import table

q = Book()
QUERIES, SQL = q.queries, q.sql


@q("fil01_file_by_path", sql("fl", "SELECT id, path, language, hash FROM fl WHERE path = (SELECT min(path) FROM fl)"))
def _(s, d):
    f = M.files(s, d)
    return f.join(f.agg(F.min("path").alias("path")), "path").select("id", "path", "language", "hash")


@q("fil02_file_by_id", sql("fl", "SELECT id, path FROM fl WHERE id = 7"))
def _(s, d):
    return M.files(s, d).filter("id = 7").select("id", "path")


@q("fil04_chunks_of_file", sql("ch", "SELECT id, symbol_path, line_start FROM ch WHERE file_id = 3 ORDER BY line_start, id"))
def _(s, d):
    return M.chunks(s, d, "file_id", "symbol_path", "line_start").filter("file_id = 3").orderBy("line_start", "id").select("id", "symbol_path", "line_start")


@q("fil05_content_hash_by_symbol", sql("ch", "SELECT file_id, symbol_path, arg_max(content_hash, id) AS content_hash FROM ch WHERE symbol_path IS NOT NULL GROUP BY ALL"))
def _(s, d):
    return M.chunks(s, d, "file_id", "symbol_path", "content_hash").filter("symbol_path is not null").groupBy("file_id", "symbol_path").agg(F.max_by("content_hash", "id").alias("content_hash"))


@q("fil06_chunks_without_vectors", sql("ch", "SELECT id FROM ch WHERE vector_id IS NULL"))
def _(s, d):
    return M.chunks(s, d, "vector_id").filter("vector_id is null").select("id")


@q("fil07_symbol_by_fqn", sql("sy", "SELECT id, name, kind FROM sy WHERE fqn = (SELECT min(fqn) FROM sy)"))
def _(s, d):
    y = M.symbols(s, d)
    return y.join(y.agg(F.min("fqn").alias("fqn")), "fqn").select("id", "name", "kind")


@q("fil09_chunk_for_symbol", sql("sy", "SELECT id, chunk_id FROM sy"))
def _(s, d):
    return M.symbols(s, d).select("id", "chunk_id")


@q("fil10_symbols_by_prefix", sql("sy", "SELECT id, name FROM sy WHERE name ILIKE 'Re_d%' ORDER BY name, id LIMIT 20"))
def _(s, d):
    return R.symbols_by_prefix(M.symbols(s, d), "Re_d", 20).select("id", "name")


@q("fil11_symbols_by_suffix", sql("sy", "SELECT id, fqn FROM sy WHERE fqn ILIKE '%_queue' ORDER BY length(fqn), id LIMIT 20"))
def _(s, d):
    return R.symbols_by_suffix(M.symbols(s, d), "_queue", 20).select("id", "fqn")


@q("fil12_file_by_path_suffix", sql("fl", "SELECT id, path FROM fl WHERE path ILIKE '%/queue.rs' ORDER BY path LIMIT 1"))
def _(s, d):
    return M.files(s, d).filter(F.col("path").ilike("%/queue.rs")).orderBy("path").limit(1).select("id", "path")


@q("fil13_first_symbol_per_file", sql("sy", "SELECT file_id, id, name FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line, id) AS rn FROM sy) WHERE rn = 1"))
def _(s, d):
    return R.first_per(M.symbols(s, d), "file_id", "line", "id").select("file_id", "id", "name")


@q("fil15_upstream_edges", sql("dp", "SELECT source_id, target_id, kind FROM dp WHERE source_id = (SELECT min(source_id) FROM dp)"))
def _(s, d):
    e = M.dependencies(s, d)
    return e.join(e.agg(F.min("source_id").alias("source_id")), "source_id")


@q("fil16_downstream_edges", sql("dp", "SELECT source_id, target_id, kind FROM dp WHERE target_id = (SELECT min(target_id) FROM dp)"))
def _(s, d):
    e = M.dependencies(s, d)
    return e.join(e.agg(F.min("target_id").alias("target_id")), "target_id").select("source_id", "target_id", "kind")


@q("fil17_external_doc_exists", "SELECT DISTINCT source_url, TRUE AS present FROM external_docs WHERE source_url LIKE '%--1'")
def _(s, d):
    return table(s, d, "external_docs").filter(F.col("source_url").like("%--1")).select("source_url", F.lit(True).alias("present")).distinct()


@q(
    "fil19_test_files",
    sql(
        "fl",
        r"""SELECT path, (regexp_matches(lower(stem), '^test_|_test$|_spec$|\.test$|\.spec$|^conftest$') OR regexp_matches(stem, '^test\p{Lu}')
        OR len(list_intersect(string_split(lower(path), '/'), ['tests','test','__tests__','spec','specs'])) > 0) AS is_test
        FROM (SELECT path, regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1') AS stem FROM fl)""",
    ),
)
def _(s, d):
    return M.files(s, d).select("path", code.is_test_file(F.col("path")).alias("is_test"))


for _name, _type in (("fil22_imports", "imports"), ("fil23_subclasses", "inherits"), ("fil24_callers", "calls")):

    @q(
        _name,
        sql("fe", f"SELECT source_path AS path, target_path AS neighbour FROM fe WHERE edge_type = '{_type}' UNION SELECT target_path, source_path FROM fe WHERE edge_type = '{_type}'"),
    )
    def _(s, d, t=_type):
        return R.neighbours_by_type(M.file_edges(s, d), t)


@q("fil25_edges_of_type", sql("fe", "SELECT source_path, target_path FROM fe WHERE edge_type = 'calls'"))
def _(s, d):
    return M.file_edges(s, d).filter("edge_type = 'calls'").select("source_path", "target_path")


@q(
    "fil27_structural_adjacency",
    sql(
        "fe",
        """SELECT n.path, count(e.target_path)::BIGINT AS degree FROM (SELECT source_path AS path FROM fe UNION SELECT target_path FROM fe) n
        LEFT JOIN (SELECT DISTINCT source_path, target_path FROM fe WHERE edge_type <> 'historical_co_change') e ON e.source_path = n.path GROUP BY n.path""",
    ),
)
def _(s, d):
    e = M.file_edges(s, d)
    nodes = e.select(F.col("source_path").alias("path")).union(e.select("target_path")).distinct()
    st = e.filter("edge_type <> 'historical_co_change'").select("source_path", "target_path").distinct()
    return nodes.join(st, nodes["path"] == st["source_path"], "left").groupBy("path").agg(F.count("target_path").alias("degree"))


@q(
    "fil28_language_classes",
    sql("fl", "SELECT path, language, language NOT IN ('html','shell','markdown','toml','yaml','json','unknown') AS code, language IN ('html','shell','markdown','toml','yaml','json') AS document FROM fl"),
)
def _(s, d):
    lang = F.col("language")
    return M.files(s, d).select("path", "language", code.is_code(lang).alias("code"), code.is_document(lang).alias("document"))


@q("join01_commits_of_files", sql("cm", "cf", "SELECT cf.path, cm.hash, cm.ts FROM cf JOIN cm USING (hash) WHERE cf.path LIKE '%.rs'"))
def _(s, d):
    return M.commit_files(s, d).filter(F.col("path").endswith(".rs")).join(M.commits(s, d).select("hash", "ts"), "hash").select("path", "hash", "ts")


@q("join02_chunks_with_paths", sql("ch", "fl", "SELECT ch.id, fl.path FROM ch JOIN fl ON fl.id = ch.file_id"))
def _(s, d):
    return M.chunks(s, d, "file_id").join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path")


@q("join04_symbol_of_chunk", sql("sy", "SELECT ch.id, sy.id AS symbol_id FROM ch LEFT JOIN sy ON sy.fqn = ch.symbol_path"))
def _(s, d):
    y = M.symbols(s, d).select(F.col("fqn").alias("symbol_path"), F.col("id").alias("symbol_id"))
    return M.chunks(s, d, "symbol_path").join(y, "symbol_path", "left").select("id", "symbol_id")


_REFS = r"""rf AS (SELECT DISTINCT ch.id AS source_id, ch.file_id, unnest(regexp_extract_all(ch.content, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS name
        FROM ch JOIN sy s0 ON s0.id = ch.id)"""


def _references(s, d):
    c = M.chunks(s, d, "file_id", "content").join(M.symbols(s, d).select("id"), "id", "left_semi")
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(")))
    return c.select(F.col("id").alias("source_id"), "file_id", F.explode(names).alias("name"))


@q(
    "join10_call_edges",
    sql(
        "sy",
        _REFS,
        "lo AS (SELECT file_id, name, arg_min(id, (line, id)) AS lid FROM sy GROUP BY ALL)",
        "wo AS (SELECT name, arg_min(id, (fqn, id)) AS wid FROM sy GROUP BY ALL)",
        """SELECT DISTINCT source_id, coalesce(lid, wid) AS target_id FROM rf LEFT JOIN lo USING (file_id, name) LEFT JOIN wo USING (name)
        WHERE coalesce(lid, wid) IS NOT NULL AND coalesce(lid, wid) <> source_id""",
    ),
)
def _(s, d):
    return R.call_edges(_references(s, d), M.symbols(s, d))


@q("join13_name_index", sql("sy", "fl", "SELECT sy.name, count(DISTINCT fl.path)::BIGINT AS files, min(fl.path) AS first_path FROM sy JOIN fl ON fl.id = sy.file_id GROUP BY sy.name"))
def _(s, d):
    i = R.name_index(M.symbols(s, d), M.files(s, d))
    return i.select("name", F.size("paths").cast("long").alias("files"), F.col("paths")[0].alias("first_path"))


@q(
    "join09_resolve_imports",
    sql(
        "sy",
        "im AS (SELECT fqn AS import, regexp_extract(fqn, '^(.*)::[^:]*$', 1) AS path, name FROM sy WHERE fqn LIKE '%::%')",
        """cand AS (SELECT import, sy.id, 0 AS rnk, 0 AS size FROM im JOIN sy ON sy.fqn = im.path || '::' || im.name
        UNION ALL SELECT import, sy.id, CASE WHEN contains(sy.fqn, im.path) THEN 2 ELSE 3 END, length(sy.fqn) FROM im JOIN sy ON sy.name = im.name)""",
        "SELECT import, id AS symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY import ORDER BY rnk, size, id) AS rn FROM cand) WHERE rn = 1",
    ),
)
def _(s, d):
    y = M.symbols(s, d)
    imports = y.filter(F.col("fqn").like("%::%")).select(F.col("fqn").alias("import"), F.regexp_extract("fqn", r"^(.*)::[^:]*$", 1).alias("path"), "name")
    return R.resolve_import(imports, y)


@q(
    "join20_import_file_edges",
    sql(
        "fl",
        "st AS (SELECT lower(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')) AS stem, min(path) AS path FROM fl GROUP BY 1)",
        "im AS (SELECT DISTINCT path AS source_path, lower(string_split(path, '/')[-2]) AS last FROM fl WHERE path LIKE '%/%')",
        "SELECT im.source_path, st.path AS target_path FROM im JOIN st ON st.stem = im.last WHERE st.path <> im.source_path",
    ),
)
def _(s, d):
    f = M.files(s, d).select("path")
    stem = F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    st = f.groupBy(stem.alias("last")).agg(F.min("path").alias("target_path"))
    im = f.filter(F.col("path").contains("/")).select(F.col("path").alias("source_path"), F.lower(F.element_at(F.split("path", "/"), -2)).alias("last"))
    return im.join(st, "last").filter("target_path <> source_path").select("source_path", "target_path")


@q(
    "join25_coverage_gaps",
    sql(
        "sy", "fl", "dp",
        r"""sx AS (SELECT sy.id % (SELECT max(l_partkey) FROM lineitem) + 1 AS node, bool_or(len(list_intersect(string_split(lower(fl.path), '/'), ['tests','test','__tests__','spec','specs'])) > 0) AS test
        FROM sy JOIN fl ON fl.id = sy.file_id GROUP BY 1)""",
        "cov AS (SELECT DISTINCT dp.target_id AS node FROM dp JOIN sx ON sx.node = dp.source_id AND sx.test)",
        """SELECT p.node, (SELECT count(*) FROM dp WHERE target_id = p.node)::BIGINT AS dependents, (SELECT count(*) FROM dp WHERE source_id = p.node)::BIGINT AS dependencies
        FROM sx p WHERE NOT p.test AND p.node NOT IN (SELECT node FROM cov)""",
    ),
)
def _(s, d):
    most = table(s, d, "lineitem").agg(F.max("l_partkey").alias("most"))
    y = M.symbols(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id")
    in_tests = F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*map(F.lit, ("tests", "test", "__tests__", "spec", "specs"))))
    sx = y.join(F.broadcast(most), how="cross").groupBy((F.col("id") % F.col("most") + 1).alias("node")).agg(F.max(in_tests).alias("test"))
    e = M.dependencies(s, d)
    covered = e.join(sx.filter("test").select(F.col("node").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("node")).distinct()
    gaps = sx.filter("not test").join(covered, "node", "left_anti").select("node")
    into, out = e.groupBy(F.col("target_id").alias("node")).agg(F.count(F.lit(1)).alias("dependents")), e.groupBy(F.col("source_id").alias("node")).agg(F.count(F.lit(1)).alias("dependencies"))
    return gaps.join(into, "node", "left").join(out, "node", "left").fillna(0)


@q("topk03_recent_commits", sql("cm", "SELECT hash, ts, message FROM cm ORDER BY ts DESC NULLS LAST, hash LIMIT 25"))
def _(s, d):
    return M.commits(s, d).orderBy(F.col("ts").desc_nulls_last(), "hash").limit(25).select("hash", "ts", "message")


@q("topk07_largest_files", sql("fl", "SELECT path, size_bytes FROM fl WHERE size_bytes IS NOT NULL ORDER BY size_bytes DESC, path LIMIT 30"))
def _(s, d):
    return M.files(s, d).filter("size_bytes is not null").orderBy(F.col("size_bytes").desc(), "path").limit(30).select("path", "size_bytes")


@q(
    "topk11_top_per_repository",
    sql("fl", "SELECT repo, path, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY size_bytes DESC, path) AS rn FROM (SELECT string_split(path, '/')[1] AS repo, path, size_bytes FROM fl WHERE size_bytes IS NOT NULL)) WHERE rn <= 3"),
)
def _(s, d):
    f = M.files(s, d).filter("size_bytes is not null").withColumn("repo", F.substring_index("path", "/", 1))
    from pyspark.sql import Window

    w = Window.partitionBy("repo").orderBy(F.col("size_bytes").desc(), "path")
    return f.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("repo", "path", "size_bytes")


@q("set02_all_known_paths", sql("fl", "cf", "SELECT path FROM fl UNION SELECT path FROM cf"))
def _(s, d):
    return M.files(s, d).select("path").union(M.commit_files(s, d).select("path")).distinct()


@q("set07_paths_no_longer_indexed", sql("fl", "cf", "SELECT path FROM cf EXCEPT SELECT path FROM fl"))
def _(s, d):
    return M.commit_files(s, d).select("path").distinct().join(M.files(s, d).select("path"), "path", "left_anti")


@q(
    "set06_jaccard_of_co_changes",
    sql("co", "n AS (SELECT path, count(*) AS n FROM cf GROUP BY path)", "SELECT path_a, path_b, round(freq / (x.n + y.n - freq)::DOUBLE, 6) AS jaccard FROM co JOIN n x ON x.path = path_a JOIN n y ON y.path = path_b WHERE freq >= 3"),
)
def _(s, d):
    cf = M.commit_files(s, d)
    sets = cf.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    x, y = sets.select(F.col("path").alias("path_a"), F.col("n").alias("na")), sets.select(F.col("path").alias("path_b"), F.col("n").alias("nb"))
    p = co_changes(cf).filter("freq >= 3").join(x, "path_a").join(y, "path_b")
    return p.select("path_a", "path_b", F.round(F.col("freq") / (F.col("na") + F.col("nb") - F.col("freq")), 6).alias("jaccard"))


@q("src03_excluded_paths", sql("fl", "SELECT path FROM fl WHERE NOT (len(list_intersect(string_split(path, '/'), ['node_modules','target','dist','.git','vendor'])) > 0 OR path LIKE '%.lock' OR path LIKE '%.min.js')"))
def _(s, d):
    parts = F.split("path", "/")
    bad = F.arrays_overlap(parts, F.array(*map(F.lit, ("node_modules", "target", "dist", ".git", "vendor")))) | F.col("path").endswith(".lock") | F.col("path").endswith(".min.js")
    return M.files(s, d).filter(~bad).select("path")


@q(
    "src05_language_by_extension",
    sql(
        "fl",
        "ex(ext, lang) AS (VALUES " + ", ".join(f"('{e}', '{lang}')" for lang, es in code.LANGUAGES.items() for e in es) + ")",
        "SELECT path, coalesce(lang, 'unknown') AS language FROM (SELECT path, CASE WHEN contains(string_split(path, '/')[-1], '.') THEN lower(string_split(path, '.')[-1]) ELSE '' END AS ext FROM fl) LEFT JOIN ex USING (ext)",
    ),
)
def _(s, d):
    return M.files(s, d).select("path", code.language_of(F.col("path")).alias("language"))


@q(
    "src06_changed_content",
    r"""WITH sc AS (SELECT nullif(regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '') AS path, nullif(lower(trim(hash)), '') AS hash FROM file_scans),
    st AS (SELECT DISTINCT nullif(regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '') AS path, nullif(lower(trim(hash)), '') AS hash FROM files)
    SELECT DISTINCT path, hash FROM sc WHERE path IS NOT NULL AND hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM st WHERE st.path = sc.path AND st.hash = sc.hash)""",
)
def _(s, d):
    from quillspan.functions.paths import plain_hash

    one = lambda t: table(s, d, t).select(plain_path(F.col("path")).alias("path"), plain_hash(F.col("hash")).alias("hash")).dropna().distinct()
    return one("file_scans").join(one("files"), ["path", "hash"], "left_anti")


@q("src09_pruned_hashes", r"""WITH sc AS (SELECT DISTINCT nullif(regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '') AS path FROM file_scans WHERE NOT coalesce(is_deleted, false)),
    fl AS (SELECT DISTINCT nullif(regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '') AS path FROM files)
    SELECT path FROM fl WHERE path IS NOT NULL AND path IN (SELECT path FROM sc)""")
def _(s, d):
    seen = table(s, d, "file_scans").filter("not coalesce(is_deleted, false)").select(plain_path(F.col("path")).alias("path")).distinct()
    return table(s, d, "files").select(plain_path(F.col("path")).alias("path")).dropna().distinct().join(seen, "path", "left_semi")


@q(
    "src12_module_names",
    sql(
        "fl",
        r"""SELECT path, CASE WHEN m = '' THEN 'root' ELSE m END AS module FROM (SELECT path, array_to_string(CASE WHEN p[-1] IN ('mod','index') THEN p[:-2] ELSE p END, '::') AS m FROM (
        SELECT path, string_split(regexp_replace(regexp_replace(regexp_replace(path, '^[^/]*/', ''), '^(src|lib|tests?)/', ''), '\.[^./]*$', ''), '/') AS p FROM fl))""",
    ),
)
def _(s, d):
    p = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^[^/]*/", ""), r"^(src|lib|tests?)/", ""), r"\.[^./]*$", ""), "/")
    cut = F.when(F.element_at(p, -1).isin("mod", "index"), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)
    m = F.array_join(cut, "::")
    return M.files(s, d).select("path", F.when(m == "", "root").otherwise(m).alias("module"))
