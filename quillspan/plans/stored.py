"""Stored tables read, replaced and cut down; predicates and dictionaries over them (reference sections 2.1, 2.2, 2.8, 2.13a)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.operators import history as H
from quillspan.operators import interchange as I
from quillspan.operators import relational as R
from quillspan.plans.base_sql import EDGE_TYPES, sql
from quillspan.plans.book import Book
from quillspan.session import materialize
from quillspan.sources import model as M
from quillspan.sources.tables import table

q = Book()
QUERIES, SQL = q.queries, q.sql

# ---------------------------------------------------------------- whole tables


@q("src58_all_files", sql("fl", "SELECT id, path, language, hash, size_bytes FROM fl"))
def _(s, d):
    return M.files(s, d).select("id", "path", "language", "hash", "size_bytes").orderBy("path")


@q("src59_all_symbols", sql("sy", "SELECT id, name, fqn, kind, file_id, line FROM sy"))
def _(s, d):
    return M.symbols(s, d).select("id", "name", "fqn", "kind", "file_id", "line")


@q("src60_all_dependencies", sql("dp", "SELECT source_id, target_id, kind FROM dp"))
def _(s, d):
    return M.dependencies(s, d)


@q("src54_known_file_edges", sql("fe", "x AS (SELECT source_path, target_path, CASE WHEN edge_type = 'calls' THEN 'mystery' ELSE edge_type END AS edge_type, weight FROM fe)", f"SELECT * FROM x WHERE list_contains({EDGE_TYPES}, edge_type)"))
def _(s, d):
    """Edges of a type that isn't known are left out when they are loaded."""
    e = M.file_edges(s, d).withColumn("edge_type", F.when(F.col("edge_type") == "calls", "mystery").otherwise(F.col("edge_type")))
    return e.filter(F.col("edge_type").isin(*M.EDGE_TYPES))


_TOKENS = r"list_sort(list_filter(regexp_split_to_array(lower(doc_comment), '[^\p{L}\p{N}]+'), lambda x: x <> ''))"


def stored_vectors(s, d):
    """(chunk_id, tokens) with the sparse vector as JSON, [[token, weight], ...]; every seventh is malformed."""
    words = F.array_sort(F.filter(F.split(F.lower("doc_comment"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    c = M.chunks(s, d, "doc_comment").filter("doc_comment is not null").select("id", F.explode(words).alias("token"))
    c = c.groupBy("id", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "n"))).alias("v"))
    text = F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: F.concat(F.lit('["'), x["token"], F.lit('",'), x["n"].cast("string"), F.lit("]"))), ","), F.lit("]"))
    return c.select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 7 == 0, F.lit("[[broken")).otherwise(text).alias("tokens"))


_STORED = (
    f"tk AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest({_TOKENS}) AS token FROM ch WHERE doc_comment IS NOT NULL) GROUP BY ALL),"
    " st AS (SELECT id AS chunk_id, CASE WHEN id % 7 = 0 THEN '[[broken' ELSE '[' || string_agg('[\"' || token || '\",' || n || ']', ',' ORDER BY token) || ']' END AS tokens FROM tk GROUP BY id)"
)


@q("src55_sparse_vectors_saved", sql("ch", _STORED, "SELECT chunk_id, tokens FROM st"))
def _(s, d):
    return stored_vectors(s, d)


@q("src56_sparse_vectors_loaded", sql("ch", _STORED, "SELECT id AS chunk_id, count(*)::BIGINT AS tokens, sum(n)::DOUBLE AS weight FROM tk WHERE id % 7 <> 0 GROUP BY id"))
def _(s, d):
    """Malformed rows are left out."""
    v = stored_vectors(s, d).withColumn("v", F.from_json("tokens", "array<array<string>>")).filter(F.col("v").isNotNull() & F.forall("v", lambda x: F.size(x) == 2))
    return v.select("chunk_id", F.size("v").cast("long").alias("tokens"), F.aggregate("v", F.lit(0.0), lambda t, x: t + x[1].cast("double")).alias("weight"))


@q("src65_symbol_strings", sql("sy", "fl", "SELECT sy.id, fl.path AS path, sy.name AS name FROM sy JOIN fl ON fl.id = sy.file_id"))
def _(s, d):
    """Symbol strings read back: what was escaped comes out again."""
    y = M.symbols(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id")
    y = y.withColumn("text", I.symbol_string(F.col("path"), F.col("name")))
    return y.select("id", *I.symbol_parts(F.col("text")))


@q("agg35_import_statistics", sql("sy", "fl", "SELECT (SELECT count(*) FROM fl)::BIGINT AS documents, (SELECT count(*) FROM sy JOIN fl ON fl.id = sy.file_id)::BIGINT AS symbols, 0::BIGINT AS errors"))
def _(s, d):
    docs = I.export_documents(M.files(s, d), M.symbols(s, d)).select(F.to_json(F.struct("relative_path", "language", "symbols")).alias("json"))
    return I.import_statistics(docs, "json")


# ---------------------------------------------------------------- deletes and replacement


@q("join03_edges_of_a_file", sql("sy", "dp", "g AS (SELECT id FROM sy WHERE file_id = (SELECT min(file_id) FROM sy))", "SELECT source_id, target_id, kind FROM dp WHERE source_id IN (SELECT id FROM g) OR target_id IN (SELECT id FROM g) UNION ALL SELECT source_id, target_id, kind FROM dp WHERE source_id % 50 = 0"))
def _(s, d):
    """Edges with an end among the symbols of a file: two semi joins, as an OR would be a nested loop."""
    y, e = M.symbols(s, d), M.dependencies(s, d)
    own = y.join(F.broadcast(y.agg(F.min("file_id").alias("file_id"))), "file_id").select("id")
    out = e.join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    into = e.join(own.select(F.col("id").alias("target_id")), "target_id", "left_semi").join(own.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    cols = ("source_id", "target_id", "kind")
    return out.select(*cols).union(into.select(*cols)).union(e.filter("source_id % 50 = 0").select(*cols))


@q("xtr26_chunks_deleted", sql("ch", "SELECT id FROM ch WHERE file_id IS NULL OR file_id % 10 <> 3"))
def _(s, d):
    gone = M.files(s, d).filter("id % 10 = 3").select(F.col("id").alias("k")).union(M.chunks(s, d, "file_id").filter("file_id % 10 = 3").select("file_id")).distinct()
    return R.delete_where(M.chunks(s, d, "file_id"), gone, {"file_id": "k"}).select("id")


@q("xtr27_symbols_deleted", sql("sy", "SELECT id, fqn FROM sy WHERE file_id IS NULL OR file_id % 10 <> 3"))
def _(s, d):
    y = materialize(M.symbols(s, d), "symbols")
    return R.delete_where(y, y.filter("file_id % 10 = 3").select(F.col("file_id").alias("k")).distinct(), {"file_id": "k"}).select("id", "fqn")


@q("xtr28_edges_of_symbols_deleted", sql("dp", "SELECT source_id, target_id, kind FROM dp WHERE source_id % 9 <> 4 AND target_id % 9 <> 4"))
def _(s, d):
    e = materialize(M.dependencies(s, d), "edges")
    ids = e.select(F.col("source_id").alias("k")).union(e.select("target_id")).distinct().filter("k % 9 = 4")
    return R.delete_where(e, ids, {"source_id": "k", "target_id": "k"}).select("source_id", "target_id", "kind")


@q("gra11_symbols_removed", sql("dp", "nd AS (SELECT source_id AS id FROM dp UNION SELECT target_id FROM dp)", "SELECT nd.id, (SELECT count(*) FROM dp WHERE source_id = nd.id AND target_id % 5 <> 2)::BIGINT AS edges_left FROM nd WHERE nd.id % 5 <> 2"))
def _(s, d):
    """Nodes that are left when some are removed, with their edges out."""
    e = materialize(M.dependencies(s, d), "edges")
    nodes = e.select(F.col("source_id").alias("id")).union(e.select("target_id")).distinct()
    gone = nodes.filter("id % 5 = 2")
    left = R.delete_where(e, gone, {"source_id": "id", "target_id": "id"}).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("edges_left"))
    return nodes.join(gone, "id", "left_anti").join(left, "id", "left").fillna(0, ["edges_left"])


@q("xtr29_edges_of_a_file_deleted", sql("fe", "SELECT source_path, target_path, edge_type FROM fe WHERE source_path NOT LIKE '%7.rs'"))
def _(s, d):
    e = materialize(M.file_edges(s, d), "file-edges")
    gone = e.filter("source_path like '%7.rs'").select(F.col("source_path").alias("p")).distinct()
    return R.delete_where(e, gone, {"source_path": "p"}).select("source_path", "target_path", "edge_type")


@q(
    "src50_files_reindexed",
    sql(
        "sy", "fl",
        "g AS (SELECT id FROM fl WHERE path LIKE '%.rs')",
        "SELECT 'chunk' AS what, id, file_id FROM ch WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'chunk', id + 1000000000, file_id FROM ch WHERE file_id IN (SELECT id FROM g) AND kind = 'function'"
        " UNION ALL SELECT 'symbol', id, file_id FROM sy WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'symbol', id + 1000000000, file_id FROM sy WHERE file_id IN (SELECT id FROM g) AND kind = 'function'",
    ),
)
def _(s, d):
    """Chunks and symbols after some files came again with their functions only, under new ids."""
    f = M.files(s, d).filter("path like '%.rs'").select(F.col("id").alias("file_id"))
    parts = []
    for what, rows in (("chunk", M.chunks(s, d, "file_id", "kind")), ("symbol", M.symbols(s, d).select("id", "file_id", "kind"))):
        rows = materialize(rows, what)
        new = rows.join(f, "file_id", "left_semi").filter("kind = 'function'").withColumn("id", F.col("id") + 1_000_000_000)
        parts.append(R.replace_files(rows, new, f).select(F.lit(what).alias("what"), "id", "file_id"))
    return parts[0].unionByName(parts[1])


@q("xtr48_changed_files", sql("fl", "sc AS (SELECT nullif(regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\\./)+', ''), '') AS path, nullif(lower(trim(hash)), '') AS h, seen_at, scan_id FROM file_scans WHERE nullif(trim(hash), '') IS NOT NULL AND seen_at IS NOT NULL)", "nw AS (SELECT path, arg_max(h, (seen_at, scan_id)) AS h FROM sc WHERE path IS NOT NULL GROUP BY path)", "SELECT nw.path, fl.hash IS DISTINCT FROM nw.h AS changed FROM nw LEFT JOIN fl USING (path)"))
def _(s, d):
    from quillspan.functions.paths import plain_hash, plain_path

    sc = table(s, d, "file_scans").select(plain_path(F.col("path")).alias("path"), plain_hash(F.col("hash")).alias("h"), "seen_at", "scan_id").filter("path is not null and h is not null and seen_at is not null")
    new = sc.groupBy("path").agg(F.max_by("h", F.struct("seen_at", "scan_id")).alias("h"))
    return new.join(M.files(s, d).select("path", "hash"), "path", "left").select("path", (~F.col("hash").eqNullSafe(F.col("h"))).alias("changed"))


# ---------------------------------------------------------------- lookups and predicates


@q("fil08_symbol_by_id", sql("sy", "SELECT id, name, fqn, kind FROM sy WHERE id IN (SELECT id FROM sy ORDER BY id DESC LIMIT 1)"))
def _(s, d):
    y = materialize(M.symbols(s, d), "symbols")
    return y.join(F.broadcast(y.agg(F.max("id").alias("id"))), "id").select("id", "name", "fqn", "kind")


@q("fil21_importers", sql("fe", "SELECT source_path AS path, target_path AS neighbour FROM fe WHERE edge_type = 'imports' UNION SELECT target_path, source_path FROM fe WHERE edge_type = 'imports'"))
def _(s, d):
    return R.neighbours_by_type(M.file_edges(s, d), "imports")


@q("fil29_document_files", sql("fl", "SELECT id FROM fl WHERE language IN (" + ", ".join(f"'{x}'" for x in code.DOCUMENT_LANGUAGES) + ")"))
def _(s, d):
    return M.files(s, d).filter(code.is_document(F.col("language"))).select("id")


@q("fil31_flow_edges", sql("dp", "SELECT source_id, target_id, kind IN ('data_flow','error_flow','type_flow') AS flow FROM dp"))
def _(s, d):
    return M.dependencies(s, d).select("source_id", "target_id", code.is_flow(F.col("kind")).alias("flow"))


_EXT = "CASE WHEN contains(string_split(path, '/')[-1], '.') THEN lower(string_split(string_split(path, '/')[-1], '.')[-1]) ELSE '' END"
_LANG = f"CASE {_EXT} " + " ".join(f"WHEN '{e}' THEN '{lang}'" for lang, es in code.LANGUAGES.items() for e in es) + " ELSE 'unknown' END"


@q("src04_source_files", sql("fl", f"SELECT path FROM fl WHERE {_LANG} <> 'unknown'"))
def _(s, d):
    return M.files(s, d).filter(code.language_of(F.col("path")) != "unknown").select("path")


@q("xtr45_language_labels", sql("cf", f"SELECT {_LANG} AS label, count(DISTINCT path)::BIGINT AS paths FROM cf GROUP BY 1"))
def _(s, d):
    return M.commit_files(s, d).groupBy(code.language_of(F.col("path")).alias("label")).agg(F.countDistinct("path").alias("paths"))


@q("str29_language_names", sql("fl", f"SELECT DISTINCT language, language IN ({', '.join(repr(x) for x in code.LANGUAGES)}) AS known FROM fl"))
def _(s, d):
    return M.files(s, d).select("language", F.col("language").isin(list(code.LANGUAGES)).alias("known")).distinct()


@q("str32_visibility_weights", sql("ch", "SELECT visibility, CASE visibility " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in code.VISIBILITY_WEIGHT.items()) + " END AS weight, count(*)::BIGINT AS n FROM ch GROUP BY ALL"))
def _(s, d):
    return M.chunks(s, d, "visibility").groupBy("visibility", code.visibility_weight(F.col("visibility")).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@q("xtr39_element_weights", sql("ch", "SELECT id, round((CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in code.KIND_WEIGHT.items()) + " ELSE 0.5 END * CASE visibility " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in code.VISIBILITY_WEIGHT.items()) + " END)::DOUBLE, 6) AS weight FROM ch"))
def _(s, d):
    return M.chunks(s, d, "kind", "visibility").select("id", F.round(code.kind_weight(F.col("kind")) * code.visibility_weight(F.col("visibility")), 6).alias("weight"))


@q("str34_trivial_methods", sql("sy", "SELECT name, lower(name) IN (" + ", ".join(f"'{x}'" for x in code.TRIVIAL_METHODS) + ") AS trivial FROM sy GROUP BY name UNION ALL SELECT unnest(['unwrap', 'Clone', 'store']), unnest([true, true, false])"))
def _(s, d):
    names = M.symbols(s, d).select("name").distinct().unionByName(s.createDataFrame([(x,) for x in ("unwrap", "Clone", "store")], "name string"))
    return names.select("name", F.lower("name").isin(list(code.TRIVIAL_METHODS)).alias("trivial"))


# ---------------------------------------------------------------- texts


@q("str14_cut_to_tokens", sql("ch", r"cut AS (SELECT id, content, CASE WHEN octet_length(encode(content)) <= 400 THEN content ELSE content[1:400] END AS c FROM ch WHERE content IS NOT NULL AND octet_length(encode(content)) = length(content))", "SELECT id, md5(CASE WHEN length(content) <= 400 OR NOT contains(c, chr(10)) THEN c ELSE c[1:length(c) - instr(reverse(c), chr(10))] END) AS cut FROM cut"))
def _(s, d):
    """Contents cut to 100 tokens, of those in ASCII, where characters are bytes."""
    c = M.chunks(s, d, "content").filter("content is not null and octet_length(content) = length(content)")
    return c.select("id", F.md5(code.cut_to_tokens(F.col("content"), 100)).alias("cut"))


@q("str15_token_counts", sql("ch", "SELECT file_id, sum(greatest(1, octet_length(encode(content)) // 4))::BIGINT AS tokens FROM ch WHERE content IS NOT NULL GROUP BY file_id"))
def _(s, d):
    return M.chunks(s, d, "file_id", "content").filter("content is not null").groupBy("file_id").agg(F.sum(F.greatest(F.lit(1), F.floor(F.octet_length("content") / 4))).alias("tokens"))


@q("str16_texts_for_embedding", sql("ch", "SELECT md5(content) AS text, count(*)::BIGINT AS n FROM ch WHERE content IS NOT NULL GROUP BY 1"))
def _(s, d):
    return M.chunks(s, d, "content").filter("content is not null").groupBy(F.md5("content").alias("text")).agg(F.count(F.lit(1)).alias("n"))


@q("str22_hash_classes", sql("ch", "SELECT min(id) AS first, count(*)::BIGINT AS n FROM ch WHERE content IS NOT NULL GROUP BY content"))
def _(s, d):
    """64-bit hashes of contents tell the same classes of equal contents as the contents."""
    return M.chunks(s, d, "content").filter("content is not null").groupBy(F.xxhash64("content")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).select("first", "n")


@q("str23_prose_pieces")
def _(s, d):
    from quillspan.sources.parse import prose_chunks

    docs = table(s, d, "external_docs").select("id", "content").filter("content is not null").distinct()

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            out = [(i, n, t) for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, t in enumerate(prose_chunks(c))]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["id", "piece", "content"])

    return docs.mapInArrow(run, "id long, piece int, content string")


_VERBS = "get|fetch|set|update|create|new|delete|remove|validate|check|parse|decode|format|encode|handle|process|is|has|to|from"


@q("str26_subjects_of_names", sql("sy", f"SELECT DISTINCT name, replace(regexp_replace(lower(name), '^(?:{_VERBS})_', ''), '_', ' ') || ' data' AS subject FROM sy"))
def _(s, d):
    return M.symbols(s, d).select("name", code.subject_of(F.col("name")).alias("subject")).distinct()


@q("src38_hunk_headers", sql("cm", r"hd AS (SELECT hash, '@@ -' || length(message) || ',3 +' || (length(message) % 90 + 1) || CASE WHEN length(message) % 3 = 0 THEN '' ELSE ',' || (length(message) % 7) END || ' @@ ' || message AS line FROM cm WHERE message IS NOT NULL)", r"SELECT hash, regexp_extract(line, '^@@ -\d+(?:,\d+)? \+(\d+)', 1)::INT AS start_line, CASE WHEN regexp_matches(line, '^@@ -\d+(?:,\d+)? \+\d+,\d+ @@') THEN regexp_extract(line, '^@@ -\d+(?:,\d+)? \+\d+,(\d+) @@', 1)::INT ELSE 1 END AS line_count FROM hd"))
def _(s, d):
    n = F.length("message")
    line = F.concat(F.lit("@@ -"), n, F.lit(",3 +"), n % 90 + 1, F.when(n % 3 == 0, "").otherwise(F.concat(F.lit(","), n % 7)), F.lit(" @@ "), "message")
    return M.commits(s, d).filter("message is not null").select("hash", line.alias("line")).select("hash", *code.hunk_header(F.col("line")))


# ---------------------------------------------------------------- history


@q("agg13_changed_together", sql("co", "SELECT path_a, path_b, freq FROM co WHERE freq >= 5"))
def _(s, d):
    return H.co_changes(M.commit_files(s, d)).filter("freq >= 5")


@q("xtr04_pairs_above", sql("co", "SELECT freq, count(*)::BIGINT AS pairs FROM co WHERE freq >= 3 GROUP BY freq"))
def _(s, d):
    return H.co_changes(M.commit_files(s, d)).filter("freq >= 3").groupBy("freq").agg(F.count(F.lit(1)).alias("pairs"))


@q("xtr03_pair_frequencies", sql("co", "cf", "ak AS (SELECT path AS x, lead(path, 3) OVER (ORDER BY path) AS y FROM (SELECT DISTINCT path FROM cf))", "SELECT x, y, coalesce(freq, 0)::BIGINT AS freq FROM ak LEFT JOIN co ON path_a = least(x, y) AND path_b = greatest(x, y) WHERE y IS NOT NULL"))
def _(s, d):
    """Frequencies of pairs asked for in any order, 0 for those that never changed together."""
    from pyspark.sql import Window

    rows = materialize(M.commit_files(s, d), "commit-files")
    # pairs that are asked for: each path with one that is near it in a sort by range, in either order
    paths = rows.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())
    paths = materialize(paths.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("path"))), "paths")
    before = paths.groupBy("part").agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = materialize(paths.join(F.broadcast(before), "part").select("path", (F.col("b") + F.col("n")).alias("n")), "places")
    asked = at.select(F.col("path").alias("x"), (F.col("n") + 3).alias("n")).join(at.select(F.col("path").alias("y"), "n"), "n").select("x", "y")
    return H.pair_frequency(H.co_changes(rows), asked)


@q("xtr05_bug_fix_counts", sql("fl", "cm", "cf", "b AS (SELECT cf.path, count(*) AS n FROM cf JOIN cm USING (hash) WHERE regexp_matches(lower(message), 'fix|bug|patch') GROUP BY 1)", "SELECT fl.path, coalesce(n, 0)::BIGINT AS bugs FROM fl LEFT JOIN b USING (path)"))
def _(s, d):
    return M.files(s, d).select("path").join(H.bug_fixes(M.commits(s, d), M.commit_files(s, d)), "path", "left").fillna(0, ["bugs"])


@q("xtr34_commits_naming_a_file", "SELECT DISTINCT lower(trim(hash)) AS hash FROM commits WHERE contains(files_changed, '\"' || (SELECT min(file_path) FROM commit_files WHERE file_path LIKE '%/src/%') || '\"')")
def _(s, d):
    path = table(s, d, "commit_files").filter("file_path like '%/src/%'").agg(F.min("file_path").alias("p"))
    c = table(s, d, "commits").join(F.broadcast(path), how="cross")  # one row
    return c.filter(F.col("files_changed").contains(F.concat(F.lit('"'), "p", F.lit('"')))).select(F.lower(F.trim("hash")).alias("hash")).distinct()


@q("src33_uncommitted_files", sql("cm", "cf", "nw AS (SELECT hash, row_number() OVER (ORDER BY ts DESC NULLS LAST, hash) AS rn FROM cm)", "SELECT DISTINCT path FROM cf JOIN nw USING (hash) WHERE rn <= 30"))
def _(s, d):
    """Union of three lists of paths (of the newest commits, ten each), each path once."""
    newest = M.commits(s, d).orderBy(F.col("ts").desc_nulls_last(), "hash").limit(30).select("hash")
    hit = materialize(M.commit_files(s, d).join(F.broadcast(newest), "hash"), "changed")
    third = F.pmod(F.xxhash64("hash"), F.lit(3))
    lists = [hit.filter(third == i).select("path") for i in range(3)]
    return lists[0].union(lists[1]).union(lists[2]).distinct()


# ---------------------------------------------------------------- rates of events


def _rate(name: str, hit: str, miss: str):  # noqa: ANN202
    part = f"count(*) FILTER (event_type IN ({hit}))"

    @q(name, f"SELECT user_id, round({part}::DOUBLE / nullif(count(*) FILTER (event_type IN ({hit}, {miss})), 0), 6) AS rate FROM events GROUP BY user_id")
    def _(s, d):
        of = lambda names: F.count(F.when(F.expr(f"event_type in ({names})"), 1))
        return table(s, d, "events").groupBy("user_id").agg(F.round(of(hit) / F.nullif(of(f"{hit}, {miss}"), F.lit(0)), 6).alias("rate"))


for _name, _hit, _miss in (("xtr50_success_rates", "'purchase'", "'error'"), ("xtr51_rejection_rates", "'error'", "'click', 'view'"), ("xtr52_deduplication_rates", "'click'", "'view'"), ("xtr54_prefetch_hit_rates", "'view'", "'click'")):
    _rate(_name, _hit, _miss)


@q("xtr53_mean_processing_times", "SELECT event_type, round(sum(value) / count(value), 6) AS mean FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.count("value"), 6).alias("mean"))


@q("xtr56_requests_over_the_limit", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*)::BIGINT AS n, greatest(count(*) - 5, 0)::BIGINT AS rejected FROM events GROUP BY ALL")
def _(s, d):
    """Requests a key makes in a fixed window, and those over its limit."""
    e = table(s, d, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("rejected", F.greatest(F.col("n") - 5, F.lit(0)))

