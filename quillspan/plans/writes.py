"""Keyed writes and cascading deletes (reference sections 2.1, 2.13a)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.paths import plain_hash, plain_path
from quillspan.operators import relational as R
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.sources import model as M
from quillspan.sources.tables import table

q = Book()
QUERIES, SQL = q.queries, q.sql

_P = r"nullif(regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '')"


@q(
    "src47_upserted_files",
    sql(
        "fl",
        f"nw AS (SELECT * FROM (SELECT {_P} AS path, nullif(lower(trim(hash)), '') AS hash, row_number() OVER (PARTITION BY {_P} ORDER BY seen_at DESC, scan_id DESC, nullif(lower(trim(hash)), '') DESC NULLS LAST) AS rn FROM file_scans WHERE {_P} IS NOT NULL) WHERE rn = 1)",
        "SELECT path, hash FROM nw UNION ALL SELECT path, hash FROM fl WHERE path NOT IN (SELECT path FROM nw)",
    ),
)
def _(s, d):
    new = table(s, d, "file_scans").select(plain_path(F.col("path")).alias("path"), plain_hash(F.col("hash")).alias("hash"), "seen_at", "scan_id").filter("path is not null")
    old = M.files(s, d).select("path", "hash", F.lit(None).cast("timestamp_ntz").alias("seen_at"), F.lit(None).cast("long").alias("scan_id"))
    return R.upsert(old, new, ["path"], [F.col("seen_at").desc(), F.col("scan_id").desc(), F.col("hash").desc_nulls_last()]).select("path", "hash")


@q("src49_symbols_last_writer", sql("sy", "SELECT fqn, id, kind FROM sy"))
def _(s, d):
    return M.symbols(s, d).select("fqn", "id", "kind")


@q(
    "src51_cascaded_delete",
    sql(
        "sy", "fl", "dp",
        "gn AS (SELECT id FROM fl WHERE path LIKE '%/src/%')", "ls AS (SELECT id FROM sy WHERE file_id IN (SELECT id FROM gn))",
        "SELECT 'files' AS t, count(*)::BIGINT AS n FROM fl WHERE id NOT IN (SELECT id FROM gn) UNION ALL SELECT 'chunks', count(*) FROM ch WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM gn)"
        " UNION ALL SELECT 'symbols', count(*) FROM sy WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM gn)"
        " UNION ALL SELECT 'dependencies', count(*) FROM dp WHERE source_id NOT IN (SELECT id FROM ls) AND target_id NOT IN (SELECT id FROM ls)",
    ),
)
def _(s, d):
    f = M.files(s, d)
    parts = R.cascade_delete(f, M.chunks(s, d, "file_id"), M.symbols(s, d), M.dependencies(s, d), f.filter(F.col("path").contains("/src/")))
    out = None
    for name, p in zip(("files", "chunks", "symbols", "dependencies"), parts, strict=True):
        one = p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n")
        out = one if out is None else out.union(one)
    return out


@q("src52_dependencies_inserted", sql("dp", "SELECT DISTINCT source_id, target_id, kind FROM (SELECT * FROM dp UNION ALL SELECT target_id, source_id, kind FROM dp WHERE kind = 'calls')"))
def _(s, d):
    e = M.dependencies(s, d)
    new = e.filter("kind = 'calls'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "kind")
    return R.insert_ignore(e.dropDuplicates(), new, ["source_id", "target_id", "kind"])


@q("src53_edges_replaced", sql("fe", "SELECT source_path, target_path, edge_type, CASE WHEN edge_type = 'calls' THEN 2.0 ELSE weight END AS weight FROM fe"))
def _(s, d):
    e = M.file_edges(s, d)
    return R.upsert(e, e.filter("edge_type = 'calls'").withColumn("weight", F.lit(2.0)), ["source_path", "target_path", "edge_type"])


@q("src57_external_docs_upserted", "SELECT source_url, max(ingested_at) AS ingested_at FROM external_docs GROUP BY source_url")
def _(s, d):
    e = table(s, d, "external_docs")
    return R.upsert(e.limit(0), e, ["source_url"], [F.col("ingested_at").desc_nulls_last(), F.col("id").desc()]).select("source_url", "ingested_at")


@q("gra10_edges_removed", sql("dp", "gn AS (SELECT DISTINCT target_id AS id FROM dp WHERE kind = 'error_flow')", "SELECT source_id, target_id FROM dp WHERE source_id NOT IN (SELECT id FROM gn) AND target_id NOT IN (SELECT id FROM gn)"))
def _(s, d):
    e = M.dependencies(s, d)
    gone = e.filter("kind = 'error_flow'").select(F.col("target_id").alias("id")).distinct()
    return R.delete_where(e, gone, {"source_id": "id", "target_id": "id"}).select("source_id", "target_id")


@q("ret09_tombstones", "SELECT vec_id AS id FROM embeddings WHERE label <> 3")
def _(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return v.select("id").join(v.filter("label = 3").select("id"), "id", "left_anti")


@q("xtr30_vectors_assigned", sql("ch", "SELECT id, coalesce(vector_id, id + 1000000) AS vector_id FROM ch"))
def _(s, d):
    c = M.chunks(s, d, "vector_id")
    return R.upsert(c, c.filter("vector_id is null").withColumn("vector_id", F.col("id") + 1000000), ["id"])


@q("xtr32_external_docs_listed", "SELECT DISTINCT id, source_url, title, ingested_at FROM external_docs")
def _(s, d):
    return table(s, d, "external_docs").select("id", "source_url", "title", "ingested_at").distinct().orderBy(F.col("ingested_at").desc(), "id")


@q("src32_commits_stored", sql("cm", "cf", "SELECT cm.hash, count(cf.path)::BIGINT AS files FROM cm LEFT JOIN cf USING (hash) GROUP BY cm.hash"))
def _(s, d):
    return M.commits(s, d).select("hash").join(M.commit_files(s, d), "hash", "left").groupBy("hash").agg(F.count("path").alias("files"))
