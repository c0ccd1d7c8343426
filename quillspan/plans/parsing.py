"""Documents, code, diffs, interchange documents (reference sections 2.1, 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators.interchange import export_documents, import_statistics
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.sources import model as M
from quillspan.sources import parse as P
from quillspan.sources.tables import table

q = Book()
QUERIES, SQL = q.queries, q.sql

_LINES = r"""ln AS (SELECT id, unnest(string_split(regexp_replace(c, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(c, '\r\n?', chr(10), 'g'), chr(10)), 1) AS pos FROM src)"""


def _sections_sql(src: str, begins: str, name: str) -> str:
    return sql(
        src, _LINES,
        f"sc AS (SELECT *, sum(({begins})::INT) OVER (PARTITION BY id ORDER BY pos) AS section FROM ln)",
        f"gr AS (SELECT id, section::BIGINT AS section, max(CASE WHEN {begins} THEN {name} END) AS name, min(pos)::INT AS line_start, max(pos)::INT AS line_end FROM sc GROUP BY id, section)",
        "SELECT id, section, name, line_start, line_end FROM gr WHERE section > 0 OR id IN (SELECT id FROM gr GROUP BY id HAVING max(section) = 0)",
    )


_DOCS = "src AS (SELECT doc_id AS id, text AS c FROM documents WHERE text IS NOT NULL)"


@q("src27_markdown_sections", _sections_sql(_DOCS, "starts_with(line, '#')", r"trim(regexp_replace(line, '^#+\s*', ''))"))
def _(s, d):
    docs = table(s, d, "documents").filter("text is not null")
    return P.markdown(docs, "doc_id", "text").drop("content")


_TOML = "src AS (SELECT ch.id, ch.content AS c FROM ch JOIN fl ON fl.id = ch.file_id WHERE fl.path LIKE '%.toml' AND ch.content IS NOT NULL)"


@q("src28_toml_tables")
def _(s, d):
    f = M.files(s, d).filter(F.col("path").endswith(".toml")).select(F.col("id").alias("file_id"))
    return P.toml(M.chunks(s, d, "file_id", "content").filter("content is not null").join(f, "file_id", "left_semi"), "id", "content").drop("content")


SQL["src28_toml_tables"] = sql(
    "ch", "fl", _TOML, _LINES,
    r"sc AS (SELECT *, regexp_matches(line, '^\s*\[\[?[^\]]+\]\]?\s*$') AS b FROM ln)",
    "sd AS (SELECT *, sum(b::INT) OVER (PARTITION BY id ORDER BY pos) AS section FROM sc)",
    r"gr AS (SELECT id, section::BIGINT AS section, max(CASE WHEN b THEN regexp_extract(line, '\[\[?([^\]]+)\]', 1) END) AS name, min(pos)::INT AS line_start, max(pos)::INT AS line_end FROM sd GROUP BY id, section)",
    "SELECT id, section, name, line_start, line_end FROM gr WHERE section > 0 OR id IN (SELECT id FROM gr GROUP BY id HAVING max(section) = 0)",
)


@q(
    "src29_blocks",
    sql(
        "src AS (SELECT doc_id AS id, text AS c FROM documents WHERE text IS NOT NULL)", _LINES,
        "bl AS (SELECT *, trim(line, ' ') = '' AS blank FROM ln)",
        "b2 AS (SELECT *, (NOT blank AND coalesce(lag(blank) OVER (PARTITION BY id ORDER BY pos), true))::INT AS b FROM bl)",
        "b3 AS (SELECT *, sum(b) OVER (PARTITION BY id ORDER BY pos) - 1 AS block FROM b2)",
        "SELECT id, block::BIGINT AS block, 'block_' || block::BIGINT AS name, min(pos)::INT AS line_start, max(pos)::INT AS line_end FROM b3 WHERE NOT blank GROUP BY id, block",
    ),
)
def _(s, d):
    return P.blocks(table(s, d, "documents").filter("text is not null"), "doc_id", "text").drop("content")


@q("src10_code_elements")
def _(s, d):
    f = M.files(s, d).select(F.col("id").alias("file_id"), "language")
    e = P.parse_code(M.chunks(s, d, "file_id", "content").join(f, "file_id"), "id", "content", "language")
    return e.select("id", "name", "kind", "line_start", "line_end", "visibility")


@q("src11_imports", sql("ch", r"g AS (SELECT id, unnest(regexp_extract_all(content, '(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+(?:static\s+)?([\w.:]+)|use\s+([\w:.]+)|#\s*include\s+[<\"]([^>\"]+)|using\s+([\w.]+))', 0)) AS g FROM ch WHERE content IS NOT NULL)", r"SELECT DISTINCT id, regexp_replace(regexp_replace(g, '^\s*(?:from|import\s+static|import|use|#\s*include|using)\s+[<\"]?', ''), '\s+import$', '') AS target FROM g"))
def _(s, d):
    return P.imports(M.chunks(s, d, "content").filter("content is not null"), "id", "content")


@q("src40_external_chunks")
def _(s, d):
    """Pages as prose chunks of about 400 tokens."""
    from collections.abc import Iterator

    import pyarrow as pa

    from quillspan.functions.code import html_text

    docs = table(s, d, "external_docs").groupBy("source_url").agg(F.max(F.struct("ingested_at", "id", "content")).alias("m"))
    text = F.when(F.col("m.content").ilike("%<html%"), html_text(F.col("m.content"))).otherwise(F.col("m.content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(u, i, c) for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(P.prose_chunks(t or ""))]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.int32()), pa.array(list(cols[2]), pa.string())], ["source_url", "no", "content"])

    return docs.select("source_url", text.alias("t")).mapInArrow(run, "source_url string, no int, content string")


@q("src37_diff_hunks", sql("fl", "SELECT id, path AS file, (id % 50 + 1)::INT AS start_line, (id % 3 + 1)::INT AS line_count, '-old' || chr(10) || '+new ' || id AS content FROM fl"))
def _(s, d):
    f, n = M.files(s, d), F.lit("\n")
    at, size, far = F.col("id") % 50 + 1, F.col("id") % 3 + 1, F.col("id") % 50 + 90
    text = F.concat(
        F.lit("diff --git a/x b/x"), n, F.lit("--- a/"), "path", n, F.lit("+++ b/"), "path", n, F.lit("@@ -1,2 +"), at, F.lit(","), size, F.lit(" @@ fn"), n,
        F.lit("-old"), n, F.lit("+new "), F.col("id"), n, F.lit("@@ -9 +"), far, F.lit(" @@"), n, F.lit(" same"),
    )
    return P.diff_hunks(f.select("id", text.alias("t")), "id", "t")


@q("src39_hunks_by_file", sql("fl", "SELECT string_split(path, '/')[1] AS repo, count(*)::BIGINT AS hunks, sum(size_bytes % 7)::BIGINT AS lines FROM fl GROUP BY 1"))
def _(s, d):
    return M.files(s, d).groupBy(F.substring_index("path", "/", 1).alias("repo")).agg(F.count(F.lit(1)).alias("hunks"), F.sum(F.col("size_bytes") % 7).alias("lines"))


@q("src31_git_log", sql("cm", "SELECT hash, message, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS committed_at, 2::INT AS files FROM cm WHERE regexp_full_match(hash, '[0-9a-f]{40}') AND ts IS NOT NULL AND message IS NOT NULL AND NOT contains(message, chr(10)) AND trim(message) = message AND message <> ''"))
def _(s, d):
    c = M.commits(s, d).filter(F.col("hash").rlike("^[0-9a-f]{40}$") & F.col("ts").isNotNull() & F.col("message").isNotNull() & ~F.col("message").contains("\n") & (F.trim("message") == F.col("message")) & (F.col("message") != ""))
    n = F.lit("\n")
    log = F.concat("hash", n, "message", n, F.coalesce("author", F.lit("?")), n, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), n, n, F.lit("a.rs"), n, F.lit("b.rs"), n)
    g = P.git_log(c.select("hash", log.alias("t")), "hash", "t")
    return g.select("hash", "message", "committed_at", F.size("files").alias("files"))


@q("str39_plan_steps", sql("cm", "x AS (SELECT hash AS id, message FROM cm WHERE message IS NOT NULL AND trim(message) <> '' AND NOT contains(message, chr(10)))", "SELECT id, 1::BIGINT AS step, trim(message) || ' goes on' AS text FROM x UNION ALL SELECT id, 2, 'then test' FROM x"))
def _(s, d):
    c = M.commits(s, d).filter(F.col("message").isNotNull() & (F.trim("message") != "") & ~F.col("message").contains("\n"))
    text = F.concat(F.lit("Plan:\n\n- "), F.trim("message"), F.lit("\n  goes on\n\n2. then test\n"))
    return P.plan_steps(c.select(F.col("hash").alias("id"), text.alias("t")), "id", "t")


@q("src63_interchange_export", sql("sy", "fl", "SELECT fl.path, count(sy.id)::BIGINT AS symbols FROM fl LEFT JOIN sy ON sy.file_id = fl.id GROUP BY fl.path"))
def _(s, d):
    e = export_documents(M.files(s, d), M.symbols(s, d))
    return e.select(F.col("relative_path").alias("path"), F.size("symbols").cast("long").alias("symbols"))


@q("src64_interchange_import", sql("sy", "fl", "SELECT count(DISTINCT fl.path)::BIGINT AS documents, count(sy.id)::BIGINT AS symbols, 0::BIGINT AS errors FROM fl LEFT JOIN sy ON sy.file_id = fl.id"))
def _(s, d):
    docs = export_documents(M.files(s, d), M.symbols(s, d)).select(F.to_json(F.struct("relative_path", "language", "symbols")).alias("json"))
    return import_statistics(docs, "json")
