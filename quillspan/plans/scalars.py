"""Scalar functions over code, queries and texts (reference section 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.sources import model as M
from quillspan.sources.tables import table

q = Book()
QUERIES, SQL = q.queries, q.sql

#: Every question asked of the search is a commit message here: short texts of all shapes.
_TYPE = r"""CASE WHEN t = '' THEN 'keyword' WHEN NOT contains(t, ' ') AND (contains(t, '::') OR contains(t, '.') OR contains(t, '__') OR regexp_full_match(t, '[\p{L}\p{N}_]+')) THEN 'symbol'
WHEN suffix(lower(t), '?') OR regexp_matches(lower(t), '^(how|what|where|why|when|which|find|show) ') THEN 'natural_language'
WHEN len(regexp_split_to_array(t, '\s+')) <= 3 THEN 'mixed' ELSE 'natural_language' END"""


def _intent_sql(c: str) -> str:
    cases = []
    for name, lists in code.INTENT_WORDS:
        cond = " AND ".join("(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")" for words in lists)
        cases.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(cases) + " ELSE 'unknown' END"


@q("str01_query_types", sql("cm", f"SELECT hash, {_TYPE} AS query_type FROM (SELECT hash, trim(message) AS t FROM cm WHERE message IS NOT NULL)"))
def _(s, d):
    return M.commits(s, d).filter("message is not null").select("hash", code.query_type(F.col("message")).alias("query_type"))


@q("str07_intents", sql("cm", f"SELECT hash, {_intent_sql('lower(message)')} AS intent FROM cm WHERE message IS NOT NULL"))
def _(s, d):
    return M.commits(s, d).filter("message is not null").select("hash", code.intent(F.col("message")).alias("intent"))


@q(
    "str08_intent_strategies",
    sql(
        "cm",
        "st(intent, architecture, implementation, tests, docs, recent, depth, high_level) AS (VALUES " + ", ".join(f"('{k}', " + ", ".join(str(x) for x in v) + ")" for k, v in code.STRATEGY.items()) + ")",
        f"SELECT intent, count(*)::BIGINT AS queries, min(depth)::INT AS depth, bool_or(tests) AS tests FROM (SELECT {_intent_sql('lower(message)')} AS intent FROM cm WHERE message IS NOT NULL) JOIN st USING (intent) GROUP BY intent",
    ),
)
def _(s, d):
    st = s.createDataFrame([(k, *v) for k, v in code.STRATEGY.items()], "intent string, architecture boolean, implementation boolean, tests boolean, docs boolean, recent boolean, depth int, high_level boolean")
    x = M.commits(s, d).filter("message is not null").select(code.intent(F.col("message")).alias("intent"))
    return x.join(st, "intent").groupBy("intent").agg(F.count(F.lit(1)).alias("queries"), F.min("depth").alias("depth"), F.max("tests").alias("tests"))


@q("str02_keyword_tokens")
def _(s, d):
    return M.commits(s, d).filter("message is not null").select("hash", F.array_join(code.keyword_tokens(F.col("message")), " OR ").alias("words"))


@q(
    "str03_identifier_parts",
    sql(
        "sy",
        r"SELECT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(name, '(\p{Ll})(\p{Lu})', '\1_\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1_\2', 'g'), '[_.:\-/]'), lambda x: x <> ''), ' ') AS parts FROM sy",
    ),
)
def _(s, d):
    return M.symbols(s, d).select("id", F.array_join(code.split_identifier(F.col("name")), " ").alias("parts"))


@q("str13_token_estimates", sql("ch", "SELECT id, token_count FROM ch"))
def _(s, d):
    return M.chunks(s, d, "token_count")


@q("str18_equal_contents", sql("ch", r"SELECT k, count(*)::BIGINT AS n FROM (SELECT md5(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS k FROM ch WHERE content IS NOT NULL) GROUP BY k HAVING count(*) > 1"))
def _(s, d):
    key = F.md5(F.trim(F.regexp_replace("content", r"\s+", " ")))
    return M.chunks(s, d, "content").filter("content is not null").groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@q("str21_file_hashes", sql("ch", "SELECT id, sha256(content) AS sha FROM ch WHERE content IS NOT NULL"))
def _(s, d):
    return M.chunks(s, d, "content").filter("content is not null").select("id", F.sha2("content", 256).alias("sha"))


@q("str20_word_shingles", sql("ch", r"w AS (SELECT id, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS w FROM ch WHERE content IS NOT NULL)", "SELECT id, (CASE WHEN len(w) >= 3 THEN len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) ELSE 1 END)::BIGINT AS n FROM w"))
def _(s, d):
    return M.chunks(s, d, "content").filter("content is not null").select("id", F.size(code.word_shingles(F.col("content"))).cast("long").alias("n"))


_PURPOSE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(n, '^({'|'.join(v)})_') THEN '{t}' || sub" for v, t in code.PURPOSE) + " WHEN regexp_matches(n, '^(is|has)_') THEN 'It returns a boolean check result' END"


@q(
    "str24_purposes",
    sql(
        "sy",
        "x AS (SELECT id, lower(name) AS n, replace(regexp_replace(lower(name), '^(get|fetch|set|update|create|new|delete|remove|validate|check|parse|decode|format|encode|handle|process|to|from)_', ''), '_', ' ') || ' data' AS sub FROM sy)",
        f"SELECT id, {_PURPOSE_SQL} AS purpose FROM x",
    ),
)
def _(s, d):
    return M.symbols(s, d).select("id", code.purpose(F.col("name")).alias("purpose"))


@q("str25_first_sentences", sql("ch", "x AS (SELECT id, trim(doc_comment) AS t FROM ch WHERE doc_comment IS NOT NULL)", r"SELECT id, nullif(CASE WHEN instr(t, '. ') > 1 THEN substr(t, 1, instr(t, '. ') - 1) ELSE regexp_replace(trim(string_split(t, chr(10))[1]), '\.$', '') END, '') AS sentence FROM x"))
def _(s, d):
    return M.chunks(s, d, "doc_comment").filter("doc_comment is not null").select("id", code.first_sentence(F.col("doc_comment")).alias("sentence"))


@q("str27_module_paths", sql("sy", "SELECT id, nullif(CASE WHEN contains(x, '::') THEN regexp_extract(x, '^(.*)::[^:]*$', 1) ELSE regexp_extract(x, '^(.*)\\.[^.]*$', 1) END, '') AS module FROM (SELECT id, regexp_replace(fqn, '^crate::', '') AS x FROM sy)"))
def _(s, d):
    return M.symbols(s, d).select("id", code.module_path(F.col("fqn")).alias("module"))


@q(
    "str28_architectural_roles",
    sql(
        "dp",
        "x AS (SELECT node, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT target_id AS node, 1 AS i, 0 AS o FROM dp UNION ALL SELECT source_id, 0, 1 FROM dp) GROUP BY node)",
        "SELECT node, CASE WHEN i >= 5 AND o >= 5 THEN 'hub' WHEN i >= 5 AND i > greatest(o * 3, 1) THEN 'gateway' WHEN o >= 5 AND o > greatest(i * 3, 1) THEN 'orchestrator' WHEN i <= 1 AND o <= 2 THEN 'utility' ELSE 'unknown' END AS role FROM x",
    ),
)
def _(s, d):
    e = M.dependencies(s, d)
    x = e.select(F.col("target_id").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("source_id", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return x.select("node", code.architectural_role(F.col("i"), F.col("o")).alias("role"))


_W = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in code.KIND_WEIGHT.items()) + " END"
_V = "CASE visibility " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in code.VISIBILITY_WEIGHT.items()) + " END"


@q("str31_chunk_weights", sql("ch", f"SELECT id, kind, visibility, round(({_W} * {_V})::DOUBLE, 6) AS weight, round((0.5 * (0.4 + 0.6 * {_W} * {_V}) * 1.2)::DOUBLE, 6) AS boosted FROM ch"))
def _(s, d):
    k, v = F.col("kind"), F.col("visibility")
    c = M.chunks(s, d, "kind", "visibility")
    return c.select("id", "kind", "visibility", F.round(code.kind_weight(k) * code.visibility_weight(v), 6).alias("weight"), F.round(code.structural_boost(F.lit(0.5), k, v, F.lit(1.2)), 6).alias("boosted"))


@q("str33_method_chains", sql("ch", r"l AS (SELECT id, unnest(string_split(content, chr(10))) AS l FROM ch WHERE content IS NOT NULL)", "m AS (SELECT id, list_filter(regexp_extract_all(l, '\\.([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1), lambda x: NOT list_contains([" + ", ".join(f"'{t}'" for t in code.TRIVIAL_METHODS) + "], x)) AS c FROM l)", "SELECT id, count(*)::BIGINT AS chains FROM m WHERE len(c) >= 2 GROUP BY id"))
def _(s, d):
    return M.chunks(s, d, "content").filter("content is not null").select("id", F.size(code.method_chains(F.col("content"))).cast("long").alias("chains")).filter("chains > 0")


@q("str35_escaped_xml", sql("ch", "SELECT id, md5(replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM ch WHERE content IS NOT NULL"))
def _(s, d):
    return M.chunks(s, d, "content").filter("content is not null").select("id", F.md5(code.escape_xml(F.col("content"))).alias("escaped"))


@q("str36_last_parts", sql("fl", "SELECT id, array_to_string(string_split(path, '/')[-2:], '/') AS tail FROM fl"))
def _(s, d):
    return M.files(s, d).select("id", code.last_parts(F.col("path"), 2).alias("tail"))


@q("str38_line_overlap", sql("ch", "r AS (SELECT id, file_id, least(line_start, line_end) AS a, greatest(line_start, line_end) AS b FROM ch WHERE line_start IS NOT NULL AND line_end IS NOT NULL)", "SELECT x.id AS ida, y.id AS idb, round((least(x.b, y.b) - greatest(x.a, y.a) + 1) / least(x.b - x.a + 1, y.b - y.a + 1)::DOUBLE, 6) AS overlap FROM r x JOIN r y ON x.file_id = y.file_id AND x.id < y.id AND least(x.b, y.b) >= greatest(x.a, y.a)"))
def _(s, d):
    r = M.chunks(s, d, "file_id", "line_start", "line_end").dropna(subset=["line_start", "line_end"]).select("id", "file_id", F.least("line_start", "line_end").alias("a"), F.greatest("line_start", "line_end").alias("b"))
    y = r.select(F.col("id").alias("idb"), "file_id", F.col("a").alias("c"), F.col("b").alias("e"))
    o = code.line_overlap(F.col("a"), F.col("b"), F.col("c"), F.col("e"))
    return r.join(y, "file_id").filter("id < idb and least(b, e) >= greatest(a, c)").select(F.col("id").alias("ida"), "idb", F.round(o, 6).alias("overlap"))


@q("str40_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value / 10))), 6) AS p FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.round(1 / (1 + F.exp(-(F.col("value") / 10))), 6).alias("p"))


@q("xtr18_snake_case", sql("sy", "SELECT id, lower(substr(name, 1, 1) || regexp_replace(substr(name, 2), '([A-Z])', '_\\1', 'g')) AS snake FROM sy"))
def _(s, d):
    return M.symbols(s, d).select("id", code.snake_case(F.col("name")).alias("snake"))


@q("ctx18_priorities", sql("ch", "SELECT id, CASE WHEN id % 17 = 0 THEN 'critical' WHEN kind = 'test' THEN 'high' WHEN id % 5 = 0 THEN 'medium' WHEN weight >= 0.8 THEN 'high' WHEN weight >= 0.5 THEN 'medium' ELSE 'low' END AS priority FROM ch"))
def _(s, d):
    c = M.chunks(s, d, "kind", "weight")
    return c.select("id", code.priority(F.coalesce("weight", F.lit(0.0)), F.col("id") % 17 == 0, F.col("kind") == "test", F.col("id") % 5 == 0).alias("priority"))


@q("src42_html_titles", r"SELECT DISTINCT id, nullif(trim(regexp_extract(content, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM external_docs WHERE content ILIKE '%<html%'")
def _(s, d):
    return table(s, d, "external_docs").filter(F.col("content").ilike("%<html%")).select("id", code.html_title(F.col("content")).alias("title")).distinct()


@q(
    "src43_html_text",
    r"""SELECT DISTINCT id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(content, '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS text FROM external_docs WHERE content ILIKE '%<html%'""",
)
def _(s, d):
    return table(s, d, "external_docs").filter(F.col("content").ilike("%<html%")).select("id", F.md5(code.html_text(F.col("content"))).alias("text")).distinct()
