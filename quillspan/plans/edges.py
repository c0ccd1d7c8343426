"""Edges taken from code and the resolution of imports, types and references (reference sections 2.3 and 2.13a)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import edges as E
from quillspan.operators import relational as R
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.session import materialize
from quillspan.sources import model as M

q = Book()
QUERIES, SQL = q.queries, q.sql


def _all(rx: str, group: int) -> str:
    return f"regexp_extract_all(content, '{rx}', {group})"


_TYPES = ("class", "trait", "typedef", "impl")
_INH = (
    "ih AS (SELECT DISTINCT id, file_id, e.child AS child, e.parent AS parent, e.kind AS kind FROM (SELECT id, file_id, unnest(list_concat("
    + f"list_transform(list_zip({_all(E.INHERITS, 1)}, {_all(E.INHERITS, 2)}), lambda x: {{'child': x[1], 'parent': x[2], 'kind': 'extends'}}), "
    + f"list_transform(list_zip({_all(E.IMPLEMENTS, 2)}, {_all(E.IMPLEMENTS, 1)}), lambda x: {{'child': x[1], 'parent': x[2], 'kind': 'implements'}}), "
    + f"list_transform(list_zip({_all(E.IMPLEMENTS, 3)}, {_all(E.IMPLEMENTS, 4)}), lambda x: {{'child': x[1], 'parent': x[2], 'kind': 'implements'}}))) AS e FROM ch WHERE content IS NOT NULL) WHERE e.child <> '' AND e.parent <> '')"
)
_TY = "ty AS (SELECT name, min(fl.path) AS target_path FROM sy JOIN fl ON fl.id = sy.file_id WHERE kind IN ('class','trait','typedef','impl') GROUP BY name)"
_NM = "nm AS (SELECT name, min(fl.path) AS target_path FROM sy JOIN fl ON fl.id = sy.file_id GROUP BY name)"
_CALLS = f"ca AS (SELECT DISTINCT file_id, unnest({_all(E.CALL, 1)}) AS name FROM ch WHERE content IS NOT NULL AND file_id IS NOT NULL)"
_NEWS = (
    "nw AS (SELECT DISTINCT file_id, unnest(CASE fl.language WHEN 'python' THEN "
    + f"{_all(E.CAPITAL, 1)} WHEN 'ruby' THEN {_all(E.RUBY_NEW, 1)} ELSE {_all(E.NEW, 1)} END) AS name FROM ch JOIN fl ON fl.id = ch.file_id WHERE content IS NOT NULL)"
)


def _edge_sql(rows: str, index: str, kind: str) -> str:
    return f"SELECT DISTINCT fl.path AS source_path, target_path, '{kind}' AS edge_type, 1.0::DOUBLE AS weight FROM {rows} JOIN fl ON fl.id = file_id JOIN {index} USING (name) WHERE fl.path <> target_path"


def code(s, d):
    return M.chunks(s, d, "file_id", "content")


def code_with_language(s, d):
    return code(s, d).join(M.files(s, d).select(F.col("id").alias("file_id"), "language"), "file_id")


def types(s, d):
    return E.name_files(M.symbols(s, d), M.files(s, d), _TYPES)


def inheritance_edges(s, d):
    rows = E.inheritance(code(s, d)).select("file_id", F.col("parent").alias("name")).distinct()
    return E.file_edges(rows, M.files(s, d), types(s, d), "inherits")


def call_edges(s, d):
    return E.file_edges(E.references(code(s, d), E.CALL), M.files(s, d), E.name_files(M.symbols(s, d), M.files(s, d)), "calls")


def instantiation_edges(s, d):
    return E.file_edges(E.instantiations(code_with_language(s, d)), M.files(s, d), types(s, d), "instantiates")


_IH_EDGES = _edge_sql("(SELECT DISTINCT file_id, parent AS name FROM ih)", "ty", "inherits")
_CA_EDGES, _NW_EDGES = _edge_sql("ca", "nm", "calls"), _edge_sql("nw", "ty", "instantiates")


@q("join14_inheritance_edges", sql("sy", "fl", _INH, _TY, _IH_EDGES))
def _(s, d):
    return inheritance_edges(s, d)


@q("join15_reference_edges", sql("sy", "fl", _CALLS, _NM, _CA_EDGES))
def _(s, d):
    return call_edges(s, d)


@q("join16_instantiation_edges", sql("sy", "fl", _NEWS, _TY, _NW_EDGES))
def _(s, d):
    return instantiation_edges(s, d)


@q("xtr07_all_code_edges", sql("sy", "fl", _INH, _TY, _NM, _CALLS, _NEWS, f"al AS ({_IH_EDGES} UNION ALL {_CA_EDGES} UNION ALL {_NW_EDGES})", "SELECT source_path, edge_type, count(*)::BIGINT AS edges FROM al GROUP BY ALL"))
def _(s, d):
    e = inheritance_edges(s, d).unionByName(call_edges(s, d)).unionByName(instantiation_edges(s, d))
    return e.groupBy("source_path", "edge_type").agg(F.count(F.lit(1)).alias("edges"))


@q(
    "join11_type_edges",
    sql(
        "sy", _INH,
        "src AS (SELECT DISTINCT sy.id AS source_id, ih.file_id, ih.parent AS name, ih.kind FROM ih JOIN sy ON sy.file_id = ih.file_id AND sy.name = ih.child)",
        "lo AS (SELECT file_id, name, arg_min(id, (coalesce(line, -1), id)) AS l FROM sy WHERE kind IN ('class','trait','typedef','impl') GROUP BY file_id, name)",
        "wo AS (SELECT name, arg_min(id, fqn) AS w FROM sy WHERE kind IN ('class','trait','typedef','impl') GROUP BY name)",
        "SELECT DISTINCT source_id, coalesce(l, w) AS target_id, src.kind FROM src LEFT JOIN lo USING (file_id, name) LEFT JOIN wo USING (name) WHERE coalesce(l, w) IS NOT NULL AND coalesce(l, w) <> source_id",
    ),
)
def _(s, d):
    y = materialize(M.symbols(s, d), "symbols")
    refs = E.inheritance(code(s, d)).join(y.select("file_id", F.col("name").alias("child"), F.col("id").alias("source_id")), ["file_id", "child"])
    out = None
    for kind in ("extends", "implements"):
        e = R.call_edges(refs.filter(F.col("kind") == kind).select("source_id", "file_id", F.col("parent").alias("name")), y.filter(F.col("kind").isin(*_TYPES))).withColumn("kind", F.lit(kind))
        out = e if out is None else out.unionByName(e)
    return out


_IM = f"im AS (SELECT DISTINCT fl.path AS source_path, fl.language, target FROM (SELECT DISTINCT file_id, unnest({_all(E.IMPORT, 1)}) AS target FROM ch WHERE content IS NOT NULL AND file_id IS NOT NULL) JOIN fl ON fl.id = file_id)"
_STEM = r"regexp_replace(string_split({c}, '/')[-1], '\..*$', '')"
_DIR = "CASE WHEN contains({c}, '/') THEN regexp_replace({c}, '/[^/]*$', '') ELSE '' END"
_MO = f"mo AS (SELECT {_STEM.format(c='path')} AS module, min(path) AS m FROM fl GROUP BY 1 HAVING {_STEM.format(c='path')} <> '')"
_PK = f"pk AS (SELECT {_STEM.format(c=_DIR.format(c='path'))} AS module, min(path) AS p FROM fl WHERE language = 'go' GROUP BY 1)"
_RP = (
    r"nx AS (SELECT *, CASE WHEN language IN ('go','java','kotlin') THEN regexp_extract(target, '([^./:]+)$', 1) ELSE regexp_extract(regexp_replace(target, '^(?:crate|super|self)::', ''), '^([^./:]+)', 1) END AS module FROM im),"
    f" rp AS (SELECT DISTINCT source_path, nx.language, target, CASE WHEN nx.language = 'go' THEN p WHEN nx.language = 'c' AND hh.path IS NOT NULL THEN hh.path ELSE m END AS target_path FROM nx LEFT JOIN pk USING (module) LEFT JOIN mo USING (module)"
    f" LEFT JOIN fl hh ON hh.path = {_DIR.format(c='source_path')} || '/' || module || '.h')"
)


def imports(s, d):
    f = M.files(s, d).select(F.col("id").alias("file_id"), F.col("path").alias("source_path"), "language")
    return E.imported(code(s, d)).join(f, "file_id").select("source_path", "target", "language").distinct()


@q("join17_resolved_imports", sql("ch", "fl", _IM, _MO, _PK, _RP, "SELECT source_path, target, target_path FROM rp WHERE target_path IS NOT NULL AND target_path <> source_path"))
def _(s, d):
    return E.resolve_paths(imports(s, d), M.files(s, d))


def _by_language(name: str, languages: tuple[str, ...]):  # noqa: ANN202
    listed = ", ".join(f"'{x}'" for x in languages)

    @q(name, sql("ch", "fl", _IM, _MO, _PK, _RP, f"SELECT source_path, target, target_path FROM rp WHERE target_path IS NOT NULL AND target_path <> source_path AND language IN ({listed})"))
    def _(s, d):
        return E.resolve_paths(imports(s, d).filter(F.col("language").isin(*languages)), M.files(s, d))


for _name, _languages in {
    "xtr10_rust_imports": ("rust",), "xtr11_python_imports": ("python",), "xtr12_script_imports": ("javascript", "typescript"), "xtr13_go_imports": ("go",), "xtr14_java_imports": ("java", "kotlin"), "xtr15_c_imports": ("c", "cpp"),
}.items():
    _by_language(_name, _languages)


_US = "us AS (SELECT DISTINCT fl.path AS source_path, fl.language, ih.parent AS type FROM ih JOIN fl ON fl.id = ih.file_id UNION SELECT DISTINCT fl.path, fl.language, sy.name FROM sy JOIN fl ON fl.id = sy.file_id WHERE sy.kind = 'class')"
_CN = (
    r"cn AS (SELECT us.source_path, us.type, fl.path AS target_path FROM us JOIN fl ON fl.path = CASE WHEN contains(us.source_path, '/') THEN regexp_replace(us.source_path, '/[^/]*$', '') ELSE '' END || '/' || CASE us.language WHEN 'python' THEN lower(regexp_replace(us.type, '([a-z0-9])([A-Z])', '\1_\2', 'g')) || '.py' WHEN 'java' THEN us.type || '.java' WHEN 'kotlin' THEN us.type || '.kt' END)"
)


def uses(s, d):
    """Types that files derive from or define, with the file and its language."""
    f = M.files(s, d).select(F.col("id").alias("file_id"), F.col("path").alias("source_path"), "language")
    names = E.inheritance(code(s, d)).select("file_id", F.col("parent").alias("type")).union(M.symbols(s, d).filter("kind = 'class'").select("file_id", "name"))
    return names.join(f, "file_id").select("source_path", "type", "language").distinct()


@q("xtr17_types_by_convention", sql("sy", "fl", _INH, _US, _CN, "SELECT * FROM cn"))
def _(s, d):
    return E.by_convention(uses(s, d), M.files(s, d))


@q("join18_resolved_types", sql("sy", "fl", _INH, _TY, _US, _CN, "SELECT source_path, type, target_path FROM us JOIN ty ON ty.name = us.type UNION SELECT * FROM cn WHERE type NOT IN (SELECT name FROM ty)"))
def _(s, d):
    u = materialize(uses(s, d), "uses")
    return E.resolve_types(u, types(s, d), M.files(s, d))


@q("join19_module_references", sql("ch", "fl", f"rf AS (SELECT DISTINCT file_id, unnest({_all(r'([A-Za-z_]\w*)\.\w+\s*\(', 1)}) AS module FROM ch WHERE content IS NOT NULL AND file_id IS NOT NULL)", _MO, "SELECT DISTINCT fl.path AS source_path, m AS target_path FROM rf JOIN mo USING (module) JOIN fl ON fl.id = file_id WHERE fl.path <> m"))
def _(s, d):
    refs = E.references(code(s, d), r"([A-Za-z_]\w*)\.\w+\s*\(").withColumnRenamed("name", "module")
    f = M.files(s, d)
    e = refs.join(E.module_files(f), "module").join(f.select(F.col("id").alias("file_id"), F.col("path").alias("source_path")), "file_id")
    return e.filter("source_path <> target_path").select("source_path", "target_path").distinct()


@q("xtr09_class_names", sql("ch", r"SELECT DISTINCT id, regexp_replace(regexp_replace(trim(x), '^new\s+', ''), '\s*(?:<[\s\S]*|\([\s\S]*|\.new[\s\S]*)$', '') AS class FROM (SELECT id, unnest(regexp_extract_all(content, '\bnew\s+[A-Z]\w*\s*[(<][^\n]*|\b[A-Z]\w*\.new\b[^\n]*')) AS x FROM ch WHERE content IS NOT NULL)"))
def _(s, d):
    made = F.regexp_extract_all("content", F.lit(r"\bnew\s+[A-Z]\w*\s*[(<][^\n]*|\b[A-Z]\w*\.new\b[^\n]*"), F.lit(0))
    return M.chunks(s, d, "content").filter("content is not null").select("id", F.explode(made).alias("x")).select("id", E.class_name(F.col("x")).alias("class")).distinct()
