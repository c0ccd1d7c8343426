"""Common table expressions with which the SQL of the queries begins, as ``sql("files", "cf", rest)``."""

from __future__ import annotations

_PATH = r"nullif(regexp_replace(regexp_replace(replace(trim({c}), chr(92), '/'), '/{{2,}}', '/', 'g'), '^(\./)+', ''), '')"

KINDS = "('function','class','trait','impl','const','typedef','module','test','top_level','summary')"
SYMBOLS = "('function','class','trait','impl','const','typedef','test')"
DEPENDENCY_KINDS = "['imports','calls','extends','implements','uses_type','instantiates','field_access','data_flow','error_flow','type_flow','historical_co_change']"
EDGE_TYPES = "['imports','inherits','calls','instantiates','historical_co_change']"

CTES = {
    "fl": f"""fl AS (SELECT * EXCLUDE rn FROM (
        SELECT id, {_PATH.format(c="path")} AS path, coalesce(nullif(lower(trim(language)), ''), 'unknown') AS language,
               nullif(lower(trim(hash)), '') AS hash, size_bytes, indexed_at, last_modified,
               row_number() OVER (PARTITION BY {_PATH.format(c="path")} ORDER BY indexed_at DESC NULLS LAST, hash DESC NULLS LAST, id DESC) AS rn
        FROM files WHERE {_PATH.format(c="path")} IS NOT NULL) WHERE rn = 1)""",
    "ch": f"""ch AS (SELECT * EXCLUDE rn FROM (
        SELECT id, file_id, symbol_path, CASE WHEN lower(trim(kind)) IN {KINDS} THEN lower(trim(kind)) ELSE 'top_level' END AS kind,
               CASE WHEN lower(trim(visibility)) IN ('public','crate','protected','private') THEN lower(trim(visibility)) ELSE 'private' END AS visibility,
               line_start, line_end, content, doc_comment, vector_id, weight, content_hash,
               (CASE WHEN content IS NULL THEN 0 ELSE greatest(1, octet_length(encode(content)) // 4) END)::INT AS token_count,
               row_number() OVER (PARTITION BY id) AS rn FROM chunks) WHERE rn = 1)""",
    "sy": f"""sy AS (SELECT * EXCLUDE rn FROM (
        SELECT id, string_split(symbol_path, '::')[-1] AS name, symbol_path AS fqn, kind, file_id, line_start AS line, id AS chunk_id,
               row_number() OVER (PARTITION BY symbol_path ORDER BY id DESC) AS rn
        FROM ch WHERE symbol_path IS NOT NULL AND kind IN {SYMBOLS}) WHERE rn = 1)""",
    "cm": """cm AS (SELECT * EXCLUDE rn FROM (
        SELECT nullif(lower(trim(hash)), '') AS hash, message, nullif(trim(author), '') AS author,
               try_cast(substr(trim(committed_at), 1, 10) || ' ' || substr(trim(committed_at), 12, 8) AS TIMESTAMP) AS ts, summary,
               row_number() OVER (PARTITION BY lower(trim(hash))) AS rn FROM commits WHERE nullif(trim(hash), '') IS NOT NULL) WHERE rn = 1)""",
    "cf": f"""cf AS (SELECT DISTINCT nullif(lower(trim(commit_hash)), '') AS hash, {_PATH.format(c="file_path")} AS path
        FROM commit_files WHERE nullif(trim(commit_hash), '') IS NOT NULL AND {_PATH.format(c="file_path")} IS NOT NULL)""",
    "dp": f"""dp AS (SELECT CASE WHEN (a + b) % 2 = 0 THEN a ELSE b END AS source_id, CASE WHEN (a + b) % 2 = 0 THEN b ELSE a END AS target_id,
               {DEPENDENCY_KINDS}[((a * 7 + b) % 11 + 1)::INT] AS kind
        FROM (SELECT x.l_partkey AS a, y.l_partkey AS b FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) x
              JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey
              GROUP BY 1, 2 HAVING count(*) >= 2))""",
    "fe": f"""fe AS (SELECT 'src/part_' || source_id || '.rs' AS source_path, 'src/part_' || target_id || '.rs' AS target_path,
               {EDGE_TYPES}[((source_id + target_id * 3) % 5 + 1)::INT] AS edge_type, 1.0::DOUBLE AS weight FROM dp)""",
    "co": """co AS (SELECT a.path AS path_a, b.path AS path_b, count(*)::BIGINT AS freq FROM cf a JOIN cf b ON a.hash = b.hash AND a.path < b.path GROUP BY 1, 2)""",
}
_NEEDS = {"sy": ["ch"], "fe": ["dp"], "co": ["cf"]}


def sql(*parts: str, recursive: bool = False) -> str:
    """The named expressions (and what they need) before the last part, the query; a part that isn't a
    name is a further expression."""
    *names, query = parts
    out: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            text = CTES.get(x, x)
            if text not in out:
                out.append(text)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(out) + "\n" + query if out else query
