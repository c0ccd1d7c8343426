"""Elements of each language, and the steps by which elements become chunks (reference sections 2.1 and 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import chunking as K
from quillspan.operators import context as C
from quillspan.operators import graph as G
from quillspan.plans.book import Book
from quillspan.plans.retrieval import search
from quillspan.session import materialize
from quillspan.sources import model as M
from quillspan.sources import parse as P

q = Book()
QUERIES, SQL = q.queries, q.sql

LANGUAGES = {
    "src13_python_elements": "python", "src14_rust_elements": "rust", "src15_typescript_elements": "typescript", "src16_javascript_elements": "javascript", "src17_go_elements": "go", "src18_java_elements": "java",
    "src19_c_elements": "c", "src20_cpp_elements": "cpp", "src21_csharp_elements": "csharp", "src22_css_elements": "css", "src23_ruby_elements": "ruby", "src24_php_elements": "php", "src25_swift_elements": "swift",
    "src26_kotlin_elements": "kotlin",
}


def sources(s, d):
    """(id, path, language, content) of every chunk: a chunk is handled as a file."""
    f = M.files(s, d).select(F.col("id").alias("file_id"), "path", "language")
    return M.chunks(s, d, "file_id", "content").filter("content is not null").join(f, "file_id").select("id", "path", "language", "content")


def _language(name: str, language: str):  # noqa: ANN202
    @q(name)
    def _(s, d):
        rows = sources(s, d).filter(F.col("language") == language)
        return P.parse_code(rows, "id", "content", "language").select("id", "name", "kind", "visibility", "line_start", "line_end", "doc")


for _name, _lang in LANGUAGES.items():
    _language(_name, _lang)


def parts(s, d):
    src = materialize(sources(s, d), "sources")
    return K.element_parts(P.parse_code(src, "id", "content", "language"), src)


@q("ctx02_lines_before")
def _(s, d):
    return parts(s, d).select("id", "name", "before").filter("before <> ''")


@q("ctx03_declarations")
def _(s, d):
    return parts(s, d).select("id", "declared").filter("declared <> ''").distinct()


@q("ctx05_cut_elements")
def _(s, d):
    return parts(s, d).filter("size(ranges) > 1").select("id", "name", "kind", F.size("ranges").alias("pieces"))


def _points(name: str, kinds: tuple[str, ...], other: bool):  # noqa: ANN202
    @q(name)
    def _(s, d):
        p = parts(s, d)
        p = p.filter(~F.col("kind").isin(*kinds) if other else F.col("kind").isin(*kinds))
        return p.select("id", "name", F.explode("points").alias("line"))


_points("ctx06_cuts_of_types", ("class", "impl", "trait"), False)
_points("ctx07_cuts_of_functions", ("function", "test"), False)
_points("ctx08_cuts_by_lines", ("class", "impl", "trait", "function", "test"), True)


@q("ctx09_pieces")
def _(s, d):
    e = parts(s, d).select("id", "name", F.size("ranges").alias("n"), F.posexplode("ranges").alias("i", "r"))
    return e.select("id", F.concat("name", F.lit("["), F.col("i") + 1, F.lit("/"), "n", F.lit("]")).alias("symbol_path"), "r.start", "r.stop")


@q("ctx10_gathered_ranges")
def _(s, d):
    return parts(s, d).select("id", "name", (F.size("points") + 1).alias("cuts"), F.size("ranges").alias("ranges"))


@q("ctx15_parsed_files")
def _(s, d):
    """Per file its hash, elements and the tokens of its chunks: all that parsing leaves, made where the text lies."""
    src = materialize(sources(s, d), "sources")
    e = P.parse_code(src, "id", "content", "language").groupBy("id").agg(F.count(F.lit(1)).alias("elements"), F.count(F.when(F.col("visibility") == "public", 1)).alias("public"))
    return src.select("id", "path", F.sha2("content", 256).alias("hash"), F.floor(F.octet_length("content") / 4).alias("tokens")).join(e, "id", "left").fillna(0, ["elements", "public"])


@q("ctx16_assembled_context")
def _(s, d):
    """The best results of each question that fit into the part of the budget its intent allows, in causal order."""
    hits = search(s, d, 20).select("query", "id", "file_id", "line_start", "score", F.col("token_count").cast("long").alias("token_count"))
    packed = C.greedy_pack(hits, 2400)
    return C.causal_order(packed, G.both_ways(M.dependencies(s, d))).select("query", "position", "id")


@q("xtr43_packed_in_causal_order")
def _(s, d):
    hits = search(s, d, 20).select("query", "id", "file_id", "line_start", "score", F.col("token_count").cast("long").alias("token_count"))
    rows = hits.withColumn("priority", F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.5, "medium").otherwise("low"))
    return C.causal_order(C.knapsack(rows, 3000).drop("priority"), G.both_ways(M.dependencies(s, d))).select("query", "position", "id")
