"""Edges from code, import and type resolution, query expansion and the stages of retrieval, on small cases."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import expansion as X
from quillspan.operators import chunking as K
from quillspan.operators import edges as E
from quillspan.operators import history as H
from quillspan.operators import interchange as I
from quillspan.operators import retrieval as T
from quillspan.sources import parse as P


def test_edges_of_code(spark):
    rows = [
        (1, 1, "class Cat extends Animal {\n  run() { return new Food(1); }\n}"), (2, 2, "class Dog(Animal):\n    def f(self):\n        Food(3)\n"), (3, 3, "impl Runner for Horse {\n}"), (4, 4, "class Cow < Animal\n  Food.new\nend"), (5, None, "class X extends Y {"), (6, 1, None),
        (7, 1, "class Bird extends Animal implements Flyer {"),
    ]
    c = spark.createDataFrame(rows, "id long, file_id long, content string").withColumn("extra", F.lit(1))
    got = {(r["id"], r["child"], r["parent"], r["kind"]) for r in E.inheritance(c).collect()}
    assert got == {(1, "Cat", "Animal", "extends"), (2, "Dog", "Animal", "extends"), (3, "Horse", "Runner", "implements"), (4, "Cow", "Animal", "extends"), (5, "X", "Y", "extends"), (7, "Bird", "Animal", "extends"), (7, "Bird", "Flyer", "implements")}
    lang = c.filter("content is not null and file_id is not null").withColumn("language", F.when(F.col("id") == 2, "python").when(F.col("id") == 4, "ruby").otherwise("typescript"))
    made = {(r["file_id"], r["name"]) for r in E.instantiations(lang).collect()}
    assert {(1, "Food"), (2, "Food"), (4, "Food")} <= made
    files = spark.createDataFrame([(i, f"src/f{i}.x") for i in range(1, 6)], "id long, path string")
    symbols = spark.createDataFrame([("Animal", 5, "class"), ("Animal", 4, "class"), ("Cow", 4, "class")], "name string, file_id long, kind string")
    refs = E.inheritance(c).select("file_id", F.col("parent").alias("name"))
    e = E.file_edges(refs, files, E.name_files(symbols, files), "inherits").collect()
    assert {(r["source_path"], r["target_path"]) for r in e} == {("src/f1.x", "src/f4.x"), ("src/f2.x", "src/f4.x")}


def test_imports_and_types_are_resolved(spark):
    files = [("a/main.go", "go"), ("a/util/x.go", "go"), ("b/Shape.java", "java"), ("b/Main.java", "java"), ("c/list.h", "c"), ("c/main.c", "c"), ("d/store.py", "python"), ("d/big_table.py", "python"), ("e/store.rs", "rust")]
    f = spark.createDataFrame(files, "path string, language string")
    imports = [("a/main.go", "example.com/util", "go"), ("b/Main.java", "org.b.Shape", "java"), ("c/main.c", "list", "c"), ("d/big_table.py", "store.open", "python"), ("e/store.rs", "crate::main::run", "rust"), ("d/store.py", "nothing.here", "python")]
    i = spark.createDataFrame(imports, "source_path string, target string, language string")
    got = {(r["source_path"], r["target_path"]) for r in E.resolve_paths(i, f).collect()}
    assert got == {("a/main.go", "a/util/x.go"), ("b/Main.java", "b/Shape.java"), ("c/main.c", "c/list.h"), ("d/big_table.py", "d/store.py"), ("e/store.rs", "a/main.go")}
    types = spark.createDataFrame([("d/store.py", "BigTable", "python"), ("b/Main.java", "Shape", "java"), ("d/store.py", "Known", "python"), ("d/store.py", "Gone", "python")], "source_path string, type string, language string")
    index = spark.createDataFrame([("Known", "z/k.py")], "name string, target_path string")
    assert {(r["type"], r["target_path"]) for r in E.resolve_types(types, index, f).collect()} == {("BigTable", "d/big_table.py"), ("Shape", "b/Shape.java"), ("Known", "z/k.py")}


def test_queries_are_widened(spark):
    q = spark.createDataFrame([("login errors in Parser::run",), ("x",)], "q string")
    a, b = (r[0] for r in q.select(X.expanded_terms(F.col("q"))).collect())
    assert a[0] == "login errors in Parser::run" and {"credential", "panic", "Parser::run", "lexer"} <= set(a) and len(a) == len(set(a)) and b == ["x"]
    w = spark.createDataFrame([("caching",), ("tests",), ("sing",), ("useless",)], "w string")
    assert [r[0] for r in w.select(X.base_form(F.col("w"), ["cache", "test", "use"])).collect()] == ["cache", "tests", "sing", "use"]
    h = spark.createDataFrame([("lock guard", "debug"), ("", "debug")], "e string, i string").select(X.hypothetical(F.col("e"), F.col("i"))).collect()
    assert "lock_guard" in h[0][0] and h[1][0] is None


def test_symbol_strings_come_back(spark):
    rows = [("a/b.rs", "plain"), ("a b/c.rs", "odd `name` here"), ("x.py", "a/b")]
    df = spark.createDataFrame(rows, "path string, name string")
    back = df.select(I.symbol_string(F.col("path"), F.col("name")).alias("s")).select(*I.symbol_parts(F.col("s")))
    assert [tuple(r) for r in back.collect()] == rows


def test_stages_of_retrieval(spark):
    rows = spark.createDataFrame([("q", i, i, s) for i, s in enumerate([0.9, 0.8, 0.2, 0.1, 0.95], 1)], "query string, id long, rank int, s double")
    assert [r["score"] for r in T.until_poor(rows, 2, 0.5).orderBy("rank").collect()] == [0.9, 0.8, 0.2, 0.1, None]
    fb = spark.createDataFrame([(2.0, True), (1.5, True), (-1.0, False), (-2.0, False), (0.1, False)], "score double, useful boolean")
    r = T.calibrated(fb).first()
    assert r["slope"] > 1.0 and r["samples"] == 5 and T.calibrated(fb.limit(2)).first()["slope"] == 1.0
    pairs = spark.createDataFrame([("a", "b", 4)], "path_a string, path_b string, freq long")
    asked = spark.createDataFrame([("b", "a"), ("a", "c")], "x string, y string")
    assert {tuple(x) for x in H.pair_frequency(pairs, asked).collect()} == {("b", "a", 4), ("a", "c", 0)}


HEADS = [
    ("rust", "pub fn a() {\n}\npub trait T {\n}\nstruct S {\n}\n", {("a", "function"), ("T", "trait"), ("S", "class")}),
    ("go", "func (r *R) A() {\n}\ntype S struct {\n}\n", {("A", "function"), ("S", "class")}),
    ("java", "public class A {\n    interface B {\n    }\n}\n", {("A", "class"), ("B", "trait")}),
    ("kotlin", "data class A(val x: Int)\nfun b(): Int {\n}\n", {("A", "class"), ("b", "function")}),
    ("swift", "public struct A {\n    func b() {\n    }\n}\n", {("A", "class"), ("b", "function")}),
    ("php", "class A {\n    public function b() {\n    }\n}\n", {("A", "class"), ("b", "function")}),
    ("ruby", "class A\n  def b\n  end\nend\n", {("A", "class"), ("b", "function")}),
    ("csharp", "public class A {\n}\npublic interface I {\n}\n", {("A", "class"), ("I", "trait")}),
    ("css", ".box {\n  color: red;\n}\n", {(".box", "class")}),
    ("cpp", "namespace n {\nclass A {\n};\n}\n", {("n", "module"), ("A", "class")}),
]


@pytest.mark.parametrize("language, text, want", HEADS)
def test_elements_of_languages(language, text, want):
    assert want <= {(e[0], e[1]) for e in P.elements(text, language)}


def test_parts_of_elements(spark):
    body = "import a\n\nclass A:\n" + "".join(f"    def f{i}(self):\n        return '{'x' * 60}'\n" for i in range(60))
    src = spark.createDataFrame([(1, "a.py", "python", body), (2, "b.py", "python", "")], "id long, path string, language string, content string")
    got = {r["name"]: r for r in K.element_parts(P.parse_code(src, "id", "content", "language"), src).collect()}
    assert got["A"]["declared"] == "import a" and len(got["A"]["ranges"]) > 1 and got["A"]["ranges"][0]["start"] == 0
    assert got["A::f1"]["before"].endswith("x'")
