"""Samples, repeated rows, streams, chunking and the rest of the engine's methods."""

import os

import pytest
from pyspark.sql import functions as F

from quillspan.engine import Engine
from quillspan.operators import chunking as K
from quillspan.operators import context as C
from quillspan.operators.interchange import export_documents, import_statistics
from quillspan.operators.sampling import bounded_sample
from quillspan.session import materialize, release
from quillspan.sources import model as M
from quillspan.sources import parse as P
from quillspan.sources.memory import Memory, rules
from quillspan.sources.scan import repository
from quillspan.streaming import index_events as S

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_materialized_tables_are_released(spark):
    df = materialize(spark.range(5), "test")
    assert df.count() == 5 and release(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_bounded_sample(spark):
    df = spark.range(10_000)
    n = bounded_sample(df, 500, "id").count()
    assert 400 < n < 600 and bounded_sample(df, 500, "id").count() == n
    assert bounded_sample(df, 20_000, "id").count() == 10_000 and bounded_sample(df.limit(0), 5, "id").count() == 0


def test_repeated_rows_are_left_out_of_the_scan(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (1, "a"), (3, None), (1, "a")]
    path = f"{tmp_path}/t.parquet"
    spark.createDataFrame(rows, "id long, content string").repartition(3).write.parquet(path)
    got = M.once_per_id(spark.read.parquet(path))
    assert sorted(got.collect(), key=lambda r: r["id"]) == [(1, "a"), (2, "b"), (3, None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_stream_upserts_and_debounce(spark, tmp_path):
    rows = [("a", 1, "2026-01-01 00:00:01"), ("a", 2, "2026-01-01 00:00:30"), ("b", 3, "2026-01-01 00:01:10"), ("a", 4, "2026-01-01 00:02:00")]
    spark.createDataFrame(rows, "k string, v int, t string").select("k", "v", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = S.file_events(spark, f"{tmp_path}/in", "*.parquet", "k string, v int, t timestamp")
    last = S.run_to_end(S.debounced(stream, "k", "t", "1 minute"), "deb", "complete")
    assert {(r["k"], r["v"]) for r in last.collect()} == {("a", 2), ("b", 3), ("a", 4)}
    S.upsert_batches(stream, f"{tmp_path}/out", ["k"], lambda: [F.col("t").desc()])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/out/state-0").collect()} == {("a", 4), ("b", 3)}


def test_state_of_several_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a", i), (f"k{i}", i)], "k string, v int").coalesce(1).write.parquet(f"{tmp_path}/in/part{i}.parquet")
    stream = S.file_events(spark, f"{tmp_path}/in/*", "*.parquet", "k string, v int", files_per_trigger=1)
    S.upsert_batches(stream, f"{tmp_path}/out", ["k"], lambda: [F.col("v").desc()])
    assert {r["k"] for r in S.newest_state(spark, f"{tmp_path}/out").collect()} == {"a", "k0", "k1", "k2"}
    with pytest.raises(ValueError):
        S.newest_state(spark, f"{tmp_path}/none")


def test_element_chunks_and_summaries(spark):
    body = "import os\n\ndef first(a):\n" + "".join(f"    x{i} = call_{i}(a)\n" for i in range(200)) + "\ndef second():\n    return 1\n"
    f = spark.createDataFrame([(1, "r/a.py", "python", body)], "id long, path string, language string, content string")
    got = K.chunk_elements(P.parse_code(f, "id", "content", "language"), f).collect()
    parts = [r for r in got if r["symbol_path"].startswith("first[")]
    assert len(parts) > 1 and all(r["token_count"] <= 600 for r in parts) and any(r["symbol_path"] == "second" for r in got)
    covered = sorted((r["line_start"], r["line_end"]) for r in parts)
    assert covered[0][0] == 3 and all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:], strict=False))
    c = spark.createDataFrame([(i, 1, "public" if i == 3 else "private", i, f"// note\nfn f{i}() {{}}") for i in range(4)], "id long, file_id long, visibility string, line_start int, content string")
    assert K.summaries(c).first()["content"].split("\n")[0] == "fn f3() {}"


def test_summaries_of_chunks_without_a_signature(spark):
    texts = ["// only\n# comments\n\n", "", "\r\n\t\r\n  @Override\r\n\tvoid run() {\r\n}\r\n", " \n\u00a0\n/** doc */\nfn a() {}  "]
    rows = [(i, 1, "private", i, t) for i, t in enumerate(texts)] + [(i, 2, "public", i, "// nothing") for i in range(10, 13)] + [(20, 3, "public", 1, "fn few() {}")]
    c = spark.createDataFrame(rows, "id long, file_id long, visibility string, line_start int, content string")
    assert {tuple(r) for r in K.summaries(c).collect()} == {(1, 4, "void run() {\nfn a() {}\n"), (2, 3, "")}


def test_causal_order(spark):
    e = spark.createDataFrame([("q", 1, 10, 5, 0.9), ("q", 2, 11, 1, 0.8), ("q", 3, 12, 1, 0.85), ("q", 4, 10, 1, 0.1)], "query string, id long, file_id long, line_start int, score double")
    both = spark.createDataFrame([(10, 11), (11, 10)], "source_id long, target_id long")
    assert [r["id"] for r in C.causal_order(e, both).orderBy("position").collect()] == [4, 1, 2, 3]


def test_interchange_round_trip(spark):
    f = spark.createDataFrame([(1, "a.rs", "rust"), (2, "b.rs", "rust")], "id long, path string, language string")
    y = spark.createDataFrame([(7, "my name", "function", 1, 3)], "id long, name string, kind string, file_id long, line int")
    docs = export_documents(f, y)
    assert docs.filter("relative_path = 'a.rs'").first()["symbols"][0]["symbol"] == "local . a.rs/`my name`."
    j = docs.select(F.to_json(F.struct("*")).alias("j")).union(spark.createDataFrame([('{"relative_path": ""}',)], "j string"))
    assert tuple(import_statistics(j, "j").first()) == (2, 1, 1)


@needs_data
def test_every_method_of_the_engine(spark):
    e = Engine(spark, SF)
    path = M.commit_files(spark, SF).orderBy("path").first()["path"]
    fqn = M.symbols(spark, SF).orderBy("fqn").first()["fqn"]
    for df in (e.get_symbol("re"), e.file_summary(path), e.explain_symbol(fqn), e.module_map(4), e.languages(), e.dependencies(2), e.call_graph(2), e.cycles(), e.recent_changes(3), e.co_changes(path), e.commit_summary(path), e.bug_prone_files(), e.external_docs(), e.context_window_pack("hold the lock"), e.search_by_intent("where is the lock"), e.multi_repo_search("hold the lock"), e.audit_plan("- hold the lock\n- test it")):
        df.limit(1).collect()
    assert e.explain_symbol(fqn).count() == 1 and e.recent_changes(3).count() == 3


def test_memory_and_rules(tmp_path):
    m = Memory(f"{tmp_path}/m.json")
    m.set("a", "x")
    m.set("a", "y")
    assert Memory(f"{tmp_path}/m.json").list() == [("a", "y")] and m.get("b") is None
    for k, v in (("", "x"), ("k" * 257, "x"), ("k", "x" * 65_537)):
        with pytest.raises(ValueError):
            m.set(k, v)
    (tmp_path / "rules.md").write_text("z" * 70_000)
    assert len(rules(f"{tmp_path}/rules.md")) == 65_536 and rules(f"{tmp_path}/none") is None


def test_scan_of_a_folder(spark, tmp_path):
    for name, text in (("a/x.py", "print(1)\n"), ("a/node_modules/y.js", "1"), ("b.bin", "1"), ("a/z.RS", "fn a() {}")):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    got = {r["path"]: (r["language"], r["content"]) for r in repository(spark, f"{tmp_path}/r").collect()}
    assert got == {"a/x.py": ("python", "print(1)\n"), "a/z.RS": ("rust", "fn a() {}")}
