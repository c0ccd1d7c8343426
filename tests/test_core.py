"""Operators against small cases worked out by hand or by brute force."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.functions.paths import plain_path
from quillspan.operators import context as C
from quillspan.operators import graph as G
from quillspan.operators import history as H
from quillspan.operators import metrics
from quillspan.operators import relational as R
from quillspan.operators import retrieval as T
from quillspan.operators.ledger import WorkLedger, completed_versions, latest_scans, pending_items, run_once
from quillspan.sources import parse as P


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "source_id long, target_id long, kind string")


def test_plain_paths(spark):
    df = spark.createDataFrame([("./a//b\\c",), ("a/b",), (" ",), (None,), ("././x",)], "p string")
    assert [r[0] for r in df.select(plain_path(F.col("p"))).collect()] == ["a/b/c", "a/b", None, None, "x"]


def test_identifiers_and_queries(spark):
    df = spark.createDataFrame([("process_file_hash",), ("SearchEngine",), ("HTTPServer",), ("a::b",), ("x-y",)], "t string")
    assert [r[0] for r in df.select(code.split_identifier(F.col("t"))).collect()] == [["process", "file", "hash"], ["Search", "Engine"], ["HTTP", "Server"], ["a", "b"], ["x", "y"]]
    q = spark.createDataFrame([("",), ("a::b",), ("how does it work",), ("two words",), ("one two three four",)], "q string")
    assert [r[0] for r in q.select(code.query_type(F.col("q"))).collect()] == ["keyword", "symbol", "natural_language", "mixed", "natural_language"]
    i = spark.createDataFrame([("data flow from a to b",), ("who imports this",), ("which tests cover it",), ("fix the crash",), ("zzz",)], "q string")
    assert [r[0] for r in i.select(code.intent(F.col("q"))).collect()] == ["data_flow", "dependency", "test_coverage", "debug", "unknown"]


def test_keyword_tokens(spark):
    df = spark.createDataFrame([("How does the SearchEngine parse my_file?",), ("the of",), ("A a! find `x`",)], "q string")
    assert [r[0] for r in df.select(code.keyword_tokens(F.col("q"))).collect()] == [["SearchEngine", "search", "engine", "parse", "my_file", "file"], [], ["x"]]


def test_cycle_graph(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert {tuple(r) for r in G.strong_components(e).collect()} == {(1, 1), (2, 1), (3, 1)}
    four = spark.createDataFrame([(4,)], "node long")
    assert {r["node"]: r["distance"] for r in G.blast_radius(e, four, 3).collect()} == {3: 1, 2: 2, 1: 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_reach_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(35)})
    e = edges(spark, pairs)
    to = {n: {b for a, b in pairs if a == n} for n in range(25)}

    def closure(n):
        seen, todo = set(), [n]
        while todo:
            for m in to[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    reach = {n: closure(n) for n in range(25)}
    scc = {n: min(m for m in {n} | {m for m in reach[n] if n in reach[m]}) for n in range(25)}
    big = {n for n in scc if sum(scc[m] == scc[n] for m in scc) > 1}
    assert {tuple(r) for r in G.strong_components(e).collect()} == {(n, scc[n]) for n in big}
    both = {n: to[n] | {a for a, b in pairs if b == n} for n in range(25)}
    comp = {}
    for n in range(25):
        seen, todo = {n}, [n]
        while todo:
            for m in both[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        comp[n] = min(seen)
    nodes = {x for p in pairs for x in p}
    assert {tuple(r) for r in G.components(e, "source_id", "target_id").collect()} == {(n, comp[n]) for n in nodes}


def test_pagerank_sums_to_one(spark):
    ranks = G.pagerank(edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (1, 2)]), iterations=12).collect()
    assert abs(sum(r["rank"] for r in ranks) - 1) < 1e-9 and len(ranks) == 4


def test_reasoning_scores(spark):
    e = edges(spark, [(1, 2), (2, 3)])
    hits = {r["node"]: round(r["score"], 4) for r in G.reasoning(e, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert hits == {2: 0.36, 3: 0.216}


@pytest.mark.parametrize("large", [2, 400])
def test_co_changes_against_brute_force(spark, large):
    rng = random.Random(3)
    rows = sorted({(f"h{rng.randrange(12)}", f"p{rng.randrange(8)}") for _ in range(50)})
    got = {(r["path_a"], r["path_b"]): r["freq"] for r in H.co_changes(spark.createDataFrame(rows, "hash string, path string"), large).collect()}
    want = {}
    for h in {h for h, _ in rows}:
        for a, b in itertools.combinations(sorted(p for g, p in rows if g == h), 2):
            want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_rank_fusion(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query string, id long, rank int")
    b = spark.createDataFrame([("q", 2, 1)], "query string, id long, rank int")
    got = {r["id"]: r["score"] for r in T.fuse([(a, 1.0), (b, 0.5)]).collect()}
    assert got[1] == pytest.approx(1 / 61) and got[2] == pytest.approx(1 / 62 + 0.5 / 61)


def test_vector_search_and_inverted_file(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        centre = i % 6
        v = [rng.gauss(1.0 if j == centre else 0.0, 0.15) for j in range(8)]
        n = sum(x * x for x in v) ** 0.5
        rows.append((i, [x / n for x in v]))
    rows.append((999, [1.0]))  # another size
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = df.filter("id % 20 = 0 and id < 300")
    exact = T.knn(df, asked, 5)
    by = dict(rows)
    for r in exact.filter("rank = 1").collect():
        best = max((x for x in by if x not in (r["query"], 999)), key=lambda x: (sum(a * b for a, b in zip(by[x], by[r["query"]], strict=True)), -x))
        assert best == r["id"]
    assert T.recall(T.InvertedFile(df.filter("id < 300"), cells=12).search(asked, 5), exact).first()[0] >= 0.9
    assert T.knn(df, df.filter("id < 0"), 5).count() == 0


def test_recall_of_the_inverted_file_on_the_data(spark):
    from quillspan.plans.retrieval import QUERIES

    assert QUERIES["ret02_ivf_recall"](spark, "/root/testdata/sf0.01").first()["recall"] >= 0.9


def test_bm25_falls_back_to_any_term(spark):
    d = spark.createDataFrame([(1, "red green"), (2, "green blue"), (3, None)], "id long, t string")
    q = spark.createDataFrame([("a", "red"), ("a", "green"), ("b", "red"), ("b", "blue")], "query string, term string")
    got = {}
    for r in T.bm25(d, "id", {"t": 1.0}, q).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    assert got == {"a": {1}, "b": {1, 2}}


def test_packing(spark):
    rows = spark.createDataFrame([("q", 1, 1, 30, 0.9), ("q", 2, 2, 50, 0.8), ("q", 3, 3, 40, 0.7), ("q", 4, 4, 10, 0.6)], "query string, id long, rank int, token_count int, score double")
    assert {r["id"] for r in C.budget_prefix(rows, 100).collect()} == {1, 2}
    assert {r["id"] for r in C.greedy_pack(rows, 100).collect()} == {1, 2, 4}
    k = rows.withColumn("priority", F.lit("medium"))
    best = max((s for n in range(5) for s in itertools.combinations([(1, 30, 0.9), (2, 50, 0.8), (3, 40, 0.7), (4, 10, 0.6)], n) if sum(x[1] for x in s) <= 85), key=lambda s: sum(x[2] for x in s))
    assert {r["id"] for r in C.knapsack(k, 85).collect()} == {x[0] for x in best}


def test_merged_and_contained_ranges(spark):
    rows = spark.createDataFrame([(1, 1, 5, 1.0, 10, "a"), (2, 6, 9, 2.0, 10, "b"), (3, 20, 30, 1.0, 10, "c"), (4, 22, 25, 1.0, 10, "d")], "id long, line_start int, line_end int, score double, token_count int, content string").withColumn("file_id", F.lit(7))
    assert sorted((r["line_start"], r["line_end"], r["content"]) for r in C.merge_adjacent(rows, ["file_id"]).collect()) == [(1, 9, "a\nb"), (20, 30, "c\nd")]
    assert [r["id"] for r in C.contained(rows).collect()] == [4]


def test_metrics(spark):
    r = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query string, item string, rank int")
    j = spark.createDataFrame([("q", "y", 3), ("q", "z", 1), ("p", "z", 1)], "query string, item string, relevance int")
    got = {x["query"]: x for x in metrics.evaluate(r, j).collect()}
    assert got["q"]["reciprocal_rank"] == 0.5 and got["q"]["recall"] == 0.5 and got["p"]["ndcg"] == 0.0


def test_upserts_and_deltas(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v int")
    assert {tuple(r) for r in R.upsert(old, new, ["k"], [F.col("v").desc()]).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert {tuple(r) for r in R.insert_ignore(old, new.filter("v < 5"), ["k"]).collect()} == {("a", 1), ("b", 2)}
    b, a = spark.createDataFrame([("f", 1), ("g", 2)], "fqn string, hash int"), spark.createDataFrame([("g", 3), ("h", 4)], "fqn string, hash int")
    assert {tuple(r) for r in R.symbol_delta(b, a).collect()} == {("f", "removed"), ("g", "modified"), ("h", "added")}


def test_parsers(spark):
    md = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny"), (2, "plain\ntext")], "id long, t string")
    assert sorted((r["id"], r["name"], r["content"]) for r in P.markdown(md, "id", "t").collect()) == [(1, "A", "# A\nx"), (1, "B", "## B\ny"), (2, None, "plain\ntext")]
    diff = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +2,3 @@\n+x\n-y\n@@ -9 +10 @@\n same\n"
    hunks = P.diff_hunks(spark.createDataFrame([(1, diff)], "id long, t string"), "id", "t").collect()
    assert [(r["file"], r["start_line"], r["line_count"], r["content"]) for r in hunks] == [("f", 2, 3, "+x\n-y")]
    assert [(e[0], e[1], e[5]) for e in P.elements("class A:\n    def _f(self):\n        g()\n", "python")] == [("A", "class", "public"), ("A::_f", "function", "protected")]
    assert [e[:2] for e in P.elements("pub fn f() {\n}\nstruct S {\n}\n", "rust")] == [("f", "function"), ("S", "class")]
    assert len(P.prose_chunks("\n\n".join(["word " * 100] * 8), 300)) > 1


# ---------------------------------------------------------------- only new or changed records

T0 = dt.datetime(2026, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


SCANS = "scan_id long, path string, hash string, is_deleted boolean, seen_at timestamp_ntz"
FILES = "path string, hash string, indexed_at timestamp_ntz, extra string"
RUNS = "run_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string"


def found(spark, scans, files, runs):
    done = completed_versions(spark.createDataFrame(files, FILES), spark.createDataFrame(runs, RUNS))
    return {r["key"] for r in pending_items(latest_scans(spark.createDataFrame(scans, SCANS)), done).collect()}


def test_only_changed_files_are_pending(spark):
    runs = [(1, at(0), at(1), "ok"), (2, at(24), None, "crashed"), (3, at(48), at(49), "failed")]
    files = [("a", "H1 ", at(0.5), "x"), ("b", "h1", at(0.5), "x"), ("c", "h1", at(24.5), "x"), ("d", "h1", at(0.5), "x"), ("e", "h1", at(0.5), None), ("e", "h2", at(48.5), None), (None, "h", at(0.5), None)]
    scans = [
        (1, "./a", "h1", False, at(50)), (2, "b", "h2", False, at(50)), (3, "c", "h1", False, at(50)), (4, "d", None, True, at(50)), (5, "d", "h9", False, at(49)),
        (6, "e", "h2", False, at(50)), (7, "new\\f", "h", None, at(50)), (8, "b", None, False, at(60)), (9, None, "h", False, at(60)), (7, "new\\f", "h", None, at(50)),
    ]
    assert found(spark, scans, files, runs) == {"b", "c", "e", "new/f"}
    assert found(spark, [], files, runs) == set()
    assert found(spark, scans[:1], [], []) == {"a"}


def test_a_run_takes_up_the_changed_files_of_the_data(spark, tmp_path):
    from quillspan.plans.incremental import p2_found
    from quillspan.sources.tables import table

    d, now = "/root/testdata/sf0.001", dt.datetime(2030, 1, 1)
    got = sorted(r["path"] for r in p2_found(spark, d).collect())
    scans, done = latest_scans(table(spark, d, "file_scans")), completed_versions(table(spark, d, "files"), table(spark, d, "index_runs"))
    assert got == sorted(r["key"] for r in pending_items(scans, done).collect()) and got
    led = WorkLedger(spark, f"file://{tmp_path}/ledger")

    def breaks(leases):
        assert sorted(r["key"] for r in leases.collect()) == got
        raise InterruptedError

    for _ in range(2):  # the run breaks off, and so does its retry
        with pytest.raises(InterruptedError):
            run_once(led, scans, done, "run", now, breaks)
    assert run_once(led, scans, done, "other", now).count() == 0  # all are leased
    leased, later = led._read("lease", "run"), now + dt.timedelta(hours=2)
    assert sorted(r["key"] for r in run_once(led, scans, done, "third", later).collect()) == got
    assert led.complete(leased, "late", later).count() == 0  # the first worker comes back
    assert led.state(later).filter("state <> 'done'").count() == 0
    assert run_once(led, scans, done, "fourth", later).count() == 0


def test_ledger_survives_failures(spark, tmp_path):
    led = WorkLedger(spark, f"file://{tmp_path}/ledger")
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("c", "1"), (None, "1"), ("d", None)], "key string, version string")
    led.enqueue(items, "run1", at(0))
    assert led.enqueue(items, "run1", at(0)).count() == 3  # the retry returns the same rows
    assert {r["key"]: r["state"] for r in led.state(at(0)).collect()} == {"a": "pending", "b": "pending", "c": "pending"}
    one = led.lease("w1", "l1", at(1), at(2))
    again = led.lease("w1", "l1", at(1), at(2))
    assert one.collect() == again.collect() and {r["token"] for r in again.collect()} == {1}
    assert {r["state"] for r in led.state(at(1.2)).collect()} == {"leased"}
    assert led.lease("w2", "l2", at(1.5), at(3)).count() == 0  # all are leased
    for _ in range(2):
        done = led.complete(one.filter("key = 'a'"), "d1", at(1.8))
        assert [r["key"] for r in done.collect()] == ["a"]
        assert {r["key"]: r["state"] for r in led.state(at(1.9)).collect()} == {"a": "done", "b": "leased", "c": "leased"}
    two = led.lease("w2", "l3", at(2.5), at(4))  # b and c came back
    assert {(r["key"], r["token"]) for r in two.collect()} == {("b", 2), ("c", 2)}
    assert led.complete(one, "d2", at(2.6)).count() == 0  # the first worker's tokens are old
    assert led.complete(two, "d3", at(2.7)).count() == 2
    assert led.complete(two, "d4", at(2.8)).count() == 0  # nothing is done twice
    assert {r["state"] for r in led.state(at(9)).collect()} == {"done"}
    led.enqueue(spark.createDataFrame([("a", "2"), ("b", "1")], "key string, version string"), "run2", at(9))
    assert {(r["key"], r["version"]) for r in led.state(at(9)).filter("state = 'pending'").collect()} == {("a", "2")}


def test_ledger_takes_up_reverted_versions(spark, tmp_path):
    led = WorkLedger(spark, f"file://{tmp_path}/ledger")
    item = lambda v: spark.createDataFrame([("a", v)], "key string, version string")
    for n, v in enumerate(["1", "2", "1"]):
        led.enqueue(item(v), f"e{n}", at(n))
        leases = led.lease("w", f"l{n}", at(n), at(n + 0.5))
        assert [(r["version"], r["token"]) for r in leases.collect()] == [(v, n + 1)]
        assert led.complete(leases, f"d{n}", at(n)).count() == 1
    led.enqueue(item("3"), "e3", at(4))
    led.enqueue(item("4"), "e4", at(5))  # 3 was never taken up
    assert {r["version"]: r["state"] for r in led.state(at(5)).filter("epoch > 2").collect()} == {"3": "superseded", "4": "pending"}


def test_writes_that_broke_off_are_not_read(spark, tmp_path):
    import os

    led = WorkLedger(spark, f"file://{tmp_path}/ledger")
    item = spark.createDataFrame([("a", "1")], "key string, version string")
    led.enqueue(item, "run", at(0))
    os.remove(tmp_path / "ledger/item/run/_SUCCESS")  # as if the write had been stopped
    assert led.state(at(0)).count() == 0
    assert led.enqueue(item, "run", at(0)).count() == 1 and led.state(at(0)).count() == 1
