"""Queries against their SQL on the smallest data, and the engine's methods."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspan.engine import Engine, checked_path, checked_query, clamp

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
NAMES = ["p2_found", "agg01_language_distribution", "join22_co_changes", "gra05_blast_radius", "ret01_keyword_search", "win05_merged_ranges", "src27_markdown_sections", "stm14_feedback_counters", "fil27_structural_adjacency", "str24_purposes"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    want = sorted((tuple(map(plain, r)) for r in con.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]}) q").fetchall()), key=str)
    assert got == want


@needs_data
def test_engine(spark):
    e = Engine(spark, SF)
    hits = e.search("callers must hold the lock", 5).collect()
    assert 0 < len(hits) <= 5 and [h["position"] for h in sorted(hits, key=lambda h: h["position"])] == list(range(1, len(hits) + 1))
    assert e.status().first()["files"] > 0
    assert e.search_with_filter("callers must hold the lock", kind="function").filter("kind <> 'function'").count() == 0
    assert e.context_window("callers must hold the lock").first()["text"].startswith("// file:")
    assert e.blast_radius(1).columns == ["start", "node", "distance"]
    assert e.search_commits("fix").count() > 0


def test_arguments():
    assert clamp(None, 10, 200) == 10 and clamp(0, 10, 200) == 1 and clamp(999, 10, 200) == 200
    for bad in ("", " ", "x" * 10_001):
        with pytest.raises(ValueError):
            checked_query(bad)
    for bad in ("/etc/x", "a/../b", "C:\\x"):
        with pytest.raises(ValueError):
            checked_path(bad)


def test_no_query_without_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())
