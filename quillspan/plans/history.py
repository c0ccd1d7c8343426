"""Commit history: co-change, bug-prone files, authors (reference sections 2.3, 2.4, 2.13a)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import history as H
from quillspan.plans.base_sql import sql
from quillspan.plans.book import Book
from quillspan.sources import model as M

q = Book()
QUERIES, SQL = q.queries, q.sql

_HOT = "(SELECT path FROM cf GROUP BY path ORDER BY count(*) DESC, path LIMIT 1)"


def _hottest(cf):
    return cf.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "path").first()["path"]


@q("join22_co_changes", sql("co", "SELECT path_a, path_b, freq FROM co WHERE freq >= 3"))
def _(s, d):
    return H.co_changes(M.commit_files(s, d)).filter("freq >= 3")


@q(
    "join23_co_changed_with_hottest",
    sql(
        "cm", "cf", f"h AS {_HOT}",
        "nw AS (SELECT hash FROM cf JOIN cm USING (hash) WHERE path = (SELECT path FROM h) ORDER BY ts DESC NULLS LAST, hash LIMIT 500)",
        "SELECT path, count(*)::BIGINT AS freq FROM cf JOIN nw USING (hash) WHERE path <> (SELECT path FROM h) GROUP BY path HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20",
    ),
)
def _(s, d):
    cf = M.commit_files(s, d)
    return H.co_changed_with(M.commits(s, d), cf, _hottest(cf))


_BUGS = "bg AS (SELECT path, count(*)::BIGINT AS bugs FROM cf JOIN cm USING (hash) WHERE contains(lower(message), 'fix') OR contains(lower(message), 'bug') OR contains(lower(message), 'patch') GROUP BY path)"


@q("agg14_bug_prone_files", sql("cm", "cf", _BUGS, "SELECT path, bugs FROM bg WHERE bugs >= 2"))
def _(s, d):
    return H.bug_fixes(M.commits(s, d), M.commit_files(s, d)).filter("bugs >= 2")


@q("agg16_bug_boost", sql("cm", "cf", _BUGS, "SELECT path, round(least(1 + bugs / 10.0::DOUBLE, 2.0), 6) AS boost FROM bg WHERE bugs >= 2"))
def _(s, d):
    return H.bug_boost(H.bug_fixes(M.commits(s, d), M.commit_files(s, d))).select("path", F.round("boost", 6).alias("boost"))


@q("agg15_enhanced_edges", sql("co", "cm", "fe", "SELECT edge_type, count(*)::BIGINT AS edges, round(sum(weight), 5) AS weight FROM (SELECT edge_type, weight FROM fe UNION ALL SELECT 'historical_co_change', freq / (SELECT count(*) FROM cm)::DOUBLE FROM co WHERE freq >= 3) GROUP BY edge_type"))
def _(s, d):
    e = H.enhance(M.file_edges(s, d), H.co_changes(M.commit_files(s, d)), M.commits(s, d).count())
    return e.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 5).alias("weight"))


@q(
    "join26_co_change_warnings",
    sql(
        "co",
        "af AS (SELECT DISTINCT path FROM cf WHERE path LIKE '%/src/%' AND path LIKE '%.rs')",
        "bt AS (SELECT path_a AS path, path_b AS other, freq FROM co UNION ALL SELECT path_b, path_a, freq FROM co)",
        "SELECT other AS path, max(freq)::BIGINT AS freq FROM bt WHERE freq >= 3 AND path IN (SELECT path FROM af) AND other NOT IN (SELECT path FROM af) GROUP BY other",
    ),
)
def _(s, d):
    cf = M.commit_files(s, d)
    return H.warnings(H.co_changes(cf), cf.filter(F.col("path").contains("/src/") & F.col("path").endswith(".rs")).select("path"))


@q("xtr02_top_authors", sql("cm", "cf", "nw AS (SELECT author FROM cm JOIN cf USING (hash) WHERE path = " + _HOT + " ORDER BY ts DESC NULLS LAST, hash LIMIT 100)", "SELECT author, count(*)::BIGINT AS n FROM nw GROUP BY author ORDER BY n DESC, author NULLS FIRST LIMIT 5"))
def _(s, d):
    cf = M.commit_files(s, d)
    return H.top_authors(M.commits(s, d), cf, _hottest(cf))


@q("xtr31_newest_commits_per_file", sql("cm", "cf", "SELECT path, hash FROM (SELECT path, hash, row_number() OVER (PARTITION BY path ORDER BY ts DESC NULLS LAST, hash) AS rn FROM cf JOIN cm USING (hash)) WHERE rn <= 2"))
def _(s, d):
    return H.newest_per_file(M.commits(s, d), M.commit_files(s, d), 2).select("path", "hash")


@q("agg12_history_statistics", sql("cm", "cf", "SELECT (SELECT count(*) FROM cm)::BIGINT AS commits, (SELECT count(*) FROM cf)::BIGINT AS changes, (SELECT count(*) FROM cm WHERE regexp_matches(lower(message), 'fix|bug|patch'))::BIGINT AS fixes, (SELECT count(*) FROM (SELECT DISTINCT hash FROM cf) WHERE hash NOT IN (SELECT hash FROM cm))::BIGINT AS missing"))
def _(s, d):
    cm, cf = M.commits(s, d), M.commit_files(s, d)
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return (
        one(cm, "commits").join(one(cf, "changes"), how="cross").join(one(cm.filter(F.lower("message").rlike("fix|bug|patch")), "fixes"), how="cross")
        .join(one(cf.select("hash").distinct().join(cm.select("hash"), "hash", "left_anti"), "missing"), how="cross")
    )


@q("xtr33_commit_files_from_lists", "WITH c AS (SELECT DISTINCT lower(trim(hash)) AS hash, files_changed FROM commits WHERE json_valid(files_changed)), x AS (SELECT DISTINCT hash, unnest(CAST(files_changed AS VARCHAR[])) AS path FROM (SELECT hash, from_json(files_changed, '[\"VARCHAR\"]') AS files_changed FROM c)) SELECT hash, count(*)::BIGINT AS files FROM x GROUP BY hash")
def _(s, d):
    from quillspan.sources.tables import table

    c = table(s, d, "commits").select(F.lower(F.trim("hash")).alias("hash"), F.from_json("files_changed", "array<string>", {"mode": "PERMISSIVE"}).alias("f"), "files_changed")
    whole = c.filter(F.col("files_changed").rlike(r"\]\s*$"))
    return whole.select("hash", F.explode("f").alias("path")).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("files"))
