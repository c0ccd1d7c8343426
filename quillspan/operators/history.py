"""Co-change mining over commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import materialize

BUG_WORDS = ("fix", "bug", "patch")
LARGE_COMMIT = 400


def co_changes(commit_files: DataFrame, large: int = LARGE_COMMIT) -> DataFrame:
    """(path_a, path_b, freq), path_a < path_b, of (hash, path): commits with both files. Equal file sets
    are counted once with a weight before their pairs are enumerated. Commits of more than ``large`` files
    are never gathered: their files are dealt into blocks, and each pair of blocks is a row of its own."""
    rows = commit_files.select("hash", "path").distinct()
    sizes = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    wide = materialize(sizes.filter(F.col("n") > large), "wide-commits")
    some = not wide.isEmpty()
    narrow = rows.join(wide.select("hash"), "hash", "left_anti") if some else rows
    sets = narrow.groupBy("hash").agg(F.array_sort(F.collect_list("path")).alias("p")).filter("size(p) > 1")
    sets = sets.groupBy("p").agg(F.count(F.lit(1)).alias("w"))
    x = F.col("p")
    pair = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.size(x)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = sets.select("w", F.explode(pair).alias("e")).select(F.col("e.a").alias("path_a"), F.col("e.b").alias("path_b"), "w")
    if some:
        blocks = F.ceil(F.col("n") / F.lit(max(large // 2, 1))).cast("int")
        r = rows.join(wide, "hash").withColumn("k", blocks).withColumn("b", F.pmod(F.xxhash64("path"), F.col("k")).cast("int"))
        r = r.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        met = r.groupBy("hash", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).agg(F.array_sort(F.collect_set(F.struct("path", "b"))).alias("p"))
        two = F.flatten(F.transform(x, lambda a, i: F.transform(F.filter(F.slice(x, i + 2, F.size(x)), lambda c: (F.col("i") == F.col("j")) | (c["b"] != a["b"])), lambda c: F.struct(a["path"].alias("a"), c["path"].alias("b")))))
        pairs = pairs.unionByName(met.select(F.explode(two).alias("e")).select(F.col("e.a").alias("path_a"), F.col("e.b").alias("path_b"), F.lit(1).cast("long").alias("w")))
    return pairs.groupBy("path_a", "path_b").agg(F.sum("w").alias("freq"))


def co_changed_with(commits: DataFrame, commit_files: DataFrame, path: str, history: int = 500, least: int = 2, limit: int = 20) -> DataFrame:
    """(path, freq) of the files that share commits with ``path``, over its newest ``history`` commits."""
    own = commit_files.filter(F.col("path") == path).select("hash")
    newest = commits.join(own, "hash").orderBy(F.col("ts").desc_nulls_last(), "hash").limit(history).select("hash")
    return (
        commit_files.join(newest, "hash").filter(F.col("path") != path).groupBy("path").agg(F.count(F.lit(1)).alias("freq"))
        .filter(F.col("freq") >= least).orderBy(F.col("freq").desc(), "path").limit(limit)
    )


def bug_fixes(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(path, bugs): commits whose message speaks of a fix, per file."""
    low = F.lower("message")
    bug = low.contains("fix") | low.contains("bug") | low.contains("patch")
    return commit_files.join(commits.filter(bug).select("hash"), "hash").groupBy("path").agg(F.count(F.lit(1)).alias("bugs"))


def bug_boost(bugs: DataFrame, least: int = 2) -> DataFrame:
    return bugs.filter(F.col("bugs") >= least).select("path", F.least(F.lit(1.0) + F.col("bugs") / 10.0, F.lit(2.0)).alias("boost"))


def enhance(edges: DataFrame, pairs: DataFrame, commits: int, least: int = 3) -> DataFrame:
    """Edges with those between files that changed together ``least`` times, of weight freq / commits."""
    new = pairs.filter(F.col("freq") >= least).select(
        F.col("path_a").alias("source_path"), F.col("path_b").alias("target_path"), F.lit("historical_co_change").alias("edge_type"), (F.col("freq") / F.lit(float(max(commits, 1)))).alias("weight")
    )
    return edges.unionByName(new)


def warnings(pairs: DataFrame, affected: DataFrame, least: int = 3) -> DataFrame:
    """(path, freq) of partners of the affected files (path) that are not affected themselves."""
    both = pairs.select(F.col("path_a").alias("path"), F.col("path_b").alias("other"), "freq").union(pairs.select("path_b", "path_a", "freq"))
    hit = both.filter(F.col("freq") >= least).join(affected.select("path").distinct(), "path", "left_semi").select(F.col("other").alias("path"), "freq")
    return hit.join(affected.select("path").distinct(), "path", "left_anti").groupBy("path").agg(F.max("freq").alias("freq"))


def newest_per_file(commits: DataFrame, commit_files: DataFrame, n: int) -> DataFrame:
    """The newest n commits of each file."""
    w = Window.partitionBy("path").orderBy(F.col("ts").desc_nulls_last(), "hash")
    return commit_files.join(commits, "hash").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def top_authors(commits: DataFrame, commit_files: DataFrame, path: str, history: int = 100, limit: int = 5) -> DataFrame:
    newest = commits.join(commit_files.filter(F.col("path") == path).select("hash"), "hash").orderBy(F.col("ts").desc_nulls_last(), "hash").limit(history)
    return newest.groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("author").asc_nulls_first()).limit(limit)


def pair_frequency(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(x, y, freq) of the pairs asked for (x, y), in any order; 0 for those that never changed together."""
    key = asked.select("x", "y", F.least("x", "y").alias("path_a"), F.greatest("x", "y").alias("path_b"))
    return key.join(pairs, ["path_a", "path_b"], "left").select("x", "y", F.coalesce("freq", F.lit(0)).alias("freq"))
