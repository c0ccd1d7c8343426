"""Queries of the training-data problems, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.paths import plain_hash, plain_path, repository
from quillspan.llm import bpe, credentials, functions, handwritten, mixing, near, pairs, split, subjects
from quillspan.session import materialize
from quillspan.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized_ids(split.split_oversized(table(spark, d, "chunks")))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.distinct_pieces(split.split_oversized(table(spark, d, "chunks")))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return functions.documented_functions(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return functions.documented_functions(table(spark, d, "chunks"), code=False).select("chunk_id", "func_name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).select("path_a", "path_b")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "commit_files").select(plain_hash(F.col("commit_hash")).alias("commit"), plain_path(F.col("file_path")).alias("path"))
    rows = rows.withColumn("repo", repository(F.col("path")))
    out = pairs.frequent_pairs(rows, "commit", "path", "repo", min_count=5, min_lift=4.0)
    return out.select(F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n_ab", "n_a", "n_b", "n", "lift", "conviction")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = near.NearDuplicates(table(spark, d, "chunks"), k=3, threshold=0.7).pairs()
    return found.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    found = near.NearDuplicates(table(spark, d, "chunks"), k=3, threshold=0.7).groups()
    return found.select(F.col("id").alias("chunk_id"), F.col("group").alias("group_id"), "links")


def _credentials(spark: SparkSession, d: str) -> DataFrame:
    chunks, docs = table(spark, d, "chunks"), table(spark, d, "external_docs")
    return credentials.find_credentials([
        credentials.find_candidates(chunks, "chunks", "id", "content", "symbol_path"),
        credentials.find_candidates(docs, "external_docs", "id", "content", "source_url"),
    ])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _credentials(spark, d).select("src", "row_id", "line_no").distinct()


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    found = materialize(_credentials(spark, d), "credentials")
    chunks = credentials.redact(table(spark, d, "chunks"), found, "chunks", "id", "content")
    return chunks.unionByName(credentials.redact(table(spark, d, "external_docs"), found, "external_docs", "id", "content"))


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify_files(table(spark, d, "files"), table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_files(spark, d).filter("not hand_written").select("file_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> mixing.SourceMix:
    sizes = bpe.count_tokens(table(spark, d, "documents"), ["doc_id", "source"]).select(F.col("doc_id").alias("id"), "source", F.col("n_tokens").alias("size"))
    return mixing.SourceMix(sizes, table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shuffled().select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copy", "position")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = subjects.lines_of(docs)
    model = subjects.fit_rules(docs, table(spark, d, "doc_subject_labels"), table(spark, d, "subject_areas"), lines=lines)
    return subjects.classify_lines(lines, model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_shares(spark, d).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(materialize(p10_shares(spark, d), "subjects"), table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p3_pairs": p3_pairs,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_masked": p6_masked,
    "p7_files": p7_files,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
    "p10_composition": p10_composition,
}

_PAIRS = r"""
WITH cf AS (
  SELECT DISTINCT lower(trim(commit_hash)) AS h,
         nullif(regexp_replace(regexp_replace(replace(trim(file_path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '') AS p
  FROM commit_files WHERE file_path IS NOT NULL AND trim(commit_hash) <> ''),
x AS (SELECT h, p, split_part(p, '/', 1) AS r FROM cf WHERE p IS NOT NULL),
na AS (SELECT r, p, count(*) AS n FROM x GROUP BY r, p),
nr AS (SELECT r, count(DISTINCT h) AS n FROM x GROUP BY r),
ab AS (SELECT a.r, a.p AS path_a, b.p AS path_b, count(*) AS n_ab
       FROM x a JOIN x b ON a.h = b.h AND a.r = b.r AND a.p < b.p GROUP BY ALL HAVING count(*) >= 5),
res AS (SELECT path_a, path_b, n_ab, i.n AS n_a, j.n AS n_b, nr.n AS n
        FROM ab JOIN na i ON i.r = ab.r AND i.p = path_a JOIN na j ON j.r = ab.r AND j.p = path_b JOIN nr ON nr.r = ab.r
        WHERE n_ab * nr.n >= 4 * i.n * j.n)
"""

SQL = {
    "p1_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE octet_length(encode(content)) // 4 > 512",
    "p4_found": _PAIRS + "SELECT path_a, path_b FROM res",
    "p4_pairs": _PAIRS
    + """SELECT *, n_ab * n / (n_a * n_b)::DOUBLE AS lift,
         CASE WHEN n_ab < n_a THEN (1 - n_b / n::DOUBLE) / (1 - n_ab / n_a::DOUBLE) END AS conviction FROM res""",
}
