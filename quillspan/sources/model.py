"""The engine's tables from the delivered ones: repeated rows once, names and spellings in one form.

Only the columns a query needs are read: each function takes the columns wanted besides the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.functions.paths import plain_hash, plain_path
from quillspan.session import materialize
from quillspan.sources.tables import table

SYMBOL_KINDS = ("function", "class", "trait", "impl", "const", "typedef", "test")

#: Kinds of dependencies between symbols, and of edges between files.
DEPENDENCY_KINDS = ("imports", "calls", "extends", "implements", "uses_type", "instantiates", "field_access", "data_flow", "error_flow", "type_flow", "historical_co_change")
EDGE_TYPES = ("imports", "inherits", "calls", "instantiates", "historical_co_change")


def files(spark: SparkSession, d: str) -> DataFrame:
    """One row per path: the one indexed last (rows never indexed after all others)."""
    f = table(spark, d, "files").withColumn("path", plain_path(F.col("path"))).filter("path is not null")
    w = Window.partitionBy("path").orderBy(F.col("indexed_at").desc_nulls_last(), F.col("hash").desc_nulls_last(), F.col("id").desc())
    f = f.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    lang = F.lower(F.trim("language"))
    return f.withColumn("language", F.coalesce(F.when(lang != "", lang), F.lit("unknown"))).withColumn("hash", plain_hash(F.col("hash")))


#: Rows to be left out that are sent to every executor: beyond that the contents are shuffled.
BROADCAST_ROWS = 500_000


def once_per_id(rows: DataFrame) -> DataFrame:
    """Rows of a parquet table without the further rows of an id, and without shuffling wide columns: ids and
    places of rows are grouped, and the places of the further rows, which are few, are left out of the scan."""
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    ids = rows.select("id", place.alias("p"))
    again = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first")).filter("n > 1")
    extra = materialize(ids.join(again, "id").filter("p <> first").select(F.col("p.f").alias("f"), F.col("p.r").alias("r")), "repeated")
    if extra.count() <= BROADCAST_ROWS:
        extra = F.broadcast(extra)
    wide = rows.select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    return wide.join(extra, ["f", "r"], "left_anti").drop("f", "r")


WIDE = {"content", "doc_comment", "metadata"}


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per id with the columns wanted; kind and visibility in their known values, tokens estimated
    from the content wherever ``token_count`` is asked for."""
    c = table(spark, d, "chunks")
    made = {
        "kind": code.known_kind(F.col("kind")),
        "visibility": code.known_visibility(F.col("visibility")),
        "token_count": code.estimate_tokens(F.col("content")),
    }
    wanted = ["id", *(made[x].alias(x) if x in made else F.col(x) for x in columns)]
    if WIDE & set(columns):
        return once_per_id(c).select(*wanted)
    return c.select(*wanted).dropDuplicates(["id"])


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, fqn, kind, file_id, line, chunk_id), one row per fqn: the chunk written last."""
    c = chunks(spark, d, "file_id", "symbol_path", "kind", "line_start").filter(F.col("symbol_path").isNotNull() & F.col("kind").isin(*SYMBOL_KINDS))
    best = c.groupBy("symbol_path").agg(F.max(F.struct("id", "kind", "file_id", "line_start")).alias("m"))
    return best.select(
        F.col("m.id").alias("id"), F.element_at(F.split("symbol_path", "::"), -1).alias("name"), F.col("symbol_path").alias("fqn"),
        "m.kind", "m.file_id", F.col("m.line_start").alias("line"), F.col("m.id").alias("chunk_id"),
    )


def commits(spark: SparkSession, d: str) -> DataFrame:
    """(hash, message, author, ts, summary) once per hash; both time formats, in UTC; an empty author is null."""
    c = table(spark, d, "commits").withColumn("hash", plain_hash(F.col("hash"))).filter("hash is not null")
    ts = F.expr("try_cast(concat(substring(trim(committed_at), 1, 10), ' ', substring(trim(committed_at), 12, 8)) as timestamp_ntz)")
    author = F.trim("author")
    c = c.select("hash", "message", F.when(author != "", author).alias("author"), ts.alias("ts"), "summary")
    return c.dropDuplicates(["hash"])


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    """(hash, path) distinct, in plain form."""
    return table(spark, d, "commit_files").select(plain_hash(F.col("commit_hash")).alias("hash"), plain_path(F.col("file_path")).alias("path")).dropna().distinct()


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, target_id, kind): the derived symbol graph of the fixture, parts that share two orders
    or more, directed by the parity of the sum of their keys."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = l.withColumnRenamed("l_partkey", "a"), l.withColumnRenamed("l_partkey", "b")
    p = a.join(b, "l_orderkey").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter("c >= 2")
    even = (F.col("a") + F.col("b")) % 2 == 0
    kind = F.element_at(F.array(*map(F.lit, DEPENDENCY_KINDS)), ((F.col("a") * 7 + F.col("b")) % 11 + 1).cast("int"))
    return p.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("source_id"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("target_id"), kind.alias("kind"))


def file_edges(spark: SparkSession, d: str) -> DataFrame:
    """(source_path, target_path, edge_type, weight): the same graph between files named after parts."""
    e = dependencies(spark, d)
    kind = F.element_at(F.array(*map(F.lit, EDGE_TYPES)), ((F.col("source_id") + F.col("target_id") * 3) % 5 + 1).cast("int"))
    name = lambda c: F.concat(F.lit("src/part_"), F.col(c).cast("string"), F.lit(".rs"))
    return e.select(name("source_id").alias("source_path"), name("target_id").alias("target_path"), kind.alias("edge_type"), F.lit(1.0).alias("weight"))
