"""Lookups, keyed writes, joins and set operations over the engine's tables.

Writes are pure functions from the old and the new rows to the rows to be stored, so that they are
retried safely; deletes cascade by anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key; of several new rows with one key
    the last by ``order``."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        new = new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key is not in it, one per key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def delete_where(rows: DataFrame, keys: DataFrame, on: dict[str, str]) -> DataFrame:
    """``rows`` without those that match ``keys`` on any of the pairs column -> key column."""
    for column, key in on.items():
        k = keys.select(F.col(key).alias(column)).distinct()
        rows = rows.join(k, column, "left_anti")
    return rows


def cascade_delete(files: DataFrame, chunks: DataFrame, symbols: DataFrame, dependencies: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the files of ``gone`` (path) and all that belongs to them."""
    ids = files.join(gone.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"))
    lost = symbols.join(ids, "file_id", "left_semi").select(F.col("id").alias("sid"))
    return (
        files.join(gone.select("path").distinct(), "path", "left_anti"),
        chunks.join(ids, "file_id", "left_anti"),
        symbols.join(ids, "file_id", "left_anti"),
        delete_where(dependencies, lost, {"source_id": "sid", "target_id": "sid"}),
    )


def like_any_case(c: Column, pattern: str) -> Column:
    """LIKE without regard to case; ``_`` and ``%`` are wild cards."""
    return c.ilike(pattern)


def symbols_by_prefix(symbols: DataFrame, prefix: str, limit: int) -> DataFrame:
    return symbols.filter(like_any_case(F.col("name"), prefix + "%")).orderBy("name", "id").limit(limit)


def symbols_by_suffix(symbols: DataFrame, suffix: str, limit: int) -> DataFrame:
    return symbols.filter(like_any_case(F.col("fqn"), "%" + suffix)).orderBy(F.length("fqn"), "id").limit(limit)


def first_per(rows: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def neighbours_by_type(edges: DataFrame, edge_type: str) -> DataFrame:
    """(path, neighbour) one edge of the type apart, in either direction."""
    e = edges.filter(F.col("edge_type") == edge_type)
    return e.select(F.col("source_path").alias("path"), F.col("target_path").alias("neighbour")).union(e.select("target_path", "source_path")).distinct()


def name_index(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(name, paths): the distinct files that define each name, sorted."""
    return symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def call_edges(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_id, target_id) of references (source_id, file_id, name): a symbol of that name in the same
    file first, else the first of all by fqn; no edge to itself. One join on the name: candidates are
    reduced per name before it, so a name in many files doesn't multiply."""
    local = first_per(symbols.select("file_id", "name", F.col("id").alias("local_id"), "line"), ["file_id", "name"], F.col("line"), F.col("local_id")).drop("line")
    world = symbols.groupBy("name").agg(F.min(F.struct("fqn", "id")).alias("m")).select("name", F.col("m.id").alias("world_id"))
    r = references.join(local, ["file_id", "name"], "left").join(world, "name", "left")
    e = r.select("source_id", F.coalesce("local_id", "world_id").alias("target_id"))
    return e.filter("target_id is not null and target_id <> source_id").distinct()


def resolve_import(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(import, symbol_id) of (import, path, name): the fqn path::name, else path.name, else a symbol whose
    fqn ends with ::name - the only one, one that contains the path, or the shortest."""
    exact = imports.withColumn("fqn", F.concat("path", F.lit("::"), "name")).join(symbols.select("fqn", "id"), "fqn").select("import", "id", F.lit(0).alias("rank"), F.lit(0).alias("size"))
    dotted = imports.withColumn("fqn", F.concat("path", F.lit("."), "name")).join(symbols.select("fqn", "id"), "fqn").select("import", "id", F.lit(1).alias("rank"), F.lit(0).alias("size"))
    named = imports.join(symbols.select("name", "fqn", "id"), "name")
    rank = F.when(F.col("fqn").contains(F.col("path")), 2).otherwise(3)
    suffix = named.select("import", "id", rank.alias("rank"), F.length("fqn").alias("size"))
    every = exact.unionByName(dotted).unionByName(suffix)
    return first_per(every, "import", "rank", "size", "id").select("import", F.col("id").alias("symbol_id"))


def symbol_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(fqn, change) of (fqn, hash) rows: added, removed or modified."""
    b, a = before.select("fqn", F.col("hash").alias("h0")), after.select("fqn", F.col("hash").alias("h1"))
    j = b.join(a, "fqn", "full")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "modified")
    return j.select("fqn", change.alias("change")).filter("change is not null")


def keep_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks with the vector of the old chunk of the same symbol path and content hash."""
    o = first_per(old.select("symbol_path", "content_hash", F.col("vector_id").alias("old_vector")), ["symbol_path", "content_hash"], F.col("old_vector").asc_nulls_last())
    return new.drop("vector_id").join(o, ["symbol_path", "content_hash"], "left").withColumnRenamed("old_vector", "vector_id")


def replace_files(rows: DataFrame, new: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """``rows`` with those of the files (column ``key``) replaced by ``new``; a file without new rows has none left."""
    return rows.join(files.select(key).distinct(), key, "left_anti").unionByName(new)
