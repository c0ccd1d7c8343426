"""Index interchange documents: nested rows per file, as JSON if wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL_SCHEMA = "relative_path string, language string, symbols array<struct<symbol: string, kind: string, line: int>>"


def symbol_string(path: Column, name: Column) -> Column:
    """Path and name as one symbol; blanks and back-quotes in a name are escaped by back-quotes."""
    escaped = F.when(name.rlike(r"^[\w+\-$]+$"), name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))
    return F.concat(F.lit("local . "), path, F.lit("/"), escaped, F.lit("."))


def export_documents(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(relative_path, language, symbols) per file; files without symbols have none."""
    s = symbols.select("file_id", "id", "name", "kind", "line")
    j = files.select(F.col("id").alias("file_id"), "path", "language").join(s, "file_id", "left")
    item = F.when(F.col("id").isNotNull(), F.struct(symbol_string(F.col("path"), F.col("name")).alias("symbol"), "kind", "line"))
    return j.groupBy(F.col("path").alias("relative_path"), "language").agg(F.array_sort(F.array_compact(F.collect_list(item))).alias("symbols"))


def import_statistics(docs: DataFrame, json_col: str) -> DataFrame:
    """(documents, symbols, errors) of JSON documents; one without a path is an error."""
    x = docs.select(F.from_json(F.col(json_col), SYMBOL_SCHEMA).alias("d"))
    bad = F.col("d.relative_path").isNull() | (F.col("d.relative_path") == "")
    return x.agg(F.count(F.when(~bad, 1)).alias("documents"), F.coalesce(F.sum(F.when(~bad, F.size("d.symbols"))), F.lit(0)).alias("symbols"), F.count(F.when(bad, 1)).alias("errors"))


def symbol_parts(symbol: Column) -> list[Column]:
    """path and name of a symbol as ``symbol_string`` writes it; null for any other text."""
    quoted, plain = r"^local \. (.*?)/`((?:[^`]|``)*)`\.$", r"^local \. (.*)/([\w+\-$]+)\.$"
    is_quoted, is_plain = symbol.rlike(quoted), symbol.rlike(plain)
    part = lambda n, change: F.when(is_quoted, change(F.regexp_extract(symbol, quoted, n))).when(is_plain, F.regexp_extract(symbol, plain, n))
    return [part(1, lambda c: c).alias("path"), part(2, lambda c: F.replace(c, F.lit("``"), F.lit("`"))).alias("name")]
