"""Source files on disk or in a shared store as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.code import language_of

EXCLUDED = ("node_modules", "target", "dist", "build", ".git", "__pycache__", ".venv", "vendor")
MOST_BYTES = 5 * 1024 * 1024


def repository(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, language, hash, size_bytes, last_modified, content) of the files below ``root`` whose language is
    known, that lie in no excluded folder and aren't too large. Names and sizes are judged before contents are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file://").rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in base) + "/", "")
    f = f.withColumn("p", path).filter(F.col("length") <= most_bytes)
    f = f.filter(~F.arrays_overlap(F.split("p", "/"), F.array(*map(F.lit, excluded))) & (language_of(F.col("p")) != "unknown"))
    return f.select(F.col("p").alias("path"), language_of(F.col("p")).alias("language"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
