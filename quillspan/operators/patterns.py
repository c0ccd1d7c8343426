"""Habits of a code base told from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def code_patterns(chunks: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(pattern, n, of_n, ratio): how many of the chunks that could have a habit do; one pass over the chunks."""
    fn, content, name = F.col("kind") == "function", F.col("content"), F.element_at(F.split("symbol_path", "::"), -1)
    documentable = F.col("kind").isin("function", "class", "trait")
    wanted = {
        "result_returns": (fn & content.like("%-> Result<%"), fn),
        "unwraps": (fn & content.like("%.unwrap()%"), fn),
        "logging": (fn & F.lower(content).like("%log%"), fn),
        "naming": (fn & name.like("%_%"), fn),
        "testing": (F.col("kind") == "test", fn),
        "documented": (documentable & F.col("doc_comment").isNotNull(), documentable),
    }
    wanted = {k: v for k, v in wanted.items() if only is None or k in only}
    one = chunks.agg(*(F.count(F.when(c, 1)).alias(f"{k}_{i}") for k, pair in wanted.items() for i, c in enumerate(pair)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), F.col(f"{k}_0").alias("n"), F.col(f"{k}_1").alias("of_n")) for k in wanted)))
    return one.select(rows.alias("r")).select("r.*").withColumn("ratio", F.round(F.least(F.lit(1.0), F.col("n") / F.nullif(F.col("of_n"), F.lit(0))), 6))


def confidences(patterns: DataFrame) -> DataFrame:
    """(pattern, n, of_n, confidence): the part of those that could, doubled for tests, 1 at most."""
    twice = F.when(F.col("pattern") == "testing", 2.0).otherwise(1.0)
    return patterns.select("pattern", "n", "of_n", F.round(F.least(F.lit(1.0), twice * F.col("n") / F.nullif(F.col("of_n"), F.lit(0))), 6).alias("confidence"))
