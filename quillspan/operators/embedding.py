"""Texts as vectors, batch by batch, with a model that is given as a function; without one, words are hashed.

A model is a function from a list of texts to a list of vectors. It is called once a batch; if that fails, each text is
tried alone, and one that fails again has no vector, so that it can be tried later."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[list[float]]]
BATCH = 256
_WORD = re.compile(r"\w+")


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """Signed counts of hashed words, of unit length; the model where none is given."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in _WORD.findall(t.lower()):
            h = zlib.crc32(w.encode())
            v[h % size] += 1.0 if h >> 16 & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / n for x in v])
    return out


def embed(texts: DataFrame, model: Model = hashed_words, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, vector) of each row; null texts and texts the model fails on, in the batch and alone, have a null vector."""
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def one(text: str) -> list[float] | None:
        try:
            return model([text])[0]
        except Exception:  # noqa: BLE001 - whatever a model raises, the other texts go on
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                p = b.slice(at, BATCH)
                texts = p.column(1).to_pylist()
                some = [t for t in texts if t is not None]
                try:
                    got = iter(model(some) if some else [])
                    vectors = [None if t is None else next(got) for t in texts]
                except Exception:  # noqa: BLE001
                    vectors = [None if t is None else one(t) for t in texts]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["id", "vector"])

    return rows.mapInArrow(run, "id long, vector array<double>")


def retried(found: DataFrame, texts: DataFrame, model: Model = hashed_words, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``found`` (id, vector) with those that have no vector tried again."""
    again = texts.join(found.filter("vector is null").select(F.col("id").alias(id_col)), id_col, "left_semi")
    return found.filter("vector is not null").unionByName(embed(again, model, id_col, text_col))


def sparse_weights(texts: DataFrame, id_col: str = "id", text_col: str = "text", least: float = 0.01, most: int = 128) -> DataFrame:
    """(id, tokens) of the words of each text by their part of it, those of ``least`` or more, the ``most`` heaviest, ties
    by the word."""
    words = F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = texts.select(F.col(id_col).alias("id"), words.alias("w")).filter("size(w) > 0")
    each = rows.select("id", F.size("w").alias("n"), F.explode("w").alias("token")).groupBy("id", "n", "token").agg(F.count(F.lit(1)).alias("c"))
    each = each.withColumn("weight", F.col("c") / F.col("n")).filter(F.col("weight") >= least)
    top = each.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("m"), "token"))), 1, most).alias("t"))
    return top.select("id", F.transform("t", lambda x: F.struct(x["token"].alias("token"), (-x["m"]).alias("weight"))).alias("tokens"))
