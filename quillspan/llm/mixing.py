"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.session import materialize

GRID = 64
ROUNDS = 6
#: Target sources: a table of more is refused. Their rates, and GRID sums of each, are all that reaches the driver.
MOST_SOURCES = 10_000


def plain_source(c: Column) -> Column:
    """Lower case, no surrounding blanks, blanks and hyphens as underscores; blank is null."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.when(s != "", s)


def uses(u: np.ndarray, rate: np.ndarray, cap: int) -> np.ndarray:
    """Quantile of u of the Poisson distribution of a mean rate, at most ``cap``; u and rate as arrays that fit together.
    A rate over 700 counts as infinite."""
    endless = rate > 700
    rate = np.where(endless, 0.0, rate)
    term = np.exp(-rate)
    cdf = term.copy()
    out = np.zeros(np.broadcast_shapes(u.shape, rate.shape), np.int64)
    for k in range(1, cap + 1):
        out += cdf < u
        term = term * rate / k
        cdf = cdf + term
    return np.where(endless, cap, out)


def _rate(y: np.ndarray) -> np.ndarray:
    """The rate of a number in [0, 1]; 1 is a rate at which every document is used up to its cap."""
    return np.where(y < 1, y / np.maximum(1 - y, 1e-300), np.inf)


class SourceMix:
    """A selection of documents in which each source has its target share of all tokens.

    ``sizes``: (id, source, size) one row per document; ``targets``: (source, target_share, max_repeats).
    Each document has a number u in (0, 1) from a hash of the seed and its id, and is used as often as
    the Poisson quantile of u at its source's mean rate, at most max_repeats times. The tokens so drawn grow
    step by step with the rate; the rate at which they come nearest to the target is found by counting them at
    GRID rates at once, each round within the interval of the round before. Documents are only repeated in the
    result.

    ``total`` is the size of the selection; by default, and at most, the largest at which every source
    can have its share. Documents of no target source, null ids and sizes of 0 or null are never used;
    a target source without any document is reported with share 0 and the others keep their
    proportions; shares needn't sum to 1; max_repeats below 1 is a source without documents. An empty
    table gives an empty selection. Sources are compared in plain spelling; a repeated id is an error
    of the input and is used once with its largest size."""

    def __init__(self, sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42) -> None:
        self.seed = seed
        goal = targets.select(plain_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
        goal = goal.filter("source is not null and share > 0").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
        rows = goal.limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} target sources")
        self.goal = {r["source"]: (r["share"], max(r["cap"] or 0, 0)) for r in rows}
        self.caps = {s: c for s, (_, c) in self.goal.items() if c > 0}
        docs = sizes.select(F.col("id").cast("long").alias("id"), plain_source(F.col("source")).alias("source"), F.col("size").cast("long").alias("size"))
        docs = docs.filter(F.col("id").isNotNull() & (F.col("size") > 0))
        docs = docs.join(F.broadcast(goal.filter("cap > 0").select("source")), "source", "left_semi")  # at most MOST_SOURCES
        docs = docs.groupBy("id").agg(F.max(F.struct("size", "source")).alias("m")).select("id", "m.source", "m.size")
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 12).cast("double") + 0.5) / F.lit(float(2**52))
        self.docs = materialize(docs.withColumn("u", u), "mix-documents")
        self.available = {r["source"]: r["t"] * self.caps[r["source"]] for r in self.docs.groupBy("source").agg(F.sum("size").alias("t")).collect()}
        live = {s: self.goal[s][0] for s in self.available}
        weight = sum(live.values())
        most = min((self.available[s] * weight / w for s, w in live.items()), default=0.0)
        self.total = most if total is None else min(total, most)
        self.want = {s: self.total * w / weight for s, w in live.items()}
        self.cut = self._cuts()

    def _drawn(self, grid: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Per source the tokens drawn at each place of its grid; sums are made where the documents lie."""
        caps = self.caps

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                source = np.asarray(b.column(0).to_pylist(), dtype=object)
                size, u = b.column(1).to_numpy(), b.column(2).to_numpy()
                for s in set(source):
                    own = source == s
                    n = uses(u[own][:, None], _rate(grid[s])[None, :], caps[s])
                    sums[s] = sums.get(s, 0) + (n * size[own][:, None]).sum(0)
            at = [(s, i, int(t)) for s, v in sums.items() for i, t in enumerate(v)]
            cols = list(zip(*at, strict=True)) if at else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["source", "at", "t"])

        out = {s: np.zeros(len(g), np.int64) for s, g in grid.items()}
        part = self.docs.select("source", "size", "u").mapInArrow(run, "source string, at int, t long")
        for r in part.groupBy("source", "at").agg(F.sum("t").alias("t")).collect():
            out[r["source"]][r["at"]] = r["t"]
        return out

    def _cuts(self) -> dict[str, float]:
        """Per source its rate, as a number in [0, 1]."""
        low, high = dict.fromkeys(self.want, 0.0), dict.fromkeys(self.want, 1.0)
        below, above = dict.fromkeys(self.want, 0), dict(self.available)
        for _ in range(ROUNDS if low else 0):
            grid = {s: np.linspace(low[s], high[s], GRID + 1)[1:-1] for s in low}
            for s, drawn in self._drawn(grid).items():
                n = int(np.searchsorted(drawn, self.want[s], side="right"))  # drawn tokens grow along the grid
                if n > 0:
                    low[s], below[s] = float(grid[s][n - 1]), int(drawn[n - 1])
                if n < len(drawn):
                    high[s], above[s] = float(grid[s][n]), int(drawn[n])
        return {s: low[s] if self.want[s] - below[s] <= above[s] - self.want[s] else high[s] for s in low}

    def selection(self) -> DataFrame:
        """(id, source, size, copy, position) of each use of a document; position is a hash by which the
        selection is shuffled: rows of one id get positions far apart."""
        cut, caps = self.cut, self.caps

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                source = b.column(1).to_pylist()
                u, n = b.column(3).to_numpy(), np.zeros(b.num_rows, np.int64)
                at = np.asarray(source, dtype=object)
                for s in set(source):
                    own = at == s
                    n[own] = uses(u[own], _rate(np.array([cut[s]])), caps[s])
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n.astype(np.int32))], ["id", "source", "size", "n"])

        used = self.docs.mapInArrow(run, "id long, source string, size long, n int").filter("n > 0")
        used = used.select("id", "source", "size", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
        return used.withColumn("position", F.xxhash64(F.lit(self.seed + 1), "id", "copy"))

    def shuffled(self, partitions: int | None = None) -> DataFrame:
        """The selection in global random order: range-partitioned and sorted by position."""
        s = self.selection()
        return (s.repartitionByRange(partitions, "position") if partitions else s.repartitionByRange("position")).sortWithinPartitions("position", "id", "copy")

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, documents, uses, most_uses, rate) per target source."""
        spark = self.docs.sparkSession
        per = self.selection().groupBy("source", "id").agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("c"))
        got = {r["source"]: r for r in per.groupBy("source").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("d"), F.sum("c").alias("u"), F.max("c").alias("m")).collect()}
        every = sum(r["t"] for r in got.values())
        weight = sum(w for w, _ in self.goal.values())
        rows = []
        for s, (w, _) in sorted(self.goal.items()):
            t, d, u, m = (got[s]["t"], got[s]["d"], got[s]["u"], got[s]["m"]) if s in got else (0, 0, 0, 0)
            y = self.cut.get(s, 0.0)
            rows.append((s, w / weight, t / every if every else 0.0, t, d, u, m, y / (1 - y) if y < 1 else float("inf")))
        schema = T.StructType.fromDDL("source string, target_share double, actual_share double, tokens long, documents long, uses long, most_uses long, rate double")
        return spark.createDataFrame(rows, schema)
