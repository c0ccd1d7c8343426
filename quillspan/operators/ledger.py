"""Processing only new or changed records: a work-item ledger over parquet.

An item is a (key, version) pair with an epoch, which counts how often the version of its key has changed, so
that a version that comes back (a revert) is an item of its own. The ledger is an append-only set of
transitions, one folder per step and run. A folder counts once its write was committed; a step that is
repeated under the same name returns the committed rows and writes nothing. The state of an item is derived:

* ``done``        a transition ``done`` whose fencing token was valid when it was written
* ``superseded``  a later epoch of its key is known
* ``leased``      the newest lease has not expired
* ``pending``     anything else that was enqueued

A lease carries a fencing token (a number that grows with each lease of the key). A worker that
lost its lease and writes late carries an old token: ``complete`` rejects it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.paths import plain_hash, plain_path

SCHEMA = "key string, version string, epoch int, state string, token long, worker string, at timestamp, expires timestamp"
ITEM = ["key", "version", "epoch"]


def latest_scans(scans: DataFrame) -> DataFrame:
    """(key, version) of what is on disk now: per path the scan with the newest seen_at among those
    with a hash or a deletion (ties: the larger scan_id); paths whose newest such scan is a deletion
    are left out. Null paths and rows without a seen_at are no sight of a file."""
    h = plain_hash(F.col("hash"))
    gone = F.coalesce(F.col("is_deleted"), F.lit(False))
    rows = scans.select(plain_path(F.col("path")).alias("key"), h.alias("version"), gone.alias("gone"), "seen_at", "scan_id")
    rows = rows.filter("key is not null and seen_at is not null and (gone or version is not null)")
    best = rows.groupBy("key").agg(F.max(F.struct("seen_at", "scan_id", "gone", "version")).alias("m"))
    return best.filter("not m.gone").select("key", "m.version")


def completed_versions(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, version, token) that the last successful run left per path.

    The token of a row is the run within whose time it was written; rows outside any ``ok`` run carry
    no valid token and are rejected. Runs are matched by the days they cover, an equi-join at any
    number of runs. A run without an end never ended well."""
    ok = runs.filter((F.lower(F.trim("status")) == "ok") & F.col("finished_at").isNotNull() & (F.col("finished_at") >= F.col("started_at")))
    days = ok.select(
        F.col("run_id").alias("token"), "started_at", "finished_at",
        F.explode(F.sequence(F.to_date("started_at"), F.to_date("finished_at"))).alias("day"),
    )
    rows = files.select(
        plain_path(F.col("path")).alias("key"), plain_hash(F.col("hash")).alias("version"), "indexed_at", F.to_date("indexed_at").alias("day")
    ).filter("key is not null and indexed_at is not null")
    met = rows.join(days, "day").filter("indexed_at between started_at and finished_at")
    best = met.groupBy("key").agg(F.max(F.struct("indexed_at", "token", "version")).alias("m"))
    return best.select("key", "m.version", "m.token")


def pending_items(current: DataFrame, done: DataFrame) -> DataFrame:
    """Items of ``current`` (key, version) that ``done`` doesn't hold in the same version."""
    d = done.select("key", F.col("version").alias("done_version"))
    return current.join(d, "key", "left").filter(~F.col("version").eqNullSafe(F.col("done_version"))).select("key", "version")


class WorkLedger:
    """Ledger in a shared folder: ``enqueue``, ``adopt``, ``lease``, ``complete``, ``state``.

    One coordinator calls it; workers only need their leases. Every step writes to
    ``<root>/<step>/<name>``, a path that depends on the caller's run name alone. A folder without the mark of
    a finished write is what a broken-off attempt left: it is never read, and the retry replaces it. A
    folder with the mark is never written again, so steps may be repeated at any time.

    Items with a null key or version are no work and left out; repeated rows count once; empty tables are
    no error; other columns are ignored."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _committed(self, step: str, name: str = "*") -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{step}/{name}/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return [x.getPath().getParent().toString() for x in found]

    def _read(self, step: str, name: str = "*") -> DataFrame:
        folders = self._committed(step, name)
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def _write(self, step: str, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """The rows of the step: those committed before, else what ``rows`` gives, written."""
        if not self._committed(step, name):
            typed = rows().selectExpr(*(f"cast({c} as {t}) {c}" for c, t in (x.split() for x in SCHEMA.split(", "))))
            typed.write.mode("overwrite").parquet(f"{self.root}/{step}/{name}")
        return self._read(step, name)

    def _items(self) -> DataFrame:
        """(key, version, epoch) of all that was enqueued or adopted."""
        return self._read("item").select(*ITEM).union(self._read("done").select(*ITEM)).distinct()

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the epoch of their item: ``known`` where the newest epoch of the key has that version, else
        ``next``."""
        items = self._items()
        last = items.groupBy("key").agg(F.max("epoch").alias("last"))
        newest = items.groupBy("key", "version").agg(F.max("epoch").alias("own"))
        at = rows.join(last, "key", "left").join(newest, ["key", "version"], "left")
        return at.withColumn("known", F.when(F.col("own") == F.col("last"), F.col("own"))).withColumn("next", F.coalesce(F.col("last") + 1, F.lit(0))).drop("last", "own")

    @staticmethod
    def _rows(df: DataFrame, state: str, now: datetime, token: object = 0, worker: object = None, expires: datetime | None = None) -> DataFrame:
        column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return df.select(*ITEM, F.lit(state).alias("state"), column(token).alias("token"), column(worker).alias("worker"), F.lit(now).alias("at"), F.lit(expires).alias("expires"))

    def enqueue(self, items: DataFrame, run: str, now: datetime) -> DataFrame:
        """Add the (key, version) items whose version is not the newest known of their key: new keys, changed
        versions and versions that came back. Older items of the key that nobody has done are superseded."""

        def rows() -> DataFrame:
            placed = self._placed(items.select("key", "version").dropna().distinct())
            return self._rows(placed.filter("known is null").withColumnRenamed("next", "epoch"), "pending", now)

        return self._write("item", run, rows)

    def adopt(self, done: DataFrame, run: str, now: datetime) -> DataFrame:
        """Record what earlier runs completed, (key, version, token), as done; rows without a version or a valid
        token are rejected, of several versions of a key the one of the greatest token counts, and what was adopted
        before is no news."""

        def rows() -> DataFrame:
            good = done.select("key", "version", "token").dropna()
            best = good.groupBy("key").agg(F.max(F.struct("token", "version")).alias("m")).select("key", "m.version", "m.token")
            known = self._read("done").select("key", "version", "token").distinct()
            placed = self._placed(best.join(known, ["key", "version", "token"], "left_anti")).withColumn("epoch", F.coalesce("known", "next"))
            return self._rows(placed, "done", now, F.col("token"))

        return self._write("done", run, rows)

    def state(self, now: datetime) -> DataFrame:
        """(key, version, epoch, state, token, worker) of each item at ``now``; token is that of the newest lease."""
        items = self._items()
        last = items.groupBy("key").agg(F.max("epoch").alias("last"))
        newest = self._read("lease").groupBy(*ITEM).agg(F.max(F.struct("token", "worker", "expires")).alias("l"))
        done = self._read("done").groupBy(*ITEM).agg(F.max("token").alias("done_token"))
        every = items.join(last, "key").join(newest, ITEM, "left").join(done, ITEM, "left")
        state = (
            F.when(F.col("done_token").isNotNull(), "done").when(F.col("epoch") < F.col("last"), "superseded")
            .when(F.col("l.expires") > F.lit(now), "leased").otherwise("pending")
        )
        return every.select(*ITEM, state.alias("state"), F.coalesce("l.token", F.lit(0)).alias("token"), "l.worker")

    def lease(self, worker: str, run: str, now: datetime, until: datetime, limit: int | None = None) -> DataFrame:
        """Lease pending items (all, or ``limit`` in key order) with tokens one above the newest of their key."""

        def rows() -> DataFrame:
            free = self.state(now).filter("state = 'pending'").select(*ITEM)
            if limit is not None:
                free = free.orderBy(*ITEM).limit(limit)
            top = self._read("lease").groupBy("key").agg(F.max("token").alias("top"))
            return self._rows(free.join(top, "key", "left"), "leased", now, F.coalesce("top", F.lit(0)) + 1, worker, until)

        return self._write("lease", run, rows)

    def complete(self, leases: DataFrame, run: str, now: datetime) -> DataFrame:
        """Mark leases done. A lease that is not the newest of its item is stale and rejected, as is one whose
        item is done already; the accepted rows are returned."""
        lease = [*ITEM, "token", "worker"]

        def rows() -> DataFrame:
            newest = self.state(now).filter("state <> 'done'").select(*lease)
            return self._rows(leases.select(*lease).distinct().join(newest, lease, "left_semi"), "done", now, F.col("token"), F.col("worker"))

        return self._write("done", run, rows)


def run_once(ledger: WorkLedger, current: DataFrame, earlier: DataFrame, run: str, now: datetime, work: Callable[[DataFrame], object] | None = None) -> DataFrame:
    """One run over what is new or changed: takes over the versions that earlier runs completed (key, version,
    token), enqueues what is there now (key, version), leases all that is pending, hands the leases to ``work``,
    and returns those it could complete. A run that broke off is repeated under the same name and goes on where
    it stopped; under another name it gets the same items once the leases have expired."""
    ledger.adopt(earlier, f"{run}-earlier", now)
    ledger.enqueue(current, f"{run}-current", now)
    leases = ledger.lease(run, run, now, now + timedelta(hours=1))
    if work is not None:
        work(leases)
    return ledger.complete(leases, run, now)
