"""Session construction and the shared-folder helper used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quillspan") -> SparkSession:
    """A local session with the settings the engine is tested with (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, a temporary folder only where
    that is unset and all executors are in this process (tests); on a cluster without it this is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete all that ``materialize`` wrote in this process; only when no result is to be read any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    n = 0
    while _written:
        path = hadoop.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by ``release``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a DataFrame once to the shared folder and read it back.

    Cuts lineage for plans that use a result several times; the files outlive lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once, unless they have it on their path."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = shared_dir(spark).removeprefix("file://")
    place = Path(folder if folder.startswith("/") and os.path.isdir(folder) else tempfile.mkdtemp(prefix="quillspan-"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(place / f"quillspan-{app}"), "zip", root, "quillspan"))
    _shipped.add(app)
