"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LOCAL = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}  # for one machine; a cluster sets its own


def build(app: str = "textverk", master: str | None = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` keys use ``__`` for dots.
    Without ``master`` the cluster's own settings hold, sizes included."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
        for k, v in LOCAL.items():
            b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="textverk-"), "textverk.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("textverk", os.path.relpath(full, top)))
    sc.addPyFile(at)  # Spark copies it to every executor


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where none is set, a local folder is made if executors run in this machine's one process;
    on a cluster that is an error, as tables would be scattered over the executors' disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="textverk-")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_scopes: list[list[str]] = []
_own: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver ends."""
    at = f"{shared_dir(spark)}/textverk-{spark.sparkContext.applicationId}"
    if at not in _own:
        _own.add(at)
        path, fs = _hadoop(spark, at)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return at


def _hadoop(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table survives the loss of executors, unlike a local checkpoint. It lasts until the
    ``scope`` it was made in ends, or else as long as the application.
    """
    at = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(at)
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end; results must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for at in _scopes.pop():
            path, fs = _hadoop(spark, at)
            fs.delete(path, True)


SMALL = 100_000  # rows up to which a side table is broadcast


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is; counting
    stops beyond that number."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
