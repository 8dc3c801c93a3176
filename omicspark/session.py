"""Session-level settings shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("omicspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


class SharedFolderMissing(RuntimeError):
    """No folder is named that all executors can reach."""


def runs_on_one_machine(master: str) -> bool:
    """True for masters whose executors are threads of the driver."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset and
    the session runs on one machine, as in tests, a folder of our own is made. On
    a cluster a machine's own folder would hold a part of each table only, so an
    unset folder is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not runs_on_one_machine(spark.sparkContext.master):
            raise SharedFolderMissing("set spark.checkpoint.dir to a folder that every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="omicspark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table survives the loss of executors, its file sizes tell the planner
    what is small enough to broadcast, and nothing upstream runs again.
    """
    path = fresh_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for one written table."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for kept in _open_stages:
        kept.append(path)
    return path


_open_stages: list[list[str]] = []


@contextmanager
def removed_stages(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, the tables that were written to the shared folder inside it.

    Results must be written or collected before the end. Without it, written
    tables stay until the folder is emptied.
    """
    paths: list[str] = []
    _open_stages.append(paths)
    try:
        yield paths
    finally:
        _open_stages.remove(paths)
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
