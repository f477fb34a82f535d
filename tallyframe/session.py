"""Session settings for local runs and the one place that looks up the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


SCOPE_PREFIX = "tallyframe-scope-"
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def local_session(cores: int | None = None, app: str = "tallyframe") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster the shared folder must
    be configured, since executors can be lost and their local disks with them. Inside a ``work_scope``
    it is the folder of that scope.
    """
    if _SCOPE.get() is not None:
        return _SCOPE.get()
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = context.getCheckpointDir() or tempfile.mkdtemp(prefix="tallyframe-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _filesystem(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all intermediates and checkpoints of the block, removed when the block ends.

    It lies in the shared checkpoint folder and goes after a failure too. Results are lazy, so whoever reads them last
    ends the block: collect or write them elsewhere inside it. Scopes may be nested; the inner one goes first.
    """
    context = spark.sparkContext
    folder = f"{checkpoint_folder(spark).rstrip('/')}/{SCOPE_PREFIX}{context.applicationId}-{uuid.uuid4().hex}"
    system, path = _filesystem(spark, folder)
    system.mkdirs(path)
    before = context.getCheckpointDir()
    context.setCheckpointDir(folder)
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        # The session's own directory again: Spark makes a subfolder with each call, so its parent is named.
        context.setCheckpointDir(os.path.dirname(before.rstrip("/")))
        system.delete(path, True)
        held = spark._jvm.org.apache.hadoop.fs.Path(before)
        if system.exists(held) and not len(system.listStatus(held)):
            system.delete(held, False)


def remove_abandoned(spark: SparkSession, hours: float) -> list[str]:
    """Remove scopes that a killed run left behind: those of other applications unchanged for so many hours.

    ``hours`` must be longer than any job may run; returns the folders removed.
    """
    if hours <= 0:
        raise ValueError("a running application's scope could be removed")
    system, path = _filesystem(spark, checkpoint_folder(spark).split(f"/{SCOPE_PREFIX}")[0])
    latest = (time.time() - hours * 3600) * 1000
    removed = []
    for status in system.listStatus(path):
        name = status.getPath().getName()
        own = name.startswith(f"{SCOPE_PREFIX}{spark.sparkContext.applicationId}-")
        if status.isDirectory() and name.startswith(SCOPE_PREFIX) and not own and _changed(system, status) < latest:
            system.delete(status.getPath(), True)
            removed.append(status.getPath().toString())
    return removed


def _changed(system, status) -> int:
    """Last change of a scope or of what lies directly in it, in milliseconds."""
    return max([status.getModificationTime(), *[s.getModificationTime() for s in system.listStatus(status.getPath())]])
