"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "packetloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here relies on: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Call sites on every expression cost more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    fallback = tempfile.mkdtemp(prefix="packetloom-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


class _Scopes:
    """Names of the scopes that are open, outermost first. Functions that travel to executors may name it; there none is open."""

    def __init__(self) -> None:
        self._names: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())
        self.get, self.set, self.reset = self._names.get, self._names.set, self._names.reset

    def __reduce__(self) -> tuple:
        # A context variable cannot be pickled.
        return _Scopes, ()


_SCOPES = _Scopes()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder and the innermost open scope, for one written table or one stream checkpoint."""
    return "/".join([_run_dir(spark), *_SCOPES.get(), uuid.uuid4().hex, name])


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A folder below the innermost scope for all that is written to the shared folder inside; it stays until ``remove_folder``."""
    names = (*_SCOPES.get(), f"scope-{uuid.uuid4().hex}")
    token = _SCOPES.set(names)
    try:
        yield "/".join([_run_dir(spark), *names])
    finally:
        _SCOPES.reset(token)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """All that is written to the shared folder inside is removed at the end, but for what the yielded function is given to keep.

    Nothing made inside may be used afterwards unless it was kept: kept rows are written to the scope around, and read from there.
    """
    outer = _SCOPES.get()

    def keep(df: DataFrame) -> DataFrame:
        token = _SCOPES.set(outer)
        try:
            return settled(df)
        finally:
            _SCOPES.reset(token)

    with scratch_folder(spark) as folder:
        try:
            yield keep
        finally:
            remove_folder(spark, folder)


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/packetloom/{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> None:
    """Removes all that this application has written below the shared folder. Tables read from there are gone with it."""
    remove_folder(spark, _run_dir(spark))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes what was written below a folder of the shared one. Tables read from there are gone with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_file(path: str):
    """A seekable file from the path that a listing gave, on any file system Arrow knows; for tasks too."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def settled(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, so later passes read only the columns they need from there.

    The table stays until the scope that it was written in ends, or until ``remove_scratch`` is called.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
