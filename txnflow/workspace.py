"""Where jobs put tables they need only while they run, and when these are removed."""

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Codec of stored tables: smaller than Spark's default, and they are read by Spark alone.
COMPRESSION = "zstd"

_local_roots: dict[str, str] = {}
_stored_at: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


class JobScope:
    """The stored tables of a job; see :func:`job_scope`."""

    def __init__(self, spark: SparkSession, outer: "JobScope | None"):
        self.spark, self.outer = spark, outer
        self.paths: dict[str, None] = {}

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Store ``df`` for whoever called the job: in the scope around this one, or for good without one."""
        return _store(df, name, self.outer)

    def close(self) -> None:
        for path in list(self.paths):
            self.remove(path)

    def remove(self, path: str) -> None:
        delete(self.spark, path)
        self.paths.pop(path, None)


_scope: ContextVar[JobScope | None] = ContextVar("scope", default=None)


@contextmanager
def job_scope(spark: SparkSession) -> Iterator[JobScope]:
    """Owns what :func:`materialize` stores inside the block and removes it when the block ends, also by a failure.

    A DataFrame that is used after the block must not read from such a table: store it with ``keep``. Scopes may be nested. A
    thread that Spark starts, such as that of a stream's batches, has no scope until it opens one.
    """
    scope = JobScope(spark, _scope.get())
    token = _scope.set(scope)
    try:
        yield scope
    finally:
        _scope.reset(token)
        scope.close()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder and what it holds; nothing happens if it isn't there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset, a session within one process gets a temporary folder; any other is refused, since a
    folder on one machine would be invisible to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses, owned by the scope if there is one."""
    return _new_path(spark, name, _scope.get())


def _new_path(spark: SparkSession, name: str, scope: JobScope | None) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid4().hex}"
    if scope is not None:
        scope.paths[path] = None
    return path


def _store(df: DataFrame, name: str, scope: JobScope | None) -> DataFrame:
    path = _new_path(df.sparkSession, name, scope)
    df.write.parquet(path, compression=COMPRESSION)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored_at[stored] = path
    return stored


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the stored table.

    Cuts the lineage: later passes, and tasks repeated after an executor is lost, read files instead of
    computing ``df`` again. The table belongs to the scope around the call; without one it stays until the folder expires.
    """
    return _store(df, name, _scope.get())


def path_of(stored: DataFrame) -> str | None:
    """Where a table that :func:`materialize` or ``keep`` returned is, or was; None for any other, or a released one."""
    return _stored_at.get(stored)


def release(*stored: DataFrame) -> None:
    """Remove tables that :func:`materialize` returned, once their last reader has been stored or counted.

    Nothing that is read later may depend on them, or a task repeated after a lost executor would fail.
    """
    for df in stored:
        path = _stored_at.pop(df, None)
        if path is None:
            continue
        delete(df.sparkSession, path)
        scope = _scope.get()
        while scope is not None:
            scope.paths.pop(path, None)
            scope = scope.outer
