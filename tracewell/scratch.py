"""Intermediate tables in the folder that the whole cluster shares.

``spark.checkpoint.dir`` names it. Tables written there cut lineage and
outlive a lost executor. Only where the setting is missing (tests, notebooks in
local mode) a temporary folder stands in for it.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: The tables that the :func:`cut_alone` around has seen written; each call has its own list, other threads have none.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_CLEANING: dict[str, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Free shuffle files after each query, as long as any thread of the session is inside; the setting from before comes back with the last."""
    session = str(spark._jsparkSession.sessionUUID())
    with _LOCK:
        users, before = _CLEANING.setdefault(session, [0, spark.conf.get(_CLEANUP, "false")])
        _CLEANING[session][0] = users + 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            _CLEANING[session][0] -= 1
            if not _CLEANING[session][0]:
                spark.conf.set(_CLEANUP, _CLEANING.pop(session)[1])


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, with its schema kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):  # the table is all that is needed later, not the shuffle files behind it
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame | None) -> None:
    """Delete a table made by :func:`cut` once nothing will read it again."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def cut_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """:func:`cut` of what ``make`` returns, after which the tables that ``make`` wrote on its way are deleted.

    Tables of other threads are left alone, even those that ``make`` starts. Calls may be nested.
    """
    mine: list[str] = []
    before = _MADE.set(mine)
    try:
        out = cut(make(), name)
    finally:
        _MADE.reset(before)
    for path in mine:
        if path != out._scratch:
            _delete(spark, path)
    if before.old_value is not before.MISSING and before.old_value is not None:
        before.old_value.append(out._scratch)
    return out
