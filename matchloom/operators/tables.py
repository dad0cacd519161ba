"""Tables in the folder that driver and executors share, between steps of an operator.

A written table cuts lineage like a checkpoint, survives lost executors and gives the planner its true size.
The folder is the session's ``spark.checkpoint.dir``; only a local session without that
setting (as in tests) gets a temporary folder of its own.

Operators drop tables that nothing reads any more.  Those that a returned DataFrame still reads go
with the ``scope`` around it, once what it gives is written, or else when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="matchloom-")
    return _own[key]


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def reserved(spark: SparkSession, name: str) -> str:
    """A new path of the shared folder; what is written there goes with its scope or the application."""
    path = f"{folder(spark)}/matchloom/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a table of the shared folder, and its path for ``drop``."""
    spark = rows.sparkSession
    path = reserved(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], tuple[DataFrame, str]]]:
    """Drops at its end the tables written inside, but for those written by the function that it gives."""
    own: list[str] = []
    _scopes.append(own)

    def keep(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
        table, path = written(rows, name)
        own.remove(path)
        if outer := _scopes[:-1]:
            outer[-1].append(path)
        return table, path

    try:
        yield keep
    finally:
        _scopes.pop()
        drop(spark, *own)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the table's files."""
    files, where = _file_system(spark, path)
    return files.getContentSummary(where).getLength()


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        files, where = _file_system(spark, path)
        files.delete(where, True)
        files.cancelDeleteOnExit(where)
