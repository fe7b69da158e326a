"""Folders that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import SparkSession

_current: ContextVar[Scope | None] = ContextVar("rowmesh_scope", default=None)


class Scope:
    """The shared folders and tables of one run of an operator: what is handed out inside ``with Scope(spark)``, in this
    thread. No other run's are ever touched.

    A scope that ends well hands what it still has to the scope around it, as a lazy result may read it; without one it
    stays for the reader of the result. A scope that ends with an error deletes all of it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def __enter__(self) -> Scope:
        self._token = _current.set(self)
        return self

    def __exit__(self, failed, error, trace) -> None:
        _current.reset(self._token)
        if failed:
            self.discard()
        elif outer := _current.get():
            outer.paths += self.paths
            outer.tables += self.tables

    def discard(self, keep: int = 0) -> None:
        """Drop the tables and delete the folders, but for the last ``keep`` of these; nothing may read them any more."""
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        gone = self.paths[: len(self.paths) - keep]
        del self.paths[: len(self.paths) - keep]
        for path in map(self.spark._jvm.org.apache.hadoop.fs.Path, gone):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, in the scope of the thread if there is one. Where that setting is
    missing, a temporary one is taken on a local master, whose tasks run in this very process; on a cluster nobody else
    would see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "rowmesh-shared")
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if scope := _current.get():
        scope.paths.append(path)
    return path


def shared_table(path: str) -> str:
    """The name of a table that is stored at ``path``, in the scope of the thread if there is one."""
    name = path.rpartition("/")[2].replace("-", "_")
    if scope := _current.get():
        scope.tables.append(name)
    return name
