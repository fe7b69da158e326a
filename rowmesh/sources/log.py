"""Matrices that are written to: a log of sorted runs, merged when they are read and compacted level by level.

A batch of writes is one run. Reading is one scan of all runs and one aggregate that keeps the last write of each cell, so
a plan is as deep for ten thousand writes as for one. Once a level holds ``fanout`` runs they are merged into one run of
the next level. A version is a small file that names its runs; it is published last and never changed, so readers of older
versions, and readers during a write, see what they saw.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MatrixError, MatrixIndexError
from ..functions.kinds import COMPLEX, DOUBLE, KINDS
from ..matrix import SparseMatrix

FANOUT = 4


class MatrixLog:
    """A version of a log: ``levels`` lists the runs of each level, oldest first."""

    def __init__(self, spark: SparkSession, path: str, version: int, facts: dict):
        self.spark, self.path, self.version, self.facts = spark, path.rstrip("/"), version, facts
        self.shape, self.kind, self.levels = (facts["rows"], facts["cols"]), KINDS[facts["kind"]], facts["levels"]

    @classmethod
    def create(cls, m: SparseMatrix, path: str, fanout: int = FANOUT) -> MatrixLog:
        log = cls(m.df.sparkSession, path, -1, {"rows": m.rows(), "cols": m.cols(), "kind": m.kind.name, "fanout": fanout, "next": 0, "levels": [[]]})
        return log.append(m.df)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> MatrixLog:
        """The last version, or an earlier one."""
        fs, folder = _folder(spark, f"{path.rstrip('/')}/versions")
        if version is None:
            names = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()] if fs.exists(folder) else []
            if not names:
                raise MatrixError("there is no log")
            version = max(names)
        text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{path.rstrip('/')}/versions/{version}").collect())
        return cls(spark, path, version, json.loads(text))

    def _run(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        rows.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.parquet(f"{self.path}/{name}")
        return name

    def _publish(self, levels: list[list[str]], steps: int) -> MatrixLog:
        facts = self.facts | {"levels": levels, "next": self.facts["next"] + steps}
        fs, file = _folder(self.spark, f"{self.path}/versions/{self.version + 1}")
        out = fs.create(file, False)  # fails if somebody else has published this version
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()
        return MatrixLog(self.spark, self.path, self.version + 1, facts)

    def append(self, new: DataFrame, drop_zeros: bool = False) -> MatrixLog:
        """A version with all of ``new(row, col, val)`` written at once; its cells must be unique unless it has ``seq``,
        which tells the later write. A null deletes an entry, and with ``drop_zeros`` so does a zero."""
        outside = (F.col("row") < 0) | (F.col("row") >= self.shape[0]) | (F.col("col") < 0) | (F.col("col") >= self.shape[1])
        if not new.where(outside).isEmpty():
            raise MatrixIndexError
        value = F.col("val").cast(self.kind.type)
        if drop_zeros:
            value = F.when(~self.kind.is_zero(F.col("val")), value)
        seq = F.col("seq").cast("long") if "seq" in new.columns else F.lit(0).cast("long")
        rows = new.select("row", "col", value.alias("val"), F.lit(self.facts["next"]).cast("long").alias("batch"), seq.alias("seq"))
        levels = [list(x) for x in self.levels]
        levels[0].append(self._run(_last(rows)))
        return self._publish(levels, 1)._compacted()

    def write(self, entries: Iterable[tuple], drop_zeros: bool = False) -> MatrixLog:
        """A version with single writes (row, col, value) applied one after the other, as one batch."""
        wrap = (lambda v: (complex(v).real, complex(v).imag)) if self.kind is COMPLEX else (float if self.kind is DOUBLE else int)
        found = [(int(i), int(j), None if v is None else wrap(v), n) for n, (i, j, v) in enumerate(entries)]
        return self.append(self.spark.createDataFrame(found, f"row bigint, col bigint, val {self.kind.type}, seq bigint"), drop_zeros)

    def _compacted(self) -> MatrixLog:
        levels, full = [list(x) for x in self.levels], False
        for level in range(len(levels)):
            if len(levels[level]) < self.facts["fanout"]:
                continue
            full = True
            merged = _last(self._read(levels[level]))
            if not any(levels[level + 1 :]):  # nothing older is left that a deletion could hide
                merged = merged.where(F.col("val").isNotNull())
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(self._run(merged))
            levels[level] = []
        if not full:
            return self
        after = self._publish(levels, 0)
        return after._compacted()

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _read(self, runs: list[str]) -> DataFrame:
        schema = f"row bigint, col bigint, val {self.kind.type}, batch bigint, seq bigint"
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{run}" for run in runs))

    def matrix(self) -> SparseMatrix:
        """One scan of all runs and one aggregate, however many writes there were."""
        return SparseMatrix(_last(self._read(self.runs())).where(F.col("val").isNotNull()), *self.shape, self.kind)

    def get(self, i: int, j: int):
        """The entry's value, or None; the cell reaches the scan of every run."""
        if not (0 <= i < self.shape[0] and 0 <= j < self.shape[1]):
            raise MatrixIndexError
        got = _last(self._read(self.runs()).where((F.col("row") == i) & (F.col("col") == j))).first()
        return None if got is None else got["val"]

    def vacuum(self) -> None:
        """Delete the runs and versions that this version does not need; nothing may read older versions any more."""
        fs, folder = _folder(self.spark, self.path)
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("run-") and name not in self.runs():
                fs.delete(status.getPath(), True)
        for status in fs.listStatus(_folder(self.spark, f"{self.path}/versions")[1]):
            name = status.getPath().getName()
            if name.isdigit() and int(name) < self.version:
                fs.delete(status.getPath(), True)


def _last(rows: DataFrame) -> DataFrame:
    """The last write to each cell."""
    last = rows.groupBy("row", "col").agg(F.max_by(F.struct("val", "batch", "seq"), F.struct("batch", "seq")).alias("x"))
    return last.select("row", "col", "x.val", "x.batch", "x.seq")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder
