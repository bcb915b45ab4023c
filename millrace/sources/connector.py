"""Storage connectors: where a session finds tables that its own database lacks."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import write


class Connector(Protocol):
    """What a store of tables must offer. Reading is lazy, so filters and columns reach the store."""

    def tables(self) -> list[str]: ...

    def read(self, name: str) -> DataFrame | None: ...

    def create(self, name: str, rows: DataFrame) -> None: ...

    def drop(self, name: str) -> None: ...


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class FolderConnector:
    """A folder of <table>.<kind> in any file system that Spark reads, in one of Spark's file formats."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "parquet") -> None:
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}.{self.kind}"

    def tables(self) -> list[str]:
        fs, path = _folder(self.spark, self.folder)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n.removesuffix(f".{self.kind}") for n in names if n.endswith(f".{self.kind}"))

    def read(self, name: str) -> DataFrame | None:
        fs, path = _folder(self.spark, self._path(name))
        return self.spark.read.format(self.kind).load(self._path(name)) if fs.exists(path) else None

    def create(self, name: str, rows: DataFrame) -> None:
        write(rows, self._path(name), self.kind)

    def drop(self, name: str) -> None:
        fs, path = _folder(self.spark, self._path(name))
        fs.delete(path, True)
