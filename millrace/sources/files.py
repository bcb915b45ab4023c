"""Readers and writers, and the shared folder for table versions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any of Spark's formats: parquet, orc, csv, json, text, jdbc, ..."""
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options) -> None:
    w = df.write.format(kind).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a temporary folder only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="millrace-tables-")
    return _OWN["dir"]
