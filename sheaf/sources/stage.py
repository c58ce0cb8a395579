"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a temporary folder is taken, but only by a session whose executors are in
    the driver (master ``local``); on a cluster an error says what to set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="sheaf-"))
    return _own_root[0]


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; Hadoop's file system removes it when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, label: str, plain: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor, unlike a local checkpoint. Spark decides
    by the size of the files whether the driver broadcasts a table: a narrow one with few distinct
    values, which takes a small part of its rows' size, is to be written ``plain``, without
    dictionaries and compression."""
    path = shared_path(df.sparkSession, label)
    writer = df.write.option("compression", "none").option("parquet.enable.dictionary", "false") if plain else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
