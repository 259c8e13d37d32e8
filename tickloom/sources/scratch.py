"""Written intermediate tables: what several branches of a plan read is computed once and survives lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only for a local master without that setting.

    It goes when the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    files, at = file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def file_system(spark: SparkSession, path: str):
    """The file system that holds a path, and the path, as Spark's own readers see them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)


def drop(df: DataFrame) -> None:
    """Deletes what ``kept`` wrote; results that read it must be written by then."""
    delete(df.sparkSession, df.scratch_path)


def kept(df: DataFrame, label: str = "kept") -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession, label)}/rows"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out
