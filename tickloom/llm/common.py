"""Shared pieces of the text operators: tables, scratch storage, word tables of a batch."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A-Z to a-z over UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds the bytes of a batch handed to Python, so that long texts can't fill a worker; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = int(re.match(r"-?\d+", spark.conf.get(key))[0])
    if given <= 0 or given > size:
        spark.conf.set(key, str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only for a local master without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


class Scratch:
    """Written intermediate tables. They cut lineage, so a lost executor costs at most one step's tasks.

    What isn't dropped before is deleted when the application ends: results read from it until then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}", 0

    def _at(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def folder(self) -> str:
        """A path below the scratch folder that doesn't exist yet."""
        if not self.n:
            files, base = self._at(self.base)
            files.mkdirs(base)
            files.deleteOnExit(base)
        self.n += 1
        return f"{self.base}/{self.n - 1}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        files, path = self._at(df.scratch_path)
        files.delete(path, True)

    def clear(self) -> None:
        files, base = self._at(self.base)
        files.delete(base, True)


def numbered(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """rid (unique long, in the order of doc_id), doc_id, text, and the row's other columns as a struct.

    A unique integer id is its own number; otherwise rows are numbered in the order of id (null ids last) and of the
    text's hash. Rows equal in both are dealt to as many ranges as they fill.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    if rows.schema["doc_id"].dataType == LongType():
        ids = docs.select(F.col(doc_id).alias("i")).groupBy("i").agg(F.count("*").alias("n"))
        if not ids.where("n > 1 or i is null").limit(1).count():
            return rows.withColumn("rid", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("turn")]
    ranged = rows.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.keep(ranged.drop("turn").withColumn("rid", F.monotonically_increasing_id()))


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose texts hold about ``limit`` bytes together (one row at least)."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, stop
        start = stop


def raw(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return texts.cast(pa.binary()).to_pylist()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A batch function that hands memory back when it ends: Python workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
