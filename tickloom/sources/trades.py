"""Trade tapes: gzip CSV archives, Parquet tapes, predicates, and the trade view of an event table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.timeaxis import iso_ms
from ..functions.values import normal_side
from .scratch import file_system

#: Names of archives: SYMBOL-2024-05.csv.gz or SYMBOL_2024-05-31.csv.gz.
_NAME = r"([^/]+?)(?:-\d{4}-\d{2}|_\d{4}-\d{2}-\d{2})\.csv\.gz$"


def symbol_of(path: str) -> str:
    found = re.search(_NAME, path)
    if not found:
        raise ValueError(f"no symbol in the file name {path!r}")
    return found[1]


def archives(spark: SparkSession, folder: str, only: Iterable[str] = (), done: dict | None = None) -> list[str]:
    """Archives of a folder on any file system, in name order, of some symbols if given, without those the manifest holds."""
    files, at = file_system(spark, folder)
    only, done = set(only), done or {}
    names = sorted(x.getPath().getName() for x in files.listStatus(at) if x.isFile())
    names = [n for n in names if n.endswith(".csv.gz") and n not in done]
    return [f"{folder.rstrip('/')}/{n}" for n in names if not only or symbol_of(n) in only]


def read_archives(spark: SparkSession, paths: list[str], start_ms: int | None = None, keep_file: bool = False) -> DataFrame:
    """Trades of archives with the columns id, ms, price, quantity, side; the first line of a file is its header.

    Lines with fewer than five fields are left out, further fields are not looked at. The instant may be a
    decimal number; a price or quantity that is no number fails the query. gzip can't be split: a file is a task.
    """
    if not paths:
        return spark.createDataFrame([], schema.TRADES)
    # A separator that no line holds gives whole lines, and the reader drops each file's header.
    reader = spark.read.schema("line string").option("header", True).option("enforceSchema", True).option("sep", "\x01").option("quote", "")
    parts = F.split("line", ",")
    lines = reader.csv(paths).where(F.size(parts) >= 5).select(F.col("_metadata.file_name").alias("file"), *[F.trim(parts[i]).alias(f"f{i}") for i in range(5)])
    ms = F.floor(F.col("f1").cast("double")).cast("long")
    if start_ms is not None:
        lines = lines.where(ms >= start_ms)
    return lines.select(
        F.regexp_extract("file", _NAME, 1).alias("symbol"), F.timestamp_millis(ms).alias("exchange_ts"), F.col("f0").alias("trade_id"),
        F.col("f2").cast("double").alias("price"), F.col("f3").cast("double").alias("quantity"), normal_side(F.col("f4")).alias("side"),
        *([F.col("file")] if keep_file else []),
    )


def file_bounds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows, first and last millisecond and their text of each archive."""
    ms = F.unix_millis("exchange_ts")
    trades = read_archives(spark, paths, keep_file=True)
    out = trades.groupBy("file").agg(F.count("*").alias("n_rows"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))
    return out.withColumns({name: iso_ms(F.timestamp_millis(c)) for name, c in (("first", "min_ms"), ("last", "max_ms"))})


def load_manifest(spark: SparkSession, path: str) -> dict:
    """Which archives are loaded, by name; empty if there is no manifest yet."""
    files, at = file_system(spark, path)
    if not files.exists(at):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def save_manifest(spark: SparkSession, path: str, done: dict) -> None:
    """Replaces the manifest in one step, where the file system can: the new one is written beside it and renamed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files, fresh = file_system(spark, f"{path}.tmp")
    out = files.create(fresh, True)
    out.write(json.dumps(done, indent=2, sort_keys=True).encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, jvm.org.apache.hadoop.fs.Path(path), options)


def load_new(spark: SparkSession, folder: str, manifest: str, only: Iterable[str] = (), force: bool = False, start_ms: int | None = None) -> tuple[DataFrame, dict]:
    """Trades of the archives that the manifest doesn't hold (or of all), and the manifest with them."""
    done = load_manifest(spark, manifest)
    paths = archives(spark, folder, only, None if force else done)
    found = {r.file: {"first": r.first, "last": r.last, "rows": r.n_rows} for r in file_bounds(spark, paths).select("file", "first", "last", "n_rows").toLocalIterator()} if paths else {}
    return read_archives(spark, paths, start_ms), done | found


def in_range(symbol: str | None = None, start: datetime | None = None, end: datetime | None = None, ts: str = "exchange_ts", end_inclusive: bool = False) -> Column:
    """Predicate for a symbol and [start, end), or [start, end]."""
    out = F.lit(True)
    if symbol is not None:
        out = out & (F.col("symbol") == symbol)
    if start is not None:
        out = out & (F.col(ts) >= F.lit(start))
    if end is not None:
        out = out & ((F.col(ts) <= F.lit(end)) if end_inclusive else (F.col(ts) < F.lit(end)))
    return out


def scan(trades: DataFrame, symbol: str | None = None, start: datetime | None = None, end: datetime | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a tape in a range; filter and columns reach the Parquet scan."""
    return trades.where(in_range(symbol, start, end)).select(*(columns or trades.columns))


def scan_bars(bars: DataFrame, symbol: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Bars of a symbol in a range, in time order."""
    return bars.where(in_range(symbol, start, end)).orderBy("exchange_ts")


def bounds(trades: DataFrame, ts: str = "exchange_ts") -> DataFrame:
    """First and last instant and the number of rows; nulls and 0 for an empty tape."""
    return trades.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_rows"))


def range_bounds(trades: DataFrame, symbol: str, start: datetime, end: datetime, ts: str = "exchange_ts") -> tuple[datetime, datetime]:
    """First and last instant of a symbol within [start, end]; an empty range is an error. The range reaches the scan."""
    found = bounds(trades.where(in_range(symbol, start, end, ts, end_inclusive=True)), ts).first()
    if not found.n_rows:
        raise ValueError(f"no rows of {symbol} from {start} to {end}")
    return found.first_ts, found.last_ts


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a tape: one real minute is one second, two symbols, quantities from the event's properties."""
    return trades_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def trades_of(events: DataFrame) -> DataFrame:
    ms = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) * 1000).cast("long")
    side = F.when(F.col("event_type").isin("purchase", "signup"), "Buy").when(F.col("event_type").isin("view", "error"), "sell").otherwise("other")
    return events.select(
        F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string")).alias("symbol"), ms.alias("ms"), F.col("event_id").alias("trade_id"),
        F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("long") + 1).alias("quantity"), side.alias("side"),
    )
