"""Tables of the engine in a catalog: creation, existence, appending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

_PARTITIONS = {"trades": ["month"], "book_messages": ["month"], "features": ["feature_name"]}


def create(spark: SparkSession, database: str | None = None) -> None:
    """Creates every table that isn't there: Parquet, zstd, tapes by month, the feature store by name."""
    for name, columns in schema.ALL.items():
        extra = ", month string" if "month" in _PARTITIONS.get(name, []) else ""
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + extra
        by = f" PARTITIONED BY ({', '.join(_PARTITIONS[name])})" if name in _PARTITIONS else ""
        full = f"`{database}`.`{name}`" if database else f"`{name}`"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({ddl}) USING parquet OPTIONS (compression 'zstd'){by}")


def require(spark: SparkSession, names: list[str]) -> None:
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise LookupError(f"tables missing: {missing}")


def append_trades(trades: DataFrame, table: str) -> None:
    """Trades by month and symbol, in time order within files; retries and batch sizes are Spark's."""
    rows = trades.withColumn("month", F.date_format("exchange_ts", "yyyy-MM"))
    rows = rows.repartition("month", "symbol").sortWithinPartitions("month", "symbol", "exchange_ts")
    rows.select(*[f.name for f in schema.TRADES], "month").write.mode("append").insertInto(table)


def append(rows: DataFrame, table: str, name: str) -> None:
    """Rows to a table of the engine, by the columns of ``schema.ALL[name]``; others are left out."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.ALL[name]]).write.mode("append").insertInto(table)


#: What errors of a sink that is short of memory, time or connections say.
RETRIABLE = ("memory", "timeout", "timed out", "too many", "connection")


def retriable(error: Exception) -> bool:
    """Whether less at a time may help."""
    return any(x in str(error).lower() for x in RETRIABLE)


def in_halves(rows: DataFrame, write: Callable[[DataFrame], None], depth: int = 8, again: Callable[[Exception], bool] = retriable) -> int:
    """Writes the rows; if that fails for want of means, each half of them by itself, and so on. Gives the writes made.

    Halves follow from a hash of the whole row, so they are the same at every try. A failed Spark write leaves nothing
    behind; for other sinks ``write`` has to see to that.
    """
    try:
        write(rows)
        return 1
    except Exception as error:
        if depth == 0 or not again(error):
            raise
    side = F.expr(f"shiftright(xxhash64({', '.join(f'`{c}`' for c in rows.columns)}), {depth}) & 1L")
    return sum(in_halves(rows.where(side == k), write, depth - 1, again) for k in (0, 1))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema.ALL[name])
