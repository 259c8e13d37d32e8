"""Column types of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


_SIMPLE = {"string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "bigint": T.LongType()}


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("decimal("):
        return T.DecimalType(*map(int, text[8:-1].split(",")))
    return _SIMPLE[text]


def _table(columns: str) -> T.StructType:
    """Columns as "name type, name type"; no session is needed."""
    return T.StructType([T.StructField(*(_type(x) if i else x for i, x in enumerate(c.split(" ")))) for c in columns.split(", ")])


TRADES = _table("symbol string, exchange_ts timestamp, trade_id string, price double, quantity double, side string")
#: A book message: prices and sizes per side, whether it replaces the book (snapshot) or changes it (delta).
BOOK_MESSAGES = _table(
    "exchange_ts timestamp, symbol string, update_type string, update_id bigint, seq bigint, "
    "bids_price array<decimal(18,8)>, bids_qty array<decimal(38,18)>, asks_price array<decimal(18,8)>, asks_qty array<decimal(38,18)>"
)
BOOK_ORDERS = _table("symbol string, seq bigint, uid bigint, side string, price double, size double")
FEATURES = _table("symbol string, exchange_ts timestamp, feature_name string, feature_value double")
CHUNKS = _table(
    "symbol string, source_table string, chunk_start timestamp, chunk_end timestamp, chunk_type string, chunk_signature_hash string, "
    "create_time timestamp, git_hash string"
)
CHUNK_SESSIONS = _table("symbol string, created_at timestamp, chunks_list array<string>, git_hash string, chunks_list_hash string")
MANUAL_CHUNKS = _table(
    "symbol string, source_table string, chunk_description string, chunk_effective_start timestamp, chunk_effective_end timestamp, "
    "created_at timestamp, chunk_hash string"
)
BARS = _table(
    "symbol string, exchange_ts timestamp, trade_count bigint, trade_count_buy bigint, trade_count_sell bigint, volume_buy double, "
    "volume_sell double, volume_total double, notional_buy double, notional_sell double, notional_total double, price_last double, "
    "price_first double, price_min double, price_max double, price_mean double, price_std double, price_q25 double, price_q75 double, "
    "q01 double, q99 double"
)
ALL = {
    "trades": TRADES, "book_messages": BOOK_MESSAGES, "features": FEATURES, "chunks": CHUNKS,
    "chunk_sessions": CHUNK_SESSIONS, "manual_chunks": MANUAL_CHUNKS, "bars": BARS,
}
