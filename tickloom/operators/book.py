"""Limit order books from order events (symbol, seq, uid, side, price, size).

Size 0 removes an order; an event of a living order changes its size only; else it adds the order, whose side and
price hold until it is removed. Levels are kept per side. All of it is grouped aggregation: an order's state at
event n follows from its events since its last removal, so no event has to be replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def living(events: DataFrame, upto: int | None = None) -> DataFrame:
    """Orders in the book after event ``upto`` (default: the last): symbol, uid, side, price, size, seq of entry."""
    if upto is not None:
        events = events.where(F.col("seq") <= upto)
    removed = events.where("size = 0").groupBy("symbol", "uid").agg(F.max("seq").alias("__gone"))
    after = events.join(removed, ["symbol", "uid"], "left").where("__gone is null or seq > __gone")
    return after.groupBy("symbol", "uid").agg(
        F.min_by("side", "seq").alias("side"), F.min_by("price", "seq").alias("price"), F.max_by("size", "seq").alias("size"), F.min("seq").alias("since_seq")
    )


def levels(orders: DataFrame) -> DataFrame:
    """Price levels: size, orders, volume (price times size)."""
    made = orders.groupBy("symbol", "side", "price").agg(F.sum("size").alias("size"), F.count("*").alias("n_orders"))
    return made.withColumn("volume", F.col("price") * F.col("size"))


def top(orders: DataFrame) -> DataFrame:
    """Best bid and ask of each symbol; null for an empty side."""
    price = lambda side: F.when(F.col("side") == side, F.col("price"))
    return orders.groupBy("symbol").agg(F.max(price("bid")).alias("best_bid"), F.min(price("ask")).alias("best_ask"))


def depth(orders: DataFrame, k: int | None = None) -> DataFrame:
    """The best k levels of each side, best first (level from 1). Of a crossed book only bids below the best ask
    and asks above the best bid count; an empty side hides nothing."""
    rows = levels(orders).join(top(orders), "symbol")
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    seen = (bid & (F.col("best_ask").isNull() | (F.col("price") < F.col("best_ask")))) | (ask & (F.col("best_bid").isNull() | (F.col("price") > F.col("best_bid"))))
    best = F.when(bid, -F.col("price")).otherwise(F.col("price"))
    ranked = rows.where(seen).withColumn("level", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(best)))
    ranked = ranked if k is None else ranked.where(F.col("level") <= k)
    return ranked.select("symbol", "side", "level", "price", "size", "n_orders", "volume")


def queue(orders: DataFrame) -> DataFrame:
    """Orders with their place in their level: first in, first out."""
    return orders.withColumn("place", F.row_number().over(Window.partitionBy("symbol", "side", "price").orderBy("since_seq")))


def from_messages(messages: DataFrame) -> DataFrame:
    """Book messages (parallel arrays per side) as order events, a level being its own order. A snapshot removes
    every level of its symbol that it doesn't name: levels that came before it are removed at its ``seq``."""
    side = lambda name: F.transform(
        F.arrays_zip(f"{name}s_price", f"{name}s_qty"),
        lambda x: F.struct(F.lit(name).alias("side"), x[f"{name}s_price"].cast("double").alias("price"), x[f"{name}s_qty"].cast("double").alias("size")),
    )
    rows = messages.select("symbol", "seq", "update_type", F.explode(F.concat(side("bid"), side("ask"))).alias("o")).select("symbol", "seq", "update_type", "o.*")
    last = messages.where("update_type = 'snapshot'").groupBy("symbol").agg(F.max("seq").alias("__snapshot"))
    rows = rows.join(last, "symbol", "left").where("__snapshot is null or seq >= __snapshot")
    return rows.select("symbol", "seq", F.xxhash64("side", "price").alias("uid"), "side", "price", "size")
