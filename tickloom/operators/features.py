"""Rolling features of a tape: causal look-back frames that end one millisecond before the trade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_buy, is_sell
from . import frames

LOOKBACK_MS = 300_000
_EXACT = "decimal(28,10)"


def rolling(trades: DataFrame, back_ms: int = LOOKBACK_MS, bucket_ms: int | None = None, momentum: bool = False) -> DataFrame:
    """All rolling metrics of every trade, wide: counts, volumes, mean prices and volumes by side, spread, balance.

    ``trades`` has symbol, ms, trade_id, price, quantity, side. One shuffle by symbol and time bucket; all metrics
    share one window. Empty frames: counts and volumes 0, means and differences of means null. ``momentum`` adds
    last minus first price of the frame.
    """
    rows = frames.bucketed(trades, back_ms=back_ms, bucket_ms=bucket_ms)
    price, quantity = F.col("price").cast(_EXACT), F.col("quantity").cast(_EXACT)
    columns: dict[str, Column] = {}
    for name, side in (("buy", is_buy(F.col("side"))), ("sell", is_sell(F.col("side")))):
        count = frames.past_count(F.coalesce(side, F.lit(False)), back_ms)
        volume, paid = (frames.past_sum(F.when(side, x), back_ms) for x in (quantity, price))
        columns |= {f"trade_count_{name}": count, f"cvd_{name}": volume.cast("double")}
        columns |= {f"mean_price_{name}": F.when(count > 0, paid.cast("double") / count), f"mean_volume_{name}": F.when(count > 0, volume.cast("double") / count)}
    if momentum:
        columns["__last"] = frames.last_before(F.col("price"), back_ms)
    out = rows.withColumns(columns)
    out = out.withColumn("trade_spread_signed", F.col("mean_price_buy") - F.col("mean_price_sell")).withColumn("volume_balance", F.col("cvd_buy") - F.col("cvd_sell"))
    if momentum:
        out = frames.with_first_since(out, "price", back_ms, "__first")
        out = out.withColumn("price_momentum", F.col("__last") - F.col("__first")).drop("__first", "__last")
    return frames.owned(out)


#: What ``rolling`` computes besides momentum, in the order of the feature store.
ROLLING = [
    "trade_count_buy", "trade_count_sell", "cvd_buy", "cvd_sell", "mean_price_buy", "mean_price_sell",
    "mean_volume_buy", "mean_volume_sell", "trade_spread_signed",
]
