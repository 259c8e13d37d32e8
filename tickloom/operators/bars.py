"""Trade bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_buy, is_sell


def bars(trades: DataFrame, bin_ms: int = 1_000) -> DataFrame:
    """Counts, volumes, notionals, prices, spread and quantiles of each symbol's bins.

    One aggregation by symbol and bin; a bin is a second of one symbol, so exact quantiles stay small.
    """
    price, quantity = F.col("price"), F.col("quantity").cast("double")
    buy, sell = (F.coalesce(f(F.col("side")), F.lit(False)) for f in (is_buy, is_sell))
    total = lambda x, when: F.coalesce(F.sum(F.when(when, x)), F.lit(0.0))
    at = F.struct("ms", "trade_id")
    return trades.groupBy("symbol", (F.floor(F.col("ms") / bin_ms) * bin_ms).cast("long").alias("bin_ms")).agg(
        F.count("*").alias("trade_count"), F.count_if(buy).alias("trade_count_buy"), F.count_if(sell).alias("trade_count_sell"),
        total(quantity, buy).alias("volume_buy"), total(quantity, sell).alias("volume_sell"), F.sum(quantity).alias("volume_total"),
        total(price * quantity, buy).alias("notional_buy"), total(price * quantity, sell).alias("notional_sell"),
        F.sum(price * quantity).alias("notional_total"), F.max_by("price", at).alias("price_last"), F.min_by("price", at).alias("price_first"),
        F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.avg("price").alias("price_mean"),
        F.stddev_samp("price").alias("price_std"), F.percentile("price", 0.25).alias("price_q25"), F.percentile("price", 0.75).alias("price_q75"),
        F.percentile("price", 0.01).alias("q01"), F.percentile("price", 0.99).alias("q99"),
    )
