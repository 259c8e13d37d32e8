"""Forward-looking targets. ``missing`` says what a trade without a forward price becomes: "null" (no target),
or "zero", where the forward price counts as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_sell
from . import frames

DELTA_MS, RISE_MS = 4_000, 200
DEADBAND, DIRECTION, RISE = 0.0045, 0.0055, 0.0055


def _forward(price: Column, missing: str) -> Column:
    if missing not in ("null", "zero"):
        raise ValueError("missing is 'null' or 'zero'")
    return F.coalesce(price, F.lit(0.0)) if missing == "zero" else price


def deadbanded(delta: Column, price: Column, ratio: float) -> Column:
    return F.when(delta.isNull(), None).when(F.abs(delta) < F.abs(price) * ratio, 0.0).otherwise(delta)


def forward(
    trades: DataFrame, delta_ms: int = DELTA_MS, rise_ms: int = RISE_MS, deadband: float = DEADBAND,
    direction: float = DIRECTION, rise: float = RISE, missing: str = "null", bucket_ms: int | None = None,
) -> DataFrame:
    """price_delta, price_direction and sell_rise of every trade, from the first trade exactly ``delta_ms`` ahead
    and the highest sell within ``rise_ms``. One shuffle; frames are a millisecond or a few wide."""
    rows = frames.bucketed(trades, ahead_ms=max(delta_ms, rise_ms), bucket_ms=bucket_ms)
    price = F.col("price")
    rows = rows.withColumns({
        "__ahead": _forward(frames.at_offset(price, F.col("trade_id"), delta_ms), missing),
        "__high": frames.ahead_max(F.when(is_sell(F.col("side")), price), rise_ms),
    })
    delta = F.col("__ahead") - price
    up, down = delta > price * direction, delta < -(price * direction)
    out = rows.withColumns({
        "price_delta": deadbanded(delta, price, deadband),
        "price_direction": F.when(delta.isNull(), None).when(up, 1.0).when(down, -1.0).otherwise(0.0),
        "sell_rise": (F.coalesce(F.col("__high"), F.lit(-1.0)) > price * (1 + rise)).cast("double"),
    })
    return frames.owned(out).drop("__ahead", "__high")


def binned_delta(trades: DataFrame, delta_ms: int = DELTA_MS, deadband: float = DEADBAND, bin_ms: int = 1_000) -> DataFrame:
    """Delta of the last price of a bin to that of the bin ``delta_ms`` later; bins without one are left out.

    An equi-join of the bins with themselves, both sides by symbol and bin.
    """
    bins = last_prices(trades, bin_ms)
    later = bins.select("symbol", (F.col("bin_ms") - delta_ms).alias("bin_ms"), F.col("price_last").alias("ahead"))
    joined = bins.join(later, ["symbol", "bin_ms"])
    return joined.select("symbol", "bin_ms", deadbanded(F.col("ahead") - F.col("price_last"), F.col("price_last"), deadband).alias("price_delta"))


def last_prices(trades: DataFrame, bin_ms: int = 1_000) -> DataFrame:
    """The last price (by ms and trade id) of each symbol's bins; partial aggregation before the shuffle."""
    bin_of = (F.floor(F.col("ms") / bin_ms) * bin_ms).cast("long")
    return trades.groupBy("symbol", bin_of.alias("bin_ms")).agg(F.max_by("price", F.struct("ms", "trade_id")).alias("price_last"))


def emit_range(trades: DataFrame, horizon_ms: int = DELTA_MS, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """[emit_start_ms, emit_end_ms): where every trade can have its whole horizon in the tape."""
    first = F.greatest(F.min("ms"), F.lit(start_ms).cast("long"))
    last = F.least(F.lit(end_ms).cast("long"), F.max("ms") - horizon_ms + 1)
    return trades.agg(first.alias("emit_start_ms"), last.alias("emit_end_ms"))
