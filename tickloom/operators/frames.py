"""Windows over a millisecond axis that stay linear in the rows and spread over many tasks.

A trade tape has few symbols, so a window partition per symbol is a task per symbol. ``bucketed`` splits the axis
of each symbol into buckets no narrower than the frame and copies the rows near a bucket's edge into its neighbour
(a share of frame / bucket of all rows); ``owned`` keeps each row once, in its own bucket, behind the window.
Counts and sums over a look-back are the difference of two running frames, which costs the same for any look-back;
a bounded sliding frame costs rows times frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol", "__bucket")
#: Buckets are at least so many frames wide, which bounds the copied share.
FRAMES = 16


def bucketed(rows: DataFrame, back_ms: int = 0, ahead_ms: int = 0, bucket_ms: int | None = None) -> DataFrame:
    """Rows with __bucket and __own; rows that another bucket's frames can see are copied to it."""
    width = max(bucket_ms or 0, FRAMES * max(back_ms, ahead_ms), 1)
    own = F.floor(F.col("ms") / width).cast("long")
    homes = [own]
    if back_ms:
        homes.append(F.when(F.col("ms") >= (own + 1) * width - back_ms, own + 1))
    if ahead_ms:
        homes.append(F.when(F.col("ms") <= own * width + ahead_ms - 1, own - 1))
    if len(homes) == 1:
        return rows.withColumn("__bucket", own).withColumn("__own", F.lit(True))
    spread = rows.withColumn("__home", own).withColumn("__bucket", F.explode(F.array_compact(F.array(*homes))))
    return spread.withColumn("__own", F.col("__bucket") == F.col("__home")).drop("__home")


def owned(rows: DataFrame) -> DataFrame:
    return rows.where("__own").drop("__own", "__bucket")


def axis() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("ms")


def past_sum(value: Column, back_ms: int) -> Column:
    """Sum over [t - back_ms, t - 1]; the row's own millisecond is not in it. Exact for integers and decimals."""
    upto = F.coalesce(F.sum(value).over(axis().rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gone = F.coalesce(F.sum(value).over(axis().rangeBetween(Window.unboundedPreceding, -back_ms - 1)), F.lit(0))
    return upto - gone


def past_count(condition: Column, back_ms: int) -> Column:
    return past_sum(condition.cast("long"), back_ms)


def at_offset(value: Column, tie: Column, ahead_ms: int) -> Column:
    """The value of the first row (by ``tie``) exactly ``ahead_ms`` ahead, else null."""
    return F.min_by(value, tie).over(axis().rangeBetween(ahead_ms, ahead_ms))


def ahead_max(value: Column, ahead_ms: int) -> Column:
    """Maximum over [t + 1, t + ahead_ms]."""
    return F.max(value).over(axis().rangeBetween(1, ahead_ms))


def last_before(value: Column, back_ms: int, tie: str = "trade_id") -> Column:
    """The last value (by ms and ``tie``) in [t - back_ms, t - 1], from one running frame."""
    seen = F.max(F.struct(F.col("ms").alias("at"), F.col(tie).alias("tie"), value.alias("value"))).over(axis().rangeBetween(Window.unboundedPreceding, -1))
    return F.when(seen["at"] >= F.col("ms") - back_ms, seen["value"])


def with_first_since(rows: DataFrame, value: str, back_ms: int, name: str, tie: str = "trade_id") -> DataFrame:
    """Adds the first value (by ms and ``tie``) in [t - back_ms, t - 1].

    Each row also sends a marker to the start of its frame; reading the axis backwards, the last trade seen is the
    first at or after the marker. One more sort of the same partitions, linear in the rows.
    """
    mark = F.array(F.struct(F.lit(1).alias("kind"), F.col("ms").alias("at")), F.struct(F.lit(0).alias("kind"), (F.col("ms") - back_ms).alias("at")))
    both = rows.withColumn("__m", F.explode(mark))
    order = Window.partitionBy(*KEYS).orderBy(F.desc("__m.at"), F.desc("__m.kind"), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    trade = F.when(F.col("__m.kind") == 1, F.struct("ms", F.col(value).alias("value")))
    both = both.withColumn("__next", F.last(trade, ignorenulls=True).over(order)).where("__m.kind = 0")
    return both.withColumn(name, F.when(F.col("__next.ms") < F.col("ms"), F.col("__next.value"))).drop("__m", "__next")


def running_total(rows: DataFrame, value: Column, order: list[str], name: str, bucket: Column, keys: list[str]) -> DataFrame:
    """Inclusive running sum along ``order`` without a single sort of all rows: totals per bucket of the axis are
    summed first (a row per bucket), then each bucket runs on from the total before it."""
    rows = rows.withColumn("__b", bucket).withColumn("__v", value)
    totals = rows.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ran = rows.withColumn("__in", F.sum("__v").over(within)).join(offsets, [*keys, "__b"])
    return ran.withColumn(name, F.col("__before") + F.col("__in")).drop("__b", "__v", "__in", "__before")
