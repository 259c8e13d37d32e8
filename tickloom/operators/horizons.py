"""Embargo and purge of intervals, time splits, row-bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

SECOND = 1_000_000


def embargo(start: Column, end: Column, us: int | Column, extra_us: int = SECOND) -> Column:
    """The start moved on by the embargo and a gap, at most to the end."""
    return F.least(start + us + extra_us, end)


def purge(start: Column, end: Column, us: int | Column, extra_us: int = SECOND) -> Column:
    """The end moved back by the purge and a gap, at least to the start."""
    return F.greatest(end - us - extra_us, start)


def is_empty(start: Column, end: Column) -> Column:
    return start >= end


def trimmed(start: Column, end: Column, us: int, operation: str, extra_us: int = SECOND) -> Column:
    """JSON of what an embargo or a purge leaves of an interval, with what it was."""
    if operation not in ("embargo", "purge"):
        raise ValueError(f"unknown operation: {operation!r}")
    first = embargo(start, end, us, extra_us) if operation == "embargo" else start
    last = purge(start, end, us, extra_us) if operation == "purge" else end
    text = lambda x: F.date_format(F.timestamp_micros(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    parts = {
        "start": text(first), "end": text(last), "original_start": text(start), "original_end": text(end), "applied_horizon_seconds": F.lit(us / SECOND),
        "extra_gap_seconds": F.lit(extra_us / SECOND), "operation": F.lit(operation), "is_empty": is_empty(first, last),
    }
    return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))


def train_share(rows: DataFrame, order: str = "ms", share: float = 0.7) -> DataFrame:
    """The 70/30 split of a timeline with repeats: n_rows, n_train, n_test, train_end (first instant of the test).

    Rows of one instant stay together on the train side. Instants are counted first, so what is ordered is a
    table of distinct instants. No row comes out if either side would be empty.
    """
    at = rows.where(F.col(order).isNotNull()).groupBy(order).agg(F.count("*").alias("n"))
    total = at.agg(F.sum("n")).first()[0] or 0
    cut = min(max(int(total * share), 1), total - 1)
    bucket = Window.partitionBy(F.floor(F.col(order) / 3_600_000))
    tops = at.groupBy(F.floor(F.col(order) / 3_600_000).alias("b")).agg(F.sum("n").alias("t"))
    tops = tops.select("b", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("n").over(bucket.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ran = at.withColumn("b", F.floor(F.col(order) / 3_600_000)).withColumn("within", within).join(tops, "b").withColumn("upto", F.col("before") + F.col("within"))
    train = F.col("upto") - F.col("n") < cut
    out = ran.agg(F.sum("n").alias("n_rows"), F.sum(F.when(train, F.col("n"))).alias("n_train"), F.min(F.when(~train, F.col(order))).alias("train_end"))
    return out.where("train_end is not null and n_rows >= 2").select("n_rows", "n_train", (F.col("n_rows") - F.col("n_train")).alias("n_test"), "train_end")


def require_split(rows: DataFrame, order: str = "ms", share: float = 0.7):
    """The row of ``train_share``; a timeline that can't be split is an error."""
    found = train_share(rows, order, share).first()
    if found is None:
        raise ValueError("a split needs two rows at least, of more than one instant")
    return found


def kth_instant(rows: DataFrame, k: int, order: str = "ms") -> DataFrame:
    """The instant of the k-th row (from 0) in order; no row if there are fewer. Only counts of instants are ordered:
    each bucket of the axis knows how many rows lie before it, and the bucket that holds the k-th is searched."""
    at = rows.where(F.col(order).isNotNull()).groupBy(order).agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col(order) / 3_600_000))
    tops = at.groupBy("b").agg(F.sum("n").alias("t"))
    tops = tops.select("b", "t", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    near = at.join(tops.where((F.col("before") <= k) & (F.col("before") + F.col("t") > k)), "b")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("upto", upto).where(F.col("upto") > k).agg(F.min(order).alias(order)).where(F.col(order).isNotNull())


def row_batches(rows: DataFrame, most: int, keys: list[str] | None = None, order: str = "ms", end: int | None = None, tail: int = 1_000, bucket: int = 3_600_000) -> DataFrame:
    """Consecutive [start, end) packed greedily: a batch ends with the instant that brings it to ``most`` rows.

    Instants are never split, so a batch holds up to ``most - 1`` rows and one instant; the last one ends ``tail``
    behind the last instant (at most at ``end``). Running counts go by buckets of the axis. Packing is sequential,
    but the k-th batch can only end where the count lies between k * most and k * (most + the largest instant - 1):
    only these instants, with their counts, stream through one task a key.
    """
    keys = keys or []
    names = [*keys, "__k"]  # a constant beside the keys, so that there is one
    at = rows.where(F.col(order).isNotNull()).withColumn("__k", F.lit(0)).groupBy(*names, order).agg(F.count("*").alias("n"))
    at = kept(at.withColumn("__b", F.floor(F.col(order) / bucket)), "instants")
    tops = at.groupBy(*names, "__b").agg(F.sum("n").alias("t"), F.min(order).alias("first"))
    along = Window.partitionBy(*names).orderBy("__b")
    before = F.coalesce(F.sum("t").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select(*names, "__b", before.alias("before"), F.lead("first").over(along).alias("after"))
    ends = at.groupBy(*names).agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.sum("n").alias("total"), F.max("n").alias("largest"))
    within = Window.partitionBy(*names, "__b").orderBy(order)
    upto = F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0))
    ran = at.withColumns({"upto": upto, "next": F.lead(order).over(within)}).join(tops, [*names, "__b"]).join(ends, names)
    ran = ran.select(*names, "largest", (F.col("before") + F.col("upto")).alias("upto"), F.coalesce("next", "after").alias("next"))
    near = ran.where((F.col("upto") >= most) & (F.col("upto") <= F.expr(f"upto div {most}") * (most - 1 + F.col("largest")))).drop("largest")
    key_types = [f"{k} {dict(at.dtypes)[k]}" for k in names]
    edges = near.repartition(*names).sortWithinPartitions(*names, "upto").mapInPandas(_edges(names, most), ", ".join([*key_types, "batch int", "upto long", "start long"]))
    starts = ends.select(*names, F.lit(0).alias("batch"), F.lit(0).cast("long").alias("upto"), F.col("lo").cast("long").alias("start"))
    starts = starts.unionByName(edges.where("start is not null"))
    by_batch = Window.partitionBy(*names).orderBy("batch")
    stop = F.col("hi") + tail if end is None else F.least(F.col("hi") + tail, F.lit(end))
    out = starts.join(ends, names).withColumns({"stop": F.coalesce(F.lead("start").over(by_batch), stop), "n_rows": F.coalesce(F.lead("upto").over(by_batch), "total") - F.col("upto")})
    return out.select(*keys, "batch", F.col("start").alias(f"start_{order}"), F.col("stop").cast("long").alias(f"end_{order}"), "n_rows")


def _edges(names: list[str], most: int):
    """The instants that end a batch, among candidates sorted by key and running count: the next batch, count, next instant."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, reached = None, 0, 0
        for frame in frames:
            for now, part in frame.groupby(names, sort=False, dropna=False):
                if now != key:
                    key, batch, reached = now, 0, 0
                counts, picked = part["upto"].to_numpy(), []
                while (i := int(counts.searchsorted(reached + most))) < len(counts):
                    picked.append(i)
                    reached = int(counts[i])
                if picked:
                    out = part.iloc[picked][[*names, "upto", "next"]].rename(columns={"next": "start"})
                    out.insert(len(names), "batch", range(batch + 1, batch + 1 + len(picked)))
                    batch += len(picked)
                    yield out.astype({"start": "Int64"})

    return run


@dataclass(frozen=True)
class Batch:
    """A planned batch: [start, end) and its rows."""

    index: int
    start: int
    end: int
    rows: int
    last: bool


def run_batches(rows: DataFrame, most: int, handler: Callable[[Batch], None], order: str = "ms", end: int | None = None, log: Callable[[str], None] | None = None) -> int:
    """Calls the handler for each batch of a tape, in order; the handler reads what it needs around its range.

    Only the plan (a row a batch) comes to the driver, piece by piece. Gives the number of batches.
    """
    planned = row_batches(rows, most, None, order, end).orderBy("batch")
    held, count = None, 0
    for r in chain(planned.toLocalIterator(), [None]):
        if held is not None:
            batch = Batch(held["batch"], held[f"start_{order}"], held[f"end_{order}"], held["n_rows"], r is None)
            if log:
                log(f"batch {batch.index}: {batch.rows} rows in [{batch.start}, {batch.end})")
            handler(batch)
            count += 1
        held = r
    return count
