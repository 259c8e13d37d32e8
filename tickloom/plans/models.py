"""Runners of online models: what the signal job needs of a model, and the models that are sums over blocks.

A runner predicts each row from the rows completed before it. Models whose state is a sum over rows (Gram matrices,
means) need no replay: a running sum over blocks gives the state before each row.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_finite
from ..operators import ridge
from ..operators.frames import running_total
from ..sources.scratch import kept


class Runner(Protocol):
    """``tag`` stands in the signal's name; ``signals`` adds blocks_done and signal (NaN where there is none yet)."""

    tag: str

    def signals(self, rows: DataFrame, inputs: list[str], order: list[str]) -> DataFrame: ...


@dataclass(frozen=True)
class Ridge:
    """Online ridge without intercept."""

    alpha: float = ridge.ALPHA
    block: int = ridge.BLOCK
    tag: str = "ridge"

    def __post_init__(self):
        if self.alpha <= 0 or self.block <= 0:
            raise ValueError("a ridge needs a positive alpha, and a row a block at least")

    def signals(self, rows: DataFrame, inputs: list[str], order: list[str]) -> DataFrame:
        return ridge.signals(rows, inputs, order=order, alpha=self.alpha, block=self.block)


@dataclass(frozen=True)
class RunningMean:
    """The mean target of the blocks completed before a row: what any other model should beat."""

    block: int = ridge.BLOCK
    tag: str = "mean"

    def __post_init__(self):
        if self.block <= 0:
            raise ValueError("a mean needs a row a block at least")

    def signals(self, rows: DataFrame, inputs: list[str], order: list[str], bucket_ms: int = 3_600_000) -> DataFrame:
        ready = F.lit(True)
        for x in inputs:
            ready = ready & is_finite(F.col(x))
        rows = kept(rows.withColumn("__ready", ready).withColumn("__train", (ready & is_finite(F.col("target"))).cast("long")), "mean")
        rows = running_total(rows, F.col("__train"), order, "__k", F.floor(F.col(order[0]) / bucket_ms), ["symbol"])
        rows = rows.withColumn("blocks_done", F.expr(f"(__k - __train) div {self.block}").cast("long"))
        sums = rows.where("__train = 1").groupBy("symbol", F.expr(f"(__k - 1) div {self.block}").alias("b")).agg(F.sum("target").alias("s"), F.count("*").alias("n"))
        upto = Window.partitionBy("symbol").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        means = sums.where(F.col("n") == self.block).select("symbol", (F.col("b") + 1).alias("blocks_done"), (F.sum("s").over(upto) / F.sum("n").over(upto)).alias("__mean"))
        out = rows.join(means, ["symbol", "blocks_done"], "left")
        signal = F.when(F.col("__ready") & F.col("__mean").isNotNull(), F.col("__mean")).otherwise(F.lit(float("nan")))
        return out.withColumn("signal", signal).drop("__ready", "__train", "__k", "__mean")
