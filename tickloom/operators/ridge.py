"""Online ridge signals: every row is predicted from the blocks of trainable rows completed before it.

Per group: rows in order; a row trains if all its inputs and its target are finite; every ``block`` trainable rows
are learned at once. With G the sum of x x' and b the sum of x y over the learned blocks, the weights solve
(alpha I + G) w = b; there is no intercept and no scaling. A row's prediction uses the blocks that were complete
before it, is NaN when an input isn't finite, and NaN before the first block.

Plan: running count of trainable rows (bucket totals first, no single sort), Gram sums per block by partial
aggregation, a running sum over blocks (one row each), one solve per block in a pandas UDF, and an equi-join of
the weights with the rows by the number of complete blocks.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_finite
from ..sources.scratch import kept
from .frames import running_total

ALPHA, BLOCK = 1.0, 64


def signals(
    rows: DataFrame, inputs: list[str], target: str = "target", keys: list[str] | None = None, order: list[str] | None = None,
    alpha: float = ALPHA, block: int = BLOCK, bucket_ms: int = 3_600_000,
) -> DataFrame:
    """``rows`` with blocks_done and signal. ``order`` starts with the millisecond column and should be unique."""
    keys, order = keys or ["symbol"], order or ["ms", "trade_id"]
    ready = F.lit(True)
    for x in inputs:
        ready = ready & is_finite(F.col(x))
    rows = rows.withColumn("__ready", ready).withColumn("__train", (ready & is_finite(F.col(target))).cast("long"))
    bucket = F.floor(F.col(order[0]) / bucket_ms)
    rows = kept(rows, "ridge")  # read by the counts, the block sums and the predictions
    rows = running_total(rows, F.col("__train"), order, "__k", bucket, keys)
    rows = rows.withColumn("blocks_done", F.expr(f"(__k - __train) div {block}").cast("long"))
    weights = coefficients(rows, inputs, target, keys, alpha, block)
    joined = rows.join(weights, [*keys, "blocks_done"], "left")
    score = sum((F.col(x) * F.col("__w")[i] for i, x in enumerate(inputs)), F.lit(0.0))
    signal = F.when(F.col("__ready") & F.col("__w").isNotNull(), score).otherwise(F.lit(float("nan")))
    return joined.withColumn("signal", signal).drop("__ready", "__train", "__k", "__w")


def grams(rows: DataFrame, inputs: list[str], target: str, keys: list[str], block: int) -> DataFrame:
    """Sums of products per complete block: columns g_i_j (i <= j) and b_i."""
    trained = rows.where("__train = 1").withColumn("__block", F.expr(f"(__k - 1) div {block}").cast("long"))
    sums = [F.sum(F.col(inputs[i]) * F.col(inputs[j])).alias(f"g_{i}_{j}") for i, j in combinations_with_replacement(range(len(inputs)), 2)]
    sums += [F.sum(F.col(x) * F.col(target)).alias(f"b_{i}") for i, x in enumerate(inputs)]
    return trained.groupBy(*keys, "__block").agg(F.count("*").alias("n"), *sums).where(F.col("n") == block)


def coefficients(rows: DataFrame, inputs: list[str], target: str, keys: list[str], alpha: float, block: int) -> DataFrame:
    """Weights (__w) after each number of complete blocks."""
    p = len(inputs)
    blocks = grams(rows, inputs, target, keys, block)
    upto = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"g_{i}_{j}" for i, j in combinations_with_replacement(range(p), 2)] + [f"b_{i}" for i in range(p)]
    sums = blocks.select(*keys, (F.col("__block") + 1).alias("blocks_done"), F.array(*[F.sum(n).over(upto) for n in names]).alias("sums"))

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        s = np.stack(sums.to_numpy()) if len(sums) else np.zeros((0, len(names)))
        gram = np.zeros((len(s), p, p))
        for k, (i, j) in enumerate(combinations_with_replacement(range(p), 2)):
            gram[:, i, j] = gram[:, j, i] = s[:, k]
        found = np.linalg.solve(gram + alpha * np.eye(p), s[:, len(names) - p :, None])[:, :, 0]
        return pd.Series(list(found))

    return sums.select(*keys, "blocks_done", solve("sums").alias("__w"))


def signal_name(target: str, model: str, inputs: list[str], prefix: str = "") -> str:
    """The name of a model's signal in the feature store."""
    return f"{prefix}signal {target} {model} {{{','.join(inputs)}}}"


def literal(x: np.ndarray, y: np.ndarray, alpha: float = ALPHA, block: int = BLOCK) -> np.ndarray:
    """Reference for tests: predict, then fit, row by row."""
    gram, b = alpha * np.eye(x.shape[1]), np.zeros(x.shape[1])
    weights, held, out = None, [], np.full(len(x), np.nan)
    for i in range(len(x)):
        ok = np.isfinite(x[i]).all()
        if ok and weights is not None:
            out[i] = x[i] @ weights
        if ok and np.isfinite(y[i]):
            held.append(i)
            if len(held) == block:
                gram, b = gram + x[held].T @ x[held], b + x[held].T @ y[held]
                weights, held = np.linalg.solve(gram, b), []
    return out
