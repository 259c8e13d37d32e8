"""Bootstrap of chunk correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_rows(pairs: DataFrame) -> DataFrame:
    """Pairs with arrays of [chunk, correlation, rows] as one row a chunk; short arrays count from defaults."""
    rows = pairs.select("feature", "target", F.posexplode("chunks").alias("pos", "c"))
    part = lambda i, default: F.coalesce(F.try_element_at("c", F.lit(i)), default)
    return rows.select("feature", "target", part(1, F.col("pos").cast("double")).cast("int").alias("chunk"), part(2, F.lit(0.0)).alias("corr"), part(3, F.lit(0.0)).cast("long").alias("n_rows"))


def summary(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, mean of absolutes, and share at or below zero."""
    return rows.groupBy(*(keys or ["feature", "target"])).agg(
        F.avg("corr").alias("avg_corr"), F.avg(F.abs("corr")).alias("weighted_score"), F.avg((F.col("corr") <= 0).cast("int")).alias("p_value_le_zero")
    )


def samples(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Summaries of n resamples with replacement of each pair's chunks; pairs with one chunk are left out.

    A pair's chunks (a few dozen) become one array; each draw picks from it by an MD5 of seed, pair, sample and draw, so
    a task that runs again draws the same.
    """
    grouped = rows.groupBy("feature", "target").agg(F.sort_array(F.collect_list(F.struct("chunk", "corr"))).alias("all")).where(F.size("all") > 1)
    drawn = grouped.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
    text = lambda i: F.concat_ws("|", F.lit(str(seed)), "feature", "target", F.col("sample").cast("string"), i.cast("string"))
    number = lambda i: F.conv(F.substring(F.md5(text(i).cast("binary")), 1, 8), 16, 10).cast("long")
    pick = F.transform("all", lambda _, i: F.element_at("all", (number(i) % F.size("all") + 1).cast("int"))["corr"])
    return summary(drawn.select("feature", "target", "sample", F.explode(pick).alias("corr")), ["feature", "target", "sample"])


def ranked(pairs: DataFrame) -> DataFrame:
    """Pairs with their summary, highest mean first."""
    return summary(chunk_rows(pairs)).orderBy(F.desc("avg_corr"), "feature", "target")
