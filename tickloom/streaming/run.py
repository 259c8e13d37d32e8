"""Running a stream over what is there now, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.scratch import shared_folder
from .tape import STATE_STORE


def available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Processes all input there is and returns the written rows: every batch's, or the last one's in complete mode."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "stream")
    out, (key, store) = f"{folder}/out", next(iter(STATE_STORE.items()))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        query = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(out)
