"""Two-pass external shuffle of whole records into shards, DataFrame functions only.

Pass one scatters the records uniformly into buckets by a seeded hash of the whole record; the number of buckets
follows from the table's bytes, so that a bucket fits in memory. Pass two gathers each bucket, brings it into a
canonical order, applies the built-in ``shuffle`` (Fisher-Yates over the positions, seeded) and writes it. Buckets
are laid end to end; position p goes to shard p mod ``shards``, slot p div ``shards``: shard counts differ by one at
most. The files hold the records, a folder for each shard, and within a file in the order of their slots.

The permutation follows from the seed and the records alone: the buckets are dealt to tasks by a number that follows
from the bytes, whatever the session's number of shuffle partitions, and in a task they stand in order.

Defined cases: null texts count as empty; an id that repeats, or is null, is scattered by the rest of the record;
records that repeat so often that their copies would crowd a bucket are counted, numbered and scattered by their
numbers, so that even one record repeated for a third of all rows spreads; an empty table gives no rows. Extra
columns are part of the record whatever their names (those of map type, which have no order, are refused by Spark).
Records that can't be told apart are interchangeable.

Scale: the records move once; what else moves is a hash and two numbers of each, to count copies and buckets. Bucket
offsets are summed in two steps, so no task reads the whole table of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch

#: Bytes of a record besides its text.
OVERHEAD = 64


def _size(text: str) -> Column:
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")


def _copies(hot: DataFrame, bucket_bytes: int, scratch: Scratch) -> DataFrame:
    """Rows (record, key, bytes) that repeat often, as their distinct records with copy numbers from 0.

    They are counted map-side; numbers are made in runs that fill a quarter bucket, each by whichever task gets it.
    """
    counted = scratch.keep(hot.groupBy("key", "bytes", "record").agg(F.count("*").alias("n")))
    runs = counted.withColumn("size", F.greatest(F.expr(f"{bucket_bytes // 4} div bytes"), F.lit(1)))
    runs = runs.select("*", F.explode(F.expr("sequence(0L, (n - 1) div size)")).alias("run")).repartition("key", "run")
    return runs.select("record", "key", F.explode(F.expr("sequence(run * size, least(n, (run + 1) * size) - 1)")).alias("copy"))


def scattered(docs: DataFrame, scratch: Scratch, text: str = "text", seed: int = 7, bucket_bytes: int = 8 << 20, least: int = 64) -> tuple[DataFrame, DataFrame, int, int]:
    """Pass one: rows (bucket, key, copy, record); the buckets' counts; their number; the table's bytes."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    records = docs.select(F.struct(*columns).alias("record"), F.xxhash64(F.lit(seed), *columns).alias("key"), (_size(f"`{text}`") + OVERHEAD).alias("bytes"))
    same = scratch.keep(records.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    total = same.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(least, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "key", "copy"), F.lit(buckets)).alias("bucket")
    crowds = (F.col("n") > 1) & (F.col("bytes") > bucket_bytes // 4)
    hot = scratch.keep(same.where(crowds).select("key"))
    n_hot = hot.count()
    counts = same.where(~crowds).withColumn("copy", F.lit(0).cast("long")).select(bucket, "n")
    cold, parts = records, []
    if n_hot:
        # Few keys can repeat that often; they are sent to every task up to 8 MB only, and beyond that meet by key.
        hot = F.broadcast(hot) if n_hot <= 1 << 19 else hot.hint("merge")
        cold = records.join(hot, "key", "left_anti")
        parts = [_copies(records.join(hot, "key", "left_semi"), bucket_bytes, scratch)]
        counts = counts.unionByName(parts[0].select(bucket, F.lit(1).cast("long").alias("n")))
    rows = cold.select("record", "key", F.lit(0).cast("long").alias("copy"))
    for part in parts:
        rows = rows.unionByName(part)
    return rows.select(bucket, "key", "copy", "record"), counts.groupBy("bucket").agg(F.sum("n").alias("n")), buckets, total


def offsets(counts: DataFrame, group: int = 4096) -> DataFrame:
    """bucket and the number of records in the buckets before it."""
    counts = counts.withColumn("group", F.expr(f"bucket div {group}"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("group").agg(F.sum("n").alias("t"))
    totals = totals.select("group", F.coalesce(F.sum("t").over(before(Window.orderBy("group"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("group").orderBy("bucket"))), F.lit(0))
    return counts.withColumn("within", within).join(totals, "group").select("bucket", (F.col("base") + F.col("within")).alias("offset"))


def shuffled(docs: DataFrame, scratch: Scratch, shards: int = 16, seed: int = 7, text: str = "text", bucket_bytes: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """Pass two: shard, slot and record of every row; in every task buckets and positions stand in order."""
    rows, counts, buckets, total = scattered(docs, scratch, text, seed, bucket_bytes)
    starts = scratch.keep(offsets(counts))
    tasks = min(max(-(-total // task_bytes), 16), buckets, 20_000)
    gathered = rows.repartition(tasks, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "copy", "record"))).alias("rows"))
    # One order of buckets in every task: a task that runs again draws the same permutations.
    drawn = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed).alias("rows"))
    # A bucket's start is a row of two numbers: up to 100,000 of them are sent to every task.
    placed = drawn.join(F.broadcast(starts) if buckets <= 100_000 else starts.hint("merge"), "bucket")
    placed = placed.select("offset", F.posexplode("rows").alias("pos", "row"))
    return placed.select(F.expr(f"cast((offset + pos) % {shards} as int)").alias("shard"), F.expr(f"(offset + pos) div {shards}").alias("slot"), F.col("row.record").alias("record"))


def write(docs: DataFrame, path: str, shards: int = 16, seed: int = 7, text: str = "text", **sizes: int) -> None:
    """The shards of the docs: folders shard=0, 1, ... of files with slot and record, each in the order of slots."""
    scratch = Scratch(docs.sparkSession, "shards")
    placed = shuffled(docs, scratch, shards, seed, text, **sizes)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    scratch.clear()


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """shard, slot and record of what ``write`` wrote of docs with that schema."""
    return spark.read.schema(StructType().add("slot", "long").add("record", schema).add("shard", "integer")).parquet(path)


def digest(written: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract columns, from the records as they were written."""
    body = F.coalesce(F.col(f"record.`{text}`"), F.lit(""))
    return written.select(
        F.col(f"record.`{doc_id}`").alias("doc_id"), _size(f"record.`{text}`").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
