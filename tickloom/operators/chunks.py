"""Chunks of a timeline: gap-stripped clock, equal shares, train/validation/test, counts, signatures.

Instants are integers (us). The timeline is the distinct instants of a tape, per key; it is split into buckets of
the axis, so differences and running sums need no single sort of all instants: each bucket knows the last instant
and the total before it from a table with one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

SECOND = 1_000_000
BUCKET_US = 3_600 * SECOND
PARTS = ("train", "validation", "test")


def timeline(rows: DataFrame, us: Column, keys: list[str] | None = None) -> DataFrame:
    """Distinct instants (keys, us), written once: every later step reads them several times."""
    return kept(rows.select(*(keys or []), us.cast("long").alias("us")).where("us is not null").distinct(), "timeline")


def require_points(instants: DataFrame, least: int = 2) -> DataFrame:
    """The timeline itself; too few instants are an error."""
    if instants.limit(least).count() < least:
        raise ValueError(f"a timeline needs {least} instants at least")
    return instants


def segments(instants: DataFrame, gap_us: int | None, keys: list[str] | None = None, bucket_us: int = BUCKET_US) -> DataFrame:
    """For every instant but the first of a key: seg_start, seg_end, real_us, eff_us, and cum_us, the clock at its end.

    A gap longer than ``gap_us`` counts as 0 (None: every gap counts).
    """
    keys = keys or []
    rows = instants.withColumn("__b", F.floor(F.col("us") / bucket_us).cast("long"))
    ends = rows.groupBy(*keys, "__b").agg(F.max("us").alias("__last"))
    over_buckets = Window.partitionBy(*keys).orderBy("__b")
    ends = ends.select(*keys, "__b", F.lag("__last").over(over_buckets).alias("__before"))
    within = Window.partitionBy(*keys, "__b").orderBy("us")
    rows = rows.withColumn("__prev", F.lag("us").over(within)).join(ends, [*keys, "__b"])
    rows = rows.withColumn("seg_start", F.coalesce("__prev", "__before")).where("seg_start is not null")
    real = F.col("us") - F.col("seg_start")
    rows = rows.withColumn("real_us", real).withColumn("eff_us", real if gap_us is None else F.when(real > gap_us, 0).otherwise(real))
    totals = rows.groupBy(*keys, "__b").agg(F.sum("eff_us").alias("__t"))
    before = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__sum"))
    rows = rows.withColumn("__in", F.sum("eff_us").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(totals, [*keys, "__b"])
    return rows.select(*keys, "seg_start", F.col("us").alias("seg_end"), "real_us", "eff_us", (F.col("__sum") + F.col("__in")).alias("cum_us"))


def span(segs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Real and effective length; zeros for a timeline of one instant."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return segs.groupBy(*(keys or [])).agg(zero("real_us")("total_real_us"), zero("eff_us")("total_eff_us"))


def boundaries(segs: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The n - 1 instants that part the effective clock into equal shares: (keys, idx, boundary_us).

    Share i ends at total * i div n on the clock, inside the one segment that holds it. Every segment works out
    which shares end in it, so nothing is compared with everything. The segments are written once.
    """
    keys, segs = keys or [], segs if hasattr(segs, "scratch_path") else kept(segs, "segments")
    totals = segs.groupBy(*keys).agg(F.sum("eff_us").alias("total"))
    rows = segs.where("eff_us > 0").withColumn("prev", F.col("cum_us") - F.col("eff_us"))
    rows = rows.join(totals, keys) if keys else rows.withColumn("total", F.lit(totals.first()[0]).cast("long"))
    low, high = F.expr(f"prev * {n} div total"), F.expr(f"cum_us * {n} div total + 1")
    share = F.explode(F.sequence(F.greatest(low, F.lit(1).cast("long")), F.least(high, F.lit(max(n - 1, 1)).cast("long")))).alias("idx")
    rows = rows.where(F.greatest(low, F.lit(1)) <= F.least(high, F.lit(n - 1))).select("*", share)
    rows = rows.withColumn("target", F.expr(f"total * idx div {n}")).where("prev < target and target <= cum_us")
    return rows.select(*keys, F.col("idx").cast("int").alias("idx"), (F.col("seg_start") + F.col("target") - F.col("prev")).alias("boundary_us"))


def closed(points: DataFrame, keys: list[str] | None = None, gap_us: int = SECOND) -> DataFrame:
    """Points (keys, idx from 0, point_us, the last one the end) to closed chunks that end a second before the next.

    A chunk whose end falls before its start is an error for the caller: ``collapsed`` tells.
    """
    order = Window.partitionBy(*(keys or [])).orderBy("idx")
    nxt = F.lead("point_us").over(order)
    last = F.lead("idx", 2).over(order).isNull()
    rows = points.withColumn("end_us", F.when(last, nxt).otherwise(nxt - gap_us)).where("end_us is not null")
    return rows.select(*(keys or []), F.col("idx").cast("int").alias("chunk_idx"), F.col("point_us").alias("start_us"), "end_us", (F.col("end_us") < F.col("point_us")).alias("collapsed"))


def points(instants: DataFrame, edges: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The n + 1 points that bound the chunks: first instant, boundaries, last instant."""
    keys = keys or []
    ends = instants.groupBy(*keys).agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    outer = ends.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.col("lo").alias("point_us")), F.struct(F.lit(n).alias("idx"), F.col("hi").alias("point_us")))).alias("p")).select(*keys, "p.*")
    return outer.unionByName(edges.select(*keys, "idx", F.col("boundary_us").alias("point_us")))


def global_chunks(instants: DataFrame, n: int, gap_us: int | None, keys: list[str] | None = None) -> DataFrame:
    """n closed chunks of equal effective time."""
    keys = keys or []
    return closed(points(instants, boundaries(segments(instants, gap_us, keys), n, keys), n, keys), keys)


def wall_chunks(start_us: int, end_us: int, n: int, spark) -> DataFrame:
    """n closed chunks of equal wall time."""
    points = spark.range(n + 1).select(F.col("id").cast("int").alias("idx"), F.expr(f"{start_us}L + ({end_us - start_us}L * id) div {n}").alias("point_us"))
    return closed(points)


def in_chunks(instants: DataFrame, chunks: DataFrame) -> DataFrame:
    """Instants with the chunk they fall in. Chunks are spread over the buckets of the axis that they cover, so both
    sides meet by bucket; which of them is sent where is left to the planner."""
    bucket = lambda c: F.floor(F.col(c) / BUCKET_US)
    spread = chunks.select("chunk_idx", "start_us", "end_us", F.explode(F.sequence(bucket("start_us"), bucket("end_us"))).alias("__b"))
    met = instants.withColumn("__b", bucket("us")).join(spread, "__b")
    return met.where(F.col("us").between(F.col("start_us"), F.col("end_us"))).drop("__b")


def thirds(chunks: DataFrame) -> DataFrame:
    """Train, validation and test of each chunk by wall time; chunks under three seconds are errors (``collapsed``)."""
    start, end = F.col("start_us"), F.col("end_us")
    cut = [start, start + F.expr("(end_us - start_us) div 3"), start + F.expr("(end_us - start_us) * 2 div 3")]
    stop = [cut[1] - SECOND, cut[2] - SECOND, end]
    pieces = F.array(*[
        F.struct(F.lit(i).alias("part_idx"), F.lit(name).alias("part"), cut[i].alias("part_start_us"), stop[i].alias("part_end_us"))
        for i, name in enumerate(PARTS)
    ])
    return chunks.select("chunk_idx", F.explode(pieces).alias("p"), (end - start < 3 * SECOND).alias("collapsed")).select("chunk_idx", "p.*", "collapsed")


def effective_thirds(instants: DataFrame, chunks: DataFrame, gap_us: int | None) -> DataFrame:
    """Train, validation and test of each chunk by its own effective clock, all chunks in one job.

    A chunk's clock starts at its first instant; its last part ends with the chunk, its first starts with it.
    The chunks, as many as were asked for, become a local table.
    """
    chunks = instants.sparkSession.createDataFrame(chunks.collect(), chunks.schema)
    inside = in_chunks(instants, chunks).select("chunk_idx", "us")
    edges = boundaries(segments(inside, gap_us, ["chunk_idx"]), 3, ["chunk_idx"])
    outer = chunks.select("chunk_idx", F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.col("start_us").alias("point_us")), F.struct(F.lit(3).alias("idx"), F.col("end_us").alias("point_us")))).alias("p")).select("chunk_idx", "p.*")
    parts = closed(
        outer.unionByName(edges.select("chunk_idx", "idx", F.col("boundary_us").alias("point_us"))).withColumnRenamed("chunk_idx", "whole"), ["whole"]
    )
    name = F.element_at(F.array(*map(F.lit, PARTS)), F.col("chunk_idx") + 1)
    return parts.select(F.col("whole").alias("chunk_idx"), F.col("chunk_idx").alias("part_idx"), name.alias("part"), F.col("start_us").alias("part_start_us"), F.col("end_us").alias("part_end_us"), "collapsed")


def counts(rows: DataFrame, us: Column, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows in each closed range (idx, n_rows), all ranges in one pass and one row to the driver's side."""
    sums = rows.select(us.alias("us")).agg(*[F.count_if(F.col("us").between(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(ranges)])
    pairs = F.array(*[F.struct(F.lit(i).alias("idx"), F.col(f"c{i}").alias("n_rows")) for i in range(len(ranges))])
    return sums.select(F.inline(pairs))


def counted(instants: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with their number of rows, zeros included; ``instants`` may repeat."""
    n = in_chunks(instants, chunks).groupBy("chunk_idx").agg(F.count("*").alias("n_rows"))
    return chunks.join(n, "chunk_idx", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))


def renumbered(chunks: DataFrame) -> DataFrame:
    """Chunks that have rows, numbered from 0 again."""
    order = Window.orderBy("chunk_idx")
    return chunks.where("n_rows > 0").withColumn("chunk_idx", F.row_number().over(order) - 1)


def stats(values: DataFrame, column: str) -> DataFrame:
    """min, max, mean, median, std (sample) of a few numbers; zeros for none, std 0 for fewer than two."""
    c = F.col(column)
    made = {"min": F.min(c), "max": F.max(c), "mean": F.avg(c), "median": F.median(c), "std": F.stddev_samp(c)}
    return values.agg(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in made.items()])


def iso(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def signatures(parts: DataFrame, symbol: str, git_hash: str) -> DataFrame:
    """Parts with the hash of (symbol, start, end, part, version)."""
    text = F.concat_ws("|", F.lit(symbol), iso(F.col("part_start_us")), iso(F.col("part_end_us")), F.col("part"), F.lit(git_hash))
    return parts.withColumn("signature", F.sha2(text, 256))


def session(signed: DataFrame) -> DataFrame:
    """The ordered list of signatures of one marking run, and its hash; a run's parts are three a chunk."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", "part_idx", "signature")))["signature"]
    return signed.agg(ordered.alias("chunks_list")).withColumn("chunks_list_hash", F.sha2(F.array_join("chunks_list", "|"), 256))


def manual(spark, symbol: str, table: str, note: str, start_us: int, end_us: int, created_us: int) -> DataFrame:
    """A chunk marked by hand; its hash tells symbol, note, table and range, not when it was marked."""
    row = spark.range(1).select(
        F.lit(symbol).alias("symbol"), F.lit(table).alias("source_table"), F.lit(note).alias("chunk_description"),
        F.timestamp_micros(F.lit(start_us)).alias("chunk_effective_start"), F.timestamp_micros(F.lit(end_us)).alias("chunk_effective_end"),
        F.timestamp_micros(F.lit(created_us)).alias("created_at"),
    )
    text = F.concat_ws("|", "symbol", "chunk_description", "source_table", iso(F.lit(start_us)), iso(F.lit(end_us)))
    return row.withColumn("chunk_hash", F.sha2(text, 256))


def latest(history: DataFrame, symbol: str, n: int) -> DataFrame:
    """The n newest manual chunks of a symbol."""
    return history.where(F.col("symbol") == symbol).orderBy(F.desc("created_at"), "chunk_hash").limit(n)


def gap_report(bounds: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """How far each table's first and last row lie inside the request: missing head and tail."""
    return bounds.withColumns({
        "head_gap_us": F.greatest(F.col("first_us") - start_us, F.lit(0)), "tail_gap_us": F.greatest(F.lit(end_us) - F.col("last_us"), F.lit(0)),
    })
