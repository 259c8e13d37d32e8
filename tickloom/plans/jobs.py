"""The engine's jobs: features and targets into the store, signals of online models, marked chunks.

Tapes have symbol, ms, trade_id, price, quantity and side; the store has (symbol, exchange_ts, feature_name,
feature_value). Every job replaces what the store held of its symbol, range and names, so it can be run again.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, horizons, kv, ridge, targets
from ..sources import tables as catalog_tables
from ..sources.scratch import drop, kept
from ..sources.trades import in_range
from .contract import Instance, guarded
from .models import Ridge, Runner
from .registry import Bundle

EPOCH = datetime.fromtimestamp(0, UTC)


def instant(ms: int) -> datetime:
    """The instant of a millisecond, without a detour over floating point."""
    return EPOCH + timedelta(milliseconds=ms)


def together(features: list[Instance]) -> list[list[Instance]]:
    """Instances that one computation gives: of one group, with equal parameters and horizons."""
    out: dict[tuple, list[Instance]] = {}
    for i in features:
        key = (i.template.group, i.summary_lookback_ms, i.summary_lookforward_ms, tuple(sorted(i.params.items()))) if i.template.group else (i.name,)
        out.setdefault(key, []).append(i)
    return list(out.values())


def values(features: list[Instance], trades: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """The features of the trades in [start, end) as rows of the store; every scan is padded by the features' horizons."""
    out = None
    for group in together(features):
        rows = kv.unpivot(guarded(group[0], trades, start_ms, end_ms), [i.name for i in group], ["symbol", "ms"])
        out = rows if out is None else out.unionByName(rows)
    return out.select("symbol", F.timestamp_millis("ms").alias("exchange_ts"), "feature_name", "feature_value")


def _span(trades: DataFrame, start_ms: int | None, end_ms: int | None) -> tuple[int, int] | None:
    if start_ms is None or end_ms is None:
        found = trades.agg(F.min("ms").alias("a"), F.max("ms").alias("b")).first()
        if found.a is None:
            return None
        start_ms, end_ms = found.a if start_ms is None else start_ms, found.b + 1 if end_ms is None else end_ms
    return (start_ms, end_ms) if start_ms < end_ms else None


def add_features(
    trades: DataFrame, path: str, symbol: str, bundle: Bundle, start_ms: int | None = None, end_ms: int | None = None, replace: bool = True,
    rows_per_batch: int | None = None, where=None, extra: dict[str, str] | None = None,
) -> DataFrame:
    """Computes the bundle's features of a symbol's trades into the store; gives each feature's rows in the range.

    ``where`` is a predicate on trades that holds ahead of every window. With ``rows_per_batch`` the range is
    computed in batches of so many trades, which can't change a value, for scans are padded.
    """
    spark, own = trades.sparkSession, trades.where(F.col("symbol") == symbol)
    own = own if where is None else own.where(where)
    span = _span(own, start_ms, end_ms)
    names = [i.name for i in bundle.instances]
    if span is None:
        return spark.createDataFrame([], "feature_name string, n_rows long")

    def store(a: int, b: int) -> None:
        rows = values(list(bundle.instances), own, a, b)
        if replace:
            kv.replace_range(spark, path, rows, symbol, instant(a), instant(b), names, extra=extra)
        else:
            kv.write(rows, path, extra=extra)

    if rows_per_batch is None:
        store(*span)
    else:
        inside = own.where(f"ms >= {span[0]} and ms < {span[1]}")
        horizons.run_batches(inside, rows_per_batch, lambda b: store(b.start, min(b.end, span[1])), end=span[1])
    return counts(spark, path, symbol, names, *span)


def counts(spark: SparkSession, path: str, symbol: str, names: list[str], start_ms: int, end_ms: int) -> DataFrame:
    """Rows of each name in the range, those without rows included."""
    found = kv.read(spark, path, names, symbol, instant(start_ms), instant(end_ms)).groupBy("feature_name").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(n,) for n in names], "feature_name string")
    return wanted.join(found, "feature_name", "left").select("feature_name", F.coalesce("n", F.lit(0).cast("long")).alias("n_rows"))


def add_targets(
    trades: DataFrame, path: str, symbol: str, aims: list[Instance], start_ms: int | None = None, end_ms: int | None = None, horizon_ms: int | None = None, replace: bool = True,
) -> DataFrame:
    """Computes targets into the store, for trades whose whole horizon lies in the tape; gives each target's rows.

    One range holds for all targets: it ends the longest look-forward (or ``horizon_ms``) before the tape's last trade.
    The forward trades themselves may lie beyond it.
    """
    spark, own = trades.sparkSession, trades.where(F.col("symbol") == symbol)
    names = [i.name for i in aims]
    horizon = max(i.summary_lookforward_ms for i in aims) if horizon_ms is None else horizon_ms
    emit = targets.emit_range(own, horizon, start_ms, end_ms).first()
    if emit.emit_start_ms is None or emit.emit_end_ms is None or emit.emit_start_ms >= emit.emit_end_ms:
        return spark.createDataFrame([(n, 0) for n in names], "feature_name string, n_rows long")
    span = emit.emit_start_ms, emit.emit_end_ms
    rows = values(aims, own, *span)
    if replace:
        kv.replace_range(spark, path, rows, symbol, *map(instant, span), names)
    else:
        kv.write(rows, path)
    return counts(spark, path, symbol, names, *span)


@dataclass(frozen=True)
class Report:
    """What the signal job did for a target and a model."""

    target: str
    signal: str
    rows: int
    train: int
    test: int
    train_end_ms: int
    skipped: tuple[str, ...]
    predictable: int
    trained: int
    predicted: int
    invalid: dict


def sync_signals(
    spark: SparkSession, path: str, symbol: str, aims: list[str], policies: dict[str, dict], models: list[Runner] | None = None,
    start_ms: int | None = None, end_ms: int | None = None, prefix: str = "", replace: bool = True, worst: int = 10,
) -> list[Report]:
    """Predicts every target's rows by every model from the store's features, each row from earlier blocks only.

    ``policies`` name the features and how their invalid values are filled; features without a row in the range are
    left out. Signals go back to the store under a name that tells target, model and inputs; a row without a
    prediction is NaN there. The 70/30 split is reported; a target that can't be split is an error.
    """
    out = []
    for aim in aims:
        span = None if start_ms is None else instant(start_ms), None if end_ms is None else instant(end_ms)
        store = kv.read(spark, path, [aim, *policies], symbol, *span).withColumn("ms", F.unix_millis("exchange_ts"))
        aimed = store.where(F.col("feature_name") == aim)
        split = horizons.require_split(aimed)
        present = {r.feature_name for r in kv.present(store, list(policies)).collect()}
        names = [n for n in policies if n in present]
        if not names:
            raise ValueError(f"{aim}: none of the features has a row in the range")
        # Within one instant a target's rows have no other order than their value.
        rows = kept(kv.matrix(store, aim, names), "matrix")
        worst_of = {r.feature_name: r.n_invalid for r in kv.invalid_counts(rows, [*names, "target"], worst).collect()}
        filled = kv.model_columns(rows, {n: policies[n] for n in names})
        inputs = [*names, *(f"{n}_invalid" for n in names if policies[n].get("onehot"))]
        for model in models or [Ridge()]:
            signal = ridge.signal_name(aim, model.tag, inputs, prefix)
            made = kept(model.signals(filled, inputs, ["ms", "target"]), "signals")
            ready = F.lit(True)
            for x in inputs:
                ready = ready & kv.is_finite(F.col(x))
            done = made.agg(F.count("*").alias("n"), F.count_if(ready).alias("ready"), F.count_if(ready & kv.is_finite(F.col("target"))).alias("trained"), F.count_if(~F.isnan("signal")).alias("predicted"), F.min("ms").alias("a"), F.max("ms").alias("b")).first()
            fresh = made.select("symbol", F.timestamp_millis("ms").alias("exchange_ts"), F.lit(signal).alias("feature_name"), F.col("signal").alias("feature_value"))
            if replace:
                kv.replace_range(spark, path, fresh, symbol, instant(done.a if start_ms is None else start_ms), instant(done.b + 1 if end_ms is None else end_ms), [signal], finite_only=False)
            else:
                kv.write(fresh, path, finite_only=False)
            drop(made)
            out.append(Report(aim, signal, done.n, split.n_train, split.n_test, split.train_end, tuple(n for n in policies if n not in present), done.ready, done.trained, done.predicted, worst_of))
        drop(rows)
    return out


@dataclass(frozen=True)
class Marked:
    """Instances (a row a table and part, with its rows), the session's row, and how far the tables miss the request."""

    instances: DataFrame
    session: DataFrame
    gaps: DataFrame


def bounds_in(tables: dict[str, DataFrame], start_us: int, end_us: int) -> dict[str, tuple[int, int]]:
    """First and last instant of each table within [start, end]; a table without any is an error."""
    out = {}
    for name, rows in tables.items():
        found = rows.where(F.col("us").between(start_us, end_us)).agg(F.min("us").alias("a"), F.max("us").alias("b")).first()
        if found.a is None:
            raise ValueError(f"{name} has no rows in the range")
        out[name] = found.a, found.b
    return out


def gap_report(spark: SparkSession, bounds: dict[str, tuple[int, int]], start_us: int, end_us: int) -> DataFrame:
    rows = spark.createDataFrame([(n, *b) for n, b in bounds.items()], "source_table string, first_us long, last_us long")
    return chunks.gap_report(rows, start_us, end_us)


def mark_chunks(
    spark: SparkSession, tables: dict[str, DataFrame], symbol: str, start_us: int, end_us: int, n: int, gap_us: int | None, version: str, created_us: int,
) -> Marked:
    """Cuts the first table's timeline within [start, end] into n chunks of equal effective time and each into train,
    validation and test, and counts every table's rows in them. ``tables`` have a column us and may be of one symbol.

    Chunks without rows in the first table are dropped before they are cut. Without a gap limit parts are thirds of
    wall time. An empty timeline, one without effective time, and chunks that collapse are errors.
    """
    names = list(tables)
    bounds = bounds_in(tables, start_us, end_us)
    low, high = bounds[names[0]]
    instants = chunks.timeline(tables[names[0]].where(F.col("us").between(low, high)), F.col("us"))
    segs = kept(chunks.segments(instants, gap_us), "segments")
    length = chunks.span(segs).first()
    if not length.total_real_us:
        raise ValueError("the timeline has no length")
    if not length.total_eff_us:
        raise ValueError("no time is left without the gaps")
    whole = chunks.closed(chunks.points(instants, chunks.boundaries(segs, n), n))
    counted = chunks.counted(tables[names[0]].where(F.col("us").between(low, high)), whole)
    # As many rows as were asked for: a local table from here on.
    counted = spark.createDataFrame(counted.collect(), counted.schema)
    if counted.where("collapsed").count():
        raise ValueError("chunks collapse: too many for this timeline")
    main = chunks.renumbered(counted).select("chunk_idx", "start_us", "end_us")
    if not main.count():
        raise ValueError("all chunks are empty")
    parts = chunks.thirds(main) if gap_us is None else chunks.effective_thirds(instants, main, gap_us)
    signed = chunks.signatures(parts, symbol, version)
    local = signed.orderBy("chunk_idx", "part_idx").collect()
    if any(r.collapsed for r in local):
        raise ValueError("a chunk is too short for three parts")
    local = spark.createDataFrame([(i, r.part, r.part_start_us, r.part_end_us, r.signature) for i, r in enumerate(local)], "chunk_idx int, part string, start_us long, end_us long, signature string")
    out = None
    for k, name in enumerate(names):
        one = chunks.counted(tables[name].where(F.col("us").between(start_us, end_us)), local).select(F.lit(k).alias("table_idx"), F.lit(name).alias("source_table"), "*")
        out = one if out is None else out.unionByName(one)
    out = kept(out, "instances")
    instances = out.select(
        F.lit(symbol).alias("symbol"), "source_table", F.timestamp_micros("start_us").alias("chunk_start"), F.timestamp_micros("end_us").alias("chunk_end"), F.col("part").alias("chunk_type"),
        F.col("signature").alias("chunk_signature_hash"), F.timestamp_micros(F.lit(created_us)).alias("create_time"), F.lit(version).alias("git_hash"), "n_rows", "table_idx", "chunk_idx",
    )
    ordered = F.array_sort(F.collect_list(F.struct("table_idx", "chunk_idx", "signature")))["signature"]
    session = out.agg(ordered.alias("chunks_list")).select(
        F.lit(symbol).alias("symbol"), F.timestamp_micros(F.lit(created_us)).alias("created_at"), "chunks_list", F.lit(version).alias("git_hash"),
        F.sha2(F.array_join("chunks_list", "|"), 256).alias("chunks_list_hash"),
    )
    drop(segs)
    return Marked(instances, session, gap_report(spark, bounds, start_us, end_us))


def store_marks(marked: Marked, chunk_table: str, session_table: str) -> None:
    """Appends instances and session to the engine's two chunk tables."""
    catalog_tables.append(marked.instances, chunk_table, "chunks")
    catalog_tables.append(marked.session, session_table, "chunk_sessions")


def row_stats(marked: Marked) -> DataFrame:
    """Distribution of each table's rows over its parts, and how many parts are empty."""
    c = F.col("n_rows")
    made = {"min": F.min(c), "max": F.max(c), "mean": F.avg(c), "median": F.median(c), "std": F.stddev_samp(c)}
    return marked.instances.groupBy("source_table").agg(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in made.items()], F.count_if(c == 0).alias("n_empty"))


def mark_by_hand(spark: SparkSession, tables: dict[str, DataFrame], symbol: str, note: str, start_us: int, end_us: int, created_us: int) -> DataFrame:
    """One chunk a table over the first table's rows within [start, end], with a note."""
    low, high = bounds_in(tables, start_us, end_us)[next(iter(tables))]
    out = None
    for name in tables:
        one = chunks.manual(spark, symbol, name, note, low, high, created_us)
        out = one if out is None else out.unionByName(one)
    return out
