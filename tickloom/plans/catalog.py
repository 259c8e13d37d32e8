"""One query per operator over the driver's tables, and DuckDB SQL that gives the same rows.

The event table plays the tape (see ``sources.trades.from_events``); it is also read as order events. Dates of
orders and line items serve as timelines for counts and splits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeaxis, values
from ..operators import bars, book, bootstrap, chunks, features, frames, horizons, kv, ridge, targets
from ..sources import tables
from ..sources import trades as source
from ..sources.scratch import file_system, kept, shared_folder
from ..streaming import run
from ..streaming import tape as stream
from . import contract, jobs, models, registry

L, H, RISE_H = 300_000, 4_000, 5_000
START_MS, END_MS = 28_401_600_000, 28_420_000_000
GAP_US, N_CHUNKS = 600_000_000, 7
_SPAN = jobs.instant(START_MS), jobs.instant(END_MS)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _ORACLES[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_events(spark, sf_dir)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event file as a stream of its folder."""
    known = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(known).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _r(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


def _rs(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


def _store(spark: SparkSession, sf_dir: str, names: list[str], momentum: bool = False) -> DataFrame:
    return kv.unpivot(features.rolling(tape(spark, sf_dir), L, momentum=momentum), names)


TAPE = """
tape AS (
  SELECT 'S' || (user_id % 2) AS symbol, CAST(epoch_us(ts) // 60000000 * 1000 AS BIGINT) AS ms, event_id AS trade_id, value AS price,
    CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS quantity,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'Buy' WHEN event_type IN ('view', 'error') THEN 'sell' ELSE 'other' END AS side
  FROM events)"""
_FRAME = f"(PARTITION BY symbol ORDER BY ms RANGE BETWEEN {L} PRECEDING AND 1 PRECEDING)"
_BUY, _SELL = "FILTER (WHERE upper(side) = 'BUY')", "FILTER (WHERE upper(side) = 'SELL')"
_METRICS = {
    "trade_count_buy": f"count(*) {_BUY} OVER w", "trade_count_sell": f"count(*) {_SELL} OVER w",
    "cvd_buy": f"coalesce(sum(quantity) {_BUY} OVER w, 0)", "cvd_sell": f"coalesce(sum(quantity) {_SELL} OVER w, 0)",
    "mean_price_buy": f"avg(price) {_BUY} OVER w", "mean_price_sell": f"avg(price) {_SELL} OVER w",
    "mean_volume_buy": f"avg(quantity) {_BUY} OVER w", "mean_volume_sell": f"avg(quantity) {_SELL} OVER w",
    "trade_spread_signed": f"avg(price) {_BUY} OVER w - avg(price) {_SELL} OVER w",
    "volume_balance": f"coalesce(sum(quantity) {_BUY} OVER w, 0) - coalesce(sum(quantity) {_SELL} OVER w, 0)",
}
ROLLED = f"rolled AS (SELECT symbol, ms, trade_id, {', '.join(f'{v} AS {k}' for k, v in _METRICS.items())} FROM tape WINDOW w AS {_FRAME})"


# Scans, bounds, counts.


@query(f"WITH {TAPE} SELECT trade_id, ms, price, quantity FROM tape WHERE symbol = 'S0' AND ms >= {START_MS} AND ms < {END_MS}")
def scan_symbol_range(spark, sf_dir):
    rows = tape(spark, sf_dir).withColumn("exchange_ts", timeaxis.from_ms(F.col("ms")))
    return source.scan(rows, "S0", *_SPAN, ["trade_id", "ms", "price", "quantity"])


@query(f"WITH {TAPE} SELECT symbol, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n_rows FROM tape GROUP BY symbol")
def table_bounds(spark, sf_dir):
    rows, out = tape(spark, sf_dir), None
    for symbol in ("S0", "S1"):
        one = source.bounds(rows.where(source.in_range(symbol)), "ms").select(F.lit(symbol).alias("symbol"), F.col("first_ts").alias("first_ms"), F.col("last_ts").alias("last_ms"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {TAPE} SELECT count(*) AS n_rows FROM tape WHERE symbol = 'S1' AND ms >= {START_MS} AND ms <= {END_MS}")
def count_range(spark, sf_dir):
    rows = tape(spark, sf_dir).withColumn("exchange_ts", timeaxis.from_ms(F.col("ms")))
    return rows.where(source.in_range("S1", *_SPAN, end_inclusive=True)).agg(F.count("*").alias("n_rows"))


@query(f"WITH {TAPE} SELECT DISTINCT symbol, ms FROM tape")
def distinct_timeline(spark, sf_dir):
    return chunks.timeline(tape(spark, sf_dir), F.col("ms"), ["symbol"]).withColumnRenamed("us", "ms")


@query(f"WITH {TAPE}, d AS (SELECT DISTINCT symbol, ms FROM tape) SELECT symbol, ms, min(ms) OVER (PARTITION BY symbol ORDER BY ms ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS next_ms FROM d QUALIFY next_ms IS NOT NULL")
def next_instant(spark, sf_dir):
    """The next distinct instant, from the segments of the timeline (the last instant has none)."""
    instants = chunks.timeline(tape(spark, sf_dir), F.col("ms"), ["symbol"])
    segs = chunks.segments(instants, None, ["symbol"], bucket_us=3_600_000)
    return segs.select("symbol", F.col("seg_start").alias("ms"), F.col("seg_end").alias("next_ms"))


# Rolling features.


def _feature_query(name: str) -> None:
    @query(f"WITH {TAPE}, {ROLLED} SELECT symbol, ms, trade_id, round(CAST({name} AS DOUBLE), 9) AS feature_value FROM rolled WHERE {name} IS NOT NULL", f"roll_{name}")
    def run(spark, sf_dir):
        return _store(spark, sf_dir, [name]).select("symbol", "ms", "trade_id", F.round("feature_value", 9).alias("feature_value"))


for _name in [*features.ROLLING, "volume_balance"]:
    _feature_query(_name)

_ALL = " UNION ALL ".join(f"SELECT symbol, ms, trade_id, '{n}' AS feature_name, round(CAST({n} AS DOUBLE), 9) AS feature_value FROM rolled WHERE {n} IS NOT NULL" for n in features.ROLLING)


@query(f"WITH {TAPE}, {ROLLED} {_ALL}")
def roll_features(spark, sf_dir):
    """All nine rolling features from one window, as key-value rows."""
    return _store(spark, sf_dir, features.ROLLING).withColumn("feature_value", F.round("feature_value", 9))


_MOMENTUM = f"SELECT symbol, ms, trade_id, arg_max(price, (ms, trade_id)) OVER w - arg_min(price, (ms, trade_id)) OVER w AS v FROM tape WINDOW w AS {_FRAME}"


@query(f"WITH {TAPE}, m AS ({_MOMENTUM}) SELECT symbol, ms, trade_id, round(v, 9) AS feature_value FROM m WHERE v IS NOT NULL")
def price_momentum(spark, sf_dir):
    return _store(spark, sf_dir, ["price_momentum"], momentum=True).select("symbol", "ms", "trade_id", F.round("feature_value", 9).alias("feature_value"))


# Targets.

_AHEAD = f"""
ahead AS (
  SELECT *, arg_min(price, trade_id) OVER (PARTITION BY symbol ORDER BY ms RANGE BETWEEN {H} FOLLOWING AND {H} FOLLOWING) AS nxt,
    max(price) {_SELL} OVER (PARTITION BY symbol ORDER BY ms RANGE BETWEEN 1 FOLLOWING AND {RISE_H} FOLLOWING) AS high
  FROM tape)"""


def _delta_sql(ratio: float, price: str = "price", ahead: str = "nxt") -> str:
    return f"CASE WHEN abs({ahead} - {price}) < abs({price}) * {ratio} THEN 0.0 ELSE {ahead} - {price} END"


def _target_queries(label: str, ratio: float) -> None:
    @query(f"WITH {TAPE}, {_AHEAD} SELECT symbol, ms, trade_id, round({_delta_sql(ratio)}, 9) AS price_delta FROM ahead WHERE nxt IS NOT NULL", f"target_delta_trade_time{label}")
    def delta(spark, sf_dir):
        return targets.forward(tape(spark, sf_dir), deadband=ratio).where("price_delta is not null").select("symbol", "ms", "trade_id", *_r("price_delta"))

    @query(
        f"WITH {TAPE}, {_AHEAD} SELECT symbol, ms, trade_id, CASE WHEN nxt - price > price * {ratio} THEN 1.0 WHEN nxt - price < -(price * {ratio}) THEN -1.0 ELSE 0.0 END AS price_direction FROM ahead WHERE nxt IS NOT NULL",
        f"target_direction{label}",
    )
    def direction(spark, sf_dir):
        return targets.forward(tape(spark, sf_dir), direction=ratio).where("price_direction is not null").select("symbol", "ms", "trade_id", "price_direction")


_target_queries("", 0.0045)
_target_queries("_wide", 0.5)


@query(f"WITH {TAPE}, {_AHEAD}, z AS (SELECT symbol, ms, trade_id, price, coalesce(nxt, 0.0) AS nxt FROM ahead) SELECT symbol, ms, trade_id, round({_delta_sql(0.0045)}, 9) AS price_delta FROM z")
def target_delta_missing_zero(spark, sf_dir):
    return targets.forward(tape(spark, sf_dir), missing="zero").select("symbol", "ms", "trade_id", *_r("price_delta"))


@query(f"WITH {TAPE}, {_AHEAD} SELECT symbol, ms, trade_id, CAST(coalesce(high, -1.0) > price * (1 + 0.0055) AS DOUBLE) AS sell_rise FROM ahead")
def target_sell_rise(spark, sf_dir):
    return targets.forward(tape(spark, sf_dir), rise_ms=RISE_H).select("symbol", "ms", "trade_id", "sell_rise")


@query(f"""WITH {TAPE}, b AS (SELECT symbol, ms // 1000 * 1000 AS bin_ms, arg_max(price, (ms, trade_id)) AS price_last FROM tape GROUP BY ALL)
SELECT a.symbol, a.bin_ms, round({_delta_sql(0.0045, 'a.price_last', 'z.price_last')}, 9) AS price_delta FROM b a JOIN b z ON z.symbol = a.symbol AND z.bin_ms = a.bin_ms + {H}""")
def target_delta_binned(spark, sf_dir):
    return targets.binned_delta(tape(spark, sf_dir), H).select("symbol", "bin_ms", *_r("price_delta"))


@query(f"WITH {TAPE} SELECT greatest(min(ms), {START_MS}) AS emit_start_ms, max(ms) - {H} + 1 AS emit_end_ms FROM tape")
def emit_range(spark, sf_dir):
    return targets.emit_range(tape(spark, sf_dir), H, start_ms=START_MS)


# The key-value store.

_KEPT = ["mean_price_buy", "mean_price_sell", "cvd_buy"]
_WIDE = f"""
wide AS (
  SELECT symbol, ms, {', '.join(f'max(CAST({n} AS DOUBLE)) AS {n}' for n in _KEPT)} FROM rolled
  GROUP BY symbol, ms HAVING {' OR '.join(f'max({n}) IS NOT NULL' for n in _KEPT)})"""


@query(f"WITH {TAPE}, {ROLLED}, {_WIDE} SELECT symbol, ms, {_rs(*_KEPT)} FROM wide")
def kv_pivot(spark, sf_dir):
    return kv.pivot(_store(spark, sf_dir, _KEPT), _KEPT).select("symbol", "ms", *_r(*_KEPT))


@query(f"WITH {TAPE}, {ROLLED} SELECT 'cvd_buy' AS feature_name WHERE EXISTS (SELECT 1 FROM rolled WHERE cvd_buy IS NOT NULL) UNION ALL SELECT 'mean_price_sell' WHERE EXISTS (SELECT 1 FROM rolled WHERE mean_price_sell IS NOT NULL)")
def present_features(spark, sf_dir):
    return kv.present(_store(spark, sf_dir, ["cvd_buy", "mean_price_sell"]), ["cvd_buy", "mean_price_sell", "no_such_feature"])


def _matrix(spark, sf_dir):
    made = features.rolling(tape(spark, sf_dir), L)
    aims = targets.forward(tape(spark, sf_dir), deadband=0.5).withColumn("aim", F.col("price_delta"))
    store = kept(kv.unpivot(made, _KEPT).unionByName(kv.unpivot(aims, ["aim"])), "store")  # the store is a table
    return kv.matrix(store, "aim", _KEPT, order=["trade_id"])


_MATRIX = f"""
aim AS (SELECT symbol, ms, trade_id, {_delta_sql(0.5)} AS target FROM ahead WHERE nxt IS NOT NULL),
matrix AS (SELECT aim.*, {', '.join(_KEPT)} FROM aim LEFT JOIN wide USING (symbol, ms))"""


@query(f"WITH {TAPE}, {ROLLED}, {_WIDE}, {_AHEAD}, {_MATRIX} SELECT symbol, ms, trade_id, {_rs('target', *_KEPT)} FROM matrix")
def kv_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("symbol", "ms", "trade_id", *_r("target", *_KEPT))


@query(f"WITH {TAPE}, {_AHEAD} SELECT trade_id, CAST(nxt IS NULL AS INTEGER) AS nxt_invalid, coalesce(nxt, -1.0) AS nxt FROM ahead")
def fill_invalid(spark, sf_dir):
    spread = frames.bucketed(tape(spark, sf_dir), ahead_ms=H)
    rows = frames.owned(spread.withColumn("nxt", frames.at_offset(F.col("price"), F.col("trade_id"), H)))
    return kv.model_columns(rows, {"nxt": {"special_value": -1, "onehot": True}}).select("trade_id", "nxt_invalid", "nxt")


@query("SELECT o_orderkey, CAST(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) IS NULL AS INTEGER) AS priority_invalid, coalesce(TRY_CAST(o_orderstatus AS DOUBLE), 7.5) AS status_filled FROM orders")
def fill_text(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    priority = values.invalid_flag(F.substring("o_orderpriority", 1, 1))
    return orders.select("o_orderkey", priority.alias("priority_invalid"), values.fill_invalid(F.col("o_orderstatus"), "7.5").alias("status_filled"))


@query(f"""WITH {TAPE}, {_AHEAD} SELECT trade_id, coalesce(last_value(high IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ms, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -5.0) AS high, coalesce(nxt, 0.0) AS nxt FROM ahead""")
def fill_policies(spark, sf_dir):
    spread = frames.bucketed(tape(spark, sf_dir), ahead_ms=RISE_H)
    made = spread.withColumns({"nxt": frames.at_offset(F.col("price"), F.col("trade_id"), H), "high": frames.ahead_max(F.when(values.is_sell(F.col("side")), F.col("price")), RISE_H)})
    rows = kv.filled(frames.owned(made), {"high": "causal_ffill", "nxt": "zero"}, bucket_ms=600_000)
    return rows.select("trade_id", F.coalesce("high", F.lit(-5.0)).alias("high"), "nxt")


_COUNTED = " UNION ALL ".join(f"SELECT '{n}' AS feature_name, count(*) FILTER (WHERE {n} IS NULL) AS n_invalid FROM rolled" for n in [*features.ROLLING])


@query(f"WITH {TAPE}, {ROLLED}, c AS ({_COUNTED}) SELECT feature_name, CAST(n_invalid AS BIGINT) AS n_invalid FROM c ORDER BY n_invalid DESC, feature_name LIMIT 5")
def invalid_counts(spark, sf_dir):
    return kv.invalid_counts(features.rolling(tape(spark, sf_dir), L), features.ROLLING, 5)


# Bars.

_Q = {"price_q25": 0.25, "price_q75": 0.75, "q01": 0.01, "q99": 0.99}


_BARS = f"""SELECT symbol, ms // 60000 * 60000 AS bin_ms, count(*) AS trade_count, count(*) {_BUY} AS trade_count_buy,
count(*) {_SELL} AS trade_count_sell, CAST(coalesce(sum(quantity) {_BUY}, 0) AS DOUBLE) AS volume_buy, CAST(coalesce(sum(quantity) {_SELL}, 0) AS DOUBLE) AS volume_sell,
CAST(sum(quantity) AS DOUBLE) AS volume_total, round(coalesce(sum(price * quantity) {_BUY}, 0), 4) AS notional_buy,
round(coalesce(sum(price * quantity) {_SELL}, 0), 4) AS notional_sell, round(sum(price * quantity), 4) AS notional_total,
arg_max(price, (ms, trade_id)) AS price_last, arg_min(price, (ms, trade_id)) AS price_first, min(price) AS price_min, max(price) AS price_max,
round(avg(price), 9) AS price_mean, round(stddev_samp(price), 6) AS price_std,
{', '.join(f'round(quantile_cont(price, {q}), 6) AS {n}' for n, q in _Q.items())} FROM tape GROUP BY ALL"""


@query(f"WITH {TAPE} {_BARS}")
def bars_minute(spark, sf_dir):
    return _rounded_bars(bars.bars(tape(spark, sf_dir), 60_000))


def _rounded_bars(made):
    rounded = {"price_mean": F.round("price_mean", 9)} | {n: F.round(n, 6) for n in ("price_std", *_Q)} | {n: F.round(n, 4) for n in ("notional_buy", "notional_sell", "notional_total")}
    return made.withColumns(rounded)


@query(f"WITH {TAPE}, b AS ({_BARS}) SELECT * FROM b WHERE symbol = 'S1' AND bin_ms >= {START_MS} AND bin_ms < {END_MS} ORDER BY bin_ms")
def scan_bars(spark, sf_dir):
    """Bars of a symbol and range, all columns, in time order."""
    made = bars.bars(tape(spark, sf_dir), 60_000).withColumn("exchange_ts", timeaxis.from_ms(F.col("bin_ms")))
    return _rounded_bars(source.scan_bars(made, "S1", *_SPAN).drop("exchange_ts"))


# Chunks.

_EVENTS = "i AS (SELECT DISTINCT epoch_us(ts) AS us FROM events)"
_SEGS = f"""
s0 AS (SELECT lag(us) OVER (ORDER BY us) AS seg_start, us AS seg_end FROM i),
s1 AS (SELECT *, seg_end - seg_start AS real_us, CASE WHEN seg_end - seg_start > {GAP_US} THEN 0 ELSE seg_end - seg_start END AS eff_us FROM s0 WHERE seg_start IS NOT NULL),
segs AS (SELECT *, CAST(sum(eff_us) OVER (ORDER BY seg_end) AS BIGINT) AS cum_us FROM s1),
tot AS (SELECT CAST(sum(eff_us) AS BIGINT) AS total FROM segs)"""
_BOUNDS = f"""
b AS (
  SELECT CAST(idx AS INTEGER) AS idx, seg_start + total * idx // {N_CHUNKS} - (cum_us - eff_us) AS boundary_us
  FROM range(1, {N_CHUNKS}) AS t(idx), tot JOIN segs ON eff_us > 0 AND cum_us - eff_us < total * idx // {N_CHUNKS} AND total * idx // {N_CHUNKS} <= cum_us)"""
_GLOBAL = f"""
p AS (SELECT idx, boundary_us AS point FROM b UNION ALL SELECT 0, min(us) FROM i UNION ALL SELECT {N_CHUNKS}, max(us) FROM i),
g0 AS (SELECT idx, point, lead(point) OVER (ORDER BY idx) AS nxt FROM p),
g AS (SELECT CAST(idx AS INTEGER) AS chunk_idx, point AS start_us, CASE WHEN idx = {N_CHUNKS} - 1 THEN nxt ELSE nxt - 1000000 END AS end_us FROM g0 WHERE nxt IS NOT NULL)"""
_THIRDS = f"""
ci AS (SELECT chunk_idx, us FROM i JOIN g ON us BETWEEN start_us AND end_us),
c0 AS (SELECT chunk_idx, lag(us) OVER (PARTITION BY chunk_idx ORDER BY us) AS seg_start, us AS seg_end FROM ci),
c1 AS (SELECT *, CASE WHEN seg_end - seg_start > {GAP_US} THEN 0 ELSE seg_end - seg_start END AS eff_us FROM c0 WHERE seg_start IS NOT NULL),
cs AS (SELECT *, CAST(sum(eff_us) OVER (PARTITION BY chunk_idx ORDER BY seg_end) AS BIGINT) AS cum_us FROM c1),
ct AS (SELECT chunk_idx, CAST(sum(eff_us) AS BIGINT) AS total FROM c1 GROUP BY 1),
cb AS (
  SELECT chunk_idx, k, seg_start + total * k // 3 - (cum_us - eff_us) AS point FROM ct JOIN cs USING (chunk_idx), (VALUES (1), (2)) AS t(k)
  WHERE eff_us > 0 AND cum_us - eff_us < total * k // 3 AND total * k // 3 <= cum_us),
cp AS (SELECT * FROM cb UNION ALL SELECT chunk_idx, 0, start_us FROM g UNION ALL SELECT chunk_idx, 3, end_us FROM g),
cq AS (SELECT chunk_idx, k, point, lead(point) OVER (PARTITION BY chunk_idx ORDER BY k) AS nxt FROM cp),
parts AS (
  SELECT chunk_idx, CAST(k AS INTEGER) AS part_idx, CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS part,
    point AS part_start_us, CASE WHEN k = 2 THEN nxt ELSE nxt - 1000000 END AS part_end_us FROM cq WHERE nxt IS NOT NULL)"""
_ISO = "strftime(make_timestamp({0} // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_SIGNED = f"signed AS (SELECT *, sha256('EVT|' || {_ISO.format('part_start_us')} || '|' || {_ISO.format('part_end_us')} || '|' || part || '|v1') AS signature FROM parts)"


def _instants(spark, sf_dir):
    return chunks.timeline(spark.read.parquet(f"{sf_dir}/events.parquet"), timeaxis.to_us(F.col("ts")))


def _global(spark, sf_dir):
    return chunks.global_chunks(_instants(spark, sf_dir), N_CHUNKS, GAP_US).drop("collapsed")


@query(f"WITH {_EVENTS}, {_SEGS} SELECT seg_start, seg_end, real_us, eff_us, cum_us FROM segs")
def eff_segments(spark, sf_dir):
    return chunks.segments(_instants(spark, sf_dir), GAP_US)


@query(f"WITH {_EVENTS}, {_SEGS} SELECT CAST(sum(real_us) AS BIGINT) AS total_real_us, CAST(sum(eff_us) AS BIGINT) AS total_eff_us FROM segs")
def eff_span(spark, sf_dir):
    return chunks.span(chunks.segments(_instants(spark, sf_dir), GAP_US))


@query(f"WITH {_EVENTS}, {_SEGS}, {_BOUNDS} SELECT idx, boundary_us FROM b")
def eff_boundaries(spark, sf_dir):
    return chunks.boundaries(chunks.segments(_instants(spark, sf_dir), GAP_US), N_CHUNKS)


@query(f"WITH {_EVENTS}, {_SEGS}, {_BOUNDS}, {_GLOBAL} SELECT * FROM g")
def global_chunks(spark, sf_dir):
    return _global(spark, sf_dir)


@query(f"WITH {_EVENTS}, {_SEGS}, {_BOUNDS}, {_GLOBAL}, {_THIRDS} SELECT * FROM parts")
def tvt_chunks(spark, sf_dir):
    instants = _instants(spark, sf_dir)
    return chunks.effective_thirds(instants, chunks.global_chunks(instants, N_CHUNKS, GAP_US), GAP_US).drop("collapsed")


@query(f"""WITH {_EVENTS}, {_SEGS}, {_BOUNDS}, {_GLOBAL}, w AS (SELECT chunk_idx, start_us AS s, end_us AS e, (end_us - start_us) // 3 AS a, (end_us - start_us) * 2 // 3 AS z FROM g)
SELECT chunk_idx, 0 AS part_idx, 'train' AS part, s AS part_start_us, s + a - 1000000 AS part_end_us FROM w
UNION ALL SELECT chunk_idx, 1, 'validation', s + a, s + z - 1000000 FROM w UNION ALL SELECT chunk_idx, 2, 'test', s + z, e FROM w""")
def tvt_wall(spark, sf_dir):
    return chunks.thirds(_global(spark, sf_dir)).drop("collapsed")


@query(f"WITH {_EVENTS}, {_SEGS}, {_BOUNDS}, {_GLOBAL} SELECT chunk_idx, start_us, end_us, (SELECT count(*) FROM events WHERE epoch_us(ts) BETWEEN start_us AND end_us) AS n_rows FROM g")
def chunk_counts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(timeaxis.to_us(F.col("ts")).alias("us"))
    return chunks.counted(rows, _global(spark, sf_dir))


@query(f"WITH {_EVENTS}, {_SEGS}, {_BOUNDS}, {_GLOBAL}, {_THIRDS}, {_SIGNED} SELECT * FROM signed")
def chunk_signatures(spark, sf_dir):
    return chunks.signatures(tvt_chunks(spark, sf_dir), "EVT", "v1")


@query(f"WITH {_EVENTS}, {_SEGS}, {_BOUNDS}, {_GLOBAL}, {_THIRDS}, {_SIGNED} SELECT len(list(signature)) AS n_parts, sha256(string_agg(signature, '|' ORDER BY chunk_idx, part_idx)) AS chunks_list_hash FROM signed")
def chunk_session(spark, sf_dir):
    made = chunks.session(chunk_signatures(spark, sf_dir))
    return made.select(F.size("chunks_list").cast("long").alias("n_parts"), "chunks_list_hash")


_YEARS = [(f"{y}-01-01", f"{y}-12-31") for y in range(1995, 2003)]


@query(" UNION ALL ".join(f"SELECT {i} AS idx, count(*) AS n_rows FROM lineitem WHERE l_shipdate BETWEEN '{a}' AND '{b}'" for i, (a, b) in enumerate(_YEARS)))
def many_range_counts(spark, sf_dir):
    day = lambda x: int(timeaxis.parse_instant(x).timestamp() * 1_000_000)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return chunks.counts(rows, timeaxis.to_us(F.col("l_shipdate")), [(day(a), day(b)) for a, b in _YEARS])


_STATS = "SELECT CAST(min(n) AS DOUBLE) AS min, CAST(max(n) AS DOUBLE) AS max, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median, round(stddev_samp(n), 6) AS std"


@query(f"WITH d AS (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1) {_STATS} FROM d")
def chunk_stats(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderdate").agg(F.count("*").alias("n"))
    return chunks.stats(days, "n").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT o_orderkey, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def latest_rows(spark, sf_dir):
    """The newest entries of a history: a top-k report."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"symbol": F.col("o_orderpriority"), "created_at": F.col("o_orderdate"), "chunk_hash": F.col("o_orderkey")})
    return chunks.latest(orders, "1-URGENT", 10).select("o_orderkey", "created_at")


# Horizons, splits, batches.


@query(f"WITH {_EVENTS}, {_SEGS}, {_BOUNDS}, {_GLOBAL} SELECT chunk_idx, least(start_us + 3600000000 + 1000000, end_us) AS embargo_start_us, greatest(end_us - 7200000000 - 1000000, start_us) AS purge_end_us, least(start_us + 3600000000 + 1000000, end_us) >= end_us AS embargo_empty FROM g")
def embargo_purge(spark, sf_dir):
    start, end = F.col("start_us"), F.col("end_us")
    moved = horizons.embargo(start, end, 3_600_000_000)
    return _global(spark, sf_dir).select("chunk_idx", moved.alias("embargo_start_us"), horizons.purge(start, end, 7_200_000_000).alias("purge_end_us"), horizons.is_empty(moved, end).alias("embargo_empty"))


@query(f"""WITH {TAPE}, c AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.7) AS BIGINT) AS cut FROM tape),
o AS (SELECT ms, row_number() OVER (ORDER BY ms) AS k FROM tape), e AS (SELECT ms AS edge FROM o, c WHERE k = cut)
SELECT n AS n_rows, (SELECT count(*) FROM tape, e WHERE ms <= edge) AS n_train, (SELECT count(*) FROM tape, e WHERE ms > edge) AS n_test, (SELECT min(ms) FROM tape, e WHERE ms > edge) AS train_end FROM c""")
def split_70_30(spark, sf_dir):
    return horizons.train_share(tape(spark, sf_dir))


@query(f"WITH {TAPE} SELECT ms FROM tape ORDER BY ms LIMIT 1 OFFSET 700")
def kth_instant(spark, sf_dir):
    return horizons.kth_instant(tape(spark, sf_dir), 700)


@query(f"""WITH RECURSIVE {TAPE}, d AS (SELECT symbol, ms, count(*) AS n FROM tape GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ms) AS k FROM d),
r AS (SELECT symbol, k, ms, n, 0 AS batch, n AS filled FROM o WHERE k = 1
  UNION ALL SELECT o.symbol, o.k, o.ms, o.n, CASE WHEN r.filled >= 700 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.filled >= 700 THEN o.n ELSE r.filled + o.n END
  FROM r JOIN o ON o.symbol = r.symbol AND o.k = r.k + 1),
g AS (SELECT symbol, batch, min(ms) AS start_ms, max(ms) AS last_ms, CAST(sum(n) AS BIGINT) AS n_rows FROM r GROUP BY 1, 2)
SELECT symbol, batch, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY symbol ORDER BY batch), last_ms + 1000) AS end_ms, n_rows FROM g""")
def row_batches(spark, sf_dir):
    return horizons.row_batches(tape(spark, sf_dir), 700, ["symbol"])


# Online ridge.

_ALPHA, _BLOCK = 1.0, 64
_RIDGE = f"""
x AS (SELECT symbol, ms, trade_id, target, mean_price_buy AS a, mean_price_sell AS z FROM matrix),
k AS (SELECT *, CAST(a IS NOT NULL AND z IS NOT NULL AS INTEGER) AS ready FROM x),
t AS (SELECT *, CAST(sum(ready) OVER (PARTITION BY symbol ORDER BY ms, trade_id) AS BIGINT) AS run FROM k),
gr AS (SELECT symbol, (run - 1) // {_BLOCK} AS block, sum(a * a) AS aa, sum(a * z) AS az, sum(z * z) AS zz, sum(a * target) AS ay, sum(z * target) AS zy, count(*) AS n
  FROM t WHERE ready = 1 GROUP BY 1, 2)"""
_GRAMS = ", ".join(f"round({c} / 1000, 4) AS {c}" for c in ("aa", "az", "zz", "ay", "zy"))
_PREFIX = f"{TAPE}, {ROLLED}, {_WIDE}, {_AHEAD}, {_MATRIX}, {_RIDGE}"


@query(f"WITH {_PREFIX} SELECT symbol, block, {_GRAMS} FROM gr WHERE n = {_BLOCK}")
def ridge_gram(spark, sf_dir):
    rows = _matrix(spark, sf_dir).withColumn("__train", values.is_finite(F.col("mean_price_buy") + F.col("mean_price_sell")).cast("long"))
    rows = ridge.running_total(rows, F.col("__train"), ["ms", "trade_id"], "__k", F.floor(F.col("ms") / 3_600_000), ["symbol"])
    made = ridge.grams(rows, ["mean_price_buy", "mean_price_sell"], "target", ["symbol"], _BLOCK)
    names = {"g_0_0": "aa", "g_0_1": "az", "g_1_1": "zz", "b_0": "ay", "b_1": "zy"}
    return made.select("symbol", F.col("__block").alias("block"), *[F.round(F.col(c) / 1000, 4).alias(n) for c, n in names.items()])


@query(f"""WITH {_PREFIX},
cs AS (SELECT symbol, block + 1 AS done, {', '.join(f'sum({c}) OVER (PARTITION BY symbol ORDER BY block) + {a} AS {c}' for c, a in (('aa', _ALPHA), ('az', 0), ('zz', _ALPHA), ('ay', 0), ('zy', 0)))} FROM gr WHERE n = {_BLOCK}),
co AS (SELECT symbol, done, (zz * ay - az * zy) / (aa * zz - az * az) AS wa, (aa * zy - az * ay) / (aa * zz - az * az) AS wz FROM cs)
SELECT t.symbol, ms, trade_id, (run - ready) // {_BLOCK} AS blocks_done, CASE WHEN ready = 1 THEN round(a * wa + z * wz, 4) END AS signal
FROM t LEFT JOIN co ON co.symbol = t.symbol AND co.done = (run - ready) // {_BLOCK}""")
def ridge_signal(spark, sf_dir):
    made = ridge.signals(_matrix(spark, sf_dir), ["mean_price_buy", "mean_price_sell"], alpha=_ALPHA, block=_BLOCK)
    return made.select("symbol", "ms", "trade_id", "blocks_done", F.round(F.nanvl("signal", F.lit(None).cast("double")), 4).alias("signal"))


@query(f"""WITH {_PREFIX} SELECT 'signal aim ridge {{mean_price_buy,mean_price_sell}}' AS feature_name, count(*) AS n_rows,
  CAST(sum(ready) AS BIGINT) AS n_predictable, CAST(sum(CASE WHEN ready = 1 AND (run - ready) // {_BLOCK} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_predicted FROM t""")
def ridge_counters(spark, sf_dir):
    """Rows, rows with all inputs, and rows with a signal, under the signal's name in the store."""
    names = ["mean_price_buy", "mean_price_sell"]
    made = ridge.signals(_matrix(spark, sf_dir), names, alpha=_ALPHA, block=_BLOCK)
    ready = values.is_finite(F.col(names[0])) & values.is_finite(F.col(names[1]))
    counted = made.agg(F.count("*").alias("n_rows"), F.count_if(ready).alias("n_predictable"), F.count_if(~F.isnan("signal")).alias("n_predicted"))
    return counted.select(F.lit(ridge.signal_name("aim", "ridge", names)).alias("feature_name"), "*")


# Order book: events as orders; an error removes its user's order.


def order_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
    size = F.when(F.col("event_type") == "error", 0.0).otherwise((F.get_json_object("props", "$.k").cast("long") + 1).cast("double"))
    return events.select(
        F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string")).alias("symbol"), F.col("event_id").alias("seq"), F.col("user_id").alias("uid"),
        F.when(F.floor(F.col("user_id") / 2) % 2 == 0, "bid").otherwise("ask").alias("side"),
        F.when(F.floor(F.col("user_id") / 2) % 2 == 0, F.floor("value") % 20).otherwise(F.floor("value") % 20 + 15).cast("double").alias("price"), size.alias("size"),
    )


_BOOK = """
ev AS (
  SELECT 'S' || (user_id % 2) AS symbol, event_id AS seq, user_id AS uid, CASE WHEN user_id // 2 % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
    floor(value) % 20 + CASE WHEN user_id // 2 % 2 = 0 THEN 0 ELSE 15 END AS price,
    CASE WHEN event_type = 'error' THEN 0.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 END AS size
  FROM events),
gone AS (SELECT symbol, uid, max(seq) AS seq FROM ev WHERE size = 0 GROUP BY 1, 2),
alive AS (SELECT ev.* FROM ev LEFT JOIN gone USING (symbol, uid) WHERE gone.seq IS NULL OR ev.seq > gone.seq),
ord AS (SELECT symbol, uid, arg_min(side, seq) AS side, arg_min(price, seq) AS price, arg_max(size, seq) AS size FROM alive GROUP BY 1, 2),
lev AS (SELECT symbol, side, CAST(price AS DOUBLE) AS price, CAST(sum(size) AS DOUBLE) AS size, count(*) AS n_orders, CAST(price * sum(size) AS DOUBLE) AS volume FROM ord GROUP BY symbol, side, price),
best AS (SELECT symbol, max(price) FILTER (WHERE side = 'bid') AS best_bid, min(price) FILTER (WHERE side = 'ask') AS best_ask FROM lev GROUP BY 1)"""


@query(f"WITH {_BOOK} SELECT * FROM lev")
def book_levels(spark, sf_dir):
    return book.levels(book.living(order_events(spark, sf_dir)))


@query(f"WITH {_BOOK} SELECT * FROM best")
def book_top(spark, sf_dir):
    return book.top(book.living(order_events(spark, sf_dir)))


@query(f"""WITH {_BOOK}, seen AS (SELECT lev.* FROM lev JOIN best USING (symbol) WHERE (side = 'bid' AND (best_ask IS NULL OR price < best_ask)) OR (side = 'ask' AND (best_bid IS NULL OR price > best_bid))),
ranked AS (SELECT symbol, side, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS INTEGER) AS level, price, size, n_orders, volume FROM seen)
SELECT * FROM ranked WHERE level <= 5""")
def book_depth(spark, sf_dir):
    return book.depth(book.living(order_events(spark, sf_dir)), 5)


# Streams, over what the event table holds now.


_STREAMED = ["symbol", "bin_ms", "trade_count", "trade_count_buy", "trade_count_sell", "volume_buy", "volume_sell", "volume_total", "notional_total", "price_last", "price_first", "price_min", "price_max", "price_mean", "price_std"]


@query(f"WITH {TAPE}, b AS ({_BARS}) SELECT {', '.join(_STREAMED)} FROM b")
def stream_bars(spark, sf_dir):
    """Bars of a stream; their quantiles are approximate and not compared."""
    trades = source.trades_of(event_stream(spark, sf_dir)).withColumn("exchange_ts", timeaxis.from_ms(F.col("ms")))
    made = run.available(stream.bars(trades, "1 minute"), "complete").withColumn("bin_ms", F.unix_millis("exchange_ts"))
    return made.withColumns({"price_mean": F.round("price_mean", 9), "price_std": F.round("price_std", 6), "notional_total": F.round("notional_total", 4)}).select(*_STREAMED)


@query(f"WITH {TAPE}, {ROLLED} SELECT symbol, ms, trade_id, trade_count_buy, trade_count_sell, CAST(cvd_buy AS DOUBLE) AS cvd_buy, CAST(cvd_sell AS DOUBLE) AS cvd_sell FROM rolled")
def stream_rolling(spark, sf_dir):
    made = run.available(stream.rolling(source.trades_of(event_stream(spark, sf_dir)), L))
    return made.select("symbol", "ms", "trade_id", "trade_count_buy", "trade_count_sell", "cvd_buy", "cvd_sell")


@query(f"WITH {_BOOK} SELECT best.symbol, best_bid, best_ask FROM best")
def stream_book(spark, sf_dir):
    made = run.available(stream.book(order_events(spark, sf_dir, event_stream(spark, sf_dir))), "update")
    return made.groupBy("symbol").agg(F.max_by("best_bid", "seq").alias("best_bid"), F.max_by("best_ask", "seq").alias("best_ask"))


# Bootstrap.

_CORR = "SELECT 'f' || l_linenumber AS feature, l_returnflag AS target, CAST(l_suppkey AS INTEGER) AS chunk, round((sum(CAST(round(l_discount * 100) AS BIGINT)) - 5 * count(*)) / count(*) / 100, 6) AS corr, count(*) AS n_rows FROM lineitem GROUP BY ALL"


def _corr(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    grouped = items.groupBy(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"), F.col("l_returnflag").alias("target"), F.col("l_suppkey").cast("int").alias("chunk"))
    return grouped.agg(F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.count("*").alias("n_rows")).select(
        "feature", "target", "chunk", F.round((F.col("d") - 5 * F.col("n_rows")) / F.col("n_rows") / 100, 6).alias("corr"), "n_rows"
    )


@query(f"WITH c AS ({_CORR}) SELECT feature, target, round(avg(corr), 9) AS avg_corr, round(avg(abs(corr)), 9) AS weighted_score, round(avg(CAST(corr <= 0 AS INTEGER)), 9) AS p_value_le_zero FROM c GROUP BY ALL")
def bootstrap_summary(spark, sf_dir):
    return bootstrap.summary(_corr(spark, sf_dir)).select("feature", "target", *_r("avg_corr", "weighted_score", "p_value_le_zero"))


_DRAWN = f"""c AS ({_CORR}),
g AS (SELECT feature, target, list(corr ORDER BY chunk) AS a FROM c GROUP BY ALL HAVING count(*) > 1),
d AS (SELECT feature, target, s, a[CAST(('0x' || substr(md5(concat_ws('|', '0', feature, target, CAST(s AS VARCHAR), CAST(i AS VARCHAR))), 1, 8)) AS BIGINT) % len(a) + 1] AS corr
  FROM g, range(50) AS t(s), unnest(range(len(a))) AS u(i))"""


@query(f"WITH {_DRAWN} SELECT feature, target, CAST(s AS INTEGER) AS sample, round(avg(corr), 9) AS avg_corr, round(avg(abs(corr)), 9) AS weighted_score, round(avg(CAST(corr <= 0 AS INTEGER)), 9) AS p_value_le_zero FROM d GROUP BY ALL")
def bootstrap_samples(spark, sf_dir):
    return bootstrap.samples(_corr(spark, sf_dir), 50).select("feature", "target", "sample", *_r("avg_corr", "weighted_score", "p_value_le_zero"))


@query(f"WITH c AS ({_CORR}) SELECT feature, target, round(avg(corr), 9) AS avg_corr, round(avg(abs(corr)), 9) AS weighted_score, round(avg(CAST(corr <= 0 AS INTEGER)), 9) AS p_value_le_zero FROM c GROUP BY ALL ORDER BY avg_corr DESC, feature, target")
def bootstrap_ranked(spark, sf_dir):
    """Pairs with arrays of [chunk, correlation, rows], summed up, the best first."""
    entry = F.array(F.col("chunk").cast("double"), "corr", F.col("n_rows").cast("double"))
    pairs = _corr(spark, sf_dir).groupBy("feature", "target").agg(F.collect_list(entry).alias("chunks"))
    return bootstrap.ranked(pairs).select("feature", "target", *_r("avg_corr", "weighted_score", "p_value_le_zero"))


# Text of instants and sides.


@query("SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, CASE WHEN event_type[1] = 's' THEN 'sell' WHEN event_type[1] = 'b' THEN 'buy' ELSE event_type END AS side, sha256(concat_ws('|', event_type, CAST(user_id AS VARCHAR))) AS h FROM events")
def instants_and_sides(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    joined = values.joined_hash(F.col("event_type"), F.col("user_id").cast("string"))
    return events.select("event_id", timeaxis.iso_ms(F.col("ts")).alias("iso"), values.normal_side(F.col("event_type")).alias("side"), joined.alias("h"))


# Archives, tables, the store.


def _archives(spark, sf_dir) -> list[str]:
    """The tape as one archive a symbol, in a shared folder."""
    folder, paths = shared_folder(spark, "archives"), []
    line = F.concat_ws(",", F.col("trade_id").cast("string"), F.col("ms").cast("string"), F.col("price").cast("string"), F.col("quantity").cast("string"), "side", F.lit("more"))
    for symbol in ("S0", "S1"):
        # Archives are files that exchanges make; here a symbol's lines go through one task to make one.
        lines = tape(spark, sf_dir).where(F.col("symbol") == symbol).select(line.alias("id,timestamp,price,volume,side"))
        lines.coalesce(1).write.option("header", True).option("quote", "").option("sep", "\x01").option("compression", "gzip").csv(f"{folder}/{symbol}")
        files, at = file_system(spark, f"{folder}/{symbol}")
        (made,) = [x.getPath() for x in files.listStatus(at) if x.getPath().getName().endswith(".csv.gz")]
        paths.append(f"{folder}/{symbol}-1970-11.csv.gz")
        files.rename(made, file_system(spark, paths[-1])[1])
    assert source.archives(spark, folder) == paths
    return paths


_NORMAL = "CASE WHEN lower(side[1]) = 'b' THEN 'buy' WHEN lower(side[1]) = 's' THEN 'sell' ELSE lower(side) END"


@query(f"WITH {TAPE} SELECT symbol, ms, CAST(trade_id AS VARCHAR) AS trade_id, price, CAST(quantity AS DOUBLE) AS quantity, {_NORMAL} AS side FROM tape WHERE ms >= {START_MS}")
def archive_rows(spark, sf_dir):
    rows = source.read_archives(spark, _archives(spark, sf_dir), start_ms=START_MS)
    return rows.select("symbol", F.unix_millis("exchange_ts").alias("ms"), "trade_id", "price", "quantity", "side")


@query(f"WITH {TAPE} SELECT symbol || '-1970-11.csv.gz' AS file, count(*) AS n_rows, min(ms) AS min_ms, max(ms) AS max_ms, strftime(make_timestamp(min(ms) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS first, strftime(make_timestamp(max(ms) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last FROM tape GROUP BY symbol")
def archive_bounds(spark, sf_dir):
    return source.file_bounds(spark, _archives(spark, sf_dir))


@query(f"WITH {TAPE} SELECT symbol || '-1970-11.csv.gz' AS file, count(*) AS n_rows FROM tape GROUP BY symbol")
def archive_manifest(spark, sf_dir):
    """What a manifest holds once one archive is loaded and then the other."""
    paths = _archives(spark, sf_dir)
    folder = paths[0].rpartition("/")[0]
    for symbol in ("S0", "S1"):
        _, done = source.load_new(spark, folder, f"{folder}/manifest.json", [symbol])
        source.save_manifest(spark, f"{folder}/manifest.json", done)
    found = source.load_manifest(spark, f"{folder}/manifest.json")
    return spark.createDataFrame([(n, x["rows"]) for n, x in found.items()], "file string, n_rows long")


@query(f"WITH {TAPE} SELECT symbol, strftime(make_timestamp(ms * 1000), '%Y-%m') AS month, count(*) AS n_rows, round(sum(price), 4) AS paid FROM tape GROUP BY ALL")
def table_trades(spark, sf_dir):
    """The tape appended to a table of the catalog, partitioned by month, and read from it."""
    name = "tape_" + shared_folder(spark, "tables").rpartition("-")[2]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_folder(spark, 'tables')}'")
    tables.create(spark, name)
    rows = tape(spark, sf_dir).select("symbol", F.timestamp_millis("ms").alias("exchange_ts"), F.col("trade_id").cast("string").alias("trade_id"), "price", F.col("quantity").cast("double").alias("quantity"), "side")
    tables.append_trades(rows, f"{name}.trades")
    tables.require(spark, [f"{name}.trades", f"{name}.chunks", f"{name}.bars"])
    return spark.table(f"{name}.trades").groupBy("symbol", "month").agg(F.count("*").alias("n_rows"), F.round(F.sum("price"), 4).alias("paid"))


def _stored(spark, sf_dir, names: list[str]) -> str:
    path = f"{shared_folder(spark, 'store')}/features"
    kv.write(_store(spark, sf_dir, names).select("symbol", F.timestamp_millis("ms").alias("exchange_ts"), "feature_name", "feature_value"), path, extra={"feature_version": "1"})
    return path


@query(f"WITH {TAPE}, {ROLLED} SELECT ms, round(CAST(mean_price_buy AS DOUBLE), 9) AS feature_value, '1' AS feature_version FROM rolled WHERE symbol = 'S1' AND ms >= {START_MS} AND ms < {END_MS} AND mean_price_buy IS NOT NULL ORDER BY ms")
def store_scan(spark, sf_dir):
    found = kv.read(spark, _stored(spark, sf_dir, ["mean_price_buy", "cvd_buy"]), "mean_price_buy", "S1", *_SPAN, ordered=True)
    return found.select(F.unix_millis("exchange_ts").alias("ms"), F.round("feature_value", 9).alias("feature_value"), "feature_version")


_INSIDE = f"symbol = 'S0' AND ms >= {START_MS} AND ms < {END_MS}"


@query(f"""WITH {TAPE}, {ROLLED}, a AS (SELECT symbol, ms, 'cvd_buy' AS n, CAST(cvd_buy AS DOUBLE) AS v FROM rolled UNION ALL SELECT symbol, ms, 'cvd_sell', CAST(cvd_sell AS DOUBLE) FROM rolled)
SELECT symbol, ms, n AS feature_name, v AS feature_value, '1' AS feature_version FROM a WHERE NOT ({_INSIDE})
UNION ALL SELECT symbol, ms, n, v + 1, '2' FROM a WHERE {_INSIDE} AND n = 'cvd_buy'""")
def store_replaced(spark, sf_dir):
    """A range of one symbol replaced, whatever the name: one feature comes again, the other is gone there."""
    path = _stored(spark, sf_dir, ["cvd_buy", "cvd_sell"])
    fresh = kv.read(spark, path, "cvd_buy", "S0", *_SPAN).withColumns({"feature_value": F.col("feature_value") + 1, "feature_version": F.lit("2")})
    kv.replace_range(spark, path, kept(fresh), "S0", *_SPAN)
    return kv.read(spark, path).select("symbol", F.unix_millis("exchange_ts").alias("ms"), "feature_name", "feature_value", "feature_version")


# Jobs.


def _job_store(spark, sf_dir, symbols=("S0", "S1"), rows_per_batch: int | None = None) -> str:
    path = f"{shared_folder(spark, 'jobs')}/features"
    for symbol in symbols:
        jobs.add_features(tape(spark, sf_dir), path, symbol, registry.rolling_bundle(), rows_per_batch=rows_per_batch)
    return path


_STORE_ALL = _ALL.replace("symbol, ms, trade_id, ", "symbol, ms, ")


@query(f"WITH {TAPE}, {ROLLED} {_STORE_ALL}")
def job_features(spark, sf_dir):
    """The rolling features of both symbols, as the store holds them."""
    return kv.read(spark, _job_store(spark, sf_dir)).select("symbol", F.unix_millis("exchange_ts").alias("ms"), "feature_name", F.round("feature_value", 9).alias("feature_value"))


@query(f"WITH {TAPE}, {ROLLED}, a AS ({_STORE_ALL}) SELECT feature_name, count(*) AS n_rows FROM a WHERE symbol = 'S1' GROUP BY 1")
def job_features_in_batches(spark, sf_dir):
    """The rows of each feature that the job reports when it goes by batches of a third of a symbol's trades."""
    rows = tape(spark, sf_dir)
    most = rows.where("symbol = 'S1'").count() // 3 + 1
    return jobs.add_features(rows, f"{shared_folder(spark, 'jobs')}/features", "S1", registry.rolling_bundle(), rows_per_batch=most)


def _aims() -> list[contract.Instance]:
    """Delta, direction and rise, the rise over a look-forward that this tape's grid can hit."""
    found = registry.standard().select(targets=True)
    return list(registry.bundle(replace(d, own_lookforward_ms=RISE_H) if d.name == "sell_rise" else d for d in found).instances)


_EMITTED = f"""e AS (SELECT symbol AS es, min(ms) AS a, max(ms) - {RISE_H} + 1 AS z FROM tape GROUP BY 1), f AS (SELECT ahead.* FROM ahead JOIN e ON es = symbol AND ms >= a AND ms < z)"""


@query(f"""WITH {TAPE}, {_AHEAD}, {_EMITTED}
SELECT symbol, ms, 'price_delta' AS feature_name, round({_delta_sql(0.0045)}, 9) AS feature_value FROM f WHERE nxt IS NOT NULL
UNION ALL SELECT symbol, ms, 'price_direction', CASE WHEN nxt - price > price * 0.0055 THEN 1.0 WHEN nxt - price < -(price * 0.0055) THEN -1.0 ELSE 0.0 END FROM f WHERE nxt IS NOT NULL
UNION ALL SELECT symbol, ms, 'sell_rise', CAST(coalesce(high, -1.0) > price * (1 + 0.0055) AS DOUBLE) FROM f""")
def job_targets(spark, sf_dir):
    path = f"{shared_folder(spark, 'jobs')}/features"
    for symbol in ("S0", "S1"):
        jobs.add_targets(tape(spark, sf_dir), path, symbol, _aims())
    return kv.read(spark, path).select("symbol", F.unix_millis("exchange_ts").alias("ms"), "feature_name", F.round("feature_value", 9).alias("feature_value"))


_PAIR = ["mean_price_buy", "mean_price_sell"]
_SYNC = f"""{TAPE}, {ROLLED}, {_WIDE}, {_AHEAD}, {_EMITTED},
aim AS (SELECT symbol, ms, {_delta_sql(0.0045)} AS target FROM f WHERE nxt IS NOT NULL AND symbol = 'S0'),
k AS (SELECT aim.*, mean_price_buy AS a, mean_price_sell AS z, CAST(mean_price_buy IS NOT NULL AND mean_price_sell IS NOT NULL AS INTEGER) AS ready FROM aim LEFT JOIN wide USING (symbol, ms)),
t AS (SELECT *, CAST(sum(ready) OVER (ORDER BY ms, target ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM k),
gr AS (SELECT (run - 1) // 64 AS block, sum(a * a) AS aa, sum(a * z) AS az, sum(z * z) AS zz, sum(a * target) AS ay, sum(z * target) AS zy, sum(target) AS y, count(*) AS n FROM t WHERE ready = 1 GROUP BY 1),
cs AS (SELECT block + 1 AS done, sum(y) OVER w / sum(n) OVER w AS mean, sum(aa) OVER w + 1 AS aa, sum(az) OVER w AS az, sum(zz) OVER w + 1 AS zz, sum(ay) OVER w AS ay, sum(zy) OVER w AS zy FROM gr WHERE n = 64 WINDOW w AS (ORDER BY block)),
co AS (SELECT done, mean, (zz * ay - az * zy) / (aa * zz - az * az) AS wa, (aa * zy - az * ay) / (aa * zz - az * az) AS wz FROM cs),
pr AS (SELECT symbol, ms, ready, CASE WHEN ready = 1 THEN a * wa + z * wz END AS ridge, CASE WHEN ready = 1 THEN mean END AS mean FROM t LEFT JOIN co ON done = (run - ready) // 64)"""


def _synced(spark, sf_dir):
    path = _job_store(spark, sf_dir, ["S0"])
    jobs.add_targets(tape(spark, sf_dir), path, "S0", _aims())
    policies = {n: {"special_value": None, "onehot": False} for n in [*_PAIR, "no_such_feature"]}
    return path, jobs.sync_signals(spark, path, "S0", ["price_delta"], policies, [models.Ridge(), models.RunningMean()], prefix="test ")


@query(f"""WITH {_SYNC} SELECT ms, 'test signal price_delta ridge {{mean_price_buy,mean_price_sell}}' AS feature_name, round(ridge, 4) AS signal FROM pr
UNION ALL SELECT ms, 'test signal price_delta mean {{mean_price_buy,mean_price_sell}}', round(mean, 4) FROM pr""")
def job_signals(spark, sf_dir):
    """Signals of two models as the store holds them, rows without a prediction (NaN there) as nulls."""
    path, reports = _synced(spark, sf_dir)
    found = kv.read(spark, path, [r.signal for r in reports])
    return found.select(F.unix_millis("exchange_ts").alias("ms"), "feature_name", F.round(F.nanvl("feature_value", F.lit(None).cast("double")), 4).alias("signal"))


@query(f"""WITH {_SYNC}, c AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.7) AS BIGINT) AS cut FROM k), o AS (SELECT ms, row_number() OVER (ORDER BY ms) AS i FROM k), eg AS (SELECT ms AS edge FROM o, c WHERE i = cut)
SELECT m.model, 'no_such_feature' AS skipped, c.n AS n_rows, (SELECT count(*) FROM k, eg WHERE ms <= edge) AS n_train, (SELECT count(*) FROM k, eg WHERE ms > edge) AS n_test,
  (SELECT CAST(sum(ready) AS BIGINT) FROM pr) AS n_predictable, (SELECT count(*) FROM pr WHERE ridge IS NOT NULL) AS n_predicted
FROM c, (VALUES ('mean'), ('ridge')) AS m(model)""")
def job_report(spark, sf_dir):
    _, reports = _synced(spark, sf_dir)
    rows = [(r.signal.split()[3], ",".join(r.skipped), r.rows, r.train, r.test, r.predictable, r.predicted) for r in reports]
    return spark.createDataFrame(rows, "model string, skipped string, n_rows long, n_train long, n_test long, n_predictable long, n_predicted long")


def _two_tables(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = timeaxis.to_us(F.col("ts")).alias("us")
    return {"events": events.select(us), "odd_events": events.where("user_id % 2 = 1").select(us)}


_MARKS = f"WITH {_EVENTS}, {_SEGS}, {_BOUNDS}, {_GLOBAL}, {_THIRDS}, {_SIGNED}, tb AS (SELECT 0 AS k, 'events' AS source_table UNION ALL SELECT 1, 'odd_events')"
_WIDE_SPAN = 0, 4_000_000_000_000_000


@query(f"""{_MARKS} SELECT 'EVT' AS symbol, source_table, part_start_us AS start_us, part_end_us AS end_us, part AS chunk_type, signature AS chunk_signature_hash, 'v1' AS git_hash,
  (SELECT count(*) FROM events WHERE epoch_us(ts) BETWEEN part_start_us AND part_end_us AND (k = 0 OR user_id % 2 = 1)) AS n_rows FROM signed, tb""")
def job_chunks(spark, sf_dir):
    """The instances that a marking run writes, for two tables of which the first one is cut."""
    made = jobs.mark_chunks(spark, _two_tables(spark, sf_dir), "EVT", *_WIDE_SPAN, N_CHUNKS, GAP_US, "v1", 0).instances
    return made.select("symbol", "source_table", F.unix_micros("chunk_start").alias("start_us"), F.unix_micros("chunk_end").alias("end_us"), "chunk_type", "chunk_signature_hash", "git_hash", "n_rows")


@query(f"{_MARKS} SELECT 'EVT' AS symbol, len(list(signature)) AS n_parts, sha256(string_agg(signature, '|' ORDER BY k, chunk_idx, part_idx)) AS chunks_list_hash FROM signed, tb")
def job_chunk_session(spark, sf_dir):
    """A marking run's instances and session, from the two tables that it appended them to."""
    name = "marks_" + shared_folder(spark, "marks").rpartition("-")[2]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_folder(spark, 'marks')}'")
    tables.create(spark, name)
    jobs.store_marks(jobs.mark_chunks(spark, _two_tables(spark, sf_dir), "EVT", *_WIDE_SPAN, N_CHUNKS, GAP_US, "v1", 0), f"{name}.chunks", f"{name}.chunk_sessions")
    n = spark.table(f"{name}.chunks").groupBy("symbol").agg(F.count("*").alias("n_parts"))
    return n.join(spark.table(f"{name}.chunk_sessions").where("size(chunks_list) > 0"), "symbol").select("symbol", "n_parts", "chunks_list_hash")


@query(f"""{_MARKS}, n AS (SELECT source_table, (SELECT count(*) FROM events WHERE epoch_us(ts) BETWEEN part_start_us AND part_end_us AND (k = 0 OR user_id % 2 = 1)) AS n FROM signed, tb)
SELECT source_table, CAST(min(n) AS DOUBLE) AS min, CAST(max(n) AS DOUBLE) AS max, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median, round(stddev_samp(n), 6) AS std, count(*) FILTER (WHERE n = 0) AS n_empty FROM n GROUP BY 1""")
def job_row_stats(spark, sf_dir):
    marked = jobs.mark_chunks(spark, _two_tables(spark, sf_dir), "EVT", *_WIDE_SPAN, N_CHUNKS, GAP_US, "v1", 0)
    return jobs.row_stats(marked).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"""WITH t AS (SELECT 'events' AS source_table, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events UNION ALL SELECT 'odd_events', min(epoch_us(ts)), max(epoch_us(ts)) FROM events WHERE user_id % 2 = 1)
SELECT *, first_us - {_WIDE_SPAN[0]} AS head_gap_us, {_WIDE_SPAN[1]} - last_us AS tail_gap_us FROM t""")
def gap_report(spark, sf_dir):
    return jobs.gap_report(spark, jobs.bounds_in(_two_tables(spark, sf_dir), *_WIDE_SPAN), *_WIDE_SPAN)


@query(f"""WITH t AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events), n AS (SELECT unnest(['events', 'odd_events']) AS source_table)
SELECT 'EVT' AS symbol, source_table, 'by hand' AS chunk_description, a AS start_us, b AS end_us, sha256('EVT|by hand|' || source_table || '|' || {_ISO.format('a')} || '|' || {_ISO.format('b')}) AS chunk_hash FROM t, n""")
def marked_by_hand(spark, sf_dir):
    made = jobs.mark_by_hand(spark, _two_tables(spark, sf_dir), "EVT", "by hand", *_WIDE_SPAN, 5)
    return made.select("symbol", "source_table", "chunk_description", F.unix_micros("chunk_effective_start").alias("start_us"), F.unix_micros("chunk_effective_end").alias("end_us"), "chunk_hash")


# What the jobs are made of.


@query(f"WITH {_EVENTS}, t AS (SELECT min(us) AS a, max(us) AS b FROM i), p AS (SELECT CAST(k AS INTEGER) AS chunk_idx, a + (b - a) * k // 5 AS start_us, a + (b - a) * (k + 1) // 5 AS nxt FROM t, range(5) AS r(k)) SELECT chunk_idx, start_us, CASE WHEN chunk_idx = 4 THEN nxt ELSE nxt - 1000000 END AS end_us FROM p")
def wall_chunks(spark, sf_dir):
    low, high = jobs.bounds_in(_two_tables(spark, sf_dir), *_WIDE_SPAN)["events"]
    return chunks.wall_chunks(low, high, 5, spark).drop("collapsed")


@query("WITH r(i, a, b) AS (VALUES (0, '1990-01-01', '1991-12-31'), (1, '1995-01-01', '1995-06-30'), (2, '2001-01-01', '2001-12-31'), (3, '2004-01-01', '2005-12-31')), c AS (SELECT i, (SELECT count(*) FROM orders WHERE o_orderdate BETWEEN CAST(a AS DATE) AND CAST(b AS DATE)) AS n_rows FROM r) SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS chunk_idx, n_rows FROM c WHERE n_rows > 0")
def chunks_renumbered(spark, sf_dir):
    """Ranges of order dates, those without orders dropped and the rest numbered again."""
    day = lambda x: int(timeaxis.parse_instant(x).timestamp() * 1_000_000)
    spans = [("1990-01-01", "1991-12-31"), ("1995-01-01", "1995-06-30"), ("2001-01-01", "2001-12-31"), ("2004-01-01", "2005-12-31")]
    ranges = spark.createDataFrame([(i, day(a), day(b)) for i, (a, b) in enumerate(spans)], "chunk_idx int, start_us long, end_us long")
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select(timeaxis.to_us(F.col("o_orderdate")).alias("us"))
    return chunks.renumbered(chunks.counted(dates, ranges)).select("chunk_idx", "n_rows")


@query(f"WITH {TAPE}, {ROLLED} SELECT symbol, ms, trade_id, CAST(cvd_buy AS DOUBLE) AS cvd_buy FROM rolled WHERE ms >= {START_MS} AND ms < {END_MS}")
def guarded_range(spark, sf_dir):
    """A feature of a range, from a scan that is padded by its horizons: the same values as from the whole tape."""
    feature = registry.rolling_bundle()["cvd_buy"]
    return contract.guarded(feature, tape(spark, sf_dir), START_MS, END_MS).select("symbol", "ms", "trade_id", "cvd_buy")


@query(f"WITH {TAPE.replace('FROM events)', 'FROM events WHERE value > 100)')}, {ROLLED} SELECT symbol, ms, trade_id, round(mean_price_buy, 9) AS mean_price_buy FROM rolled")
def filtered_window(spark, sf_dir):
    """A predicate that holds ahead of the window, on a tape with other column names."""
    names = {"symbol_column": "pair", "time_column": "at", "price_column": "paid", "quantity_column": "volume", "side_column": "taker"}
    theirs = tape(spark, sf_dir).where("price > 100").select(F.col("symbol").alias("pair"), timeaxis.from_ms(F.col("ms")).alias("at"), "trade_id", F.col("price").alias("paid"), F.col("quantity").alias("volume"), F.col("side").alias("taker"))
    feature = registry.rolling_bundle(registry.Factory(shared=names))["mean_price_buy"]
    return feature.rows(theirs).select("symbol", "ms", "trade_id", *_r("mean_price_buy"))


_DECLARED = [(n, "feature", L, 0) for n in sorted(features.ROLLING)] + [("price_delta", "target", 0, 4000), ("price_direction", "target", 0, 4000), ("price_momentum", "feature", L, 0), ("price_momentum_for_balance", "feature", L, 0), ("sell_rise", "target", 0, 200), ("volume_balance", "feature", 2 * L, 0)]


@query(f"SELECT * FROM (VALUES {', '.join(map(str, _DECLARED))}) AS t(feature, kind, lookback_ms, lookforward_ms)")
def feature_graph(spark, sf_dir):
    """The default set in order of its graph, with what a scan must reach back and ahead."""
    made = registry.bundle(registry.standard().select())
    rows = [(i.name, "target" if i.template.target else "feature", i.summary_lookback_ms, i.summary_lookforward_ms) for i in made.instances]
    return spark.createDataFrame(rows, "feature string, kind string, lookback_ms long, lookforward_ms long")


@query(f"SELECT * FROM (VALUES {', '.join(str((n, 0, 0)) for n in sorted([*features.ROLLING, 'price_momentum']))}) AS t(feature, frames_ahead, rows_changed)")
def leakage(spark, sf_dir):
    """Causal features: frames that hold the row's own instant or later, and rows that change with later trades."""
    chosen = registry.bundle(registry.standard().select(include=[*features.ROLLING, "price_momentum"])).instances
    rows, cut, out = tape(spark, sf_dir), START_MS, None
    for i in chosen:
        one = contract.leaks(i, rows, cut).agg(F.count("*").alias("rows_changed")).select(F.lit(i.name).alias("feature"), F.lit(len(contract.looks_ahead(i.rows(rows)))).cast("long").alias("frames_ahead"), "rows_changed")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_BOOK}, l AS (SELECT symbol, uid, side, price, size, min(seq) OVER (PARTITION BY symbol, uid) AS since_seq FROM (SELECT ord.*, alive.seq FROM ord JOIN alive USING (symbol, uid))) SELECT DISTINCT symbol, uid, side, CAST(price AS DOUBLE) AS price, since_seq, CAST(dense_rank() OVER (PARTITION BY symbol, side, price ORDER BY since_seq) AS INTEGER) AS place FROM l")
def book_queue(spark, sf_dir):
    return book.queue(book.living(order_events(spark, sf_dir))).select("symbol", "uid", "side", "price", "since_seq", "place")


@query(f"WITH {_EVENTS}, {_SEGS} SELECT seg_end, real_us // 86400000000 || 'd ' || strftime(make_timestamp(real_us % 86400000000), '%H:%M:%S') AS text FROM segs")
def duration_texts(spark, sf_dir):
    return chunks.segments(_instants(spark, sf_dir), GAP_US).select("seg_end", timeaxis.duration_text(F.col("real_us")).alias("text"))


_TEXTS = [("7d", 604_800, "7d"), ("36h", 129_600, "36h"), ("90m", 5_400, "90m"), ("1.5h", 5_400, "90m"), ("45s", 45, "45s"), ("off", 0, "none"), ("", 0, "none")]


@query("SELECT * FROM (VALUES " + ", ".join(map(str, _TEXTS)) + ") AS t(text, seconds, again)")
def durations(spark, sf_dir):
    """Duration texts, parsed and written again; texts that mean no limit are ``none``."""
    parsed = [(t, timeaxis.parse_duration(t)) for t, _, _ in _TEXTS]
    return spark.createDataFrame([(t, int(d.total_seconds()) if d else 0, timeaxis.format_duration(d) if d else "none") for t, d in parsed], "text string, seconds long, again string")


@query(f"""WITH {_EVENTS}, {_SEGS}, {_BOUNDS}, {_GLOBAL} SELECT chunk_idx, {_ISO.format('greatest(end_us - 7200000000 - 1000000, start_us)')} AS purge_end, greatest(end_us - 7200000000 - 1000000, start_us) <= start_us AS is_empty FROM g""")
def trimmed_chunks(spark, sf_dir):
    """What a purge leaves of each chunk, out of its JSON."""
    text = horizons.trimmed(F.col("start_us"), F.col("end_us"), 7_200_000_000, "purge")
    return _global(spark, sf_dir).select("chunk_idx", F.get_json_object(text, "$.end").alias("purge_end"), F.get_json_object(text, "$.is_empty").cast("boolean").alias("is_empty"))
