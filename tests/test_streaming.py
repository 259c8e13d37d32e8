"""Streams against their batch twins."""

import random
from datetime import UTC

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, book, features
from tickloom.streaming import tape
from tickloom.streaming.run import available

TRADES = "symbol string, ms long, trade_id long, price double, quantity long, side string"


def trades(seed, n=200):
    draw = random.Random(seed)
    return sorted(((draw.choice("AB"), draw.randrange(8000), i, draw.randrange(99) / 4, draw.randrange(1, 9), draw.choice(["buy", "sell"])) for i in range(n)), key=lambda r: r[1])


def stream(spark, folder, rows, schema, pieces=3):
    step = -(-len(rows) // pieces)
    for i in range(pieces):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(df, folder, mode):
    return available(df, mode).collect()


def test_bars(spark, tmp_path):
    rows = trades(1)
    df = stream(spark, tmp_path, rows, TRADES, 1).withColumn("exchange_ts", F.timestamp_millis("ms"))
    got = run(tape.bars(df), tmp_path, "complete")
    want = {(r.symbol, r.bin_ms): r for r in bars.bars(spark.createDataFrame(rows, TRADES)).collect()}
    assert len(got) == len(want)
    for r in got:
        twin = want[r.symbol, int(r.exchange_ts.replace(tzinfo=UTC).timestamp() * 1000)]
        for c in ("trade_count", "trade_count_buy", "volume_sell", "price_min", "price_max", "price_first"):
            assert r[c] == twin[c]


def test_rolling(spark, tmp_path):
    rows = trades(2)
    got = {r.trade_id: r for r in run(tape.rolling(stream(spark, tmp_path, rows, TRADES, 1), 700), tmp_path, "append")}
    want = {r.trade_id: r for r in features.rolling(spark.createDataFrame(rows, TRADES), 700).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        for c in features.ROLLING:
            assert (r[c] is None) == (want[k][c] is None) and (r[c] is None or r[c] == pytest.approx(want[k][c])), c


def test_rolling_state_reaches_over_batches(spark, tmp_path):
    rows = sorted({r[1]: r for r in trades(3)}.values(), key=lambda r: r[1])
    got = {r.trade_id: r.trade_count_buy for r in run(tape.rolling(stream(spark, tmp_path, rows, TRADES, 3), 900), tmp_path, "append")}
    want = {r.trade_id: r.trade_count_buy for r in features.rolling(spark.createDataFrame(rows, TRADES), 900).collect()}
    assert got == want


def test_late_rows_are_marked(spark, tmp_path):
    rows = sorted({r[1]: r for r in trades(5)}.values(), key=lambda r: r[1])
    late = [("A", 3, 9001, 1.0, 1, "buy"), ("B", 4, 9002, 1.0, 1, "sell")]
    got = run(tape.rolling(stream(spark, tmp_path, [*rows, *late], TRADES, 2), 900), tmp_path, "append")
    assert {r.trade_id for r in got if r.late} >= {9001, 9002} and len(got) == len(rows) + 2
    assert all(r.trade_count_buy is None and r.cvd_buy is None for r in got if r.late)


@pytest.mark.parametrize("seed", [9, 10, 11])
def test_book(spark, tmp_path, seed):
    from tests.test_models import EVENT, random_events

    events = random_events(seed, 240)
    got = run(tape.book(stream(spark, tmp_path, events, EVENT, 3)), tmp_path, "update")
    last = {}
    for r in got:
        if r.seq >= last.get(r.symbol, r).seq:
            last[r.symbol] = r
    want = {r.symbol: r for r in book.top(book.living(spark.createDataFrame(events, EVENT))).collect()}
    assert {s: (r.best_bid, r.best_ask) for s, r in last.items()} == {s: (r.best_bid, r.best_ask) for s, r in want.items()}
