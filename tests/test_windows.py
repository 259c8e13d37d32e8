"""Rolling features and targets: hand-made tapes, bounded frames, leakage, plans."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import features, frames, targets

TAPE = "symbol string, ms long, trade_id long, price double, quantity long, side string"
M1 = [("A", 1000, 2, 10.0, 1, "buy"), ("A", 1000, 1, 11.0, 1, "sell"), ("A", 1500, 3, 12.0, 1, "SELL"), ("A", 5000, 4, 13.0, 1, "buy"), ("A", 5000, 5, 14.0, 1, "Buy")]


def by_trade(df, *columns):
    return {r.trade_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_hand_made_tape(spark):
    tape = spark.createDataFrame(M1, TAPE)
    got = by_trade(features.rolling(tape, momentum=True), "trade_count_buy", "mean_price_buy", "price_momentum")
    assert got == {2: (0, None, None), 1: (0, None, None), 3: (1, 10.0, -1.0), 4: (1, 10.0, 1.0), 5: (1, 10.0, 1.0)}
    ahead = by_trade(targets.forward(tape), "price_delta")
    assert ahead[1] == (2.0,) and ahead[2] == (3.0,) and ahead[3] == (None,)


@pytest.mark.parametrize(("price", "delta", "direction"), [(100.4, 0.0, 0.0), (100.5, 0.5, 0.0), (100.6, 0.6, 1.0), (99.4, -0.6, -1.0)])
def test_deadband_and_direction(spark, price, delta, direction):
    tape = spark.createDataFrame([("A", 0, 1, 100.0, 1, "buy"), ("A", 4000, 2, price, 1, "buy")], TAPE)
    got = by_trade(targets.forward(tape), "price_delta", "price_direction")
    assert got[1] == (pytest.approx(delta), direction) and got[2] == (None, None)
    zero = by_trade(targets.forward(tape, missing="zero"), "price_delta", "price_direction")
    assert zero[2] == (-price, -1.0)


def test_sell_rise(spark):
    rows = [("A", 0, 1, 100.0, 1, "buy"), ("A", 150, 2, 100.56, 1, "sell"), ("B", 0, 3, 100.0, 1, "buy"), ("B", 150, 4, 100.54, 1, "sell"), ("C", 0, 5, 100.0, 1, "buy"), ("C", 201, 6, 200.0, 1, "sell")]
    got = by_trade(targets.forward(spark.createDataFrame(rows, TAPE)), "sell_rise")
    assert (got[1], got[3], got[5]) == ((1.0,), (0.0,), (0.0,))
    with pytest.raises(ValueError, match="missing"):
        targets.forward(spark.createDataFrame(rows, TAPE), missing="guess")


trades = st.lists(st.tuples(st.sampled_from("AB"), st.integers(-50, 400), st.integers(1, 50), st.integers(1, 9), st.sampled_from(["buy", "SELL", "other", None])), min_size=1, max_size=40)


@given(trades, st.integers(1, 60), st.integers(1, 90))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_buckets_and_differences_equal_bounded_frames(spark, rows, back, width):
    tape = spark.createDataFrame([(s, ms, i, p / 4, q, side) for i, (s, ms, p, q, side) in enumerate(rows)], TAPE)
    got = by_trade(features.rolling(tape, back, bucket_ms=width, momentum=True), "trade_count_buy", "cvd_sell", "mean_price_sell", "price_momentum")
    w = Window.partitionBy("symbol").orderBy("ms").rangeBetween(-back, -1)
    sell = F.upper("side") == "SELL"
    plain = tape.select(
        "trade_id", F.count_if(F.coalesce(F.upper("side") == "BUY", F.lit(False))).over(w).alias("a"),
        F.coalesce(F.sum(F.when(sell, F.col("quantity").cast("double"))).over(w), F.lit(0.0)).alias("b"), F.avg(F.when(sell, F.col("price"))).over(w).alias("c"),
        (F.max_by("price", F.struct("ms", "trade_id")).over(w) - F.min_by("price", F.struct("ms", "trade_id")).over(w)).alias("d"),
    )
    want = by_trade(plain, "a", "b", "c", "d")
    assert {k: tuple(None if x is None else round(x, 9) for x in v) for k, v in got.items()} == {k: tuple(None if x is None else round(x, 9) for x in v) for k, v in want.items()}


def test_features_do_not_see_the_present_or_the_future(spark):
    draw = random.Random(3)
    rows = [("A", draw.randrange(2000), i, draw.random(), draw.randrange(9), draw.choice(["buy", "sell"])) for i in range(200)]
    changed = [r if r[1] < 1000 else (r[0], r[1], r[2], r[3] + 5, r[4] + 7, "buy") for r in rows]
    names = [*features.ROLLING, "price_momentum"]
    before, after = (by_trade(features.rolling(spark.createDataFrame(x, TAPE), 300, momentum=True).where("ms <= 1000"), *names) for x in (rows, changed))
    assert before == after


def test_one_window_and_no_cartesian_product(spark):
    plan = features.rolling(spark.createDataFrame(M1, TAPE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "Cartesian" not in plan and "Python" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_running_total_over_buckets(spark):
    rows = [("A", i * 7 % 101, i, 1.0, i, "b") for i in range(101)]
    tape = spark.createDataFrame(rows, TAPE)
    got = frames.running_total(tape, F.col("quantity"), ["ms"], "total", F.floor(F.col("ms") / 10), ["symbol"])
    total = 0
    for r in got.orderBy("ms").collect():
        total += r.quantity
        assert r.total == total
