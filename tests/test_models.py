"""Online ridge, order books, bootstrap, the feature graph."""

import random
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import book, bootstrap, features, ridge
from tickloom.plans import contract, registry
from tickloom.plans.contract import Declaration, Instance, Snapshot, Template


def predictions(spark, x, y, block, alpha=1.0, bucket_ms=50):
    rows = [("A", i // 2, i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    names = [f"x{i}" for i in range(len(x[0]))]
    df = spark.createDataFrame(rows, "symbol string, ms long, trade_id long, " + ", ".join(f"{n} double" for n in names) + ", target double")
    got = ridge.signals(df, names, block=block, alpha=alpha, bucket_ms=bucket_ms).orderBy("trade_id").collect()
    return np.array([r.signal for r in got])


def test_ridge_by_hand(spark):
    one = predictions(spark, [[1], [1], [2]], [2, 4, 6], 1)
    assert np.isnan(one[0]) and one[1:].tolist() == pytest.approx([1, 4])
    two = predictions(spark, [[1], [1], [2]], [2, 4, 6], 2)
    assert np.isnan(two[:2]).all() and two[2] == pytest.approx(4)


@pytest.mark.parametrize("block", [1, 7])
def test_ridge_matches_the_loop(spark, block):
    draw = np.random.default_rng(block)
    x, y = draw.normal(size=(300, 3)), draw.normal(size=300)
    x[draw.random((300, 3)) < 0.03] = np.nan
    y[draw.random(300) < 0.05] = np.inf
    want = ridge.literal(x, y, block=block)
    got = predictions(spark, x.tolist(), y.tolist(), block)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.nanmax(np.abs(got - want)) < 1e-9


def test_signal_name():
    assert ridge.signal_name("t", "ridge", ["a", "b"], "x ") == "x signal t ridge {a,b}"


EVENT = "symbol string, seq long, uid long, side string, price double, size double"


def test_book_by_hand(spark):
    rows = [("A", 1, 1, "bid", 100.0, 5.0), ("A", 2, 1, "bid", 999.0, 4.0)]
    got = book.levels(book.living(spark.createDataFrame(rows, EVENT))).first()
    assert (got.price, got.size, got.volume) == (100.0, 4.0, 400.0)
    before = book.levels(book.living(spark.createDataFrame(rows, EVENT), upto=1)).first()
    assert before.volume == 500.0
    two = [("A", 1, 1, "bid", 100.0, 1.0), ("A", 2, 2, "bid", 100.0, 1.0), ("A", 3, 1, "bid", 0.0, 0.0)]
    assert book.levels(book.living(spark.createDataFrame(two, EVENT))).first().n_orders == 1
    gone = [*two, ("A", 4, 2, "bid", 0.0, 0.0), ("A", 5, 77, "ask", 0.0, 0.0)]
    assert book.top(book.living(spark.createDataFrame(gone, EVENT))).count() == 0


def test_depth_and_queue(spark):
    rows = [("A", i, i, side, p, 1.0) for i, (side, p) in enumerate([("bid", 100.0), ("bid", 95.0), ("bid", 90.0), ("ask", 200.0), ("ask", 205.0), ("ask", 210.0), ("ask", 200.0), ("bid", 300.0)])]
    orders = book.living(spark.createDataFrame(rows[:7], EVENT))
    got = {(r.side, r.level): (r.price, r.n_orders) for r in book.depth(orders, 2).collect()}
    assert got == {("bid", 1): (100.0, 1), ("bid", 2): (95.0, 1), ("ask", 1): (200.0, 2), ("ask", 2): (205.0, 1)}
    crossed = book.depth(book.living(spark.createDataFrame(rows, EVENT)))
    assert {r.price for r in crossed.where("side = 'bid'").collect()} == {100.0, 95.0, 90.0} and crossed.where("side = 'ask'").count() == 0
    one_side = book.depth(book.living(spark.createDataFrame(rows[:3], EVENT)))
    assert one_side.count() == 3
    assert [r.place for r in book.queue(orders).where("price = 200").orderBy("since_seq").collect()] == [1, 2]


def literal_book(events):
    alive = {}
    for s, _, uid, side, price, size in sorted(events, key=lambda e: e[1]):
        if size == 0:
            alive.pop((s, uid), None)
        elif (s, uid) in alive:
            alive[s, uid] = (*alive[s, uid][:2], size)
        else:
            alive[s, uid] = (side, price, size)
    return {(*k, *v) for k, v in alive.items()}


def random_events(seed, n=300):
    draw = random.Random(seed)
    return [(draw.choice("AB"), i, draw.randrange(25), draw.choice(["bid", "ask"]), float(draw.randrange(20)), float(draw.choice([0, 1, 2, 5]))) for i in range(n)]


def test_book_matches_a_replay(spark):
    events = random_events(4)
    got = {(r.symbol, r.uid, r.side, r.price, r.size) for r in book.living(spark.createDataFrame(events, EVENT)).collect()}
    assert got == literal_book(events)


def test_messages(spark):
    kind = "symbol string, seq long, update_type string, bids_price array<double>, bids_qty array<double>, asks_price array<double>, asks_qty array<double>"
    rows = [("A", 1, "snapshot", [9.0], [5.0], [11.0], [1.0]), ("A", 2, "delta", [9.0, 8.0], [0.0, 2.0], [], []), ("A", 3, "snapshot", [7.0], [1.0], [], []), ("A", 4, "delta", [], [], [12.0], [3.0])]
    orders = lambda n: {(r.side, r.price, r.size) for r in book.living(book.from_messages(spark.createDataFrame(rows[:n], kind))).collect()}
    assert orders(2) == {("bid", 8.0, 2.0), ("ask", 11.0, 1.0)} and orders(4) == {("bid", 7.0, 1.0), ("ask", 12.0, 3.0)}


def test_bootstrap(spark):
    pairs = spark.createDataFrame([("f", "t", [[0.0, 0.2, 5.0], [1.0, 0.3], [2.0, -0.1, 1.0], [3.0, 0.4, 1.0]]), ("g", "t", [[0.0, 0.9, 1.0]])], "feature string, target string, chunks array<array<double>>")
    rows = bootstrap.chunk_rows(pairs)
    assert rows.where("feature = 'f' and chunk = 1").first().n_rows == 0
    best = bootstrap.ranked(pairs).collect()
    assert [r.feature for r in best] == ["g", "f"] and best[1].p_value_le_zero == 0.25
    drawn = bootstrap.samples(rows, 200)
    assert drawn.count() == 200 and {r.feature for r in drawn.collect()} == {"f"}
    assert drawn.agg(F.avg("avg_corr")).first()[0] == pytest.approx(0.2, abs=0.05)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, bootstrap.samples(rows, 200).collect()))


def template(name, **kind):
    return Template(name, lambda trades, params: trades, **kind)


def declared(name, *parents, **more):
    return Declaration(name, template(name), parents=parents, **more)


def test_graph():
    order = [d.name for d in registry.ordered([declared("c", "a", "b"), declared("b"), declared("a", "b"), declared("d")])]
    assert order == ["b", "d", "a", "c"]
    for bad in ([declared("a"), declared("a")], [declared("a", "a")], [declared("a", "x")], [declared("a", "b"), declared("b", "a")]):
        with pytest.raises(ValueError):
            registry.ordered(bad)


def test_selection_and_binding():
    standard = registry.standard()
    assert [d.name for d in standard.select(targets=True)] == ["price_delta", "price_direction", "sell_rise"]
    with pytest.raises(ValueError, match="parents missing"):
        registry.bundle(standard.select(include=["volume_balance"]))
    made = registry.rolling_bundle(registry.Factory(shared={"k": 1, "own_lookback_ms": 5}, by_feature={"cvd_buy": {"k": 2}}))
    assert [i.name for i in made.instances] == sorted(features.ROLLING)
    assert made["cvd_buy"].params["k"] == 2 and made["cvd_sell"].params["k"] == 1
    assert made["cvd_buy"].params["own_lookback_ms"] == made["cvd_buy"].own_lookback_ms == 300_000
    assert not made.targets and registry.target_feature("price_delta_binned").own_lookforward_ms == 4_000


def test_deep_horizons():
    out = registry.bundle([declared("a", own_lookback_ms=100), declared("b", "a", own_lookback_ms=40), declared("c", "a", "b", own_lookback_ms=2)])
    assert out["c"].summary_lookback_ms == 142


def instance(**change):
    base = {"name": "x", "template": template("x"), "own_lookback_ms": 1, "own_lookforward_ms": 0, "params": {}}
    return Instance(**(base | change))


@pytest.mark.parametrize("change", [{"name": ""}, {"own_lookback_ms": -1}, {"name": " "}, {"own_lookforward_ms": 3}, {"params": {"own_lookback_ms": 2}}, {"ml_policy": {"odd": 1}}, {"ml_policy": {}}, {"ml_policy": {"onehot": True}}, {"ml_policy": {"special_value": 0.0, "onehot": True, "odd": 1}}, {"template": template("x", required=frozenset({"need"}))}, {"template": template("x", causal=False, target=True)}])
def test_invalid_instances(change):
    with pytest.raises(ValueError):
        instance(**change)


@pytest.mark.parametrize("change", [{"own_lookback_ms": True}, {"own_lookback_ms": 1.0}, {"own_lookforward_ms": "1"}, {"ml_policy": {"special_value": None, "onehot": 1}}])
def test_instances_of_wrong_type(change):
    with pytest.raises(TypeError):
        instance(**change)


def test_horizons_of_parents_count():
    ahead = Instance("aim", template("aim", causal=False, target=True), 0, 4000, {})
    back = instance(name="past", own_lookback_ms=5)
    with pytest.raises(ValueError, match="forward"):
        instance(parents=(ahead,))
    with pytest.raises(ValueError, match="forward"):
        instance(name="grandchild", parents=(instance(name="child", template=template("child", causal=False), parents=(ahead,)),))
    with pytest.raises(ValueError, match="back"):
        Instance("late", template("late", causal=False, target=True), 0, 1, {}, (back,))
    with pytest.raises(ValueError, match="itself"):
        instance(parents=(instance(),))
    assert instance(parents=(back,)).summary_lookback_ms == 6


def test_leakage_checks(spark):
    draw = random.Random(8)
    rows = [("A", draw.randrange(4000), i, draw.random(), draw.randrange(9), draw.choice(["buy", "sell"])) for i in range(200)]
    tape = spark.createDataFrame(rows, "symbol string, ms long, trade_id long, price double, quantity long, side string")
    names = [*features.ROLLING, "price_momentum", "price_momentum_for_balance", "volume_balance"]
    made = registry.bundle(registry.with_horizons(registry.standard().select(include=names), 700))
    for feature in made.instances:
        assert contract.looks_ahead(feature.rows(tape)) == [], feature.name
    for name in ("cvd_buy", "price_momentum", "volume_balance", "trade_spread_signed"):
        assert contract.leaks(made[name], tape, 2000).count() == 0
    aims = registry.bundle(registry.with_horizons(registry.standard().select(targets=True), ahead_ms=700))
    for target in aims.instances:
        assert contract.looks_ahead(target.rows(tape))
    assert contract.leaks(aims["sell_rise"], tape, 2000).count() > 0


def test_column_names_are_parameters(spark):
    rows = [("A", datetime.fromtimestamp(i / 10, UTC), i, float(i), 1 + i % 3, "buy" if i % 2 else "sell") for i in range(50)]
    kind = "{} string, {} timestamp, {} long, {} double, {} long, {} string"
    theirs = spark.createDataFrame(rows, kind.format("pair", "at", "id", "paid", "volume", "taker"))
    ours = spark.createDataFrame([(s, int(t.timestamp() * 1000), *more) for s, t, *more in rows], "symbol string, ms long, trade_id long, price double, quantity long, side string")
    names = {"symbol_column": "pair", "time_column": "at", "id_column": "id", "price_column": "paid", "quantity_column": "volume", "side_column": "taker"}
    picked = registry.with_horizons(registry.standard().select(include=["cvd_buy"]), 700)
    want = registry.bundle(picked)["cvd_buy"].rows(ours).select("trade_id", "cvd_buy").collect()
    got = registry.bundle(picked, registry.Factory(shared=names))["cvd_buy"].rows(theirs).select("trade_id", "cvd_buy").collect()
    assert sorted(got) == sorted(want)


def test_templates_and_copies():
    with pytest.raises(ValueError):
        template("x", causal=True, target=True)
    made = instance()
    assert made.with_params(a=1).params["a"] == 1 and "a" not in made.params


def test_guard_gives_the_same_values_for_any_batch(spark):
    draw = random.Random(6)
    rows = [("A", draw.randrange(5000), i, draw.random(), draw.randrange(9), draw.choice(["buy", "sell"])) for i in range(300)]
    tape = spark.createDataFrame(rows, "symbol string, ms long, trade_id long, price double, quantity long, side string")
    feature = registry.bundle(registry.with_horizons(registry.standard().select(include=["cvd_buy"]), 700))["cvd_buy"]
    assert feature.own_lookback_ms == feature.params["own_lookback_ms"] == 700
    whole = {r.trade_id: r.cvd_buy for r in feature.rows(tape).collect()}
    parts = {r.trade_id: r.cvd_buy for a in range(0, 5000, 1000) for r in contract.guarded(feature, tape, a, a + 1000).collect()}
    assert parts == whole
    with pytest.raises(ValueError):
        contract.guarded(feature, tape, 5, 5)


def snapshot(**change):
    base = {"name": "cvd", "version": 1, "start": datetime(2024, 1, 1, tzinfo=UTC), "end": datetime(2024, 2, 1), "kind": "time_based", "own_lookback_ms": 1800}
    return Snapshot(**(base | change))


def test_snapshots():
    filled = contract.Backfill("trades_ms", "rolling", "zero", 0.0, "1d", {"max_threads": 4})
    made = snapshot(parents=(contract.Parent("trades_ms", 2), contract.Parent("b")), backfill=filled).as_dict()
    assert made["parent_contracts"] == [{"feature_name": "trades_ms", "feature_version": 2}, {"feature_name": "b"}]
    assert made["defined_start_ts"] == "2024-01-01T00:00:00.000Z" and made["feature_type"] == "time_based" and made["own_lookforward_ms"] == 0
    assert made["backfill"] == {"compute_backend": "spark_batch", "source_table": "trades_ms", "template": "rolling", "fill_policy": "zero", "resource_settings": {"max_threads": 4}, "fill_value": 0.0, "chunk_span": "1d"}
    assert "backfill" not in snapshot().as_dict() and snapshot(extra={"k": 1}).as_dict()["extra"] == {"k": 1}
    assert snapshot().as_json().startswith('{"defined_end_ts":"2024-02-01T00:00:00.000Z","defined_start_ts"')
    hashes = {snapshot(backfill=b).hash for b in (None, contract.Backfill("a", "t"), contract.Backfill("b", "t"))} | {snapshot(version=2).hash}
    assert len(hashes) == 4 and all(len(h) == 64 for h in hashes)
    aim = snapshot(kind="target", target=True, causal=False, own_lookback_ms=0, own_lookforward_ms=180_000)
    assert (aim.own_lookback_ms, aim.own_lookforward_ms) == (0, 180_000)
    bound = registry.target_feature("price_delta")
    assert Snapshot.of(bound, 1, datetime(2024, 1, 1), datetime(2024, 1, 1)).as_dict()["own_lookforward_ms"] == 4000


@pytest.mark.parametrize(
    "change",
    [
        {"name": ""}, {"version": 0}, {"end": datetime(2023, 1, 1)}, {"kind": "odd"}, {"kind": "target"}, {"target": True}, {"own_lookback_ms": -1},
        {"own_lookforward_ms": 1}, {"kind": "target", "target": True, "own_lookback_ms": 5}, {"kind": "time_point", "target": True},
    ],
)
def test_invalid_snapshots(change):
    with pytest.raises(ValueError):
        snapshot(**change)


@pytest.mark.parametrize("change", [{"source_table": ""}, {"template": " "}, {"fill_policy": "guess"}, {"backend": "other"}])
def test_invalid_backfills(change):
    with pytest.raises(ValueError):
        contract.Backfill(**({"source_table": "t", "template": "x"} | change))
