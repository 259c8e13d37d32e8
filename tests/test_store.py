"""Archives, the key-value store, tables, fills, text helpers."""

import gzip
import hashlib
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import timeaxis, values
from tickloom.operators import chunks, kv
from tickloom.sources import tables, trades


def archive(folder, name, *lines):
    with gzip.open(folder / name, "wt", encoding="utf-8-sig", newline="") as f:
        f.write("id,timestamp,price,volume,side\r\n" + "".join(f"{x}\r\n" for x in lines))
    return str(folder / name)


def test_archives(spark, tmp_path):
    a = archive(tmp_path, "SYM-2024-05.csv.gz", "42,5000,1.5,2.0,sell,1", "", "1,999,1,1,buy", "short,1,2", "7,3000.9,1,1,", "8,1000,1,1,Block")
    archive(tmp_path, "OTH_2024-05-31.csv.gz", "1,1,1,1,x")
    got = {r.trade_id: r for r in trades.read_archives(spark, [a]).collect()}
    assert set(got) == {"42", "1", "7", "8"} and {r.symbol for r in got.values()} == {"SYM"}
    assert [got[k].side for k in ("42", "1", "7", "8")] == ["sell", "buy", "buy", "buy"]
    assert got["7"].exchange_ts.replace(tzinfo=UTC) == datetime.fromtimestamp(3, UTC)
    assert trades.read_archives(spark, [a], start_ms=1000).count() == 3
    bounds = trades.file_bounds(spark, [a]).first()
    assert (bounds.n_rows, bounds.min_ms, bounds.max_ms) == (4, 999, 5000)
    assert (bounds.first, bounds.last) == ("1970-01-01T00:00:00.999Z", "1970-01-01T00:00:05.000Z")
    assert trades.archives(spark, str(tmp_path), only=["SYM"]) == [a]
    assert len(trades.archives(spark, str(tmp_path), done={"SYM-2024-05.csv.gz": {}})) == 1
    assert trades.read_archives(spark, []).schema == schema.TRADES
    with pytest.raises(ValueError):
        trades.symbol_of("trades.csv.gz")
    bad = archive(tmp_path, "BAD-2024-05.csv.gz", "1,1,x,1,buy")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        trades.read_archives(spark, [bad]).collect()


def test_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/manifest.json"
    assert trades.load_manifest(spark, path) == {}
    for done in ({"a": {"first": "x"}}, {"a": {"first": "é\n"}, "b": {}}):
        trades.save_manifest(spark, path, done)
        assert trades.load_manifest(spark, path) == done
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["manifest.json"]


def test_only_new_archives_are_loaded(spark, tmp_path):
    for month in ("04", "05"):
        archive(tmp_path, f"SYM-2024-{month}.csv.gz", f"{month},5000,1.5,2.0,sell", f"x{month},7000,1,1,buy")
    folder, manifest = f"file://{tmp_path}", f"file://{tmp_path}/manifest.json"
    rows, done = trades.load_new(spark, folder, manifest, start_ms=6000)
    assert {r.trade_id for r in rows.collect()} == {"x04", "x05"}
    assert done["SYM-2024-04.csv.gz"] == {"first": "1970-01-01T00:00:05.000Z", "last": "1970-01-01T00:00:07.000Z", "rows": 2}
    trades.save_manifest(spark, manifest, {k: v for k, v in done.items() if "04" in k})
    rows, again = trades.load_new(spark, folder, manifest)
    assert {r.trade_id for r in rows.collect()} == {"05", "x05"} and again == done
    trades.save_manifest(spark, manifest, done)
    assert trades.load_new(spark, folder, manifest)[0].count() == 0 and trades.load_new(spark, folder, manifest, force=True)[0].count() == 4


def at(s):
    return datetime.fromtimestamp(s, UTC)


def test_ranges(spark):
    df = spark.createDataFrame([("A", at(i), str(i), 1.0, 1.0, "buy") for i in range(5)], schema.TRADES)
    assert trades.scan(df, "A", at(1), at(3), ["trade_id"]).count() == 2
    assert df.where(trades.in_range("A", at(1), at(3), end_inclusive=True)).count() == 3
    assert df.where(trades.in_range("A'; DROP TABLE x --")).count() == 0
    assert trades.bounds(df.limit(0)).first().first_ts is None
    assert [x.replace(tzinfo=UTC) for x in trades.range_bounds(df, "A", at(1), at(3))] == [at(1), at(3)]
    with pytest.raises(ValueError, match="no rows"):
        trades.range_bounds(df, "A", at(9), at(10))
    with pytest.raises(ValueError, match="no rows"):
        trades.range_bounds(df, "B", at(0), at(10))


def test_matrix_keeps_repeats(spark):
    rows = [("A", 1, "t", 1.0), ("A", 1, "t", 2.0), ("A", 2, "t", 3.0), ("A", 1, "a", 3.0), ("A", 1, "a", 5.0), ("A", 9, "a", 7.0), ("A", 1, "b", float("nan"))]
    store = spark.createDataFrame(rows, "symbol string, ms long, feature_name string, feature_value double")
    got = sorted((r.ms, r.target, r.a, r.b) for r in kv.matrix(store, "t", ["a", "b"]).collect())
    assert got == [(1, 1.0, 5.0, None), (1, 2.0, 5.0, None), (2, 3.0, None, None)]


def test_fill(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.5,)], "x double")
    got = kv.model_columns(df, {"x": {"special_value": -1, "onehot": True}}).collect()
    assert [(r.x, r.x_invalid) for r in got] == [(-1.0, 1), (-1.0, 1), (-1.0, 1), (1.5, 0)]
    assert values.replacement("1.0') OR 1=1 --") == 0.0 and values.replacement("2.5") == 2.5
    for bad, error in ((True, TypeError), (float("nan"), ValueError)):
        with pytest.raises(error):
            values.replacement(bad)


def test_fill_policies(spark):
    rows = [("A", i * 10, i, x, x) for i, x in enumerate([None, 1.0, None, None, 2.0, None])]
    df = spark.createDataFrame(rows, "symbol string, ms long, trade_id long, f double, z double")
    got = kv.filled(df, {"f": "causal_ffill", "z": "zero"}, bucket_ms=20).orderBy("ms").collect()
    assert [r.f for r in got] == [None, 1.0, 1.0, 1.0, 2.0, 2.0] and [r.z for r in got] == [0.0, 1.0, 0.0, 0.0, 2.0, 0.0]
    assert [r.f for r in kv.filled(df, {"f": "null"}).orderBy("ms").collect()] == [r[3] for r in rows]
    with pytest.raises(ValueError):
        kv.filled(df, {"f": "guess"})
    worst = kv.invalid_counts(df, ["f", "z", "ms"], 2).collect()
    assert [(r.feature_name, r.n_invalid) for r in worst] == [("f", 4), ("z", 4)]


def feature_rows(spark, rows):
    return spark.createDataFrame([("A", at(s), n, v) for s, n, v in rows], schema.FEATURES)


def test_replace_range(spark, tmp_path):
    path = str(tmp_path / "store")
    kv.write(feature_rows(spark, [(1, "a", 1.0), (5, "a", 2.0), (1, "b", 3.0), (2, "c", 4.0), (3, "a", float("nan"))]), path)
    new = feature_rows(spark, [(6, "a", 9.0)])
    kv.replace_range(spark, path, new, "A", at(4), at(10), ["a"])
    kv.replace_range(spark, path, new.limit(0), "A", at(0), at(10), ["c"])
    got = sorted((r.feature_name, r.exchange_ts.replace(tzinfo=UTC).timestamp(), r.feature_value) for r in kv.read(spark, path).collect())
    assert got == [("a", 1.0, 1.0), ("a", 6.0, 9.0), ("b", 1.0, 3.0)]
    assert kv.read(spark, path, "b").count() == 1


MONTH = 31 * 86400


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_replacing_keeps_columns_and_other_folders(spark, tmp_path):
    path = tmp_path / "store"
    rows = [(1, "signal x {a,b}", 1.0), (2 * MONTH, "signal x {a,b}", 2.0), (4 * MONTH, "signal x {a,b}", 3.0), (1, "007", 4.0), (2 * MONTH, "007", 5.0)]
    kv.write(feature_rows(spark, rows), str(path), extra={"feature_version": "1", "contract_hash": "h"})
    kv.write(feature_rows(spark, [(2 * MONTH, "007", 6.0)]).withColumn("symbol", F.lit("B")), str(path), extra={"feature_version": "1", "contract_hash": "h"})
    before = files(path)
    fresh = feature_rows(spark, [(2 * MONTH + 1, "signal x {a,b}", 7.0), (9 * MONTH, "new", 8.0), (1, "007", 10.0)])
    kv.replace_range(spark, str(path), fresh, "A", at(2 * MONTH), at(2 * MONTH + 60), extra={"feature_version": "2"})
    got = {(r.symbol, r.feature_name, r.feature_value): (r.feature_version, r.contract_hash) for r in kv.read(spark, str(path)).collect()}
    old, new = ("1", "h"), ("2", None)
    assert got == {
        ("A", "signal x {a,b}", 1.0): old, ("A", "signal x {a,b}", 3.0): old, ("A", "007", 4.0): old, ("B", "007", 6.0): old,
        ("A", "signal x {a,b}", 7.0): new, ("A", "new", 8.0): new, ("A", "007", 10.0): new,
    }
    same = {f for f in files(path) if before.get(f) == files(path)[f]}
    assert len(same) == 2 and all("signal" in f for f in same)  # the two months of it that the range doesn't touch
    kv.replace_range(spark, str(path), fresh.limit(0), "A", at(0), at(99 * MONTH))
    assert [(r.symbol, r.feature_value) for r in kv.read(spark, str(path)).collect()] == [("B", 6.0)]
    kv.replace_range(spark, str(path), fresh.limit(0), "B", at(0), at(99 * MONTH), ["007"])
    assert kv.read(spark, str(path)).count() == 0


def test_a_broken_replacement_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    kv.write(feature_rows(spark, [(1, "a", 1.0), (2, "a", 2.0)]), path)
    finish = kv.finish
    monkeypatch.setattr(kv, "finish", lambda *_: None)
    kv.replace_range(spark, path, feature_rows(spark, [(2, "a", 9.0)]), "A", at(2), at(3), ["a"])
    assert kv.fetch(kv.read(spark, path, ordered=True))["feature_value"] == [1.0, 2.0]
    monkeypatch.setattr(kv, "finish", finish)
    kv.replace_range(spark, path, feature_rows(spark, [(5, "b", 5.0)]), "A", at(5), at(6))
    assert kv.fetch(kv.read(spark, path, ordered=True))["feature_value"] == [1.0, 9.0, 5.0]
    (tmp_path / "store__staged" / "rows").mkdir(parents=True)  # one that was broken off while it was staged counts for nothing
    kv.finish(spark, path)
    assert kv.read(spark, path).count() == 3


def test_scan_of_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert kv.read(spark, path).columns == schema.FEATURES.names
    kv.write(feature_rows(spark, [(9 - i, "a", float(i)) for i in range(9)] + [(3 * MONTH, "a", 1.0), (3, "b", 1.0)]), path)
    found = kv.read(spark, path, "a", "A", at(3), at(7), ordered=True)
    assert kv.fetch(found)["feature_value"] == [6.0, 5.0, 4.0, 3.0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan or "month" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "feature_name" in plan.split("PartitionFilters:")[1].split("]")[0] and "GreaterThanOrEqual(exchange_ts" in plan
    assert kv.read(spark, path, ["a", "b"], "B").count() == 0


def test_signals_keep_nan(spark, tmp_path):
    kv.write(feature_rows(spark, [(1, "s", float("nan"))]), str(tmp_path / "s"), finite_only=False)
    assert kv.read(spark, str(tmp_path / "s")).count() == 1


def test_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS tick LOCATION '{tmp_path}/tick.db'")
    tables.create(spark, "tick")
    tables.require(spark, ["tick.trades", "tick.features"])
    with pytest.raises(LookupError):
        tables.require(spark, ["tick.nothing"])
    tables.append_trades(spark.createDataFrame([("A", at(0), "1", 1.0, 1.0, "buy")], schema.TRADES), "tick.trades")
    assert spark.table("tick.trades").first().month == "1970-01"
    assert tables.empty(spark, "features").schema == schema.FEATURES
    tables.append(chunks.manual(spark, "A", "trades", "note", 0, 1, 2).withColumn("odd", F.lit(1)), "tick.manual_chunks", "manual_chunks")
    marked = spark.table("tick.manual_chunks").first()
    assert marked.chunk_description == "note"
    assert marked.chunk_hash == hashlib.sha256(b"A|note|trades|1970-01-01T00:00:00.000Z|1970-01-01T00:00:00.000Z").hexdigest()
    assert spark.table("tick.bars").schema.names == schema.BARS.names
    spark.sql("DROP DATABASE tick CASCADE")


def test_writing_in_halves(spark, tmp_path):
    rows, path, tried = spark.range(1000).withColumn("x", F.lit("a")), str(tmp_path / "out"), []

    def write(part):
        tried.append(part.count())
        if tried[-1] > 300:
            raise RuntimeError("Memory limit exceeded")
        part.write.mode("append").parquet(path)

    assert tables.in_halves(rows, write) == 4 and tried[0] == 1000 and len(tried) == 7
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(1000))
    with pytest.raises(RuntimeError, match="Memory"):
        tables.in_halves(rows, write, depth=1)
    with pytest.raises(ValueError):
        tables.in_halves(rows, lambda part: int("x"))


def test_text_helpers(spark):
    assert timeaxis.parse_duration("7d") == timedelta(days=7) and timeaxis.parse_duration("12h") == timedelta(hours=12)
    assert timeaxis.parse_duration("off") is None and timeaxis.format_duration(timedelta(minutes=90)) == "90m"
    with pytest.raises(ValueError):
        timeaxis.parse_duration("soon")
    assert timeaxis.parse_instant("2024-01-01T02:00:00.1239+02:00") == datetime(2024, 1, 1, 0, 0, 0, 123000, UTC)
    assert timeaxis.parse_list(" a, ,b") == ["a", "b"]
    row = spark.range(1).select(timeaxis.duration_text(F.lit(273_906_000_000)).alias("d"), timeaxis.iso_ms(F.timestamp_micros(F.lit(123_999))).alias("i")).first()
    assert row.d == "3d 04:05:06" and row.i == "1970-01-01T00:00:00.123Z"
