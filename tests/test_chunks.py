"""Timelines, splits, horizons, batches, hashes: hand-computed fixtures and properties."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, chunks, horizons

S = chunks.SECOND


def line(spark, seconds, key=None):
    if key is None:
        return spark.createDataFrame([(int(s * S),) for s in seconds], "us long")
    return spark.createDataFrame([(key, int(s * S)) for s in seconds], "symbol string, us long")


def spans(df, *names):
    return [tuple(r[n] / S for n in names) for r in df.orderBy("chunk_idx").collect()]


def test_equal_wall_chunks(spark):
    assert spans(chunks.wall_chunks(0, 20 * S, 2, spark), "start_us", "end_us") == [(0, 9), (10, 20)]


def test_gap_stripped_chunks(spark):
    instants = line(spark, [0, 5, 10, 35, 40])
    assert spans(chunks.global_chunks(instants, 3, 10 * S), "start_us", "end_us") == [(0, 4), (5, 9), (10, 40)]
    total = chunks.span(chunks.segments(instants, 10 * S)).first()
    assert (total.total_real_us, total.total_eff_us) == (40 * S, 15 * S)


def test_a_timeline_needs_two_points(spark):
    assert chunks.require_points(line(spark, [1, 2])).count() == 2
    with pytest.raises(ValueError):
        chunks.require_points(line(spark, [1, 1]).distinct())


def test_thirds(spark):
    whole = spark.createDataFrame([(0, 0, 9 * S), (1, 0, 2 * S)], "chunk_idx int, start_us long, end_us long")
    rows = chunks.thirds(whole).orderBy("chunk_idx", "part_idx").collect()
    assert [(r.part, r.part_start_us // S, r.part_end_us // S) for r in rows[:3]] == [("train", 0, 2), ("validation", 3, 5), ("test", 6, 9)]
    assert [r.collapsed for r in rows] == [False] * 3 + [True] * 3


def literal_segments(us, gap):
    us, out, cum = sorted(set(us)), [], 0
    for a, b in zip(us, us[1:], strict=False):
        eff = 0 if gap is not None and b - a > gap else b - a
        cum += eff
        out.append((a, b, b - a, eff, cum))
    return out


def literal_boundaries(us, gap, n):
    segs = literal_segments(us, gap)
    total, out = segs[-1][4], []
    for i in range(1, n):
        target = total * i // n
        out += [(i, a + target - (cum - eff)) for a, _, _, eff, cum in segs if eff and cum - eff < target <= cum]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_segments_and_boundaries_match_a_loop(spark, seed):
    draw = random.Random(seed)
    us = [draw.randrange(40_000) * S // 3 for _ in range(120)]
    gap = draw.choice([None, 300 * S, 900 * S])
    instants = chunks.timeline(spark.createDataFrame([(u,) for u in us], "u long"), F.col("u"))
    segs = chunks.segments(instants, gap, bucket_us=1000 * S)
    assert sorted(map(tuple, segs.collect())) == literal_segments(us, gap)
    assert sorted(map(tuple, chunks.boundaries(segs, 9).collect())) == literal_boundaries(us, gap, 9)
    keyed = chunks.segments(instants.select(F.lit("A").alias("k"), "us"), gap, ["k"])
    assert sorted((r.idx, r.boundary_us) for r in chunks.boundaries(keyed, 9, ["k"]).collect()) == literal_boundaries(us, gap, 9)


def test_parts_cover_and_do_not_overlap(spark):
    draw = random.Random(8)
    instants = line(spark, sorted({draw.randrange(100_000) for _ in range(400)}))
    whole = chunks.global_chunks(instants, 5, 900 * S)
    parts = chunks.effective_thirds(instants, whole, 900 * S).orderBy("part_start_us").collect()
    assert len(parts) == 15 and not any(r.collapsed for r in parts)
    for a, b in zip(parts, parts[1:], strict=False):
        assert b.part_start_us - a.part_end_us == S
    assert parts[0].part_start_us == instants.agg(F.min("us")).first()[0] and parts[-1].part_end_us == instants.agg(F.max("us")).first()[0]


def test_counts_and_empty_chunks(spark):
    rows = line(spark, [1, 1, 2, 30])
    whole = spark.createDataFrame([(0, 0, 5 * S), (1, 6 * S, 20 * S), (2, 21 * S, 40 * S)], "chunk_idx int, start_us long, end_us long")
    counted = chunks.counted(rows, whole)
    assert [r.n_rows for r in counted.orderBy("chunk_idx").collect()] == [3, 0, 1]
    assert [(r.chunk_idx, r.start_us) for r in chunks.renumbered(counted).orderBy("chunk_idx").collect()] == [(0, 0), (1, 21 * S)]
    assert [r.n_rows for r in chunks.counts(rows, F.col("us"), [(0, 5 * S), (6 * S, 20 * S)]).collect()] == [3, 0]


def test_stats(spark):
    got = chunks.stats(spark.createDataFrame([(1,), (2,), (3,), (4,)], "n int"), "n").first()
    assert tuple(got)[:4] == (1.0, 4.0, 2.5, 2.5) and got.std == pytest.approx(1.2909944487)
    assert tuple(chunks.stats(spark.createDataFrame([], "n int"), "n").first()) == (0.0,) * 5
    assert chunks.stats(spark.createDataFrame([(7,)], "n int"), "n").first().std == 0.0


def test_signatures_and_session(spark):
    whole = chunks.wall_chunks(0, 60 * S, 2, spark)
    signed = chunks.signatures(chunks.thirds(whole), "SYM", "abc")
    first = signed.where("chunk_idx = 0 and part = 'train'").first()
    text = "SYM|1970-01-01T00:00:00.000Z|1970-01-01T00:00:08.666Z|train|abc"
    assert first.part_end_us == 8_666_666 and first.signature == hashlib.sha256(text.encode()).hexdigest()
    session = chunks.session(signed).first()
    assert len(session.chunks_list) == 6 and session.chunks_list[0] == first.signature
    assert session.chunks_list_hash == hashlib.sha256("|".join(session.chunks_list).encode()).hexdigest()


def test_manual_and_latest(spark):
    history = None
    for i in range(4):
        row = chunks.manual(spark, "A", "trades", f"n{i}", 0, S, i * S)
        history = row if history is None else history.unionByName(row)
    assert [r.chunk_description for r in chunks.latest(history, "A", 2).collect()] == ["n3", "n2"]
    assert len(history.first().chunk_hash) == 64


def test_gap_report(spark):
    got = chunks.gap_report(spark.createDataFrame([("t", 5 * S, 8 * S)], "name string, first_us long, last_us long"), 0, 10 * S).first()
    assert (got.head_gap_us, got.tail_gap_us) == (5 * S, 2 * S)


def test_embargo_and_purge(spark):
    df = spark.createDataFrame([(0, 60 * S), (0, 5 * S)], "a long, b long")
    a, b = F.col("a"), F.col("b")
    row = df.select(horizons.embargo(a, b, 5 * S).alias("e"), horizons.purge(a, b, 7 * S).alias("p"), horizons.is_empty(horizons.embargo(a, b, 10 * S), b).alias("x")).collect()
    assert (row[0].e, row[0].p, row[0].x) == (6 * S, 52 * S, False) and row[1].x


def ms(spark, values):
    return spark.createDataFrame([("A", int(v)) for v in values], "symbol string, ms long")


def test_train_share(spark):
    assert tuple(horizons.train_share(ms(spark, range(10))).first()) == (10, 7, 3, 7)
    assert tuple(horizons.train_share(ms(spark, [0, 1, 2, 3, 4, 5, 6, 6, 8, 9])).first())[1] == 8
    for bad in ([0, 1, 2, 3, 4, 5, 6, 6, 6, 6], [1], []):
        assert horizons.train_share(ms(spark, bad)).count() == 0


def test_kth_instant(spark):
    tape = ms(spark, [5, 5, 1, 9_000_000, 7])
    assert [[r.ms for r in horizons.kth_instant(tape, k).collect()] for k in range(6)] == [[1], [5], [5], [7], [9_000_000], []]


def test_row_batches(spark):
    got = [tuple(r) for r in horizons.row_batches(ms(spark, [1, 2, 3, 3, 4]), 2, ["symbol"]).orderBy("batch").collect()]
    assert got == [("A", 0, 1, 3, 2), ("A", 1, 3, 4, 2), ("A", 2, 4, 1004, 1)]
    hot = [tuple(r)[1:] for r in horizons.row_batches(ms(spark, [5] * 9), 2, ["symbol"], end=8).collect()]
    assert hot == [(0, 5, 8, 9)]
    assert horizons.row_batches(ms(spark, []), 2).count() == 0


def test_bars(spark):
    rows = [("A", 100, 1, 10.0, 2, "buy"), ("A", 900, 3, 12.0, 1, "sell"), ("A", 900, 2, 11.0, 1, None), ("A", 1000, 4, 9.0, 1, "buy")]
    got = bars.bars(spark.createDataFrame(rows, "symbol string, ms long, trade_id long, price double, quantity long, side string")).orderBy("bin_ms").collect()
    assert (got[0].trade_count, got[0].trade_count_buy, got[0].trade_count_sell) == (3, 1, 1)
    assert (got[0].price_first, got[0].price_last, got[0].volume_total, got[0].notional_buy) == (10.0, 12.0, 4.0, 20.0)
    assert got[1].price_std is None and got[1].volume_sell == 0.0


@pytest.mark.parametrize("seed", range(2))
def test_row_batches_match_the_loop(spark, seed):
    draw = random.Random(seed)
    tape = {k: sorted(draw.randrange(draw.choice([50, 40_000_000])) for _ in range(draw.randrange(1, 400))) for k in "AB"}
    rows = spark.createDataFrame([(k, x) for k, xs in tape.items() for x in xs], "symbol string, ms long")
    for most in (1, 7, 90, 1000):
        want = []
        for k, xs in tape.items():
            batch, i = 0, 0
            while i < len(xs):
                stop = min(i + most, len(xs)) - 1
                while stop + 1 < len(xs) and xs[stop + 1] == xs[stop]:
                    stop += 1
                want.append((k, batch, xs[i], xs[stop + 1] if stop + 1 < len(xs) else xs[-1] + 1000, stop + 1 - i))
                batch, i = batch + 1, stop + 1
        assert sorted(map(tuple, horizons.row_batches(rows, most, ["symbol"]).collect())) == want


def test_batches_are_run_in_order(spark):
    seen, said = [], []
    n = horizons.run_batches(ms(spark, [1, 2, 3, 3, 4]), 2, seen.append, log=said.append)
    assert n == 3 and [(b.index, b.start, b.end, b.rows, b.last) for b in seen] == [(0, 1, 3, 2, False), (1, 3, 4, 2, False), (2, 4, 1004, 1, True)]
    assert said[0] == "batch 0: 2 rows in [1, 3)"
    assert horizons.run_batches(ms(spark, []), 2, seen.append) == 0 and len(seen) == 3


def test_trimmed_as_json(spark):
    df = spark.createDataFrame([(0, 60 * S)], "a long, b long")
    get = lambda us, what: json.loads(df.select(horizons.trimmed(F.col("a"), F.col("b"), us, what)).first()[0])
    whole = {"original_start": "1970-01-01T00:00:00.000Z", "original_end": "1970-01-01T00:01:00.000Z", "extra_gap_seconds": 1.0}
    assert get(5 * S, "embargo") == whole | {"start": "1970-01-01T00:00:06.000Z", "end": "1970-01-01T00:01:00.000Z", "applied_horizon_seconds": 5.0, "operation": "embargo", "is_empty": False}
    assert get(7 * S, "purge")["end"] == "1970-01-01T00:00:52.000Z" and get(90 * S, "purge")["is_empty"]
    with pytest.raises(ValueError):
        get(1, "cut")


def test_a_split_that_cannot_be_is_an_error(spark):
    assert horizons.require_split(ms(spark, range(10))).n_train == 7
    for bad in ([], [1], [5] * 9):
        with pytest.raises(ValueError):
            horizons.require_split(ms(spark, bad))
