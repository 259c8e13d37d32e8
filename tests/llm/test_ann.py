import numpy as np
import pytest

from tickloom.llm import ann


def vectors(n, dim=16, seed=0, scale=False):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim)) + 2 * draw.normal(size=(8, dim))[draw.integers(0, 8, n)]
    return x * draw.uniform(0.2, 3, size=(n, 1)) if scale else x / np.linalg.norm(x, axis=1, keepdims=True)


def run(spark, rows, k=5, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")
    got = ann.search(frame, frame.where("vec_id % 20 = 0"), k=k, **options).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_scores(spark, scale):
    x = vectors(3000, scale=scale)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    got = run(spark, rows, k=20, part_bytes=1 << 16)
    want = ann.brute_force({i: v for i, v, _ in rows}, list(got), 20)
    assert set(got) == set(range(0, 3000, 20))
    hits = sum(len({i for _, i, _ in got[q]} & set(want[q])) for q in got)
    assert hits / (20 * len(got)) >= 0.9
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(s == pytest.approx(float(x[q] @ x[i]), rel=1e-12) and i != q for _, i, s in found)


def test_copies_ties_and_unusable_rows(spark):
    x = vectors(300, seed=3)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    rows += [(i, x[7].tolist(), "b") for i in range(300, 500)] + [(300, x[7].tolist(), "again")]
    rows += [(520, None, "b"), (540, [0.0] * 16, "b"), (560, [1.0, None] * 8, "b"), (580, [float("nan")] * 16, "b"), (600, [1.0], "b"), (None, x[0].tolist(), "b")]
    got = run(spark, rows)
    assert set(got) == set(range(0, 500, 20))
    for q in (300, 320, 480):
        assert [i for _, i, _ in got[q]] == [i for i in (7, 300, 301, 302, 303, 304) if i != q][:5]


def test_few_rows_give_all(spark):
    rows = [(i, v.tolist(), "a") for i, v in enumerate(vectors(4))]
    got = run(spark, rows, k=20)
    assert {q: len(f) for q, f in got.items()} == {0: 3}
    assert run(spark, rows[:1]) == {}
    assert run(spark, []) == {}


def test_crowded_buckets_are_split(spark):
    draw = np.random.default_rng(1)
    x = np.concatenate((vectors(200), vectors(1)[0] + 1e-4 * draw.normal(size=(800, 16))))
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    got = run(spark, rows, part_bytes=1 << 14)
    want = ann.brute_force({i: v for i, v, _ in rows}, list(got), 5)
    assert sum(len({i for _, i, _ in got[q]} & set(want[q])) for q in got) / (5 * len(got)) >= 0.9


def test_probes_answer_every_query_in_one_part(spark, monkeypatch):
    # With the default part_bytes all tables share one part; the probes alone must give k distinct points.
    asked, exact = [], ann._exact
    monkeypatch.setattr(ann, "_exact", lambda points, queries, *rest: asked.append(queries.count()) or exact(points, queries, *rest))
    x = vectors(5000, dim=64, seed=5)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    got = run(spark, rows, k=20)
    assert asked[0] > 0 and asked[1:] == [0]  # the fit's trial, then the queries that fell short
    want = ann.brute_force({i: v for i, v, _ in rows}, list(got), 20)
    assert set(got) == set(range(0, 5000, 20))
    assert sum(len({i for _, i, _ in got[q]} & set(want[q])) for q in got) / (20 * len(got)) >= 0.9


def test_mixed_lengths_and_no_usable_query(spark):
    x = vectors(200, dim=16, seed=2)
    rows = [(i, v.tolist()[:8] if i % 20 == 0 and i else v.tolist(), "a") for i, v in enumerate(x)]
    got = run(spark, rows)
    assert set(got) == {0}
    assert [i for _, i, _ in got[0]] == ann.brute_force({i: v for i, v, _ in rows if len(v) == 16}, [0])[0][:5]
    assert run(spark, [(i, v if i % 20 else v[:8], "a") for i, v, _ in rows]) == {}


def test_exact_where_the_trial_fails(spark):
    rows = [(i, v.tolist(), "a") for i, v in enumerate(vectors(400, seed=8))]
    rows += [(400 + i, rows[i][1], "b") for i in range(30)]
    got = run(spark, rows, k=20, tables=1, width=0.01, most_probes=1)
    want = ann.brute_force({i: v for i, v, _ in rows}, list(got), 20)
    assert {q: [i for _, i, _ in f] for q, f in got.items()} == want


def test_exact_in_blocks(spark):
    x = vectors(500, seed=6)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "p long, v array<double>")
    queries = points.where("p % 7 = 0").withColumnRenamed("p", "q").select("q", "v")
    scratch = ann.Scratch(spark, "test")
    found = ann._best(ann._exact(points, queries, 16, 6, 4, scratch, query_bytes=10 * 128), 5).collect()
    assert scratch.n == 8
    want = ann.brute_force({i: v.tolist() for i, v in enumerate(x)}, list(range(0, 500, 7)), 5)
    for q in want:
        assert [r.p for r in sorted((r for r in found if r.q == q), key=lambda r: (-r.score, r.p))][1:] == want[q]
