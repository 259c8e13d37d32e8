import math
import random

import numpy as np
import pytest

from tickloom.llm import simhash
from tickloom.llm.common import Scratch


def near_copies(seed, groups=30):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(groups):
        words = draw.choices(vocabulary, k=draw.choice([3, 12, 60, 200]))
        out.append(" ".join(words))
        for _ in range(draw.randrange(4)):
            copy = list(words)
            copy[draw.randrange(len(copy))] = "CHANGED"
            out.append("\t".join(copy))
    return out + [None, "", "  \n", "Same Text", "same text", "é ü ß x y", out[0]]


def test_matches_brute_force(spark):
    texts = dict(enumerate(near_copies(1)))
    docs = spark.createDataFrame([(k, t, "fp", 1) for k, t in texts.items()], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.classes(docs).collect()}
    assert got == simhash.brute_force(texts)


def planted(draw, n=400):
    """Fingerprints with links at 0 to 6 differing bits, chains and dense groups."""
    points = [draw.getrandbits(64) for _ in range(n)]
    for p in points[:60]:
        for _ in range(draw.randrange(1, 12)):
            for bit in draw.sample(range(64), draw.randrange(1, 7)):
                p ^= 1 << bit
            points.append(p)
    return sorted(set(points))


def roots_of(pairs, points):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


@pytest.mark.parametrize("cell_rows", [4096, 2])
def test_no_link_is_lost(spark, cell_rows):
    points = planted(random.Random(5))
    whole = np.array(points, dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(whole[:, None] ^ whole[None, :]) <= 4)
    want = roots_of([(points[i], points[j]) for i, j in near], points)
    frame = spark.createDataFrame([(int(x),) for x in whole.view(np.int64)], "fp long")
    found = simhash.links(frame, Scratch(spark, "test"), cell_rows=cell_rows).collect()
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found]
    assert roots_of(pairs, points) == want


def test_manhattan_is_a_lower_bound():
    x = np.random.default_rng(0).integers(0, 1 << 63, size=(2, 5000), dtype=np.uint64)
    assert (np.bitwise_count(simhash.embed(x[0]) ^ simhash.embed(x[1])) <= np.bitwise_count(x[0] ^ x[1])).all()


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.classes(docs).collect())
    assert got == [(-1, 3), (-1, 3), (-1, 9), (3, 3), (3, 3), (9, 9)]
    assert simhash.classes(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == [3, 9]
    lone = spark.createDataFrame([(None, "a b c d e", 1), (None, "f g h i j", 2), (4, "k l m", 3), (4, "n o p", 4)], "doc_id long, text string, rid int")
    assert sorted(r.rid for r in simhash.representatives(lone).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("points", [10, 10**6, 10**8, 10**10])
def test_first_grid_follows_the_number_of_points(points):
    groups = simhash.groups_for(points, 4)
    assert 6 <= groups <= 12 and len(simhash._grids(0, 4, points)) == math.comb(groups, 4)
    assert groups == 12 or points / (8 / 3) ** (32 * (groups - 4) / groups) <= 32


def test_long_text_in_blocks():
    text = (" ".join(f"w{i % 977}" for i in range(100_000))).encode()
    assert simhash.fingerprint(text) == simhash.fingerprint(text, block=1 << 20)
