import math
import random

import numpy as np
import pytest

from tickloom.llm import langid, toxicity

GOOD = "the sun sets over quiet hills and people walk home with bread and stories to tell near rivers".split()
BAD = "idiot moron scum loser".split()


def corpus(n, seed=0):
    draw = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = draw.choices(GOOD, k=draw.randrange(5, 150))
        if i % 3 == 0:
            for _ in range(2):
                words.insert(draw.randrange(len(words)), draw.choice(BAD))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_gradients_match_differences():
    texts, labels = corpus(6)
    text = toxicity.Text(texts)
    net = toxicity.Network(text.hashes[::2], np.zeros(len(text.hashes[::2]), np.float32))
    doc, first, size = text.windows()
    label, rows = np.array(labels, np.float32)[doc], net.rows(text)

    def loss():
        x = net.logits(text)[2].astype(float)
        return float(np.mean(np.logaddexp(0, x) - label * x))

    g = net.gradients(text, rows, first, size, label)
    for name in net.w:
        flat, want = net.w[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(want))[:3]:
            was, eps = flat[i], 1e-2
            flat[i] = was + eps
            up = loss()
            flat[i] = was - eps
            down = loss()
            flat[i] = was
            assert (up - down) / (2 * eps) == pytest.approx(want[i], rel=0.05, abs=2e-4), name


def test_windows_cover_every_word():
    text = toxicity.Text(["a " * n for n in (0, 1, 24, 25, 36, 37, 100)])
    doc, first, size = text.windows()
    for d in range(7):
        n = text.begin[d + 1] - text.begin[d]
        seen = {w for a, k in zip(first[doc == d], size[doc == d], strict=True) for w in range(a, a + k)}
        assert seen == set(range(text.begin[d], text.begin[d] + n))


def test_learns_and_spots_one_window_in_a_long_text(spark):
    texts, labels = corpus(600)
    net = toxicity.build(texts, labels)
    fresh, truth = corpus(200, seed=5)
    score = net.scores(fresh)
    assert ((score >= 0.3) == np.array(truth, bool)).mean() > 0.97
    draw = random.Random(7)
    long = draw.choices(GOOD, k=20_000)
    rows = [(1, " ".join(long)), (2, " ".join([*long[:9000], "you", "idiot", "moron", *long[9000:]])), (3, None), (None, ""), (5, "!?"), (1, fresh[0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, net).collect()]
    assert [s for i, s in got if i in (3, None, 5)] == [0.0] * 3
    assert [s >= 0.3 for i, s in got if i == 2] == [True] and min(s for i, s in got if i == 1) < 0.3 or truth[0]
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_fit_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (4, None)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = langid.held_out("doc_id", 4, 2)
    net = toxicity.fit(docs, labels.where(~out))
    rows = toxicity.score(docs.where(out), net).join(labels, "doc_id").select("score", "toxic").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows]) > 0
    rank = np.argsort(np.argsort(score))
    auc = (rank[toxic].mean() - (toxic.sum() - 1) / 2) / (~toxic).sum()
    assert auc > 0.95


def test_every_window_is_scored():
    draw = random.Random(9)
    texts = [" ".join(draw.choices(GOOD + BAD, k=n)) for n in (0, 1, 11, 12, 13, 40, 300)]
    text = toxicity.Text(texts)
    net = toxicity.Network(text.hashes[::2], np.zeros(len(text.hashes[::2]), np.float32))
    alone = [[" ".join(w[i : i + toxicity.WINDOW]) for i in range(max(len(w) - toxicity.WINDOW + 1, 1))] for w in map(str.split, texts)]
    want = [net.highest(toxicity.Text(x), len(x)).max() for x in alone]
    for lanes in (7, 1024):
        assert net.highest(text, len(texts), lanes).tolist() == pytest.approx(want, abs=1e-5)
    assert want[6] > net.logits(text)[2][text.windows()[0] == 6].max()  # windows that overlap by half miss it


def plain_odds(net, text: str) -> float:
    """The highest window's log-odds with plain Python numbers, word by word and unit by unit."""
    w, u = {k: v.astype(float).tolist() for k, v in net.w.items()}, toxicity.UNITS
    known = {int(h): i + 1 for i, h in enumerate(net.vocabulary)}

    def vector(word):
        own = toxicity.Text([word])
        tri = [w["char"][int(t)] for t in own.trigrams]
        return w["word"][known.get(int(own.hashes[0]), 0)] + [sum(c) / len(tri) for c in zip(*tri, strict=True)]

    def read(vectors, d):
        h, out = [0.0] * u, []
        for x in vectors:
            gate = [w[f"bias_{d}"][j] + sum(x[i] * w[f"in_{d}"][i][j] for i in range(len(x))) for j in range(3 * u)]
            back = [sum(h[i] * w[f"rec_{d}"][i][j] for i in range(u)) for j in range(3 * u)]
            z, r = ([1 / (1 + math.exp(-gate[k * u + j] - back[k * u + j])) for j in range(u)] for k in (0, 1))
            new = [math.tanh(gate[2 * u + j] + r[j] * back[2 * u + j]) for j in range(u)]
            h = [(1 - z[j]) * new[j] + z[j] * h[j] for j in range(u)]
            out.append(h)
        return out

    words = text.lower().split()
    best = -math.inf
    for at in range(max(len(words) - toxicity.WINDOW, 0) + 1):
        inputs = [vector(x) for x in words[at : at + toxicity.WINDOW]]
        states = [a + b for a, b in zip(read(inputs, "f"), read(inputs[::-1], "b")[::-1], strict=True)]
        e = [math.exp(sum(a * s for a, s in zip(w["attend"], h, strict=True))) for h in states]
        value = [sum(a * s for a, s in zip(w["out"], h, strict=True)) for h in states]
        best = max(best, sum(a * b for a, b in zip(e, value, strict=True)) / sum(e) + w["bias"][0])
    return best


def test_scores_match_a_plain_forward_pass():
    texts, labels = corpus(60, seed=3)
    net = toxicity.build(texts, labels, epochs=1)
    fresh = [*corpus(8, seed=4)[0], "unseen words beside a moron", "idiot"]
    want = [1 / (1 + math.exp(-(net.slope * plain_odds(net, t) + net.shift))) for t in fresh]
    assert net.scores(fresh).tolist() == pytest.approx(want, abs=1e-4)


def test_sample_is_bounded_whatever_repeats(spark):
    texts, labels = corpus(40)
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(50)] + [(0, "another text of a hot id")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels) for _ in range(20)], "doc_id long, toxic int")
    seen = []
    build = toxicity.build
    toxicity.build = lambda texts, labels: seen.append(len(texts)) or build(texts, labels, epochs=1)
    try:
        assert toxicity.fit(docs, marks, per_class=5) is not None
    finally:
        toxicity.build = build
    assert seen == [10]
