import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import suffixdedup, wordhash


def corpus(seed, n=40):
    draw = random.Random(seed)
    fresh = lambda k: [f"w{draw.randrange(10**6)}" for _ in range(k)]
    passages = [fresh(k) for k in (49, 50, 51, 60, 75, 130, 400)]
    out = []
    for i in range(n):
        words = fresh(draw.choice([0, 5, 40, 120, 300]))
        for p in draw.sample(passages, draw.randrange(3)):
            words += p + fresh(draw.randrange(30))
        out.append(draw.choice([" ", "\n", "  "]).join(words))
    return [*out, out[3], out[5].upper(), None, "", "x " * 40, " ".join(fresh(70) * 2)]


def positions(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    texts = dict(enumerate(corpus(seed)))
    docs = spark.createDataFrame([(k, t, "a", "b") for k, t in texts.items()], "doc_id long, text string, rid string, row string")
    rows = suffixdedup.find(docs).collect()
    got = positions(rows)
    assert {k: sorted(got[k]) for k in texts} == suffixdedup.brute_force(texts)
    for r in rows:  # what is reported stands in the reference too
        a, b = ((texts[k] or "").lower().split() for k in (r.doc_id, r.ref_doc_id))
        assert a[r.start_word : r.start_word + 50] == b[r.ref_start_word : r.ref_start_word + 50]


def test_removal_keeps_one_of_each(spark):
    texts = dict(enumerate(corpus(3)))
    docs = spark.createDataFrame([(k, t, k) for k, t in texts.items()], "doc_id long, text string, spans int")
    left = suffixdedup.remove(docs)
    assert left.columns == docs.columns
    after = {r.doc_id: (r.text or "").split() for r in left.collect()}
    inside = {i: set(p) for i, p in suffixdedup.brute_force(texts).items()}
    kept = {i: [w for j, w in enumerate((t or "").split()) if j not in inside[i]] for i, t in texts.items()}
    assert after == {i: words for i, words in kept.items() if words or not inside[i]}


def family(seed, copies=60):
    """Copies of one text with their own edits, none of them the original."""
    draw = random.Random(seed)
    original = [f"w{draw.randrange(10**6)}" for _ in range(700)]
    out = []
    for _ in range(copies):
        words = list(original)
        for _ in range(6):
            words[draw.randrange(700)] = f"e{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_result_does_not_depend_on_tasks(spark):
    texts = dict(enumerate(family(4) + corpus(5)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "5", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, suffixdedup.find(docs).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
    got = positions(suffixdedup.find(docs).collect())
    want = {k: set(p) for k, p in suffixdedup.brute_force(texts).items()}
    assert {k: got[k] for k in texts} == want


def test_many_variants_of_one_beginning(spark):
    """49 words of boilerplate and then one of several sequels, dealt out by turns, with rows of equal ids between."""
    draw = random.Random(11)
    fresh = lambda k: [f"w{draw.randrange(10**6)}" for _ in range(k)]
    notice, ends = fresh(49), [fresh(draw.randrange(1, 30)) for _ in range(7)]
    starts = [fresh(draw.randrange(1, 30)) for _ in range(5)]
    texts = {i: " ".join(fresh(draw.randrange(40)) + starts[i % 5] + notice + ends[i % 7] + fresh(draw.randrange(40))) for i in range(150)}
    for seed in range(3):
        many = texts | {200 + i: " ".join(w if draw.random() > 0.02 else "z" for w in t.split()) for i, t in texts.items()}
        got = positions(suffixdedup.find(spark.createDataFrame(list(many.items()), "doc_id long, text string")).collect())
        assert {k: sorted(got[k]) for k in many} == suffixdedup.brute_force(many)


@pytest.mark.parametrize("least", [16, 23, 50])
def test_few_distinct_words(spark, least):
    draw = random.Random(least)
    texts = {i: " ".join(draw.choices("ab", weights=[9, 1], k=draw.randrange(150))) for i in range(40)}
    got = positions(suffixdedup.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), min_words=least).collect())
    assert {k: sorted(got[k]) for k in texts} == suffixdedup.brute_force(texts, least)


def test_hot_row_without_an_id_is_dealt_to_several_tasks(spark):
    body = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(None, body)] * 5000 + [(1, "other")], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = suffixdedup.numbered(docs, "doc_id", "text", suffixdedup.Scratch(spark, "test"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows.select("rid").distinct().count() == 5001
    assert rows.where("doc_id is null").select((F.col("rid") / 2**33).cast("long").alias("task")).distinct().count() > 1
    assert suffixdedup.find(docs).count() == 4999


def test_repeated_ids_and_nulls(spark):
    body = " ".join(f"v{i}" for i in range(80))
    rows = [(1, body), (1, body), (None, body), (2, "short"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixdedup.find(docs).collect()
    assert len(found) == 2 and all(r.n_words == 80 for r in found)
    assert sorted((r.doc_id or 0) for r in suffixdedup.remove(docs).collect()) in ([0, 2, 3], [1, 2, 3])
    assert suffixdedup.find(docs.limit(0)).count() == 0
    assert suffixdedup.remove(docs.limit(0)).count() == 0


def test_word_table_in_blocks():
    text = ("Some WORDS\tof\n" * 3000 + "x" * 5000 + " end").encode()
    whole, parts = wordhash.words(text), wordhash.words(text, block=64)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert len(whole[2]) == len(text.split())
    assert whole[2][0] == wordhash.words(b"some")[2][0] != wordhash.words(b"somf")[2][0]
    data = np.arange(50, dtype=np.uint64)[::-1]
    assert (wordhash.sliding(np.minimum, data, 7) == [data[i : i + 7].min() for i in range(44)]).all()


def test_long_text(spark):
    draw = random.Random(9)
    body = " ".join(f"w{draw.randrange(10**7)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, body), (2, "a b c " + body[:700_000])], "doc_id long, text string")
    (row,) = suffixdedup.find(docs).collect()
    assert row.doc_id == 2 and row.start_word == 3 and row.ref_start_word == 0
    assert row.n_words in (len(body[:700_000].split()), len(body[:700_000].split()) - 1)
