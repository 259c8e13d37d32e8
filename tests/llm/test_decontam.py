import random

import pytest

from tickloom.llm import decontam

ITEM = "One two THREE four five six seven eight nine ten eleven"
ITEMS = [(1, ITEM), (2, "tiny item"), (3, None), (4, ""), (None, "no id"), (2, "tiny item"), (10, "é1 x")]
DOCS = [
    (1, "before: one, two three four-five six seven eight nine ten! after", "x"),
    (2, "Tiny  ITEM tiny item", None),
    (3, None, "y"),
    (4, "", "y"),
    (5, "nothing here", "y"),
    (5, "nothing here", "y"),
    (None, "É1 x é1 X and é1 x", "z"),
    (7, "word " * 30000 + ITEM, "z"),
    (8, "a text with no id in it", "z"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_words string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_matches_brute_force(tables):
    rows = decontam.scan(*tables).collect()
    assert len(rows) == len(DOCS)
    want = decontam.brute_force({i: t for i, (_, t, _) in enumerate(DOCS)}, dict(ITEMS))
    got = sorted((r.n_words, r.n_hit, r.item_ids) for r in rows)
    assert got == sorted(want.values()) and (7, 2, []) in got


def test_spans_point_into_the_original(tables):
    by_id = {r.doc_id: r for r in decontam.scan(*tables).collect()}
    (span,) = by_id[1].spans
    assert DOCS[0][1][span.start : span.end] == "one, two three four-five six seven eight nine ten"
    assert [DOCS[6][1][s.start : s.end] for s in by_id[None].spans] == ["é1 X", "é1 x"]
    assert by_id[7].n_hit == 11


def test_blocks_of_items_give_the_same(tables):
    one = decontam.digest(decontam.scan(*tables)).collect()
    many = decontam.digest(decontam.scan(*tables, block_bytes=200)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert [r.items_sha256 for r in one if r.doc_id == 2] == [decontam.sha_of(["2"])]


def test_fifty_blocks_against_brute_force(spark):
    draw = random.Random(4)
    text = lambda n: " ".join(draw.choices("abcdefgh", k=n))
    items = {i: text(draw.choice([2, 3, 5, 9, 12, 30])) for i in range(200)}
    texts = {i: text(draw.randrange(60)) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame([*items.items(), (None, "a b a b a")], "item_id long, text string")
    size = sum(len(t) for t in items.values()) + 9
    found = decontam.scan(docs, table, block_bytes=-(-size * 10 // 50), spans=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the blocks' hits are written by then, each by its own job
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found.collect()}
    assert got == decontam.brute_force(texts, items | {None: "a b a b a"})


def test_clean_keeps_columns(tables):
    left = decontam.clean(*tables)
    assert left.columns == tables[0].columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 5]


def test_empty_tables(spark, tables):
    docs, items = tables
    assert decontam.scan(docs.limit(0), items).count() == 0
    assert decontam.scan(docs, items.limit(0)).where("n_hit > 0").count() == 0
