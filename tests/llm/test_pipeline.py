"""The pipeline against brute force, stage by stage, and its edges."""

import numpy as np
import sentencepiece

import corpus_pipeline
from tests.llm.test_nearcopies import groups
from tickloom.llm import decontam, langid, queries, suffixdedup

SF = "/root/testdata/sf0.001"


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, texts = langid.fit(docs), {}
    for r in docs.collect():
        clean = langid.normalise(r.text)
        counts = [langid.brute_phrases(clean, s) for s in model.samples.values()] if clean else []
        if clean:
            assert model.phrases([clean])[0].tolist() == counts
            texts[r.doc_id] = r.text
    first = groups(texts)
    texts = {i: t for i, t in texts.items() if first[i] == i}
    inside = {i: set(p) for i, p in suffixdedup.brute_force(texts).items()}
    left = {}
    for i, t in texts.items():
        words = t.split()
        if not inside[i]:
            left[i] = t
        elif len(inside[i]) < len(words):
            spans = [(a, a + 1) for a in inside[i]]
            left[i] = suffixdedup.cut(t, spans)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    hits = decontam.brute_force(left, items)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    want = {i: t.split() for i, t in left.items() if not hits[i][1]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        text = library.decode(r.ids)
        assert text.split() == want[i] and r.ids == library.encode(text) and r.round_trip and r.n_ids == len(r.ids)


def stages(spark, docs, folder):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        yield docs.columns, (docs := spark.read.parquet(f"{folder}/{k}"))


def test_edges(spark, tmp_path):
    body = " ".join(f"mot{i}" for i in range(300))
    rows = [(1, body), (1, body), (2, None), (3, ""), (4, "12 !"), (None, "quelques mots sans identifiant"), (5, body + " " + " ".join(f"w{i}" for i in range(200)))]
    frame = spark.createDataFrame([(i, t, "fr", None, None, "a", "b", "c", "d") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, rid string, lang_pred string, score string")
    for k, (before, after) in enumerate(stages(spark, frame, tmp_path)):
        if k < 4:
            assert after.columns == before
    got = {r.doc_id for r in after.collect()}
    assert got == {1, None, 5}


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, after in stages(spark, docs, tmp_path):
        assert after.count() == 0


def test_models_learn_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = langid.fit(docs), langid.fit(docs.orderBy("text"))
    assert one.alphabet == two.alphabet and one.samples == two.samples
    for a, b in zip(one.combs, two.combs, strict=True):
        assert a[0] == b[0] and all(np.array_equal(x, y) for x, y in zip(a[1:], b[1:], strict=True))
