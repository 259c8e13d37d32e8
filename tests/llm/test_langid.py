import random

from pyspark.sql import functions as F

from tickloom.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then it runs through the forest with other animals "
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann mit anderen tieren durch den wald "


def test_phrases_match_substring_search():
    draw = random.Random(2)
    samples = {"x": "".join(draw.choices("abc ", k=400)), "y": "".join(draw.choices("abde ", k=300))}
    model = langid.Model(samples)
    texts = ["".join(draw.choices("abcdez ", k=n)).strip() for n in (1, 5, 40, 255, 256, 257, 900)]
    got = model.phrases(texts)
    for text, row in zip(texts, got, strict=True):
        assert row.tolist() == [langid.brute_phrases(text, samples[k]) for k in model.languages]


def test_many_scripts_keep_all_their_letters(spark):
    # 1,900 characters and more in all; the last language's lie beyond U+FFFF.
    draw = random.Random(4)
    scripts = {"el": range(0x3B1, 0x3CA), "ja": range(0x3041, 0x3097), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x5400), "zy": range(0x20000, 0x20100), "en": range(97, 123)}
    samples = {}
    for k, letters in scripts.items():
        known = ["".join(chr(draw.choice(letters)) for _ in range(draw.randrange(1, 7))) for _ in range(400)]
        samples[k] = " ".join(draw.choices(known, k=1200))
    model = langid.Model(samples)
    assert all(c in model.alphabet for x in samples.values() for c in x)
    parts = {k: x[1000:1300].strip() for k, x in samples.items()}
    for text, row in zip(parts.values(), model.phrases(list(parts.values())), strict=True):
        assert row.tolist() == [langid.brute_phrases(text, samples[k]) for k in model.languages]
    rows = [(i, x, k) for i, (k, x) in enumerate(samples.items())]
    fitted = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(k, x[:200]) for k, x in samples.items()], "doc_id string, text string"), fitted).collect()
    assert len(got) == len(samples) and all(r.doc_id == r.lang_pred and r.score > 0.1 for r in got)


def test_copies_are_drawn_once(spark):
    # 4,000 copies of ten German texts, one of which is most of them; every other language has its own texts.
    german = [f"{DE}{w * 3}" for w in ("haus ", "baum ", "katze ", "vogel ", "stein ", "wasser ", "himmel ", "feuer ", "strasse ", "garten ")]
    copies = [(i, german[i % 10] if i % 4 else german[0], "de") for i in range(4000)]
    rows = [*copies, *((i, "12 34 56" + " " * i, "de") for i in range(300)), (1, EN * 3, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for sample_rows in (10, 1000):
        sample = langid.fit(docs.where("text not like '12 %'"), sample_rows=sample_rows).samples["de"]
        assert all(sample.count(x.strip()) == 1 for x in map(langid.normalise, german))
    assert langid.fit(docs, sample_rows=10).languages == ["de", "en"]


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    rows = [(f"{EN} {i % 700}{'x' * (i % 700)}", "en") for i in range(6000)] + [(EN, "en")] * 3000 + [(DE + "z" * i, "de") for i in range(900)]
    docs, seen = spark.createDataFrame(rows, "text string, lang string"), []
    plain = langid.normalise
    monkeypatch.setattr(langid, "normalise", lambda t: seen.append(t) or plain(t))
    assert langid.fit(docs, sample_rows=50).languages == ["de", "en"]
    assert 60 < len(seen) <= 100


def test_eight_scripts_are_told_apart(spark):
    """Texts of words that the sample doesn't hold, letters of which it does."""
    draw = random.Random(6)
    scripts = {"ar": 0x627, "el": 0x3B1, "en": 0x61, "he": 0x5D0, "hi": 0x905, "ko": 0xAC00, "ru": 0x430, "zh": 0x4E00}
    word = lambda k: "".join(chr(scripts[k] + draw.randrange(600 if k in ("ko", "zh") else 22)) for _ in range(draw.randrange(2, 6)))
    rows = [(i, " ".join(word(k) for _ in range(200)), k) for k in scripts for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(k, " ".join(word(k) for _ in range(60))) for k in scripts for _ in range(5)]
    got = langid.predict(spark.createDataFrame(asked, "doc_id string, text string"), model).collect()
    assert all(r.doc_id == r.lang_pred for r in got) and len(got) == 40


def test_languages_and_edges(spark):
    rows = [(i, t, l, "x") for i, (t, l) in enumerate([(EN * 3, "en"), (DE * 3, "de"), (None, "en"), ("abc", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    asked = [(1, "the dog and the fox"), (2, "der hund und der fuchs"), (3, None), (4, ""), (5, "12 34 !"), (None, "the dog"), (1, "the dog and the fox"), (8, EN * 4000)]
    got = langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (8, "en")]
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.predict(docs, langid.fit(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out("doc_id", 3, 1)
    model = langid.fit(docs.where(~out))
    scored = langid.predict(docs.where(out), model, keep=["lang"])
    assert scored.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
