import random
import struct

import numpy as np
import pytest
import sentencepiece

from tickloom.llm import spwfst

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def model(data):
    return spwfst.compile_model(data)


def samples(seed, n=400):
    draw = random.Random(seed)
    letters = "aeiouthnsrdl" * 4 + "ABCéèüßñ.,;:!?'\"-_()[]{}0123456789 \t\n\r" + "  " * 3 + "漢字あ😀▁ \x00ﬁ"
    return ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(n)]


def test_ids_match_the_library(spark, data, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    code = ["def f(x):\n    return x**2  # ok\n\n\n", "    " * 9 + "x", "a" * 500, "\n\n\n", "http://www.example.com/?q=1&b=2", " "]
    for text in [*samples(1), *code, *(r.text for r in docs)]:
        want = library.encode(text)
        assert model.encode(text).tolist() == want, text[:200]
        assert model.decode(np.array(want, dtype=np.int32)) == library.decode(want), text[:200]


def test_shortest_path_of_the_composed_machine(model):
    for unit in ["▁thonretion,", "▁the", "ththeinandand", "▁▁hello", "été漢"]:
        weight, path = spwfst.compose_and_search(model, unit)
        assert weight == 0.0 and path == model.path(unit) == model.merged(unit)


def test_invalid_bytes_and_ids(data, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    for ids in ([0xC3 + 3, 300], [0xE6 + 3, 0xBC + 3], [0xFF + 3] * 2, [1, 2, 300], [0]):
        assert model.decode(np.array(ids)) == library.decode(ids)
    assert model.decode(np.array([-5, 10**6])) == ""


def proto(pieces, kind, fallback, prefix=True, squeeze=True):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    def sized(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    def number(field, x):
        return varint(field << 3) + varint(x)

    out = b""
    for text, score, k in pieces:
        out += sized(1, sized(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, k))
    out += sized(2, number(3, kind) + number(4, len(pieces)) + number(35, fallback))
    return out + sized(3, sized(1, b"identity") + number(3, prefix) + number(4, squeeze) + number(5, 1))


@pytest.mark.parametrize("fallback", [0, 1])
def test_unigram_matches_the_library(fallback):
    draw = random.Random(4)
    words = {"".join(draw.choices("abcd▁", k=draw.randrange(1, 5))) for _ in range(60)} | set("abc▁")
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * fallback
    pieces += [(w, -draw.uniform(1, 9), 1) for w in sorted(words)]
    made = proto(pieces, 1, fallback)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=made), spwfst.compile_model(made)
    for _ in range(300):
        text = "".join(draw.choices("abcdxé  ", k=draw.randrange(30)))
        assert model.encode(text).tolist() == library.encode(text), text


def test_frames(spark, data):
    rows = [(1, "Hello  world\n", "a"), (1, "Hello  world\n", "a"), (None, "", None), (3, None, "b"), (4, "no_spaces" * 20000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = spwfst.encode(docs, data, round_trip=True)
    got = ids.collect()
    assert sorted((r.n_ids if r.n_ids is not None else -1, r.round_trip) for r in got)[:3] == [(-1, None), (0, True), (4, True)]
    assert all(r.round_trip is not False for r in got)
    back = spwfst.decode(ids, data).collect()
    assert sorted((r.text or "", r.doc_id or 0) for r in back) == sorted((t or "", d or 0) for d, t, _ in rows)
    assert spwfst.encode(docs.limit(0), data).count() == 0
