import random

import numpy as np
import pytest

from tickloom.llm import licenses as lic


def brute_increasing(values):
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
    return max(best, default=0)


def test_longest_increasing_subsequence():
    draw = random.Random(1)
    for _ in range(200):
        values = [draw.randrange(12) for _ in range(draw.randrange(12))]
        found = [values[i] for i in lic.increasing(values)]
        assert found == sorted(set(found)) and len(found) == brute_increasing(values)


def test_patience_pairs_are_equal_and_in_order():
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.choice("abcdefgh") for _ in range(draw.randrange(15))] for _ in range(2))
        pairs = lic.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
    assert len(lic.patience(list("the quick fox"), list("the quick fox"))) == 13


def brute(text, coverage=0.8, density=0.75):
    """Every template against every stretch of the text that could hold it."""
    templates, out = lic.Templates(lic.TEMPLATES, coverage, density), set()
    hashes = lic.words(lic.fold(text.encode()))[2]
    known = {int(h): i for i, h in enumerate(templates.vocabulary)}
    word = [known.get(int(h), -1) for h in hashes]
    for t, name in enumerate(templates.names):
        span = int(templates.size[t] / density) + 1
        for a in range(max(len(word) - 2, 0)):
            if word[a] >= 0 and templates.match(t, word[a : a + span]):
                out.add(name)
    return out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    common = "of the to is with and in for any use this".split() + [f"v{i}" for i in range(50)]
    prose = lambda n: " ".join(draw.choices(common, k=n))
    out = []
    for name, body in lic.TEMPLATES.items():
        edited = body.split()
        if len(edited) > 15:
            for _ in range(len(edited) // 12):
                edited[draw.randrange(len(edited))] = "edited"
        out += [f"{prose(30)}\n{body}\n{prose(40)}", f"{prose(8)} {' '.join(edited).upper()} {prose(9)}", f"{body}\n{body}"]
        out.append(" ".join(w for i, w in enumerate(body.split()) if i % 2))
    return [*out, prose(400), "", "All of the rights that are reserved", "é all Rights reserved ü"]


def test_scan_finds_what_brute_force_finds(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "All rights reserved.", "x"), (-1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    found = lic.scan(docs).collect()
    for i, text in enumerate(texts):
        assert {r.license for r in found if r.doc_id == i} >= brute(text), text[:200]
        for r in (r for r in found if r.doc_id == i):  # and each is a match indeed
            own, part = (lic.fold(x.encode()).lower().split() for x in (lic.TEMPLATES[r.license], text[r.start : r.end]))
            pairs = plain_patience(part, own)
            assert len(pairs) == round(r.coverage * len(own)) and len(pairs) >= max(0.8 * len(own), 0.75 * len(part))
    names = list(lic.TEMPLATES)
    for n, name in enumerate(names):
        plain = [r for r in found if r.doc_id == 4 * n and r.license == name]
        assert [r.coverage for r in plain] == [1.0]
        assert texts[4 * n][plain[0].start : plain[0].end] == lic.TEMPLATES[name].rstrip("./")
        assert len([r for r in found if r.doc_id == 4 * n + 2 and r.license == name]) == 2
    assert [r.license for r in found if r.doc_id is None] == ["all-rights-reserved"]
    assert not [r for r in found if r.doc_id == -1]
    assert lic.scan(docs.limit(0)).count() == 0


def test_long_text(spark):
    body = "of the software " * 100_000 + lic.TEMPLATES["mit"]
    (row,) = [r for r in lic.scan(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect() if r.license == "mit"]
    assert row.coverage == 1.0 and body[row.start : row.end] == lic.TEMPLATES["mit"].rstrip(".")
    assert np.isfinite(row.coverage)


@pytest.mark.parametrize("name", ["mit", "apache-2.0-header", "zlib"])
@pytest.mark.parametrize("gap", ["", "of the software and other parts by some authors named here"])
def test_consecutive_copies(spark, name, gap):
    body, edited = lic.TEMPLATES[name], lic.TEMPLATES[name].split()
    edited[len(edited) // 3 : len(edited) // 3 + 2] = ["quite", "another", "wording"]
    texts = [f"\n{gap}\n".join([body] * n) for n in (3, 10, 1000)]
    texts.append(f"\n{gap}\n".join([body, " ".join(edited)] * 5))
    found = lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, text in enumerate(texts):
        spans = sorted((r.start, r.end) for r in found if r.doc_id == i and r.license == name)
        assert len(spans) == (3, 10, 1000, 10)[i]
        assert all(a < b <= c for (a, b), (c, _) in zip(spans, spans[1:], strict=False))
        if i < 3:
            assert {text[a:b] for a, b in spans} == {body.rstrip(".")}


def plain_patience(a, b):
    """Recursive patience alignment by plain scans."""
    pairs = []

    def go(a0, a1, b0, b1):
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        left, right = a[a0:a1], b[b0:b1]
        once = [(a0 + i, b0 + right.index(w)) for i, w in enumerate(left) if left.count(w) == right.count(w) == 1]
        chains: list[list] = []
        for i, j in once:
            chains.append([*max((c for c in chains if c[-1][1] < j), key=len, default=[]), (i, j)])
        best = max(chains, key=len, default=[])
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *best], [*best, (a1, b1)], strict=True):
            if best:
                go(i + 1, k, j + 1, m)
        pairs.extend(best)

    go(0, len(a), 0, len(b))
    return sorted(pairs)


def plain_occurrences(text, template, coverage=0.8, density=0.75):
    """Every stretch that begins and ends with a matched word; of overlapping ones the best covered, then shortest."""
    n, found, out = len(template), [], []
    for i in range(len(text)):
        for j in range(i + int(coverage * n), min(len(text), i + int(n / density) + 1) + 1):
            if text[i] in template and text[j - 1] in template:
                pairs = plain_patience(text[i:j], template)
                if pairs and pairs[0][0] == 0 and pairs[-1][0] == j - i - 1 and len(pairs) >= max(coverage * n, density * (j - i)):
                    found.append((-len(pairs), j - i, i))
    for pairs, size, i in sorted(found):
        if all(i + size <= a or b <= i for a, b, _ in out):
            out.append((i, i + size, -pairs / n))
    return sorted(out)


def scanned(text, templates):
    """(template, first and end word, coverage) in one text."""
    hashes = lic.words(lic.fold(text.encode()))[2]
    at = np.minimum(np.searchsorted(templates.vocabulary, hashes), len(templates.vocabulary) - 1)
    word = np.where(templates.vocabulary[at] == hashes, at, -1)
    return [(templates.names[t], a, b, c) for _, t, c, a, b in lic.find(word, np.zeros(len(word), int), templates)]


def test_edited_copies_against_plain_alignment():
    texts = {"a": "the quick brown fox jumps over the lazy dog and the other dog runs over the hill to the fox", "b": lic.TEMPLATES["all-rights-reserved"], "c": lic.TEMPLATES["gpl-3.0-notice"]}
    templates, draw, seen = lic.Templates(texts, 0.8, 0.75), random.Random(3), 0
    for _ in range(50):
        name = draw.choice("abc")
        own = lic.fold(texts[name].encode()).lower().decode().split()
        text = []
        for _ in range(draw.randrange(1, 5)):
            copy = list(own)
            for _ in range(draw.randrange(4)):
                k = draw.randrange(len(copy))
                copy[k : k + draw.randrange(2)] = draw.choice([["zz"], [draw.choice(own)], []]) or ["q"]
            text += copy + [draw.choice([*own, "u", "v"]) for _ in range(draw.randrange(6))]
        got = sorted((a, b, c) for n, a, b, c in scanned(" ".join(text), templates) if n == name)
        want = plain_occurrences(text, own)
        assert len(got) == len(want)
        for (a, b, c), (i, j, d) in zip(got, want, strict=True):
            assert max(a, i) < min(b, j) and abs(c - d) <= 0.1
        seen += len(want)
    assert seen > 60


@pytest.mark.parametrize("name", sorted(lic.TEMPLATES))
def test_every_copy_is_found(name):
    templates, draw = lic.Templates(lic.TEMPLATES, 0.8, 0.75), random.Random(5)
    for n, gap in [(1, 0), (2, 1), (3, 0), (3, 60), (5, 5), (5, 15), (20, 40), (200, 0), (200, 7)]:
        fill = lambda: " ".join(f"z{draw.randrange(10**6)}" for _ in range(gap))  # noqa: B023, E731
        text = " ".join(f"{fill()} {lic.TEMPLATES[name]}" for _ in range(n))
        assert sum(x[0] == name and x[3] == 1.0 for x in scanned(text, templates)) == n
