"""Language identification by cross-parsing entropy.

Each language's labelled text is turned into a suffix automaton, which accepts exactly the substrings of that
text. A document is parsed greedily against each automaton: a phrase is the longest match from here, the next
phrase begins behind it. The fewer phrases a letter needs, the closer the text is to the language; phrase
counts are normalised by the cost of naming a phrase, log(reference length) / letters, and the least one wins.

Texts are lower-cased; letters stay and every run of other characters is one space. The parse starts afresh
every ``CHUNK`` characters, which adds less than one phrase per chunk to every language alike and lets chunks
be parsed side by side as numpy lanes; whole texts are parsed.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the language that
sorts first; labelled rows with null text or null language teach nothing; with no learnable language every
text is ``und``; extra columns are not looked at. Repeated rows are each scored.

The fit takes a bounded sample: up to ``chars`` normalised characters of each language, up to ``piece`` of them
from each of at most ``sample_rows`` distinct texts drawn by hash, for every labelled language. Scoring is map-only
over all rows, with the automata broadcast: 8 bytes for each of at most ``3 * chars`` moves of a language, beside
the gaps between them, and 4 at most for each code point.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, slices

CHUNK = 256
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def normalise(text: str | None) -> str:
    """Lower-case letters and single spaces; empty if there is no letter."""
    if not text or not _LETTER.search(text):
        return ""
    return _OTHER.sub(" ", text.lower()).strip()


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions {code: state} of the automaton of all substrings; state 0 is none, the root is 1."""
    moves, link, length = [{}, {}], [0, 0], [0, 0]
    last = 1
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def comb(moves: list[dict[int, int]], width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The automaton with its rows laid into each other: root, and each slot's owner (-1: none) and next state.

    A state is known by the place of its row, which no other has; its move by c is in slot state + c if it owns that.
    """
    taken, place, low = bytearray(), [0] * len(moves), 0
    for s in sorted(range(1, len(moves)), key=lambda s: (-len(moves[s]), s)):
        at, row = low, moves[s]
        taken.extend(bytes(max(0, at + width - len(taken))))
        # Bit 1: a move is here; bit 2: a row begins here.
        while taken[at] & 2 or any(taken[at + c] & 1 for c in row):
            at += 1
            if at + width > len(taken):
                taken.extend(bytes(width + len(taken)))
        taken[at] |= 2
        for c in row:
            taken[at + c] |= 1
        place[s] = at
        low = max(low, at - 8)
    owner = np.full(max(place) + width, -1, dtype=np.int32)
    after = np.zeros(len(owner), dtype=np.int32)
    for s in range(1, len(moves)):
        for c, to in moves[s].items():
            owner[place[s] + c], after[place[s] + c] = place[s], place[to]
    return place[1], owner, after


class Model:
    """Automata of all languages; every character of every sample has its own code."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(k for k, v in samples.items() if v)
        self.samples = {k: samples[k] for k in self.languages}
        common = Counter(c for k in self.languages for c in samples[k])
        #: code 0: a character that no automaton has.
        self.alphabet = {c: i + 1 for i, (c, _) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0])))}
        self.width = len(self.alphabet) + 1
        self.combs, self.cost = [], []
        for k in self.languages:
            self.combs.append(comb(suffix_automaton([self.alphabet[c] for c in samples[k]]), self.width))
            self.cost.append(np.log(max(len(samples[k]), 2)))
        self.codes = np.zeros(max(map(ord, self.alphabet), default=0) + 2, dtype=np.min_scalar_type(self.width))
        for c, i in self.alphabet.items():
            self.codes[ord(c)] = i

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases [text, language] of normalised texts."""
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        whole = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        codes = self.codes[np.minimum(whole, len(self.codes) - 1)]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        per = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * CHUNK
        size = np.minimum(CHUNK, sizes[owner] - nth * CHUNK)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        grid = np.zeros((CHUNK, len(start)), dtype=codes.dtype)
        live = np.searchsorted(-size, -np.arange(CHUNK), side="left")  # lanes with a character at step t
        for t in range(CHUNK):
            grid[t, : live[t]] = codes[start[: live[t]] + t]
        for k, (home, owned, after) in enumerate(self.combs):
            state = np.full(len(start), home, dtype=np.int64)
            count = np.zeros(len(start), dtype=np.int32)
            row = slice(home, home + self.width)
            first = np.where(owned[row] == home, after[row], home).astype(np.int64)
            for t in range(CHUNK):
                n = live[t]
                if not n:
                    break
                c, now = grid[t, :n], state[:n]
                slot = now + c
                miss = owned[slot] != now
                count[:n] += miss | (now == home)  # a phrase begins here
                state[:n] = np.where(miss, first[c], after[slot])
            out[:, k] = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return out

    def rates(self, texts: list[str]) -> np.ndarray:
        """Normalised phrases a character [text, language]; inf for empty texts."""
        size = np.fromiter(map(len, texts), dtype=np.float64, count=len(texts))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.phrases(texts) * np.array(self.cost) / size[:, None]
        return np.where(size[:, None] > 0, out, np.inf)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", chars: int = 16_000, sample_rows: int = 1_000, piece: int = 1_000) -> Model:
    """Learn from rows with text and language. The sample's bounds are parameters; see the module."""
    named = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    rows = named.select("l", F.xxhash64("t").alias("h"), F.substring("t", 1, 4 * piece).alias("t")).where(F.col("t").rlike(r"\p{L}"))
    # Copies of a text count and are drawn once.
    counted = rows.select("l", "h").distinct().groupBy("l").agg(F.count("*").alias("n")).orderBy("l").collect()
    share = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    drawn = [(F.col("l") == x.l) & (share <= sample_rows / x.n) for x in counted]
    samples: dict[str, list[str]] = {x.l: [] for x in counted}
    if drawn:
        near = rows.where(reduce(or_, drawn)).groupBy("l", "h").agg(F.min("t").alias("t"))
        nth = F.row_number().over(Window.partitionBy("l").orderBy(share, "h"))
        near = near.withColumn("n", nth).where(F.col("n") <= sample_rows).drop("n")
        for r in sorted(near.collect(), key=lambda r: (r.l, r.h)):
            part = normalise(r.t)[:piece]
            if part and sum(map(len, samples[r.l])) < chars:
                samples[r.l].append(part)
    return Model({k: " ".join(parts)[:chars] for k, parts in samples.items()})


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (and the ``keep`` columns, which may hold the text), lang_pred and score.

    The score tells how far the runner-up's rate lies above the best one, from 0 to 1.
    """
    kept = list(dict.fromkeys([doc_id, *(keep or [])]))
    columns = list(dict.fromkeys([*kept, text]))
    shared, at_text = docs.sparkSession.sparkContext.broadcast(model), columns.index(text)

    def labels(texts: list[str | None]) -> tuple[list[str], list[float]]:
        m, clean = shared.value, [normalise(x) for x in texts]
        if not m.languages:
            return ["und"] * len(clean), [0.0] * len(clean)
        rates = m.rates(clean)
        best = rates.argmin(axis=1)
        least = rates[np.arange(len(clean)), best]
        other = np.sort(rates, axis=1)[:, 1] if len(m.languages) > 1 else np.ones(len(clean)) + least
        with np.errstate(invalid="ignore"):
            score = np.clip(np.where(np.isfinite(least), 1 - least / other, 0.0), 0, 1)
        return [m.languages[b] if np.isfinite(x) else "und" for b, x in zip(best, least, strict=True)], score.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at_text)):
                part = batch.slice(a, b - a)
                lang, score = labels(part.column(at_text).to_pylist())
                found = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *found], names=[*kept, "lang_pred", "score"])

    rows = docs.select(*columns)
    schema = StructType([rows.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(lean(run), schema)


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part``; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def brute_phrases(text: str, reference: str, chunk: int = CHUNK) -> int:
    """Reference for tests: greedy longest matches by substring search."""
    total = 0
    for at in range(0, len(text), chunk):
        part, i = text[at : at + chunk], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and part[i : i + n + 1] in reference:
                n += 1
            total += 1
            i += n
    return total
