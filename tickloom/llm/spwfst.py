"""SentencePiece encoding and decoding as a weighted finite-state transducer over the tropical semiring.

``compile_model`` reads a model file and builds the parts: the normaliser (character rules, white space to its
mark, a leading mark), the pieces (each spells its characters and gives its id) and the byte fallback (a
character without a piece spells its UTF-8 byte pieces). ``encode`` composes them with an input and takes the
shortest path; composition is lazy, state by state.

Weights. In a unigram model a piece weighs its negated score, an unknown character the worst score plus 10. A
BPE model has no path scores: a piece sequence is the model's segmentation if and only if the model keeps every
two neighbours apart. So pieces weigh one (0) and are composed with an acceptor whose states are pieces and
whose arc from one to the next weighs 0 if the merges of the two together end in just these two, else zero
(infinity). Of all paths to a position exactly one is finite, which makes the shortest path a single pass.

Merges never cross a place where no piece has the two characters side by side; texts are cut into units there
(before white space, around characters of no longer piece, before marks that never follow a letter in a piece) by
one regular expression, and a unit's path is remembered in a table of bounded size. Where rival pieces share
one score (runs of spaces in some models) no acceptor arc may be finite; such a unit is merged directly.

Decoding runs the inverse: ids spell their pieces, byte pieces join to UTF-8 (each invalid byte is U+FFFD), the
mark becomes a space and the leading one goes.

Defined cases: null texts give null ids and text; empty texts give no ids; repeated rows and any length work
alike, a unit without white space is one path; ids out of range decode to nothing; extra columns are kept aside.
Everything is map-only.
"""

from __future__ import annotations

import codecs
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .common import lean

MARK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
INF = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _char_rules(blob: bytes) -> dict[str, str]:
    """Character rules of a precompiled map: a double array over UTF-8 bytes, and the replacements it points to."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4), blob[4 + size :]
    rules, todo = {}, [(0, b"")]
    while todo:
        node, key = todo.pop()
        unit = int(units[node])
        base = node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))
        if unit >> 8 & 1:
            start = int(units[base]) & 0x7FFFFFFF
            rules[key.decode()] = texts[start : texts.index(b"\0", start)].decode()
        for c in range(1, 256):
            to = base ^ c
            if to < len(units) and int(units[to]) & 0x800000FF == c:
                todo.append((to, key + bytes([c])))
    return rules


@dataclass
class Model:
    """The compiled transducers; see the module for what they weigh."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    byte_fallback: bool
    prefix: bool
    squeeze: bool
    escape: bool
    rules: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        usable = (NORMAL, USER, UNUSED)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in usable}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        normal = [self.scores[i] for i in self.ids.values() if self.kinds[i] == NORMAL]
        self.worst = min(normal, default=0.0) - 10
        self.best = max(normal, default=0.0)
        users = sorted((p for p, i in self.ids.items() if self.kinds[i] == USER), key=len, reverse=True)
        joined = {c for p in self.ids if len(p) > 1 for c in p} - {MARK}
        # Characters that no piece holds right behind a letter or digit (or another one not of their kind).
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        breaks, size = {c for c in joined if not c.isalpha() and not c.isdecimal()}, -1
        while len(breaks) != size:
            size = len(breaks)
            breaks -= {b for a, b in pairs if b in breaks and a not in breaks and a != MARK}
        one_of = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]" if chars else r"(?!)"
        whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids) or not self.bpe
        parts = [f"{MARK}*{one_of(joined - breaks)}+", f"{MARK}*{one_of(breaks)}{one_of(joined)}*", f"{MARK}+", r"(?s:.)"]
        units = [re.escape(u) for u in users] + ([r"(?s:.+)"] if whole else parts)
        self.units = re.compile("|".join(units))
        self.rule = re.compile("|".join(map(re.escape, sorted(self.rules, key=len, reverse=True)))) if self.rules else None
        self.users = frozenset(users)
        self.ends: dict = {}  # pieces by their characters from the right; a node's own piece is at ""
        for p in self.ids if self.bpe else ():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        self.apart: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        spelled = [self._spell(i) for i in range(len(self.pieces))] + [b""]  # the last: ids out of range
        self.spell_size = np.array([len(x) for x in spelled], dtype=np.int64)
        self.spell_at = np.cumsum(self.spell_size) - self.spell_size
        self.spell_bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def _spell(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else self.pieces[i].encode()

    # The normaliser.

    def normalise(self, text: str) -> str:
        if self.rule:
            text = self.rule.sub(lambda m: self.rules[m[0]], text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    # The acceptor of piece pairs, of a BPE model.

    def merged(self, unit: str) -> list[str]:
        """The merges themselves: the best-scored neighbours join, the leftmost of equals first."""
        parts = [unit] if unit in self.users else list(unit)
        while len(parts) > 1:
            best, at = -INF, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def keeps_apart(self, a: str, b: str) -> bool:
        """Whether the merges of both together end in just these two; with an empty ``a``, in ``b`` itself."""
        row = self.apart.get(a)
        if row is None:
            row = self.apart[a] = {}
        ok = row.get(b)
        if ok is None:
            self.pairs += 1
            if self.pairs > 1_000_000:
                self.apart.clear()
                self.pairs = 0
            ok = row[b] = self.merged(a + b) == ([a, b] if a else [b])
        return ok

    # Shortest paths.

    def path(self, unit: str) -> list[str]:
        """Pieces on the shortest path of one unit."""
        return next(self.paths([unit]))

    def paths(self, units: list[str]) -> Iterator[list[str]]:
        """Pieces on the shortest path of each unit. Sorted units share the states of their common beginnings."""
        if not self.bpe:
            yield from map(self._path_unigram, units)
            return
        ends, apart, ids, keeps_apart = self.ends, self.apart, self.ids, self.keeps_apart
        last, before = [""], ""  # the one piece that the finite path to a position ends with
        for unit in units:
            n, shared = len(unit), 0
            most = min(n, len(before))
            while shared < most and unit[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared, n):
                start, node, found = end, ends, ""
                while True:  # pieces that end here, by their letters from the right
                    node = node.get(unit[start])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is not None:
                        left = last[start]
                        if left or not start:
                            row = apart.get(left)
                            ok = row.get(piece) if row is not None else None
                            if ok is None:
                                ok = keeps_apart(left, piece)
                            if ok:
                                found = piece
                                break
                    if not start:
                        break
                    start -= 1
                if not found and unit[end] not in ids and (last[end] or not end) and keeps_apart(last[end], unit[end]):
                    found = unit[end]
                last.append(found)
            before, out, end = unit, [], n
            while end and last[end]:
                out.append(last[end])
                end -= len(last[end])
            yield out[::-1] if not end else self.merged(unit)

    def _path_unigram(self, unit: str) -> list[str]:
        n, users = len(unit), self.users
        cost, back = [0.0] + [INF] * n, [0] * (n + 1)
        for start in range(n):
            if cost[start] == INF:
                continue
            single = False
            for end in range(start + 1, min(n, start + self.longest) + 1):
                k = self.ids.get(unit[start:end])
                if k is None or self.kinds[k] == UNUSED:
                    continue
                single |= end == start + 1
                score = (end - start) * self.best - 0.1 if unit[start:end] in users else self.scores[k]
                if cost[start] - score < cost[end]:
                    cost[end], back[end] = cost[start] - score, start
            if not single and cost[start] - self.worst < cost[start + 1]:
                cost[start + 1], back[start + 1] = cost[start] - self.worst, start
        out, end = [], n
        while end:
            out.append(unit[back[end] : end])
            end = back[end]
        return out[::-1]

    # Pieces to ids, with byte fallback.

    def _ids_of(self, path: list[str]) -> bytes:
        ids, kinds, out, todo = self.ids, self.kinds, [], path[::-1]
        while todo:
            piece = todo.pop()
            k = ids.get(piece)
            if k is not None and kinds[k] != UNUSED:
                out.append(k)
            elif k is not None and len(piece) > 1:  # an unused piece falls apart into what it was merged of
                a = next(piece[:i] for i in range(len(piece) - 1, 0, -1) if self.merged(piece[:i]) == [piece[:i]])
                todo += [piece[len(a) :], a]
            elif self.byte_fallback:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def encode_all(self, texts: list[str], limit: int = 200_000, size: int = 64) -> list[np.ndarray]:
        """Ids of each text. Units' ids are remembered in two generations of ``limit`` units of up to ``size``."""
        units = [self.units.findall(self.normalise(t)) for t in texts]
        table, young, old, missing = {}, self.young, self.old, []
        for u in set().union(*units):
            ids = young.get(u) or old.get(u)
            if ids is None:
                missing.append(u)
            else:
                table[u] = ids
        missing.sort()
        for u, path in zip(missing, self.paths(missing), strict=True):
            table[u] = self._ids_of(path)
        if len(young) + len(table) > limit:
            self.old, self.young = young, {}
        self.young.update((u, ids) for u, ids in table.items() if len(u) <= size)
        out = [np.frombuffer(b"".join(map(table.__getitem__, u)), dtype=np.int32) for u in units]
        return out if self.byte_fallback else [self._one_unknown(x) for x in out]

    def _one_unknown(self, ids: np.ndarray) -> np.ndarray:
        """A run of unknown characters is one unknown piece."""
        return ids[np.concatenate(([True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)))] if len(ids) else ids

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray, block: int = 1 << 16) -> str:
        data = []
        for i in range(0, len(ids), block):
            part = ids[i : i + block]
            part = np.where((part < 0) | (part >= len(self.pieces)), len(self.pieces), part)
            size = self.spell_size[part]
            at = np.repeat(self.spell_at[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            data.append(self.spell_bytes[at].tobytes())
        text = b"".join(data).decode("utf-8", "tickloom_each_byte")
        if self.prefix and text[:1] == (MARK if self.escape else " "):
            text = text[1:]
        return text.replace(MARK, " ") if self.escape else text


codecs.register_error("tickloom_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def compile_model(data: bytes) -> Model:
    """The transducers of a model file's bytes. Word, character and suffix-mark models are not supported."""
    pieces, scores, kinds = [], [], []
    kind, fallback, suffix = 1, False, False
    spec: dict[int, int | bytes] = {}
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            pieces.append(x.get(1, b"").decode())
            scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
            kinds.append(x.get(3, NORMAL))
        elif number == 2:
            x = dict(_fields(value))
            kind, fallback, suffix = x.get(3, 1), bool(x.get(35, 0)), bool(x.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
    if kind not in (1, 2) or suffix:
        raise ValueError("only unigram and BPE models with the mark before words are supported")
    return Model(
        pieces, scores, kinds, kind == 2, fallback, bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), _char_rules(spec.get(2, b""))
    )


_MODELS: dict[str, Model] = {}


def _model(key: str, data: bytes) -> Model:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = compile_model(data)
    return _MODELS[key]


def encode(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", round_trip: bool = False) -> DataFrame:
    """doc_id, ids, n_ids; with ``round_trip`` also whether decoding the ids gives the text again."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = StructType().add("doc_id", docs.schema[doc_id].dataType).add("ids", ArrayType(IntegerType())).add("n_ids", "integer")
    schema = schema.add("round_trip", "boolean") if round_trip else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(key, shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):  # about 2 MB of text at a time
                part, size, first = [], 0, at
                while at < len(texts) and size < 1 << 21:
                    part.append(texts[at].as_py())
                    size, at = size + len(part[-1] or ""), at + 1
                found = m.encode_all([t or "" for t in part])
                found = [None if t is None else x for t, x in zip(part, found, strict=True)]
                same = [None if t is None else m.decode(x) == t for t, x in zip(part, found, strict=True)] if round_trip else []
                lists = pa.array(found, pa.list_(pa.int32()))
                columns = [ids.slice(first, at - first), lists, pa.array([None if x is None else len(x) for x in found], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(same, pa.bool_())] if round_trip else [])], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), schema)


def decode(rows: DataFrame, model: bytes, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the decoded text of every row of ids."""
    shared, key = rows.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = StructType().add("doc_id", rows.schema[doc_id].dataType).add("text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(key, shared.value)
        for batch in batches:
            lists = batch.column(1)
            texts = [m.decode(x.values.fill_null(-1).to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(lean(run), schema)


def compose_and_search(model: Model, text: str) -> tuple[float, list[str]]:
    """Reference for tests: the composed machine of input, pieces and pair acceptor as explicit states and arcs,
    and its shortest path by relaxation over (position, last piece). Gives weight and pieces of a BPE model."""
    n, best = len(text), {(0, ""): (0.0, [])}
    for at in range(n):
        for (pos, last), (weight, path) in [x for x in best.items() if x[0][0] == at]:
            for end in range(at + 1, min(n, at + model.longest) + 1):
                piece = text[at:end]
                if piece in model.ids or end == at + 1:
                    arc = 0.0 if (model.keeps_apart(last, piece) if last else model.merged(piece) == [piece]) else INF
                    if weight + arc < best.get((end, piece), (INF, []))[0]:
                        best[end, piece] = weight + arc, [*path, piece]
    ends = [x for k, x in best.items() if k[0] == n]
    return min(ends, default=(INF, []))
