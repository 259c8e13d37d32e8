"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows of the test items.

Texts are normalised to lower-case ASCII letters, digits and non-ASCII characters, words joined by single
spaces; an item gives every run of ``window`` consecutive words (an item with fewer words gives itself). A
document is scanned once per block of items and matches are mapped back to word positions and to character
offsets of the original text.

Defined cases: null or wordless texts have no words and no hits; null or wordless items give no window; an item
without an id gives windows like any other, but can't be named: its words are hit and it isn't counted; repeated
documents are scanned row by row; repeated items with one id count once; extra columns of either table are not
looked at. An empty item table leaves every document clean.

Scale: the scan is map-only, no shuffle. The item table is sized first, and a block of items is collected and
broadcast only up to ``block_bytes`` of windows (an automaton takes about 64 times that in a worker). More items are
more blocks, each a job of its own whose hits are written and whose broadcast is released: a task never holds two
automata. Hits leave a block as merged runs of words, and meet by row.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from .common import Scratch, lean, raw, slices

#: Bytes that separate words: \x00-\x2F \x3A-\x60 \x7B-\x7F once A-Z are lower-cased.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_RUNS = ArrayType(StructType().add("first", "integer").add("stop", "integer"))
#: Of the worker: the automaton of the block in use, by the block's key.
_AUTOMATA: dict[str, tuple[ahocorasick.Automaton, list]] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows_of(text: bytes | None, window: int) -> list[bytes]:
    """Distinct windows of an item, in order of first occurrence."""
    words = words_of(text)
    if not words:
        return []
    n = min(window, len(words))
    return list(dict.fromkeys(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int, window: int) -> Iterator[list]:
    """Items in blocks whose windows stay below ``block_bytes``; each block is collected by itself."""
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = -(-size * window // block_bytes)
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(count)) == b).collect()
        if rows:
            yield [(r.id, r.t) for r in rows]


def _automaton(key: str, block: Broadcast, window: int) -> tuple[ahocorasick.Automaton, list[tuple]]:
    """The automaton, whose values are a window's words and number, and by number the items that have the window."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        owners: dict[bytes, list] = {}
        for item, text in block.value:
            for w in windows_of(text.encode(), window):
                owners.setdefault(w, []).append(item)
        built = ahocorasick.Automaton()
        for k, w in enumerate(owners):
            built.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, k))
        built.make_automaton()
        _AUTOMATA[key] = built, [tuple(x for x in who if x is not None) for who in owners.values()]
    return _AUTOMATA[key]


def _hits(automaton: ahocorasick.Automaton, words: list[bytes], inside: np.ndarray) -> set[int]:
    """Numbers of the windows found in a text's words; adds 1 at the first word of each and -1 behind its last."""
    line, at, seen, numbers, first, stop = f" {b' '.join(words).decode('latin-1')} ", 0, 0, set(), array("q"), array("q")
    for end, (n, k) in automaton.iter(line):
        seen += line.count(" ", at, end)
        at = end
        first.append(seen - n)
        stop.append(seen)
        numbers.add(k)
    np.add.at(inside, np.frombuffer(first, np.int64), 1)
    np.add.at(inside, np.frombuffer(stop, np.int64), -1)
    return numbers


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of every run of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _scan(block: Broadcast | None, window: int, schema: pa.Schema, spans: bool = False):
    """Rows with what a block hits in them, beside what their columns __runs and __items (if any) say already.

    A schema without n_words is that of a block's hits: rows without a hit are left out.
    """
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, owners = _automaton(key, block, window) if block else (None, [])
        for whole in batches:
            for a, b in slices(whole.column("__text")):
                batch = whole.slice(a, b - a)
                texts = raw(batch.column("__text"))
                given = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * len(texts) for c in ("__runs", "__items")]
                out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "item_ids", "spans", "__runs", "__items")}
                for text, runs, names in zip(texts, *given, strict=True):
                    words = words_of(text)
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    for x in runs or ():
                        edge[x["first"]] += 1
                        edge[x["stop"]] -= 1
                    found = set(names or ())
                    if automaton and words:
                        found.update(x for k in _hits(automaton, words, edge) for x in owners[k])
                    inside = np.cumsum(edge)[:-1] > 0
                    out["n_words"].append(len(words))
                    out["n_hit"].append(int(inside.sum()))
                    out["item_ids"].append(sorted(found))
                    out["spans"].append(_char_spans(text, inside) if spans and inside.any() else [])
                    if "n_words" not in schema.names:
                        out["__runs"].append([{"first": int(i), "stop": int(j)} for i, j in zip(*_runs(inside), strict=True)])
                        out["__items"].append(out["item_ids"][-1])
                made = [pa.array(out[f.name], type=f.type) if f.name in out else batch.column(f.name) for f in schema]
                made = pa.RecordBatch.from_arrays(made, schema=schema)
                yield made if "n_words" in schema.names else made.filter(pa.array(np.array(out["n_hit"], dtype=np.int64) > 0))

    return run


def _char_spans(text: bytes, inside: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, seen, chars = [], 0, 0
    for first, stop in zip(*_runs(inside), strict=True):
        begin, end = at[first][0], at[stop - 1][1]
        chars += len(text[seen:begin].decode())
        length = len(text[begin:end].decode())
        out.append({"start": chars, "end": chars + length})
        seen, chars = end, chars + length
    return out


def scan(
    docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20, keep: list[str] | None = None,
    spans: bool = True, keep_text: bool = False,
) -> DataFrame:
    """One row per document: id (and the ``keep`` columns), n_words, n_hit, item_ids sorted, spans of the original.

    With ``keep_text`` the text comes along as __text.
    """
    spark = docs.sparkSession
    kept = [doc_id, *(keep or []), *(["__text"] if keep_text else [])]
    df = docs.select(F.col(doc_id), *(keep or []), F.col(text).alias("__text"))
    span = StructType().add("start", "integer").add("end", "integer")
    out = StructType([f for f in df.schema if f.name in kept]).add("n_words", "long").add("n_hit", "long")
    out = out.add("item_ids", ArrayType(StringType())).add("spans", ArrayType(span))
    blocks = _blocks(items, item_id, item_text, block_bytes, window)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        block = spark.sparkContext.broadcast(first) if first else None
        return df.mapInArrow(lean(_scan(block, window, to_arrow_schema(out), spans)), out)
    scratch, found = Scratch(spark, "decontam"), None
    rows = scratch.keep(df.withColumn("__rid", F.monotonically_increasing_id()))
    hits = StructType().add("__rid", "long").add("__runs", _RUNS).add("__items", ArrayType(StringType()))
    for block in chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(block)
        part = scratch.keep(rows.select("__rid", "__text").mapInArrow(lean(_scan(shared, window, to_arrow_schema(hits))), hits))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    joined = found.groupBy("__rid").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("__runs", "__items")])
    both = rows.join(joined.hint("merge"), "__rid", "left").drop("__rid")
    return both.mapInArrow(lean(_scan(None, window, to_arrow_schema(out), spans)), out)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The contract columns of ``scan``'s rows."""
    return found.select(
        F.col(doc_id).alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a hit word, all columns kept."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("__row")
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__words"), others)
    found = scan(rows, items, window, "__id", "__words", keep=["__row"], spans=False, keep_text=True).where("n_hit = 0")
    return found.select(*[F.col("__text").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def brute_force(texts: dict, items: dict, window: int = 10) -> dict:
    """Reference for tests: every window against every position. Gives id -> (n_words, n_hit, sorted item ids)."""
    out = {}
    for key, text in texts.items():
        words = words_of(None if text is None else text.encode())
        inside, who = set(), set()
        for item, t in items.items():
            for w in windows_of(None if t is None else t.encode(), window):
                w = w.split(b" ")
                for i in range(len(words) - len(w) + 1):
                    if words[i : i + len(w)] == w:
                        inside |= set(range(i, i + len(w)))
                        who |= {str(item)} - {"None"}
        out[key] = (len(words), len(inside), sorted(who))
    return out


def sha_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
