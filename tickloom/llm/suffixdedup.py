"""Repeated passages by a sparse suffix array; exact.

1. Anchors. Every window of ``min_words`` words has one anchor: of its first ``min_words // 2`` positions the one
   whose word 8-gram has the least hash, the leftmost of equals. It depends on the window's words alone. The
   windows of one anchor follow each other; together they are the anchor's block.
2. Sparse suffix array. Only suffixes at anchors are kept, about 2 in ``min_words // 2`` words. They are sorted by
   range over (hash of the first ``prefix`` words, which every window of the anchor holds, hash of the block,
   document, position); a run may span many tasks, so a passage that a third of all documents share is split like
   any other rows.
3. Neighbours. A suffix whose neighbour before it has the same block repeats it as a whole. A suffix that shares its
   prefix with no other is unique. What is left shares its prefix, but not its block: the first suffix of every
   block of such a run stays open.
4. Extension. Open matches are extended to the left and right of their anchors, window by window: the windows of
   the open blocks are sorted by their own hashes, and one whose neighbour before it is equal is a repeat.

Nothing is lost: equal windows have equal anchors and prefixes, hence stand in one run; the earliest of them is
never in a block that repeats an earlier one, so it is open together with all that aren't settled with their block.
A result row is a stretch of words that such windows cover; the occurrence later in the order of (document,
position) is the one reported, so that the earliest always stays. The reference of a stretch is an occurrence that
stands before its first window.

The tasks' first and last rows (two a task) are compared by the driver, so the result doesn't depend on how rows were
dealt to tasks. Words are runs of bytes but white space, A-Z lower-cased; equality of windows and blocks is that of
128 bits of hashes. Defined cases: null, empty and short texts have no repeats; repeated rows and repeated or null
ids are told apart by an order-keeping row number, so later copies are reported against an earlier one; repeats
within one document count; extra columns are kept aside; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Scratch, lean, numbered, raw, slices
from .wordhash import grams, mix, sliding, spans, words

GRAM = 8


def blocks(hashes: np.ndarray, owner: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of ``min_words`` that lie in one document: their words, first windows and window counts."""
    window = min_words // 2
    gram = min(GRAM, min_words - window + 1)
    n = len(hashes) - min_words + 1
    if n < 1:
        return (np.zeros(0, dtype=np.int64),) * 3
    g = grams(hashes, np.arange(len(hashes) - gram + 1), gram)
    least = sliding(lambda a, b: np.where(g[a] <= g[b], a, b), np.arange(len(g)), window)[:n]
    start = np.flatnonzero(owner[:n] == owner[min_words - 1 :])
    at = least[start]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), bool), at[1:] != at[:-1])))
    return at[first], start[first], np.diff(np.append(first, len(at)))


def _suffixes(min_words: int):
    """Rows (h, b, rid, s, m): an anchor's hash over its prefix and over its block, the block's first window and windows."""
    prefix = min_words - min_words // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rids = batch.column(1), batch.column(0).to_numpy()
            for a, b in slices(texts):
                rows = raw(texts.slice(a, b - a))
                ends = np.cumsum([len(x or b"") + 1 for x in rows])
                first, _, hashes = words(b" ".join(x or b"" for x in rows))
                owner = np.searchsorted(ends, first, side="right")
                begin = np.searchsorted(owner, np.arange(len(rows) + 1))
                at, start, count = blocks(hashes, owner, min_words)
                block = spans(hashes, start, start + count - 1 + min_words) + count.astype(np.uint64)
                columns = [grams(hashes, at, prefix).view(np.int64), mix(block).view(np.int64), rids[a:b][owner[at]], (start - begin[owner[at]]).astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "b", "rid", "s", "m"])

    return run


def _windows(min_words: int):
    """Rows (h, b, rid, s, 1) of the windows of a text's open blocks: two hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                rows = raw(part.column(1))
                ends = np.cumsum([len(x) + 1 for x in rows])
                first, _, hashes = words(b" ".join(rows))
                begin = np.searchsorted(first, ends - [len(x) + 1 for x in rows])
                asked = part.column(2)
                count = asked.flatten().field("m").to_numpy()
                owner = np.repeat(np.repeat(np.arange(len(rows)), asked.value_lengths().to_numpy()), count)
                start = np.repeat(asked.flatten().field("s").to_numpy() - (np.cumsum(count) - count), count) + np.arange(count.sum())
                at = begin[owner] + start
                again = grams(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), at, min_words)
                columns = [grams(hashes, at, min_words).view(np.int64), again.view(np.int64), part.column(0).to_numpy()[owner], start.astype(np.int32), np.ones(len(at), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "b", "rid", "s", "m"])

    return run


#: Rows of ``_neighbours``: a repeat of (ref, ref_s); a suffix that stays open; first and last row of a task.
REPEAT, OPEN, FIRST, LAST = range(4)
_SUFFIX = "h long, b long, rid long, s int, m int"
_FOUND = "kind int, part int, h long, b long, rid long, s int, m int, ref long, ref_s int"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, b, rid, s, m) of one task, sorted, to rows of ``_FOUND``. What the next task may go on with is open."""
    part = TaskContext.get().partitionId()
    last = held = None  # the row before; the first suffix of a run that has one block so far

    def rows(kind: int, columns: list, ref=None) -> pa.RecordBatch:
        size = len(columns[0])
        made = [np.full(size, kind, np.int32), np.full(size, part, np.int32), *(np.asarray(c, t) for c, t in zip(columns, (np.int64, np.int64, np.int64, np.int32, np.int32), strict=True))]
        refs = [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32())] if ref is None else [pa.array(ref[0]), pa.array(ref[1])]
        return pa.RecordBatch.from_arrays([*map(pa.array, made), *refs], names=["kind", "part", "h", "b", "rid", "s", "m", "ref", "ref_s"])

    one = lambda row: [[x] for x in row]
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not len(columns[0]):
            continue
        if last is None:
            last = [c[0] for c in columns]
            yield rows(FIRST, one(last))
            columns = [c[1:] for c in columns]
            if not len(columns[0]):
                continue
        before = [np.concatenate(([v], c[:-1])) for v, c in zip(last, columns, strict=True)]
        other_run = before[0] != columns[0]
        head = other_run | (before[1] != columns[1])
        yield rows(REPEAT, [c[~head] for c in columns], (before[2][~head], before[3][~head]))
        heads = np.flatnonzero(head)
        opens = other_run[heads]  # the first of a run
        if len(heads):
            if held is not None and not opens[0]:
                yield rows(OPEN, one(held))
            followed = np.concatenate((~opens[1:], [False]))
            yield rows(OPEN, [c[heads[~opens | followed]] for c in columns])
            held = [c[heads[-1]] for c in columns] if opens[-1] else None
        last = [c[-1] for c in columns]
    if held is not None:
        yield rows(OPEN, one(held))
    if last is not None:
        yield rows(LAST, one(last))


def _seams(found: DataFrame) -> DataFrame:
    """The first row of every task, as a repeat of the last row of the task before it or open: two rows a task in all."""
    out, last = [], None
    for r in found.where(F.col("kind") >= FIRST).orderBy("part", "kind").collect():
        if r.kind == FIRST:
            same = last is not None and (last.h, last.b) == (r.h, r.b)
            out.append((REPEAT if same else OPEN, r.part, r.h, r.b, r.rid, r.s, r.m, last.rid if same else None, last.s if same else None))
        else:
            last = r
    return found.sparkSession.createDataFrame(out, _FOUND)


def _sorted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Repeats and open rows of a suffix array. Its rows are written before, for its ranges follow a sample of them."""
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    kept = scratch.keep(rows)
    array = kept.repartitionByRange(parts, "h", "b", "rid", "s").sortWithinPartitions("h", "b", "rid", "s")
    found = scratch.keep(array.mapInArrow(lean(_neighbours), _FOUND))
    scratch.drop(kept)
    return found.where(F.col("kind") < FIRST).unionByName(_seams(found))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rid, start, -stop): overlapping repeats of a document become one, with the first's reference."""
    held, names = None, ["rid", "start", "stop", "ref", "ref_start"]
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate((a, b)) for a, b in zip(held, columns, strict=True)]
        rid, start, stop, ref, ref_start = columns
        if not len(rid):
            continue
        doc = np.concatenate(([0], np.cumsum(rid[1:] != rid[:-1])))
        top = int(stop.max()) + 1
        reach = np.maximum.accumulate(stop + doc * top) - doc * top  # furthest end so far in the document
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])))
        begin = np.flatnonzero(new)
        ends = np.concatenate((begin[1:], [len(rid)])) - 1
        merged = [rid[begin], start[begin], reach[ends], ref[begin], ref_start[begin]]
        held = [c[-1:] for c in merged]
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in merged], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)


def repeats(rows: DataFrame, scratch: Scratch, min_words: int = 50) -> DataFrame:
    """rid, start, stop (words), ref, ref_start of every repeated passage of ``numbered`` rows."""
    texts = rows.select("rid", "text")
    array = _sorted(texts.where(F.length("text") >= 2 * min_words - 1).mapInArrow(lean(_suffixes(min_words)), _SUFFIX), scratch)
    asked = array.where(F.col("kind") == OPEN).groupBy("rid").agg(F.collect_list(F.struct("s", "m")).alias("asked"))
    # One plan at every size: both sides meet by sorted keys, none is sent to all tasks.
    opened = texts.join(asked.hint("merge"), "rid").select("rid", "text", "asked")
    extended = _sorted(opened.mapInArrow(lean(_windows(min_words)), _SUFFIX), scratch)
    both = array.where(F.col("kind") == REPEAT).unionByName(extended.where(F.col("kind") == REPEAT))
    found = both.select("rid", F.col("s").cast("long").alias("start"), (F.col("s") + F.col("m") - 1 + min_words).cast("long").alias("stop"), "ref", F.col("ref_s").cast("long").alias("ref_start"))
    ordered = found.repartition("rid").sortWithinPartitions("rid", "start", F.desc("stop"), "ref", "ref_start")
    return scratch.keep(ordered.mapInArrow(lean(_merge), "rid long, start long, stop long, ref long, ref_start long"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """doc_id, start_word, n_words of every repeat, and the doc_id and word where it stands before."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = numbered(docs, doc_id, text, scratch)
    found = repeats(rows, scratch, min_words)
    if rows.schema["doc_id"].dataType == LongType() and not hasattr(rows, "scratch_path"):
        found = found.withColumnsRenamed({"rid": "doc_id", "ref": "ref_doc_id"})
    else:
        names = rows.select("rid", "doc_id")
        found = found.join(names, "rid").join(names.select(F.col("rid").alias("ref"), F.col("doc_id").alias("ref_doc_id")), "ref")
    return found.select("doc_id", F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"), "ref_doc_id", F.col("ref_start").alias("ref_start_word"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stands between kept words stays as it was."""
    data = text.encode()
    first, stop, _ = words(data)
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(data[at : first[a]])
        at = max(at, int(stop[b - 1]))
    return b"".join([*out, data[at:]]).decode()


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """The documents without their repeats, columns as they came; a document of which no word is left goes."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = numbered(docs, doc_id, text, scratch)
    spans = repeats(rows, scratch, min_words).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(scratch.keep(spans).hint("merge"), "rid", "left").select("text", "spans", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 22):
                part = batch.slice(a, b - a)
                texts, keep = part.column(0).to_pylist(), []
                for i, spans in enumerate(part.column(1).to_pylist()):
                    if spans:
                        texts[i] = cut(texts[i], [(s["start"], s["stop"]) for s in spans])
                    keep.append(not spans or bool(texts[i].strip()))
                out = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column(2)], names=["text", "row"])
                yield out.filter(pa.array(keep, pa.bool_()))

    left = joined.mapInArrow(lean(run), joined.select("text", "row").schema)
    return left.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def brute_force(texts: dict, min_words: int = 50) -> dict:
    """Reference for tests: positions of words in any window of ``min_words`` that stands earlier already."""
    seen, out = set(), {}
    for key in sorted(texts):
        parts = (texts[key] or "").encode().lower().split()
        inside = set()
        for i in range(len(parts) - min_words + 1):
            window = tuple(parts[i : i + min_words])
            if window in seen:
                inside |= set(range(i, i + min_words))
            seen.add(window)
        out[key] = sorted(inside)
    return out
