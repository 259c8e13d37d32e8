"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check, components.

Fingerprint (64 bits): over the XXH64 values of a text's word shingles, a bit is set if more than half have it.
Join at ``bits`` or fewer differing bits, without all pairs and without losing a link:

1. Embedding. The 64 bits are cut into 32 segments of two; a fingerprint is mapped to its 32 bit counts. The
   Manhattan distance of two such points is a lower bound of the Hamming distance. Counts are kept in unary
   (00, 01, 11), so the Manhattan distance is a popcount of an exclusive or.
2. Grid. The 32 coordinates lie in G groups. Points within Manhattan distance t differ in at most t groups, so they
   share a cell of at least one grid over G - t of the groups; each point enters one cell of each of these
   C(G, t) grids, which is the range join with radius t. G follows from the number of points, so that a cell holds
   few of them: 6 groups (15 cells a point) up to some 10**6 points, 7 (35 cells) up to 10**7, and so on.
3. In a cell, the Manhattan bound filters and the exact Hamming distance decides. What leaves a cell is a link
   from each point to the smallest of its component in the cell: at most one row per point, never all pairs.
4. A cell of over ``cell_rows`` points isn't gathered: its points go to a finer grid over the bits themselves
   (segments of one bit, whose count is the bit), and so on to the finest, exactly as complete as the first. A cell
   of the finest leaves at most 24 bits open for 4 differing bits, so it holds 2**24 distinct points (128 MB) at most.

Copies of one text share a fingerprint and are one point. Components are joined in ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import LOWER, Scratch, lean, numbered, raw
from .components import components

_FIVES = 0x5555555555555555
_POINTS = "key long, fp long"


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42, block: int = 1 << 15) -> int:
    """Unsigned 64-bit fingerprint; zero for a null or wordless text."""
    parts = text.translate(LOWER).split() if text else []
    if not parts:
        return 0
    line, n = b" ".join(parts), max(len(parts) - words + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.concatenate(([0], ends))[:n].tolist()
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for i in range(0, n, block):
        sums = b"".join([digest(line[a:b], seed) for a, b in zip(starts[i : i + block], stops[i : i + block], strict=True)])
        bits = np.unpackbits(np.frombuffer(sums, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of every row. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, words, seed) for x in raw(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), StructType().add("doc_id", kind).add("fp", LongType()))


def embed(fp: np.ndarray) -> np.ndarray:
    """Unary counts of the 32 two-bit segments of unsigned fingerprints."""
    low, high = fp & np.uint64(_FIVES), (fp >> np.uint64(1)) & np.uint64(_FIVES)
    return (low | high) | ((low & high) << np.uint64(1))


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Manhattan bound first, exact distance for what passes."""
    out = np.bitwise_count(embed(a) ^ embed(b)) <= bits
    out[out] = np.bitwise_count((a ^ b)[out]) <= bits
    return out


def _links(points: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links (member, smallest of its component) among the points of one cell, by search from point to point."""
    rest, a, b = np.sort(points), [], []
    while len(rest):
        seeds, root, rest = [rest[0]], int(rest[0]), rest[1:]
        while seeds and len(rest):
            near = _near(seeds.pop(), rest, bits)
            found, rest = rest[near], rest[~near]
            seeds.extend(found)
            a.extend(found.tolist())
            b.extend([root] * len(found))
    return a, b


def _join(bits: int, cell_rows: int):
    """Over rows sorted by cell: rows (link, a, b), or (False, point, 0) for the points of an oversized cell."""

    def rows(kind: bool, a, b) -> pa.RecordBatch:
        a, b = (np.asarray(x, dtype=np.uint64).view(np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), pa.array(a), pa.array(b)], names=["link", "a", "b"])

    def cells(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(keys)) + 1
        first, stop = np.concatenate(([0], edges)), np.concatenate((edges, [len(keys)]))
        size = stop - first
        few = (size > 1) & (size <= 8)
        a, b = [], []
        for lag in range(1, 8):  # small cells: all their pairs at once, by lag
            with_lag = few & (size > lag)
            i = np.concatenate([first[with_lag] + k for k in range(8 - lag)] or [first[:0]])
            i = i[i + lag < np.tile(stop[with_lag], 8 - lag)]
            near = _near(fps[i], fps[i + lag], bits)
            a.append(fps[i][near])
            b.append(fps[i + lag][near])
        yield rows(True, np.concatenate(a), np.concatenate(b))
        for i, j in zip(first[size > 8], stop[size > 8], strict=True):
            yield rows(True, *_links(fps[i:j], bits)) if j - i <= cell_rows else rows(False, fps[i:j], np.zeros(j - i, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if over is not None:  # the rest of an oversized cell passes through
                n = int(np.searchsorted(k != over, True))
                yield rows(False, f[:n], np.zeros(n, np.uint64))
                k, f = k[n:], f[n:]
                over = over if not len(k) else None
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            if len(keys):
                last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                if last:
                    yield from cells(keys[:last], fps[:last])
                    keys, fps = keys[last:], fps[last:]
                if len(keys) > cell_rows:
                    over = keys[0]
                    yield rows(False, fps, np.zeros(len(fps), np.uint64))
                    keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from cells(keys, fps)

    return run


def groups_for(points: int, bits: int, per_cell: int = 32) -> int:
    """Groups of the first grid: the fewest whose cells hold about ``per_cell`` points if fingerprints are random.

    The count of a two-bit segment is worth log2(8 / 3) bits: two of them agree with odds of 3 / 8.
    """
    groups = bits + 2
    while groups < bits + 8 and points / (8 / 3) ** (32 * (groups - bits) / groups) > per_cell:
        groups += 1
    return groups


def _grids(level: int, bits: int, points: int) -> list[int]:
    """Masks whose cells hold every pair within ``bits``: the unary counts at level 0, then the bits themselves."""
    groups = groups_for(points, bits) if level == 0 else max([7, 11][level - 1], bits + 1 + level)
    width = [64 * i // groups for i in range(groups + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(width, width[1:], strict=False)]
    return [sum(x) for x in combinations(masks, groups - bits)]


def links(points: DataFrame, scratch: Scratch, bits: int = 4, cell_rows: int = 4096) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) that join everything within ``bits`` differing bits."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    low = F.col("fp").bitwiseAND(F.lit(_FIVES))
    high = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_FIVES))
    unary = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    out, parts, n = None, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), points.count()
    for level in range(3):
        points = points.repartition(parts, "fp")
        point = unary if level == 0 else F.col("fp")
        cells = [F.xxhash64(F.lit(i), point.bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(_grids(level, bits, n))]
        keyed = points.select(F.explode(F.array(*cells)).alias("key"), "fp")
        keyed = keyed.repartition("key").sortWithinPartitions("key")
        last = level == 2
        made = scratch.keep(keyed.mapInArrow(lean(_join(bits, 1 << 62 if last else cell_rows)), "link boolean, a long, b long"))
        found = made.where("link").select("a", "b")
        out = found if out is None else out.unionByName(found)
        points = made.where("not link").select(F.col("a").alias("fp")).distinct()
        if last or not made.where("not link").limit(1).count():
            return out


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """Every row's doc_id, fp and component_id: the smallest doc_id reachable over links, its own included.

    Null ids take part as documents but never name a component (null only if no id in it is known); null, empty
    and wordless texts have fingerprint zero and link like any other; repeated rows and ids are each returned.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.keep(fingerprints(docs, doc_id, text, words, seed))
    points = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(points.select("fp"), scratch, bits), scratch)
    roots = scratch.keep(points.join(roots, points["fp"] == roots["node"]).select("fp", "least", "root"))
    named = roots.groupBy("root").agg(F.min("least").alias("joined"))
    joined = roots.join(named, "root").select(F.col("fp").alias("node"), "joined")
    ids = points.join(joined, points["fp"] == joined["node"], "left").select("fp", F.when(F.col("node").isNotNull(), F.col("joined")).otherwise(F.col("least")).alias("component_id"))
    return own.join(ids, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """One row of every group of linked fingerprints, with all columns: the one with the least id.

    Rows are told apart by their number in the order of ids (null ids last), so of rows that share an id, or have none,
    one of each group stays.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    rows = numbered(docs, doc_id, text, scratch)
    found = classes(rows.select("rid", "text"), "rid", "text", words, bits, seed)
    chosen = scratch.keep(found.where("doc_id = component_id").select(F.col("doc_id").alias("rid")))
    kept = rows.join(chosen.hint("merge"), "rid", "left_semi")
    return kept.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def brute_force(texts: dict, words: int = 4, bits: int = 4, seed: int = 42) -> dict:
    """Reference for tests: id -> (fingerprint, component), by plain counting and all pairs."""
    fps = {}
    for key, text in texts.items():
        parts = (text or "").encode().translate(LOWER).split()
        shingles = [b" ".join(parts[i : i + words]) for i in range(max(len(parts) - words + 1, 1))] if parts else []
        hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
        fps[key] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {k: k for k in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= bits:
                    root[a] = root[b] = min(root[a], root[b])
    return {k: (fps[k], root[k]) for k in fps}
