"""Nearest neighbours by largest inner product: multiprobe p-stable hashing with exact reranking.

Vectors are mapped to a sphere, where the largest inner product is the least Euclidean distance: x becomes
(x / U, sqrt(1 - |x|^2 / U^2)) with U the largest norm, and a query (q / |q|, 0). A table's key is ``hashes``
values floor((a.x + b) / width) with Gaussian a, uniform b; there are ``tables`` of them. A query visits its own
bucket and ``probes`` perturbed ones in each table, in the order of estimated success: a perturbation moves some
values to the next bucket up or down, its cost is the sum of squared distances to the crossed boundaries. The
candidates of all tables are merged and ranked by their exact inner product in double precision.

The index is fitted on a bounded sample of ``sample`` rows: the width follows the sample's distances to near
neighbours; the number of hash values grows until a bucket would hold about ``per_bucket`` rows of the whole
table; the probes (and, if ``most_probes`` don't do, fewer hash values) are the fewest that find ``aim`` of the
true neighbours of ``trial`` sampled rows, which are looked up in the whole table. Every row is indexed.

Layout: each table's buckets are dealt to parts whose number follows from the bytes of points and visits, so a
part fits in memory; a query meets a part once, with all its probes there, and leaves at most ``k + 1`` rows. No
pair of a query and a candidate is ever a row. A bucket of more points than a quarter part is split by point and
visited in all its splits. Equal vectors are one point that carries its ``k + 1`` smallest ids, which is all
that any ranking can use, so a vector that repeats for a third of all rows costs one point. A query whose probes
find fewer than ``k`` rows is looked up against all points, in blocks of queries; so is every query if the trial
shows that even the coarsest hash doesn't find ``aim`` of the neighbours.

Defined cases: vectors (of rows and queries) that are null, zero, of another length than most rows have, or hold
null or non-finite components take no part; null ids take no part; an id that repeats with different vectors stands
for each; ties in score go to the smaller id; a table with k or fewer other rows gives all of them; no usable row or
query gives no result; extra columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .wordhash import mix


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and v (array of double) of the rows that can take part if their length fits."""
    v = F.col("v")
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def length_of(rows: DataFrame) -> int:
    """The commonest length of the vectors, the least of equals; 0 for none."""
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return most.n if most else 0


class Index:
    """The hash functions: ``hashes`` values a key in each table."""

    def __init__(self, sample: np.ndarray, norm: float, rows: int, tables: int, per_bucket: float, width: float, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.dim, self.norm, self.tables, self.probe_count = sample.shape[1], norm, tables, 0
        self.enough = True
        points = self.lift(sample[:1000])
        near = np.sort(np.maximum(2 - 2 * points @ points.T, 0), axis=1)[:, 1 : 1 + max(1, min(10, len(points) - 1))]
        spread = float(np.sqrt(np.median(near))) if near.size else 1.0
        self.width = max(width * spread, 1e-6)
        self.all_a = draw.normal(size=(tables, 24, self.dim + 1))
        self.all_b = draw.uniform(0, self.width, size=(tables, 24))
        self.salt = draw.integers(1, 1 << 62, size=(tables, 24), dtype=np.int64) | 1
        keys = np.floor((points @ self.all_a[0].T + self.all_b[0]) / self.width)
        self.hashes = 1
        for m in range(1, 25):
            self.hashes = m
            _, counts = np.unique(keys[:, :m], axis=0, return_counts=True)
            together = float((counts * (counts - 1.0)).sum()) / max(len(points) * (len(points) - 1.0), 1)
            if together * rows <= per_bucket:
                break

    @property
    def a(self) -> np.ndarray:
        return self.all_a[:, : self.hashes]

    @property
    def b(self) -> np.ndarray:
        return self.all_b[:, : self.hashes]

    def tune(self, asked: np.ndarray, near: list[np.ndarray], aim: float, most: int) -> None:
        """The fewest probes, of the most hash values, that reach ``aim`` of the given neighbours of each vector.

        ``enough`` tells whether any do.
        """
        total = sum(map(len, near))
        while total:
            rank = np.full((len(asked), max(map(len, near))), most + 1)
            for t, visits in enumerate(self.probes(asked, most)):
                for i, (own, found) in enumerate(zip(visits, near, strict=True)):
                    if len(found):
                        same = self.key(found, t)[:, None] == own[None, :]
                        at = np.where(same.any(axis=1), same.argmax(axis=1), most + 1)
                        rank[i, : len(found)] = np.minimum(rank[i, : len(found)], at)
            ranks = np.sort(np.concatenate([r[: len(f)] for r, f in zip(rank, near, strict=True)]))
            needed = int(ranks[min(int(np.ceil(aim * total)), total) - 1])
            if needed <= most or self.hashes == 1:
                self.probe_count, self.enough = min(needed, most), needed <= most
                return
            self.hashes -= 1

    def key(self, x: np.ndarray, table: int) -> np.ndarray:
        return self.keys(np.floor((self.lift(x) @ self.a[table].T + self.b[table]) / self.width), table)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        rest = np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))
        return np.concatenate((x, rest[:, None]), axis=1)

    def keys(self, values: np.ndarray, table: int) -> np.ndarray:
        """One long a row of hash values (collisions only add candidates)."""
        with np.errstate(over="ignore"):
            return mix((values.astype(np.int64) * self.salt[table, : self.hashes]).sum(axis=-1).astype(np.uint64)).view(np.int64)

    def probes(self, q: np.ndarray, count: int) -> Iterator[np.ndarray]:
        """Keys [query, probe] that queries visit in each table: their own bucket, then by estimated success."""
        q = np.concatenate((q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))), axis=1)
        m = self.hashes
        ranks = self._sets(m, count) if count else []
        member = np.zeros((len(ranks), 2 * m))
        for i, s in enumerate(ranks):
            member[i, list(s)] = 1
        for t in range(self.tables):
            at = (q @ self.a[t].T + self.b[t]) / self.width
            base = np.floor(at)
            below = at - base
            cost = np.concatenate((below**2, (1 - below) ** 2), axis=1)  # one down, one up, of each value
            order = np.argsort(cost, axis=1)
            value = np.take_along_axis(cost, order, axis=1)
            total = value @ member.T  # the cost of every set for each query; the cheapest are visited
            moved = np.zeros((len(q), 2 * m))
            keys = [self.keys(base, t)]
            best = np.argsort(total, axis=1, kind="stable")
            step = np.concatenate((-np.eye(m), np.eye(m)))  # what a move adds to the hash values
            for k in range(min(count, len(ranks))):
                chosen = member[best[:, k]]
                moved[:] = 0
                np.put_along_axis(moved, order, chosen, axis=1)
                keys.append(self.keys(base + moved @ step, t))
            yield np.stack(keys, axis=1)

    @staticmethod
    def _sets(m: int, count: int) -> list[tuple[int, ...]]:
        """Sets of ranks in the order of moves by cost, by their expected cost, without both moves of one value.

        The j-th cheapest of 2m moves costs about j (j + 1) / (4 (m + 1) (m + 2)) on average for the cheaper half.
        A value's two moves tend to stand at mirrored ranks, so mirrored ranks don't meet in a set.
        """
        low = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) for j in range(m)]
        expect = low + [1 - (m - j) / (m + 1) + (m - j) * (m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m)]
        found: list[tuple[float, tuple[int, ...]]] = []
        heap = [(expect[0], (0,))]
        while heap and len(found) < 2 * count:
            cost, s = heapq.heappop(heap)
            if not any(2 * m - 1 - j in s for j in s):
                found.append((cost, s))
            if s[-1] + 1 < 2 * m:
                heapq.heappush(heap, (cost - expect[s[-1]] + expect[s[-1] + 1], (*s[:-1], s[-1] + 1)))
                heapq.heappush(heap, (cost + expect[s[-1] + 1], (*s, s[-1] + 1)))
        return [s for _, s in found]


def fit(
    points: DataFrame, k: int, tables: int, per_bucket: float, width: float, sample: int, trial: int, aim: float, most_probes: int, block: int, scratch: Scratch
) -> Index | None:
    """An index for points (p, v, ids); the sample is about ``sample`` rows with the smallest hash."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = points.agg(F.count("*").alias("n"), F.sqrt(F.max(norm2)).alias("u")).first()
    if not stats.n:
        return None
    share = F.pmod(F.xxhash64("p"), F.lit(1 << 30)) / float(1 << 30)
    chosen = sorted(map(tuple, points.where(share <= sample / stats.n).select("p", "v").limit(2 * sample).collect()))
    chosen = chosen or sorted(map(tuple, points.select("p", "v").limit(sample).collect()))
    index = Index(np.array([v for _, v in chosen]), stats.u, stats.n, tables, per_bucket, width)
    tried = chosen[:: max(len(chosen) // trial, 1)][:trial]
    asked = points.sparkSession.createDataFrame(tried, "q long, v array<double>")
    true = _best(_exact(points, asked, index.dim, k + 1, block, scratch), k).where("q <> p")
    near: dict[int, list] = {q: [] for q, _ in tried}
    for r in true.join(points.select("p", "v"), "p").select("q", "v").collect():
        near[r.q].append(r.v)
    index.tune(np.array([v for _, v in tried]), [np.array(near[q]).reshape(-1, index.dim) for q, _ in tried], aim, most_probes)
    return index


def search(
    rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
    tables: int = 4, per_bucket: float = 24.0, width: float = 2.5, sample: int = 2_000, trial: int = 100,
    aim: float = 0.95, most_probes: int = 512, part_bytes: int = 24 << 20, block: int = 256,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest found; ``queries`` are rows of the same kind."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "ann")
    taken = usable(rows, vec_id, embedding)
    same = F.size("v") == length_of(taken)
    asked = usable(queries, vec_id, embedding).where(same).distinct()
    # Equal vectors: one point with its smallest ids. The rank limit works on each task's rows before they move.
    order = Window.partitionBy("v").orderBy("id")
    first = taken.where(same).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    points = scratch.keep(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("p"), "v", "ids"))
    queries = scratch.keep(asked.groupBy("v").agg(F.min("id").alias("q")).select("q", "v"))
    index = fit(points, k, tables, per_bucket, width, sample, trial, aim, most_probes, block, scratch)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not index.enough:
        return _expand(_best(_exact(points, queries, index.dim, k + 1, block, scratch), k), points, queries, asked, k)
    dim, point_bytes = index.dim, 8 * index.dim + 16
    n_points, n_queries = points.count(), queries.count()
    shared = spark.sparkContext.broadcast(index)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(tables if batch.num_rows else 0):
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.key(_matrix(batch.column(1), dim), t)), *batch.columns], names=["key", "p", "v"])

    # Buckets of more than a quarter part; there are at most four for each part.
    part_rows = max(part_bytes // point_bytes, 16)
    visits = n_queries * (16 * tables * (index.probe_count + 1) + point_bytes)
    parts = max(1, -(-(n_points * point_bytes * tables + visits) // part_bytes))
    indexed = points.select("p", "v").mapInArrow(hashed, "key long, p long, v array<double>")
    crowded = indexed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > part_rows // 4).collect()
    splits = spark.sparkContext.broadcast({r.key: -(-4 * r.n // part_rows) for r in crowded})

    def dealt(keys: np.ndarray, split: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64) + split.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            split = np.array([splits.value.get(x, 1) for x in keys.tolist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(dealt(keys, p % np.maximum(split, 1))), *batch.columns], names=["part", "key", "p", "v"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "q", "v", "keys"]
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                rows = batch.slice(i, block)
                # All tables' visits of a query together: it meets a part once.
                keys = np.concatenate(list(shared.value.probes(_matrix(rows.column(1), dim), shared.value.probe_count)), axis=1)
                owner, flat = np.repeat(np.arange(len(keys)), keys.shape[1]), keys.ravel()
                times = np.array([splits.value.get(x, 1) for x in flat.tolist()], dtype=np.int64)
                owner, flat = np.repeat(owner, times), np.repeat(flat, times)
                part = dealt(flat, np.arange(len(flat)) - np.repeat(np.cumsum(times) - times, times))
                order = np.lexsort((flat, part, owner))
                owner, part, flat = owner[order], part[order], flat[order]
                new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(flat)), pa.int32()), pa.array(flat))
                taken = rows.take(pa.array(owner[new]))
                yield pa.RecordBatch.from_arrays([pa.array(part[new]), *taken.columns, lists], names=names)

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        """One part: its points (part, key, p, v) and the queries that visit it (part, q, v, keys)."""
        names, out = ["q", "p", "score"], []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            buckets, bucket = np.unique(left["key"].to_numpy(), return_inverse=True)
            p, v = left["p"].to_numpy(), _matrix(left["v"].combine_chunks(), dim)
            # A point stands here once for each of its buckets: its vector is kept once, entries by their turn.
            bits = (v.view(np.uint64) * (2 * np.arange(dim, dtype=np.uint64) + 0x9E3779B97F4A7C15)).sum(axis=1)
            order = np.lexsort((bits, p))
            new = np.concatenate(([True], (np.diff(p[order]) != 0) | (bits[order][1:] != bits[order][:-1])))
            point, first = np.empty(len(p), dtype=np.int64), np.flatnonzero(new)
            point[order] = np.cumsum(new) - 1
            turn = np.empty(len(p), dtype=np.int64)
            turn[order] = np.arange(len(p)) - first[point[order]]
            turns = [np.flatnonzero(turn == j) for j in range(turn.max() + 1)]
            p, v = p[order[first]], v[order[first]]
            for i in range(0, right.num_rows, block):
                some = right.slice(i, block)
                q, lists = _matrix(some["v"].combine_chunks(), dim), some["keys"].combine_chunks()
                flat = lists.flatten().to_numpy()
                owner = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
                at = np.minimum(np.searchsorted(buckets, flat), len(buckets) - 1)
                hit = buckets[at] == flat
                visited = np.zeros((len(q), len(buckets)), dtype=bool)
                visited[owner[hit], at[hit]] = True
                candidate = np.zeros((len(q), len(p)), dtype=bool)
                for entries in turns:
                    candidate[:, point[entries]] |= visited[:, bucket[entries]]
                seen = candidate.any(axis=0).nonzero()[0]
                if not len(seen):
                    continue
                candidate = candidate[:, seen]
                score = np.where(candidate, q @ v[seen].T, -np.inf)
                row, col = _top(score, k + 1)
                keep = candidate[row, col]
                row, col = row[keep], seen[col[keep]]
                exact = np.einsum("ij,ij->i", q[row], v[col])
                out.append(pa.Table.from_arrays([some["q"].combine_chunks().take(pa.array(row)), pa.array(p[col]), pa.array(exact)], names=names))
        return pa.concat_tables(out) if out else pa.table({"q": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    homes = indexed.mapInArrow(placed, "part long, key long, p long, v array<double>").groupBy("part")
    guests = queries.mapInArrow(probed, "part long, q long, v array<double>, keys array<long>").groupBy("part")
    found = homes.cogroup(guests).applyInArrow(ranked, "q long, p long, score double")
    best = scratch.keep(_best(found.dropDuplicates(["q", "p"]), k))
    # Exact for what the probes left short of k rows.
    counted = best.join(points.select("p", F.size("ids").alias("n")), "p").groupBy("q").agg(F.sum("n").alias("n"))
    short = scratch.keep(queries.join(counted.where(F.col("n") > k), "q", "left_anti"))
    exact = _best(_exact(points, short, dim, k + 1, block, scratch), k)
    every = best.join(short.select("q"), "q", "left_anti").unionByName(exact)
    return _expand(every, points, queries, asked, k)


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k + 1 best points of each query point; ties by the point's smallest id."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "p")
    return scores.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")


def _top(score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``most`` highest scores of each row, with all that tie with the last of them."""
    edge = np.partition(score, -most, axis=1)[:, -most] if score.shape[1] > most else score.min(axis=1, initial=np.inf)
    return np.divmod(np.flatnonzero(score >= (edge - 1e-9 * np.abs(edge))[:, None]), max(score.shape[1], 1))


def _exact(points: DataFrame, queries: DataFrame, dim: int, most: int, block: int, scratch: Scratch, query_bytes: int = 4 << 20) -> DataFrame:
    """Scores of the ``most`` best points of each query in each task: query blocks against all points.

    A job for every ``query_bytes`` of query vectors, whose result is written; a task keeps ``most`` points a query.
    """
    spark, out, size = points.sparkSession, None, max(query_bytes // (8 * dim), 1)
    ids = [r.q for r in queries.select("q").orderBy("q").limit(size).collect()]
    while ids:
        part = sorted((r.q, r.v) for r in queries.where(F.col("q").between(ids[0], ids[-1])).collect())
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in part]), np.array([v for _, v in part])))

        def against(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors = shared.value
            row, p, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                found, v, new = [(row, p, score)], _matrix(batch.column(1), dim), batch.column(0).to_numpy()
                for i in range(0, len(names) if len(new) else 0, block):
                    r, c = _top(vectors[i : i + block] @ v.T, most)
                    found.append((r + i, new[c], np.einsum("ij,ij->i", vectors[r + i], v[c])))
                row, p, score = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((p, -score, row))
                row, p, score = row[order], p[order], score[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < most
                row, p, score = row[keep], p[keep], score[keep]
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(p), pa.array(score)], names=["q", "p", "score"])

        scores = scratch.keep(points.select("p", "v").mapInArrow(against, "q long, p long, score double"))
        shared.destroy()
        out = scores if out is None else out.unionByName(scores)
        ids = [r.q for r in queries.select("q").where(F.col("q") > ids[-1]).orderBy("q").limit(size).collect()]
    return out if out is not None else spark.createDataFrame([], "q long, p long, score double")


def _expand(best: DataFrame, points: DataFrame, queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """From points to rows: each point's ids, each query's own id left out, ``k`` of them ranked."""
    rows = best.join(points.select("p", F.explode("ids").alias("id")), "p").select("q", "score", "id")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("q")
    lists = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("n"), "id", "score"))).alias("found"))
    # A query id with several vectors leaves out itself in each.
    members = asked.join(queries, "v").select("q", F.col("id").alias("query_id"))
    own = members.join(lists, "q").select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("found"))
    ranked = own.select("query_id", F.posexplode("found").alias("i", "x"))
    return ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def brute_force(vectors: dict[int, list | None], queries: list[int], k: int = 20) -> dict[int, list[int]]:
    """Reference for tests: ids of the k nearest of each query by plain sorting."""
    good = {i: np.array(v, dtype=float) for i, v in vectors.items() if v and None not in v}
    good = {i: v for i, v in good.items() if np.isfinite(v).all() and v.any()}
    out = {}
    for q in queries:
        if q in good:
            ranked = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)
            out[q] = [i for _, i in ranked[:k]]
    return out
