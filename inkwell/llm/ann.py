"""Approximate nearest neighbours by adaptive dimension scans of inverted lists.

Vectors get one more dimension so that the largest inner product is the smallest distance (Bachrach
et al., 2014), and are turned by a random rotation. A list is scanned in column blocks: after each
block a pair goes on only if its partial distance, scaled up to all dimensions, doesn't reject
"nearer than the query's current k-th" at the significance that `epsilon` stands for (Gao and Long,
2023). What survives all blocks is scored exactly, in double precision on the original vectors.

Equal vectors are one entry (its least ids are kept beside it), so copies neither fill lists nor
results. Lists are split into parts of bounded size; a query visits every part of its lists. The
first, nearest list sets each query's threshold for the rest.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .labelled import unit_hash
from .shared import Scratch

BLOCK, PART = 16, 8192
HELD, EACH = 400, 40  # queries that measure the lists to visit, sampled vectors a list
SAMPLE_BYTES = 1 << 28  # of the vectors that the index is fitted on, as doubles


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part: not null, not zero, all components finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.filter(fine)


class Index:
    """Rotation and centroids; a bounded number of vectors of the table's dimension."""

    def __init__(self, sample: np.ndarray, lists: int, longest: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.longest = longest
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        x = self.turned(sample)
        c = x[rng.permutation(len(x))[:lists]]
        for _ in range(10):
            near = self._nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            s = np.zeros_like(c)
            np.add.at(s, near, x)
            c = np.where(n[:, None] > 0, s / np.maximum(1, n)[:, None], c)
        self.centroids, self.sizes = c, np.zeros(len(c), np.int64)

    def probes_for(self, recall: float, queries: np.ndarray, of: np.ndarray, lists: np.ndarray) -> int:
        """Lists that a query must visit for that share of the neighbours; of: their queries, lists: where they are.

        The queries must be none of the vectors that the centroids were fitted on. All lists if there are none.
        """
        if not len(of):
            return len(self.centroids)
        place = np.argsort(self.order(queries), 1)  # of each list in a query's order
        share = np.sort(place[of, lists]) + 1
        return int(share[min(len(share) - 1, int(recall * len(share)))])

    @staticmethod
    def _nearest(x, c):
        half = (c * c).sum(1) / 2
        return np.concatenate([np.argmin(half - x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(1)))
        return np.concatenate((x, extra[:, None]), 1) @ self.rotation

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.turned(x), self.centroids)

    def order(self, x: np.ndarray) -> np.ndarray:
        """All lists of each query, the nearest first."""
        return np.argsort((self.centroids**2).sum(1) / 2 - self.turned(x, query=True) @ self.centroids.T, 1, kind="stable")

    def probes(self, x: np.ndarray, most: int, enough: int) -> list[np.ndarray]:
        """Lists to visit, nearest first: `most`, or more until they hold `enough` vectors."""
        order = self.order(x)
        held = np.cumsum(self.sizes[order], 1)
        n = np.maximum(most, (held < enough).sum(1) + 1)
        return [o[:k] for o, k in zip(order, n)]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scan(x: np.ndarray, q: np.ndarray, limit: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (candidate, query) of rotated vectors that no block's test abandons; limit: squared distances, one a query."""
    d = x.shape[1]
    first = slice(0, BLOCK)
    part = (x[:, first] ** 2).sum(1)[:, None] + (q[:, first] ** 2).sum(1) - 2 * x[:, first] @ q[:, first].T
    cut = lambda n: (1 + epsilon / np.sqrt(n)) ** 2 * n / d * limit if n < d else limit * (1 + 1e-9) + 1e-12
    i, j = np.nonzero(part <= cut(min(BLOCK, d)))
    part = part[i, j]
    for at in range(BLOCK, d, BLOCK):
        b = slice(at, at + BLOCK)
        diff = x[i, b] - q[j, b]
        part = part + np.einsum("ij,ij->i", diff, diff)
        keep = part <= cut(min(at + BLOCK, d))[j]
        i, j, part = i[keep], j[keep], part[keep]
    return i, j


def _best(cand, query, score, k):
    """The k best of each query: largest score, ties to the smaller id."""
    order = np.lexsort((cand, -score, query))
    query, cand, score = query[order], cand[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    keep = rank < k
    return cand[keep], query[keep], score[keep]


def _scanner(index, k: int, epsilon: float):
    """Scans of a bucket's list parts: the k best of every visiting query."""

    def run(key, vectors: pa.Table, visits: pa.Table) -> pa.Table:
        m = index.value
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(vectors) and len(visits):
            lists = visits.column("cells").combine_chunks()
            at, want = vectors.column("cell").to_numpy(), lists.flatten().to_numpy()
            asks = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            raw, ask = _matrix(vectors.column("embedding")), _matrix(visits.column("embedding"))
            rid, qid = vectors.column("rid").to_numpy(), visits.column("qid").to_numpy()
            far = visits.column("limit").to_numpy(zero_copy_only=False).astype(float)
            for cell in np.unique(want):
                own, asking = np.flatnonzero(at == cell), asks[want == cell]
                for s in range(0, len(asking), 512):
                    a = asking[s : s + 512]
                    q, limit = m.turned(ask[a], query=True), np.where(np.isnan(far[a]), np.inf, far[a])
                    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                    norm = (ask[a] ** 2).sum(1) + m.longest**2
                    step = 64  # the first few set the threshold, the rest come in larger runs
                    start = 0
                    while start < len(own):
                        o = own[start : start + step]
                        i, j = scan(m.turned(raw[o]), q, limit, epsilon)
                        score = np.einsum("ij,ij->i", raw[o[i]], ask[a[j]])
                        best = _best(np.concatenate((best[0], rid[o[i]])), np.concatenate((best[1], j)), np.concatenate((best[2], score)), k)
                        count = np.bincount(best[1], minlength=len(a))
                        worst = np.full(len(a), np.inf)
                        np.minimum.at(worst, best[1], best[2])
                        limit = np.where(count >= k, np.minimum(limit, norm - 2 * worst), limit)
                        start, step = start + step, 2048
                    out.append((best[0], qid[a[best[1]]], best[2]))
        return pa.table({c: np.concatenate(x) for c, x in zip(("rid", "qid", "score"), zip(*out))})

    return run


def _truth(rids: np.ndarray, queries: np.ndarray, k: int):
    """The k best of the task's vectors for each query, by brute force, and the lists they are in."""

    def run(batches):
        score, lists = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        for b in batches:
            x, rid = _matrix(b.column("embedding")), b.column("rid").to_numpy()
            if not len(x):
                continue
            s = queries @ x.T
            i, j = np.nonzero(rids[:, None] == rid)
            own = (queries[i] == x[j]).all(1)
            s[i[own], j[own]] = -np.inf
            s, at = np.concatenate((score, s), 1), np.concatenate((lists, np.broadcast_to(b.column("list").to_numpy(), s.shape)), 1)
            top = np.argpartition(-s, k - 1, 1)[:, :k]
            score, lists = np.take_along_axis(s, top, 1), np.take_along_axis(at, top, 1)
        i, j = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(score[i, j]), pa.array(lists[i, j].astype(np.int32))], ["query", "score", "list"])

    return run


def neighbours(vectors: DataFrame, is_query: Column, scratch: Scratch, k: int = 20, recall: float = 0.96, lists: int | None = None, sample: int = 16_384, epsilon: float = 2.1) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query (rows of vectors for which is_query, on vec_id, holds).

    All other rows are candidates, copies of the query too, and other vectors of its vec_id; ties go to the smaller vec_id. Defined results: equal
    rows count once; a vec_id that occurs with several vectors counts as each, as query and as candidate; vectors
    are searched among those of their own dimension, each dimension by an index of its own; a query without a
    candidate and an empty table give none; other columns are left out, whatever their names. The index (rotation and 2 * sqrt(n) centroids, at most
    8,192) is fitted on a sample of about `sample` vectors, 40 a list at least and SAMPLE_BYTES at most (long vectors have fewer lists for it), and holds every vector.
    How many lists a query visits follows from the data: as many as hold the share `recall` of the true
    neighbours, in the whole table, of about `HELD` vectors that are kept out of the sample.
    """
    rows = usable(vectors).distinct().withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding"), "dimension": F.size("embedding")})
    rows = scratch.keep(rows, "vectors")
    asked = rows.groupBy("dimension").agg(F.max(F.struct(is_query.alias("q"))).alias("q")).filter("q.q").select("dimension").collect()
    found = [_of_one_dimension(rows.filter(F.col("dimension") == d), is_query, scratch, k, recall, lists, sample, epsilon) for d in sorted(r[0] for r in asked)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found)


def _of_one_dimension(rows: DataFrame, is_query: Column, scratch: Scratch, k: int, recall: float, lists: int | None, sample: int, epsilon: float) -> DataFrame:
    spark = rows.sparkSession
    copies = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.max(F.struct(is_query.alias("q"))).alias("q"), F.first("embedding").alias("embedding"))
    # Numbered in order of their least ids, so that ties by number are ties by id, and two vectors of one id are two entries.
    order = ["vec_id", "h1", "h2"]
    entries = copies.repartitionByRange(*order).sortWithinPartitions(*order).select("h1", "h2", F.monotonically_increasing_id().alias("rid"), F.col("q.q").alias("asks"), "embedding")
    entries = scratch.keep(entries, "entries")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    n, longest = entries.agg(F.count("*"), F.max(norm)).first()
    most = max(EACH, SAMPLE_BYTES // (8 * rows.first()["dimension"]))
    lists = lists or int(min(8192, most // EACH, max(1, 2 * np.sqrt(n))))
    sample, out = min(most, max(sample, EACH * lists)), min(0.1, HELD / n)
    u = unit_hash(F.col("h1"))
    taken = _matrix(entries.filter((u < sample / n) & (u < 1 - out)).select("embedding").limit(2 * sample).toArrow().column("embedding"))
    taken = taken if len(taken) else np.array([entries.first()["embedding"]])
    index = Index(taken, lists, longest)
    del taken
    held = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.lists_of(_matrix(b.column("embedding"))).astype(np.int32))], [*b.schema.names, "list"])

    placed = scratch.keep(entries.select("rid", "asks", "embedding").mapInArrow(assign, "rid long, asks boolean, embedding array<double>, list int"), "placed")
    asking = entries.filter(u >= 1 - out).select("rid", "embedding").limit(2 * HELD).toPandas()
    queries = np.stack(list(asking["embedding"])) if len(asking) else np.zeros((0, 1))
    true = placed.mapInArrow(_truth(asking["rid"].to_numpy(np.int64), queries, k), "query long, score double, list int") if len(asking) else None
    best_of = W.partitionBy("query").orderBy(F.desc("score"), "list")
    true = true.withColumn("r", F.row_number().over(best_of)).filter(F.col("r") <= k).select("query", "list").toPandas() if true is not None else None
    probes = index.probes_for(recall, queries, *(true[c].to_numpy() if true is not None else np.zeros(0, np.int64) for c in ("query", "list")))
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    for i, size in sizes.items():
        index.sizes[i] = size
    held = spark.sparkContext.broadcast(index)
    parts = np.maximum(1, -(-index.sizes // PART))
    first_cell = np.concatenate(([0], np.cumsum(parts)))
    buckets = int(max(1, -(-n // 16_384)))

    def cells(batches):
        for b in batches:
            at = b.column("list").to_numpy()
            cell = first_cell[at] + b.column("rid").to_numpy() % parts[at]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("embedding"), pa.array(cell), pa.array(cell % buckets)], ["rid", "embedding", "cell", "bucket"])

    def visits(batches):
        for b in batches:
            own, cell, bucket, turn = [], [], [], []
            for i, ls in enumerate(held.value.probes(_matrix(b.column("embedding")), probes, 4 * (k + 1))):
                for t, some in ((0, ls[:1]), (1, ls[1:])):
                    c = np.concatenate([np.zeros(0, np.int64), *(np.arange(first_cell[x], first_cell[x + 1]) for x in some)])
                    for to in np.unique(c % buckets):
                        own.append(i), cell.append(c[c % buckets == to]), bucket.append(to), turn.append(t)
            ids = pa.array(np.array(own, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("rid").take(ids), b.column("embedding").take(ids), pa.array(cell, pa.list_(pa.int64())), pa.array(bucket, pa.int64()), pa.array(turn, pa.int32())], ["qid", "embedding", "cells", "bucket", "turn"])

    found_as = "rid long, qid long, score double"
    candidates = scratch.keep(placed.mapInArrow(cells, "rid long, embedding array<double>, cell long, bucket long"), "cells")
    asked = placed.filter("asks").select("rid", "embedding").mapInArrow(visits, "qid long, embedding array<double>, cells array<long>, bucket long, turn int")
    asked = scratch.keep(asked, "visits")
    near = W.partitionBy("qid").orderBy(F.desc("score"), "rid")

    def best(v):
        got = candidates.groupBy("bucket").cogroup(v.groupBy("bucket")).applyInArrow(_scanner(held, k + 1, epsilon), found_as)
        return got

    start = scratch.keep(best(asked.filter("turn = 0").withColumn("limit", F.lit(None).cast("double"))), "first")
    kth = start.withColumn("r", F.row_number().over(near)).filter(F.col("r") == k + 1).select("qid", F.col("score").alias("kth"))
    later = asked.filter("turn > 0").join(kth, "qid", "left")
    own = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    rest = best(later.withColumn("limit", own + F.lit(longest**2) - 2 * F.col("kth")).drop("kth"))
    top = start.union(rest).withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).drop("r")

    # Copies: the least ids of each entry stand for it; then the query itself is left out.
    ids = rows.join(entries.select("h1", "h2", "rid"), ["h1", "h2"]).select("rid", "vec_id", is_query.alias("asks"))
    ids = scratch.keep(ids, "ids")
    least = ids.withColumn("r", F.row_number().over(W.partitionBy("rid").orderBy("vec_id"))).filter(F.col("r") <= k + 1).select("rid", "vec_id")
    nearest = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    wide = top.join(least, "rid").withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k + 1).select("qid", "rid", "vec_id", "score")
    asking = ids.filter("asks").select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"))
    answers = wide.join(asking, "qid").filter("not (rid = qid and vec_id = query_id)")
    answers = answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")
