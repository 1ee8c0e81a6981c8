"""Ranked lexical search: documents reordered by recursive graph bisection, a clustered index, exact early stopping.

1. Every document is cut into terms once; what is kept is its number of terms and how often it holds each term of the
   queries (a term that no query has is never read again, so it isn't written). Statistics cover all documents.
2. Recursive graph bisection: documents and their terms are a bipartite graph. Halves of a sample swap documents as long
   as that lowers the cost in bits of their terms' gaps, and each half is bisected again. Every split is kept as one
   weight a term (how much rather the term stands right) and a threshold, so that all documents, not only the sample,
   descend the tree to a leaf; their leaf and a number in it are their new order.
3. Clustered index: leaves, cut into shards of about 4,096 documents. A shard has one row a term: the documents by
   their numbers in the shard, what the term adds to each score, and the largest of these.
4. Search: the sum of a query's largest values bounds a shard's scores. Each query visits shards in order of their
   bounds, 8, then 64, then all that are left, and no shard whose bound is under the score of its k-th document so
   far. A shard with an equal bound is visited, since a smaller doc_id could win the tie; so the result is exact.

A visited shard's rows and its queries meet in one task, at most some 4,096 documents' terms; nothing else is gathered.
Bounds on what goes to all tasks: MOST_TERMS terms of queries at a time (queries with more are searched in blocks),
a tree of at most 255 splits by TREE_TERMS terms, fitted on SAMPLE documents.

Defined results: a null text, on either side, has no term, hence no result; equal query rows count once, and queries
that share an item_id but not a text are each ranked by themselves; rows that share a doc_id are ranked as documents of
their own; null doc_ids lose ties; empty tables give no rows; very long texts count as a whole; other columns, whatever
their names, are not read. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import flat_bytes, hash_spans, slices

SHARD = 4_096
SAMPLE, TREE_TERMS, LEVELS, SWEEPS = 8_192, 2_048, 8, 8
MOST_TERMS = 1 << 20
ROUNDS = (8, 64, None)
_TERM = np.zeros(256, bool)
_TERM[128:] = _TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True
_LAST = np.iinfo(np.int64).max


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts (runs of ASCII letters, digits and other than ASCII characters; only A-Z
    lower-cased), and the offset of each text's terms."""
    data, offsets = flat_bytes(texts)
    inside = _TERM[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    return hash_spans(data, starts, np.flatnonzero(edge == -1) - starts), np.searchsorted(starts, offsets)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, th and the hashes of a query's terms, once each; queries without a term are left out."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                h, at = term_hashes(part.column("text"))
                own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:])]
                columns = [part.column("item_id"), part.column("th"), lists(np.concatenate([np.zeros(0, np.int64), *own]), np.array([len(x) for x in own], int))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "th", "terms"])

    rows = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").withColumn("th", F.xxhash64("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.dropDuplicates(["item_id", "th"]).mapInArrow(cut, f"item_id {kind}, th long, terms array<long>").filter(F.size("terms") > 0)


def held_terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, row, n (terms, repeats included), terms (numbers in the vocabulary, ascending) and times of each document."""

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                h, cut = term_hashes(part.column("text"))
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == h)
                doc = np.searchsorted(cut, hit, "right") - 1
                pair, times = np.unique(doc * len(vocabulary) + at[hit], return_counts=True)
                each = np.bincount(pair // len(vocabulary), minlength=part.num_rows)
                columns = [part.column("doc_id"), part.column("row"), pa.array(np.diff(cut).astype(np.int64)), lists((pair % len(vocabulary)).astype(np.int32), each), lists(times.astype(np.int32), each)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, row long, n long, terms array<int>, times array<int>")


class Bisection:
    """The splits of a recursive graph bisection: `levels` rows of weights a node and term, and thresholds."""

    def __init__(self, sample: list[np.ndarray], terms: int, levels: int):
        self.levels, self.weights, self.least = levels, [], []
        doc = np.repeat(np.arange(len(sample)), [len(x) for x in sample])
        term = np.concatenate([np.zeros(0, np.int64), *sample]).astype(np.int64)
        node = np.zeros(len(sample), np.int64)
        for level in range(levels):
            n = 1 << level
            side = self._halves(node, np.arange(len(node)))
            for _ in range(SWEEPS):
                held, size = self._degrees(node, side, doc, term, n, terms)
                gain = np.zeros(len(node))
                for own in (0, 1):
                    of = side[doc] == own
                    gain += np.bincount(doc[of], self._gains(held, size, own)[node[doc[of]], term[of]], len(node))
                if not self._swap(node, side, gain):
                    break
            held, size = self._degrees(node, side, doc, term, n, terms)
            weight = np.log2((held[1] + 1) / (size[1] + 2)[:, None]) - np.log2((held[0] + 1) / (size[0] + 2)[:, None])
            score = np.bincount(doc, weight[node[doc], term], len(node))
            least = np.array([np.median(score[node == k]) if (node == k).any() else 0.0 for k in range(n)])
            self.weights.append(weight)
            self.least.append(least)
            node = 2 * node + (score > least[node])

    @staticmethod
    def _halves(node, order):
        """0 for the first half of each node's documents in that order, 1 for the rest."""
        by = np.lexsort((order, node))
        first = np.searchsorted(node[by], node[by])
        size = np.searchsorted(node[by], node[by], "right") - first
        side = np.zeros(len(node), np.int64)
        side[by] = 2 * (np.arange(len(node)) - first) >= size
        return side

    @staticmethod
    def _degrees(node, side, doc, term, n, terms):
        held = [np.bincount(node[doc[of]] * terms + term[of], minlength=n * terms).reshape(n, terms).astype(float) for of in (side[doc] == 0, side[doc] == 1)]
        return held, [np.bincount(node[side == s], minlength=n).astype(float) for s in (0, 1)]

    @staticmethod
    def _gains(held, size, own):
        """Bits that a term saves in its node if one of its documents leaves its own half for the other."""
        cost = lambda d, m: d * np.log2((m + 1)[:, None] / (d + 1))
        here, there, m, o = held[own], held[1 - own], size[own], size[1 - own]
        return cost(here, m) + cost(there, o) - cost(np.maximum(here - 1, 0), m) - cost(there + 1, o)

    @staticmethod
    def _swap(node, side, gain) -> bool:
        """Swap the best of both halves of each node, pair by pair, while a pair gains."""
        by = np.lexsort((-gain, side, node))
        group = node[by] * 2 + side[by]
        rank = np.arange(len(by)) - np.searchsorted(group, group)
        key = node[by] * (len(by) + 1) + rank
        left, right = side[by] == 0, side[by] == 1
        _, a, b = np.intersect1d(key[left], key[right], assume_unique=True, return_indices=True)
        a, b = by[left][a], by[right][b]
        good = gain[a] + gain[b] > 1e-9
        side[a[good]], side[b[good]] = 1, 0
        return bool(good.any())

    def leaves(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of n documents, from their pairs (document, tree term)."""
        node = np.zeros(n, np.int64)
        for weight, least in zip(self.weights, self.least):
            node = 2 * node + (np.bincount(doc, weight[node[doc], term], n) > least[node])
        return node


def bisect(held: DataFrame, df: np.ndarray, n: int, shard: int) -> tuple[Bisection, np.ndarray]:
    """The tree, fitted on the SAMPLE documents with the smallest hashes, and the tree's number of each vocabulary term
    (-1: none): of the terms that at most half of the documents hold the TREE_TERMS most frequent."""
    able = np.flatnonzero((df > 0) & (2 * df <= n))
    able = np.sort(able[np.argsort(-df[able], kind="stable")[:TREE_TERMS]])
    of = np.full(len(df), -1, np.int64)
    of[able] = np.arange(len(able))
    levels = min(LEVELS, max(0, math.ceil(math.log2(max(1, n) / shard)))) if len(able) else 0

    def known(batches):
        for batch in batches:
            column = batch.column("terms")
            each, flat = np.diff(column.offsets.to_numpy()), of[column.flatten().to_numpy(zero_copy_only=False)]
            doc = np.repeat(np.arange(len(each)), each)[flat >= 0]
            yield pa.RecordBatch.from_arrays([lists(flat[flat >= 0].astype(np.int32), np.bincount(doc, minlength=len(each)))], ["terms"])

    sample = held.filter(F.size("terms") > 0).orderBy(F.xxhash64("doc_id", "row"), "row").limit(SAMPLE).select("terms") if levels else None
    rows = [np.array(r["terms"], np.int64) for r in sample.mapInArrow(known, "terms array<int>").toLocalIterator()] if levels else []
    return Bisection(rows, max(1, len(able)), levels), of


def placed(held: DataFrame, tree: Bisection, of: np.ndarray, weights: np.ndarray, n: int, total: int) -> DataFrame:
    """doc_id, row, leaf, terms and what each adds to the document's score."""

    def place(batches):
        for batch in batches:
            terms, times = batch.column("terms"), batch.column("times")
            each, flat, tf = np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(each)), each)
            m = 50 + (50 * batch.column("n").to_numpy(zero_copy_only=False) * n) // total
            adds = weights[flat] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            some = of[flat] >= 0
            leaf = tree.leaves(doc[some], of[flat[some]], len(each))
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(leaf), terms, lists(adds, each)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "leaf", "terms", "adds"])

    return held.filter(F.size("terms") > 0).mapInArrow(place, "doc_id long, row long, leaf long, terms array<int>, adds array<long>")


def clustered(places: DataFrame, shard: int) -> DataFrame:
    """shard, term, bound (the largest value), at (numbers of the documents in the shard) and value; a row with term -1
    has the doc_ids in order of these numbers as its value."""
    sizes = places.groupBy("leaf").count().collect()  # 256 rows at most
    blocks = F.create_map(*[F.lit(x) for r in sizes for x in (r["leaf"], -(-r["count"] // shard))]) if sizes else F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<long>"))
    block = F.pmod(F.xxhash64("row"), F.coalesce(F.try_element_at(blocks, F.col("leaf")), F.lit(1)))

    def invert(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")]).combine_chunks()
        column = lambda name: table.column(name).chunk(0)
        each, flat, adds = np.diff(column("terms").offsets.to_numpy()), column("terms").flatten().to_numpy(), column("adds").flatten().to_numpy()
        order = np.argsort(flat, kind="stable")
        term, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        at, value = np.repeat(np.arange(len(each), dtype=np.int32), each)[order], adds[order]
        own = pa.array(np.full(len(term) + 1, table.column("shard")[0].as_py(), np.int64))
        ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), column("doc_id"))
        return pa.table({
            "shard": own, "term": pa.array(np.concatenate(([-1], term)).astype(np.int32)), "bound": pa.array(np.concatenate(([0], np.maximum.reduceat(value, first))).astype(np.int64)),
            "at": lists(at, np.concatenate(([0], count))), "value": pa.concat_arrays([ids, lists(value, count)]),
        })

    dealt = places.withColumn("shard", F.shiftleft("leaf", 32) + block).drop("leaf")
    return dealt.groupBy("shard").applyInArrow(invert, "shard long, term int, bound long, at array<int>, value array<long>")


def best(index: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each visited shard. visits: shard, item, terms."""

    def visit(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        found = {"item": [], "doc_id": [], "score": []}
        if rows.num_rows and queries.num_rows:
            term = rows.column("term").to_pylist()
            at, value = rows.column("at").chunk(0), rows.column("value").chunk(0)
            where = {t: i for i, t in enumerate(term)}
            ids = pc.fill_null(value[where[-1]].values, _LAST).to_numpy(zero_copy_only=False)
            for item, terms in zip(queries.column("item").to_pylist(), queries.column("terms").to_pylist()):
                score = np.zeros(len(ids), np.int64)
                for t in terms:
                    if (i := where.get(t)) is not None:
                        score[at[i].values.to_numpy()] += value[i].values.to_numpy()
                some = np.flatnonzero(score)
                if len(some) > k:
                    some = some[score[some] >= np.partition(score[some], -k)[-k]]
                some = some[np.lexsort((ids[some], -score[some]))[:k]]
                found["item"].append(np.full(len(some), item, np.int64))
                found["doc_id"].append(ids[some])
                found["score"].append(score[some])
        flat = {c: np.concatenate([np.zeros(0, np.int64), *x]) for c, x in found.items()}
        return pa.table({c: pa.array(x, mask=x == _LAST if c == "doc_id" else None) for c, x in flat.items()})

    some = index.join(visits.select("shard").distinct(), "shard", "left_semi")
    return some.groupBy("shard").cogroup(visits.groupBy("shard")).applyInArrow(visit, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, scratch, k: int = 50, shard: int = SHARD, most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item.

    docs: doc_id, text; items: item_id, text. The score of a document is the sum over the item's different terms of
    weight * (10^9 tf div (1000 tf + 20 m)), with weight = floor(1000 ln((2N + 2) / (2 df + 1))) and
    m = 50 + 50 n N div L, n its terms, N the documents with a term and L all terms. k: per item; ties go to the smaller doc_id.
    """
    queries = scratch.keep(query_terms(items).withColumn("item", F.monotonically_increasing_id()), "queries")
    terms = queries.select(F.explode("terms").alias("term")).distinct()
    known = terms.count()
    parts = max(1, -(-known * 2 // most_terms)) if known > most_terms else 1
    found = []
    for part in range(parts):
        some = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        found.append(_search(docs, some, scratch, k, shard))
    top = found[0]
    for more in found[1:]:
        top = top.unionAll(more)
    return top.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, queries: DataFrame, scratch, k: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    kind = "item long, rank int, doc_id long, score long"
    hashed = queries.select(F.explode("terms").alias("term")).distinct().toArrow().column("term").to_numpy()
    if not len(hashed):
        return spark.createDataFrame([], kind)
    vocabulary = np.sort(hashed.view(np.uint64))
    held = scratch.keep(held_terms(docs, vocabulary), "terms")
    n, total = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], kind)
    df = np.zeros(len(vocabulary), np.int64)
    counts = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df[counts.column("term").to_numpy()] = counts.column("count").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    tree, of = bisect(held, df, n, shard)
    places = scratch.keep(placed(held, tree, of, weights, n, total), "places")
    index = scratch.keep(clustered(places, shard), "index")

    numbers = spark.createDataFrame(pa.table({"term": pa.array(vocabulary.view(np.int64)), "number": pa.array(np.arange(len(vocabulary), dtype=np.int32))}))
    asked = queries.select("item", F.explode("terms").alias("term")).join(numbers, "term").select("item", F.col("number").alias("term"))
    wanted = scratch.keep(asked.groupBy("item").agg(F.collect_list("term").alias("terms")), "asked")
    each = wanted.select("item", F.explode("terms").alias("term"))
    bounds = index.filter("bound > 0").select("shard", "term", "bound").join(each, "term").groupBy("item", "shard").agg(F.sum("bound").alias("bound"))
    turn = F.row_number().over(W.partitionBy("item").orderBy(F.col("bound").desc(), "shard"))
    bounds = scratch.keep(bounds.withColumn("turn", turn), "bounds")

    top, done = None, 0
    last = bounds.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0]
    by = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for upto in ROUNDS:
        upto = last if upto is None else min(upto, last)
        if upto <= done and top is not None:
            break
        visits = bounds.filter((F.col("turn") > done) & (F.col("turn") <= upto))
        if top is not None:
            worst = top.filter(F.col("rank") == k).select("item", F.col("score").alias("least"))
            visits = visits.join(worst, "item", "left").filter(F.coalesce(F.col("bound") >= F.col("least"), F.lit(True)))
        more = best(index, visits.join(wanted, "item").select("shard", "item", "terms"), k)
        more = more if top is None else more.unionAll(top.select("item", "doc_id", "score"))
        top = scratch.keep(more.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score"), "top")
        done = upto
    return top
