"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a seed (a run of `least` words, found by a rolling hash) are
tiled: the longest common run of words that no tile covers yet is marked in both, again and again,
until no run of `least` words is left. The part of the item that is covered tells a leak, in
whatever order its sentences stand in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hashed_words, ngram_hashes, slices, small_batches, with_fields

LEAK = "struct<item_id:bigint,coverage:double,tiles:int>"


def diagonal_runs(held: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item position, document position and seeds of each run of seeds that follow each other in both texts.

    held: for each item position the document positions (ascending, out of n) with the same seed. Both texts may repeat a seed as often as
    they like: an item position costs a few passes over n bits, and pairs of positions are never listed, only the runs they form.
    """
    m = len(held)
    begun = np.zeros(n + m + 1, np.int32)  # by diagonal: the item position where its current run began
    before, out = np.zeros(n, bool), []
    for i in range(m + 1):
        now = np.zeros(n, bool)
        if i < m:
            now[held[i]] = True
        goes_on = np.zeros(n, bool)
        goes_on[:-1] = before[:-1] & now[1:]
        ended = np.flatnonzero(before & ~goes_on)
        if len(ended):
            first = begun[ended - (i - 1) + m]
            out.append((first, ended - (i - 1) + first, i - first))
        fresh = now.copy()
        fresh[1:] &= ~before[:-1]
        at = np.flatnonzero(fresh)
        begun[at - i + m] = i
        before = now
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *x]).astype(np.int64) for x in zip(*out)) if out else (empty, empty, empty)


def _pieces(i: np.ndarray, j: np.ndarray, n: int, least: int, used_i: np.ndarray, used_j: np.ndarray):
    """The free stretches of at least `least` words of matches of n words: arrays i, j, words, a batch at a time."""
    places = lambda used, free: np.append(np.minimum.accumulate(np.where(used != free, np.arange(len(used)), len(used))[::-1])[::-1], len(used))
    to_used_i, to_used_j = places(used_i, False), places(used_j, False)
    to_free_i, to_free_j = places(used_i, True), places(used_j, True)
    at = np.zeros(len(i), np.int64)
    while len(i):
        x = at
        while True:  # the next place that is free on both sides
            y = np.maximum(to_free_i[np.minimum(i + x, len(used_i))] - i, to_free_j[np.minimum(j + x, len(used_j))] - j)
            if (y == x).all():
                break
            x = np.maximum(x, y)
            if (x >= n).all():
                break
        live = x < n
        i, j, x = i[live], j[live], x[live]
        end = np.minimum(n, np.minimum(to_used_i[i + x] - i, to_used_j[j + x] - j))
        some = end - x >= least
        yield i[some] + x[some], j[some] + x[some], (end - x)[some]
        at = end
        more = at < n
        i, j, at = i[more], j[more], at[more]


def tiled(i: np.ndarray, j: np.ndarray, n: np.ndarray, least: int, words_i: int, words_j: int) -> list[tuple[int, int, int]]:
    """(item position, document position, words) of each tile, from matches of n words at i and j.

    The longest match is taken first, ties by item position, then by document position; a match that tiles overlap is cut down to the stretches
    that are free on both sides, which wait among the shorter ones. All matches of a length are looked at together. When the item has no free
    stretch of `least` words left, nothing more can be taken.
    """
    pool: dict[int, list] = {}

    def add(i, j, n):
        order = np.argsort(n, kind="stable")
        sizes, first = np.unique(n[order], return_index=True)
        for size, part in zip(sizes.tolist(), np.split(order, first[1:])):
            pool.setdefault(size, []).append((i[part], j[part]))

    add(i, j, n)
    used_i, used_j, tiles = np.zeros(words_i, bool), np.zeros(words_j, bool), []
    while pool:
        size = max(pool)
        i, j = (np.concatenate(x) for x in zip(*pool.pop(size)))
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        while len(i):
            sum_i, sum_j = (np.concatenate(([0], np.cumsum(u))) for u in (used_i, used_j))
            free = (sum_i[i + size] == sum_i[i]) & (sum_j[j + size] == sum_j[j])
            for piece in _pieces(i[~free], j[~free], size, least, used_i, used_j):
                add(*piece)
            i, j = i[free], j[free]
            if len(i):
                tiles.append((int(i[0]), int(j[0]), size))
                used_i[i[0] : i[0] + size] = used_j[j[0] : j[0] + size] = True
                edge = np.flatnonzero(np.diff(np.concatenate(([1], used_i.astype(np.int8), [1]))))
                if not len(edge) or (edge[1::2] - edge[::2]).max() < least:
                    return sorted(tiles)
                i, j = i[1:], j[1:]
    return sorted(tiles)


def tile(seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """The tiles of two texts from the positions (item, document) of their equal runs of `least` words."""
    if not seeds:
        return []
    words_i, words_j = (max(x) + least for x in zip(*seeds))
    held: list[list[int]] = [[] for _ in range(words_i - least + 1)]
    for i, j in sorted(set(seeds)):
        held[i].append(j)
    i, j, n = diagonal_runs([np.array(x, np.int64) for x in held], words_j - least + 1)
    return tiled(i, j, n + least - 1, least, words_i, words_j)


def tiles_of(item: np.ndarray, text: np.ndarray, least: int, words_item: int, words_text: int, coverage: float) -> list[tuple[int, int, int]] | None:
    """The tiles of an item and a text, given by the hashes of their runs of `least` words; None if what they share is under coverage of the item."""
    kinds, of = np.unique(item, return_inverse=True)
    kind = np.minimum(np.searchsorted(kinds, text), len(kinds) - 1)
    at = np.flatnonzero(kinds[kind] == text) if len(text) else np.zeros(0, np.int64)
    order = at[np.argsort(kind[at], kind="stable")]
    cut = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
    shared = np.zeros(words_item + 1, np.int64)
    there = np.flatnonzero(cut[of + 1] > cut[of])
    np.add.at(shared, there, 1)
    np.add.at(shared, there + least, -1)
    if np.count_nonzero(np.cumsum(shared[:-1])) < coverage * words_item:
        return None  # tiles cover no more than seeds do
    i, j, n = diagonal_runs([order[cut[k] : cut[k + 1]] for k in of], len(text))
    return tiled(i, j, n + least - 1, least, words_item, words_text)


class Items:
    """The test items' seeds, sorted for search; at most one entry a word of the benchmark."""

    def __init__(self, ids: list, texts: list, least: int):
        words, cut = hashed_words(pa.array(texts, pa.large_string()))
        self.ids, self.words, self.least = ids, np.diff(cut), least
        grams = [ngram_hashes(words[a:b], least) if b - a >= least else np.zeros(0, np.uint64) for a, b in zip(cut[:-1], cut[1:])]
        of, at = np.repeat(np.arange(len(grams)), list(map(len, grams))), np.concatenate([np.zeros(0, int), *(np.arange(len(g)) for g in grams)])
        flat, self.grams = np.concatenate([np.zeros(0, np.uint64), *grams]), grams
        order = np.argsort(flat, kind="stable")
        self.seed, self.item, self.at = flat[order], of[order], at[order].astype(int)
        self.may = np.zeros(1 << 22, bool)
        self.may[(self.seed & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def leaks(self, texts: pa.Array, coverage: float) -> list[list[dict]]:
        """For each text the items of which tiles cover at least that share."""
        words, cut = hashed_words(texts)
        grams = ngram_hashes(words, self.least)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if not len(grams) or not len(self.seed):
            return out
        at = np.flatnonzero(self.may[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        doc = np.searchsorted(cut, at, "right") - 1
        inside = at + self.least <= cut[doc + 1]
        at, doc = at[inside], doc[inside]
        # Each different seed of a document once: how often it occurs in either text doesn't matter here.
        pair = np.unique(np.stack((doc.astype(np.uint64), grams[at])), axis=1)
        lo, hi = np.searchsorted(self.seed, pair[1], "left"), np.searchsorted(self.seed, pair[1], "right")
        n = hi - lo
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.unique(np.stack((np.repeat(pair[0].astype(np.int64), n), self.item[entry])), axis=1)
        for d, item in both.T.tolist():
            text = grams[cut[d] : max(cut[d], cut[d + 1] - self.least + 1)]
            tiles = tiles_of(self.grams[item], text, self.least, int(self.words[item]), int(cut[d + 1] - cut[d]), coverage)
            part = sum(x[2] for x in tiles) / int(self.words[item]) if tiles else 0.0
            if tiles and part >= coverage:
                out[d].append({"item_id": self.ids[item], "coverage": part, "tiles": len(tiles)})
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, least: int = 5, bound: int = 64_000_000) -> DataFrame:
    """docs with a column leaks: the test items that a document covers to at least `coverage`.

    The items go to every executor if their texts hold at most `bound` bytes, counted first; a larger
    benchmark is joined on the seeds' hashes instead, with the same result.

    Defined results: null, empty and short texts (under `least` words) have no seeds, hence no leaks,
    on either side; repeated rows each have their own; repeated items are reported once a row; ties between matches go to the
    earlier place in the item, then in the document; very long texts count as a whole, and what repeats itself in a text or an item
    costs no more than its length; an empty benchmark gives empty lists, an empty table none. A column named leaks is replaced.
    """
    docs, spark = docs.drop("leaks"), docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    if (items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) > bound:
        return _joined(docs, items, coverage, least)
    rows = items.orderBy("item_id", "text").collect()
    held = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], least))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))

    def run(batches):
        for b in batches:
            for part in slices(b):
                found = held.value.leaks(part.column("text"), coverage)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, "leaks"])

    return docs.mapInArrow(run, with_fields(docs, leaks=f"array<{LEAK}>"))


def _joined(docs: DataFrame, items: DataFrame, coverage: float, least: int) -> DataFrame:
    """The same by a join on seeds, for a benchmark of any size. Equal texts are tiled once.

    Both sides bring each different seed of a text once, an item with the number of its words that the seed can cover. Pairs whose shared
    seeds could cover enough are then tiled from their texts, each pair for itself: nothing of a pair or of a seed is gathered in a list.
    """
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    texts = keyed.select("_text", F.col("text").cast("string").alias("text")).dropDuplicates(["_text"])

    def seeds(key):
        def run(batches):
            for b in batches:
                for part in slices(b):
                    words, cut = hashed_words(part.column("text"))
                    own = part.column(key).to_numpy(zero_copy_only=False)
                    for i in range(part.num_rows):
                        g = ngram_hashes(words[cut[i] : cut[i + 1]], least) if cut[i + 1] - cut[i] >= least else np.zeros(0, np.uint64)
                        g, n = np.unique(g, return_counts=True)
                        columns = [pa.array(np.full(len(g), own[i])), pa.array(g.view(np.int64)), pa.array(n * least), pa.array(np.full(len(g), cut[i + 1] - cut[i], np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, [key, "seed", "covers", "words"])

        return run

    numbered = items.withColumn("_item", F.xxhash64("item_id", "text")).dropDuplicates(["_item"])
    a = texts.mapInArrow(seeds("_text"), "_text long, seed long, covers long, words long").select("_text", "seed")
    b = numbered.select("_item", "text").mapInArrow(seeds("_item"), "_item long, seed long, covers long, words long")
    pairs = a.join(b, "seed").groupBy("_text", "_item").agg(F.sum("covers").alias("covers"), F.first("words").alias("words"))
    pairs = pairs.filter(F.col("covers") >= coverage * F.col("words")).select("_text", "_item")
    both = pairs.join(texts, "_text").join(numbered.select("_item", F.col("text").alias("item")), "_item")

    def run(batches):
        for b in batches:
            for part in slices(b):
                (words, cut), (item, ends) = hashed_words(part.column("text")), hashed_words(part.column("item"))
                found = []
                for k in range(part.num_rows):
                    t, q = words[cut[k] : cut[k + 1]], item[ends[k] : ends[k + 1]]
                    tiles = tiles_of(ngram_hashes(q, least), ngram_hashes(t, least), least, len(q), len(t), coverage)
                    found.append((sum(x[2] for x in tiles) / len(q), len(tiles)) if tiles else (0.0, 0))
                keep = pa.array([x[0] >= coverage and x[1] > 0 for x in found], pa.bool_())
                columns = [part.column("_text"), part.column("_item"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["_text", "_item", "coverage", "tiles"]).filter(keep)

    found = both.select("_text", "_item", "text", "item").mapInArrow(run, "_text long, _item long, coverage double, tiles int")
    every = items.withColumn("_item", F.xxhash64("item_id", "text")).select("_item", "item_id")
    found = found.join(every, "_item").groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("item_id", "coverage", "tiles"))).alias("leaks"))
    empty = F.array().cast(f"array<{LEAK}>")
    return keyed.join(found, "_text", "left").select(*docs.columns, F.coalesce("leaks", empty).alias("leaks"))
