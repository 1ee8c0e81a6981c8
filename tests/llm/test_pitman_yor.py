"""The Pitman-Yor model against exact laws, a sampler that moves one customer at a time, and brute-force counts."""

import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import pitman_yor as py
from inkwell.llm import queries
from inkwell.llm.shared import crc_mod

from ..conftest import SMALL
from .test_operators import docs, local, prose, scratch  # noqa: F401

D, D0 = 0.6, 0.5


def bucket(pairs: dict) -> py.Bucket:
    """A bucket that holds all pairs (context, word) -> count; contexts and words are small integers."""
    contexts, words = (np.array(sorted({k[i] for k in pairs}), np.uint64) for i in (0, 1))
    keys = sorted(pairs)
    tokens = collections.Counter()
    for (u, _), n in pairs.items():
        tokens[u] += n
    size = [sum(1 for k in keys if k[0] == u) for u in contexts]
    row = {
        "bucket": 0, "a": py.pack_sorted(contexts), "b": py.pack(np.array(size, np.uint32)), "c": py.pack(np.searchsorted(words, np.array([k[1] for k in keys], np.uint64)).astype(np.uint32)),
        "d": py.pack(np.array([pairs[k] for k in keys], np.uint64)), "e": py.pack(np.array([tokens[u] * 2 for u in contexts], np.uint64)), "f": py.pack_sorted(words),
    }
    return py.Bucket(row)


def sampled(x: py.Bucket, vocabulary: int, rounds: int, burn: int, seed=0):
    """Means of predictive probabilities and of tables, by the operator's steps."""
    rng, tables, chance, mean = np.random.default_rng(seed), np.minimum(x.count, 1), 0, 0
    total = len(x.words)
    for turn in range(rounds):
        k = np.bincount(x.w, tables, len(x.words)).astype(np.int64)
        s = py.Parent(D0, 0, total, vocabulary).seat(k, rng)
        total = int(s.sum())
        parent = py.Parent(D0, int(k.sum()), total, vocabulary)
        every = np.bincount(x.u, tables, len(x.contexts)).astype(np.int64)
        if turn >= burn:
            chance, mean = chance + py.predictive(x, tables, k, s, every, parent, D), mean + tables
        tables = py.seat(x, tables, k, s, every, parent, D, rng)
    return chance / (rounds - burn), mean / (rounds - burn)


class Franchise:
    """The same model with every customer at a table of its own record, moved one at a time."""

    def __init__(self, pairs, vocabulary, seed=1):
        self.rng, self.vocabulary = random.Random(seed), vocabulary
        self.at = {u: collections.defaultdict(list) for u, _ in pairs}  # sizes of the tables of each dish
        self.root = collections.defaultdict(list)
        self.customers = [k for k, n in sorted(pairs.items()) for _ in range(n)]
        for u, w in self.customers:
            self.add(u, w)

    def base(self, w):
        k, s = sum(map(sum, self.root.values())), sum(map(len, self.root.values()))
        return (sum(self.root[w]) - D0 * len(self.root[w]) + (py.ROOT_THETA + D0 * s) / (self.vocabulary + 1)) / (py.ROOT_THETA + k)

    def join(self, tables, d, new):
        weights = [n - d for n in tables] + [new]
        i = self.rng.choices(range(len(weights)), weights)[0]
        if i == len(tables):
            tables.append(0)
        tables[i] += 1
        return tables[i] == 1

    def leave(self, tables):
        i = self.rng.choices(range(len(tables)), tables)[0]
        tables[i] -= 1
        if not tables[i]:
            tables.pop(i)
            return True

    def add(self, u, w):
        if self.join(self.at[u][w], D, (py.THETA + D * sum(map(len, self.at[u].values()))) * self.base(w)):
            self.join(self.root[w], D0, (py.ROOT_THETA + D0 * sum(map(len, self.root.values()))) / (self.vocabulary + 1))

    def sweep(self):
        for u, w in self.customers:
            if self.leave(self.at[u][w]):
                self.leave(self.root[w])
            self.add(u, w)

    def chance(self, u, w):
        here = self.at[u][w]
        return (sum(here) - D * len(here) + (py.THETA + D * sum(map(len, self.at[u].values()))) * self.base(w)) / (py.THETA + sum(map(sum, self.at[u].values())))


PAIRS = {(0, 1): 9, (0, 2): 3, (0, 3): 1, (1, 1): 2, (1, 2): 70, (2, 3): 4, (2, 4): 1, (3, 1): 1, (3, 4): 5, (4, 5): 2, (4, 1): 2}


def test_seatings_agree_with_customers_moved_one_at_a_time():
    one = Franchise(PAIRS, 5)
    chance = collections.Counter()
    for turn in range(1500):
        one.sweep()
        if turn >= 100:
            for u, w in PAIRS:
                chance[u, w] += one.chance(u, w) / 1400
            if not turn % 100:
                every = sum(one.chance(0, w) for w in range(1, 7))  # 6 is the unknown word
                assert abs(every - 1) < 1e-9
    got, _ = sampled(bucket(PAIRS), 5, 1500, 100)
    want = np.array([chance[k] for k in sorted(PAIRS)])
    assert np.abs(np.log(got / want)).max() < 0.06


def test_continuations_sum_to_one():
    """Over the vocabulary and one unknown word, of contexts seen and unseen."""
    full = {(u, w): PAIRS.get((u, w), 0) for u in range(7) for w in range(1, 7)}
    got, _ = sampled(bucket(full), 5, 6, 2)
    assert np.allclose(got.reshape(7, 6).sum(1), 1) and (got > 0).all()


def law(c, d, new):
    """P(t) of c customers by the recursion over customers."""
    log, t = np.full(c + 2, -np.inf), np.arange(c + 2)
    log[1] = 0.0
    for n in range(1, c):
        with np.errstate(divide="ignore"):
            log = np.logaddexp(np.concatenate(([-np.inf], log[:-1])), np.where(t <= n, np.log(np.maximum(n - d * t, 0)), -np.inf) + log)
    p = np.exp(log + t * np.log(new) - (log + t * np.log(new)).max())
    return p / p.sum()


def test_large_dishes_follow_the_law():
    for c, new, d in ((6000, 60.0, 0.74), (65, 3.0, 0.5)):
        p = law(c, d, new)
        mean = p @ np.arange(len(p))
        got = py.draw_large(np.full(2000, c), np.full(2000, new), d, np.random.default_rng(0))
        assert abs(got.mean() - mean) < 0.6 and abs(got.std() - (p @ (np.arange(len(p)) - mean) ** 2) ** 0.5) < 0.6
    assert (abs(py.draw_large(np.array([11_830, 1_000_000]), np.array([696.0, 696.0]), 0.74, np.random.default_rng(0)) - 941) < 200).all()


def test_table_of_small_dishes():
    p = law(30, 0.7, 2.0)
    row = py.log_stirling(40, 0.7)[30, :32] + np.arange(32) * np.log(2.0)
    assert np.allclose(np.exp(row - row.max()) / np.exp(row - row.max()).sum(), p[:32])


def test_counts_and_base(spark, docs, scratch):  # noqa: F811
    got = py.score(docs, crc_mod(F.col("doc_id"), 7) == 2, scratch).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").lower().split() + [None]
    count = collections.Counter(w for i, t in local(docs) if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = collections.Counter((i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in local(docs))
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert py.score(docs.limit(0), F.lit(False), scratch).count() == 0


def test_any_layout_gives_the_model(spark, scratch, monkeypatch):  # noqa: F811
    """Many blocks and buckets, hot contexts spread: scores agree with one block's and with the sampler above."""
    texts = [(i, " ".join(random.Random(i).choice(["a b", "b c a", "d", "a a c"]) for _ in range(6))) for i in range(24)]
    df = spark.createDataFrame([*texts, (100, ""), (101, "a b"), (102, "z a")], "doc_id long, text string").withColumn("block", F.lit("clash"))
    run = lambda: {r["doc_id"]: r["score"] for r in py.score(df, F.col("doc_id") >= 100, scratch, rounds=8, samples=5).collect()}
    whole = run()
    for name, value in (("BLOCK_BYTES", 60), ("WORDS_IN_BUCKET", 4), ("PAIRS_IN_BUCKET", 20), ("HOT", 15)):
        monkeypatch.setattr(py, name, value)
    parts = run()
    assert whole.keys() == parts.keys() and all(abs(whole[i] - parts[i]) < 0.15 + 0.02 * abs(whole[i]) for i in whole)
    pairs = collections.Counter()
    for _, t in texts:
        words = ["<", *t.split(), ">"]
        pairs.update(zip(words, words[1:]))
    names = {w: i for i, w in enumerate(sorted({w for k in pairs for w in k} | {"z"}))}
    counts = {(names[u], names[w]): n for (u, w), n in pairs.items()}
    d = py.discount(sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values()))
    follows = collections.Counter(w for _, w in counts)
    d0 = py.discount(sum(n == 1 for n in follows.values()), sum(n == 2 for n in follows.values()))
    monkeypatch.setitem(globals(), "D", d), monkeypatch.setitem(globals(), "D0", d0)
    one = Franchise(counts, 5)
    chance = collections.Counter()
    wanted = {100: [("<", ">")], 101: [("<", "a"), ("a", "b"), ("b", ">")]}
    for turn in range(150):
        one.sweep()
        for e in {e for v in wanted.values() for e in v}:
            chance[e] += (one.chance(names[e[0]], names[e[1]]) / 100) * (turn >= 50)
    for i, events in wanted.items():
        assert abs(whole[i] - sum(math.log10(chance[e]) for e in events)) < 0.15


def test_beats_the_base(spark):
    got = queries.op5_pitman_yor(spark, SMALL).toPandas()
    h = got[got.held_out]
    assert h.score.sum() > h.base_score.sum()
