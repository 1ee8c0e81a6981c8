"""The filter audit, bottom-k fingerprints and ranked search against brute force, with every odd case."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import bottomk, filter_audit, lexical, queries
from inkwell.llm.shared import Scratch

from ..conftest import SMALL, same
from .test_operators import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def odd_rows():
    """(doc_id, text, source): nulls, empty and very long texts, copies, equal rows, one id with two texts."""
    long = prose(40_000, 5)
    data = [(i, prose(60 + 40 * (i % 8), i) + (" #" if i % 5 == 0 else "") + " LOUD" * (i % 4 * 9), "ab"[i % 3 == 0]) for i in range(40)]
    data += [(50 + i, data[i][1], "a") for i in range(6)] + [(60, None, None), (61, "", "a"), (62, " \t\n", ""), (63, long, "b"), (64, long + " x", None)]
    data += [(None, data[0][1], "a"), (None, "fresh text", "b"), (65, "one", "a"), (65, "one", "a"), (66, "one", "b"), (66, "two", "b"), (67, "é ü 中文 😀😀 A", "b")]
    return data


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_bottomk", "op13_lexical"])
def test_equals_sql(spark, duck, name):
    same(queries.queries()[name](spark, SMALL), duck, queries.oracle_sql()[name])


def brute_audit(data, labels):
    first = {}
    for i, t, _ in data:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for i, t, source in data:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        rows.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = defaultdict(lambda: [0] * 6)
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, fails, g, x in rows:
            gone = False
            for step, letter in enumerate(order, 1):
                here = not gone and letter in fails
                for k, add in enumerate([not gone and not here, here, gone and letter in fails, fails == {letter}, here and g, here and x]):
                    out[part, order, step][k] += add
                gone |= here
    shapley = Counter()
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] += x[1]
    return {(*k, *x, shapley[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def test_filter_audit(spark, scratch):
    data = odd_rows()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 70, 3)] + [(3, 1, None), (None, 1, 1), (6, None, 1)]
    docs = spark.createDataFrame([(*x, "y", 1) for x in data], "doc_id long, text string, source string, part string, fails int")
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), scratch).drop("filter")
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) == 3 * 600 and set(got) == brute_audit(data, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"), scratch).count() == 0
    with pytest.raises(ValueError):
        filter_audit.replay(docs, "ABCDEFG")


def hashes(text, n=5):
    w = WORD.findall(text or "")
    runs = [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w] if w else []
    return {int(hashlib.md5(" ".join(r).encode()).hexdigest()[:15], 16) for r in runs}


def like(a, b, k):
    union = sorted(set(a) | set(b))[:k]
    return len(set(a) & set(b) & set(union)) / len(union) if union else 1.0


def test_fingerprints(spark, scratch):
    k = 16
    data = [(i, t) for i, t, _ in odd_rows()]
    got = bottomk.compare_neighbours(spark.createDataFrame([(*x, "y") for x in data], "doc_id long, text string, sketch string"), scratch, k).collect()
    low = lambda t: sorted(hashes(t))[:k]
    printed = lambda h: "".join(f"{x:015x}" for x in h)
    distinct = list({(i, t or ""): 0 for i, t in data})
    wanted, repeats = Counter(), Counter((i, t or "") for i, t in data)
    shared = {i for i, n in Counter(i for i, _ in distinct).items() if n > 1}  # the order of one id's texts follows a hash
    order = sorted(distinct, key=lambda x: (x[0] is None, x[0] or 0))
    for (i, t), (j, after) in zip(order, order[1:] + order[:1]):
        if i not in shared and j not in shared:
            q = len(t) // 4
            changed = t[: len(t) - q] + after[:q]
            row = (i, len(t), hashlib.sha256(changed.encode()).hexdigest(), printed(low(t)), printed(low(changed)), like(low(t), low(changed), k), like(low(t), low(after), k))
            wanted[row] += repeats[i, t]
    rows = Counter(tuple(r)[:7] for r in got)
    assert len(got) == len(data) and not wanted - rows
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and 0 <= r["contained_next"] <= 1 for r in got)
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {""}
    assert bottomk.compare_neighbours(spark.createDataFrame([], "doc_id long, text string"), scratch).count() == 0
    one = bottomk.compare_neighbours(spark.createDataFrame([(1, prose(50, 1))], "doc_id long, text string"), scratch).first()
    assert one["near_next"] == one["contained_next"] == 1 and one["n_shingles"] == len(hashes(prose(50, 1)))


def test_sketches_merge_and_estimate(spark):
    parts = [(g, p, prose(300, 10 * g + p % 7)) for g in range(3) for p in range(9)] + [(None, 0, prose(20, 1)), (7, 0, None), (7, 1, " ")]
    df = spark.createDataFrame(parts, "g int, p int, text string").withColumn("sketch", bottomk.sketch(F.col("text"), 64))
    got = {r["g"]: r["sketch"] for r in bottomk.merged(df, ["g"], k=64).collect()}
    assert got == {g: sorted(set().union(*(hashes(t) for h, _, t in parts if h == g)))[:64] for g in (0, 1, 2, None, 7)}
    a, b = prose(3000, 1), prose(3000, 1)[: len(prose(3000, 1)) // 2]
    both = spark.createDataFrame([(a, b)], "a string, b string").select(bottomk.sketch(F.col("a")).alias("a"), bottomk.sketch(F.col("b")).alias("b"))
    r, c, n, m = both.select(bottomk.resemblance(F.col("a"), F.col("b")), bottomk.containment(F.col("b"), F.col("a")), bottomk.shingles(F.col("a")), bottomk.merge(F.col("a"), F.col("b"))).first()
    assert abs(r - like(hashes(a), hashes(b), 10**9)) < 0.15 and c > 0.75 and abs(n / len(hashes(a)) - 1) < 0.3 and m == sorted(hashes(a) | hashes(b))[:128]


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for i, c, size in held:
            m = 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score:
                scored.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank, i, -score] += 1
    return out


def test_search_visits_shards_and_stays_exact(spark, scratch, monkeypatch):
    rng = random.Random(4)
    topics = [[f"t{g}w{j}" for j in range(30)] for g in range(10)]
    docs = [(i, " ".join(rng.choice(topics[i % 10] if rng.random() < 0.7 else rng.choice(topics)) for _ in range(rng.randint(5, 60)))) for i in range(1200)]
    docs += [(i, t) for i, t, _ in odd_rows()] + [(2000 + i, docs[7][1].upper()) for i in range(90)] + [(None, docs[8][1])] * 3
    items = [(g, " ".join(rng.sample(topics[g % 10], 6)) + ", The.the") for g in range(12)] + [(3, docs[7][1]), (3, docs[7][1]), (20, None), (21, ""), (22, "no such thing"), (None, "t1w1 ü"), (23, prose(30, 3))]
    visited, real = [], lexical.best

    def counted(index, visits, k):
        visited.append((visits.count(), index.select("shard").distinct().count()))
        return real(index, visits, k)

    monkeypatch.setattr(lexical, "best", counted)
    monkeypatch.setattr(lexical, "ROUNDS", (2, 6, None))
    columns = "doc_id long, text string, score string"
    found = lexical.search(spark.createDataFrame([(*x, "y") for x in docs], columns), spark.createDataFrame(items, "item_id long, text string"), scratch, k=10, shard=40)
    assert Counter(tuple(r) for r in found.collect()) == brute_search(docs, items, 10)
    assert visited[0][1] > 25 and sum(n for n, _ in visited) < 14 * visited[0][1]  # shards that can't matter are left out
    blocks = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), scratch, k=10, shard=300, most_terms=20)
    assert Counter(tuple(r) for r in blocks.collect()) == brute_search(docs, items, 10)
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(empty, some, scratch).count() == lexical.search(some.toDF("doc_id", "text"), some.limit(0), scratch).count() == 0


def test_bisection_gathers_topics():
    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat(np.arange(4), 100))
    sample = [np.unique(rng.integers(0, 25, 12) + 25 * g) for g in topic]
    tree = lexical.Bisection(sample, 100, 2)
    leaf = tree.leaves(np.repeat(np.arange(400), [len(x) for x in sample]), np.concatenate(sample), 400)
    assert sum(Counter(topic[leaf == k].tolist()).most_common(1)[0][1] for k in range(4)) > 360 and np.bincount(leaf).max() < 160
