"""Novelty: the most similar reference of every entry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.let import let
from ..functions.similarity import token_sets
from ..tables import kept

KINDS = ("words", "bigrams")


def _hashed(text: Column) -> Column:
    """struct(words, bigrams): the features of a text as hashes."""
    return let(token_sets(F.coalesce(text, F.lit(""))), lambda sets: F.struct(*(F.transform(sets[k], lambda w: F.xxhash64(w)).alias(k) for k in KINDS)))


def novelty(entries: DataFrame, references: DataFrame, bound: int = 8_000_000) -> DataFrame:
    """entry_id, ref_id, score of the reference with the largest score: the larger Jaccard similarity of words and
    of bigrams; ties go to the smaller ref_id. Entries without a common word have score 0 and no reference.

    entries (entry_id, text), references (ref_id, text). While the references' texts are under `bound` bytes (measured first) their
    inverted index goes to every executor, and an entry's best reference is found where the entry lies: nothing is shuffled. More
    references are joined on features, the rarest first (see _joined).
    """
    size = references.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return _indexed(entries, references) if size <= bound else _joined(entries, references)


def _index(rows: list) -> tuple[np.ndarray, list]:
    """The references' ids in order, and for each kind of feature the sorted features, their references, and the sizes."""
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    for k in range(len(KINDS)):
        flat = np.concatenate([np.zeros(0, np.int64), *(np.array(r[1 + k], np.int64) for r in rows)])
        of = np.repeat(np.arange(len(rows)), [len(r[1 + k]) for r in rows])
        order = np.argsort(flat, kind="stable")
        out.append((flat[order], of[order], np.array([len(r[1 + k]) for r in rows])))
    return np.array([r[0] for r in rows]), out


def _scores(lists: pa.Array, index, references: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, reference and Jaccard similarity of every pair that shares a feature."""
    features, of, size = index
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    own = np.diff(lists.offsets.to_numpy())
    entry = np.repeat(np.arange(len(own)), own)
    low, high = np.searchsorted(features, flat, "left"), np.searchsorted(features, flat, "right")
    hits = high - low
    at = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
    pair, common = np.unique(np.repeat(entry, hits) * references + of[at], return_counts=True)
    e, r = pair // max(1, references), pair % max(1, references)
    return e, r, common / (own[e] + size[r] - common)


def _indexed(entries: DataFrame, references: DataFrame) -> DataFrame:
    spark = entries.sparkSession
    rows = [(r["ref_id"], r["s"]["words"], r["s"]["bigrams"]) for r in references.filter("ref_id is not null").select("ref_id", _hashed(F.col("text")).alias("s")).collect()]
    held = spark.sparkContext.broadcast(_index(rows))

    def run(batches):
        ids, index = held.value
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                sets = part.column("s")
                got = [_scores(pa.concat_arrays([sets.field(k)]), index[i], len(ids)) for i, k in enumerate(KINDS)]
                e, r, s = (np.concatenate(x) for x in zip(*got))
                order = np.lexsort((r, -s, e))
                first = order[np.flatnonzero(np.concatenate(([True], e[order][1:] != e[order][:-1])))] if len(e) else order
                best, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                best[e[first]], score[e[first]] = r[first], s[first]
                named = ids[np.maximum(best, 0)] if len(ids) else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("entry_id"), pa.array(named, pa.int64(), mask=best < 0), pa.array(score)], ["entry_id", "ref_id", "score"])

    kind = entries.schema["entry_id"].dataType.simpleString()
    return entries.select("entry_id", _hashed(F.col("text")).alias("s")).mapInArrow(run, f"entry_id {kind}, ref_id bigint, score double")


def _sets(df: DataFrame, *ids: str) -> DataFrame:
    """ids, kind (0 word, 1 bigram), size and f, the features: a row for each of a text's two sets that isn't empty."""
    sets = df.select(*ids, _hashed(F.col("text")).alias("s"))
    both = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(f"s.{k}").alias("f")) for i, k in enumerate(KINDS)))
    return sets.select(*ids, F.explode(both).alias("k")).select(*ids, "k.kind", F.size("k.f").alias("size"), "k.f").filter("size > 0")


def _joined(entries: DataFrame, references: DataFrame, first: int = 4) -> DataFrame:
    """The best reference by joins, the rarest features first.

    Features are ordered by how many references have them, and only those that some reference has are kept of an entry: the others are in
    no intersection. References that share one of an entry's `first` rarest features are compared; the best score found, s, bounds the rest. A reference
    of m features reaches s with an entry of n only if they have c = s * (n + m) / (1 + s) features or more in common, and the rarest of
    those is among the first m - c + 1 of the reference's and, as c is s * n or more, among the entry's but for the last s * n. So
    one more look at the features finds every reference that is as good, and what nearly every reference has comes last on both sides. Candidates are
    compared by all of their features; an entry's go through one exchange before the looks and one for each of the two.
    """
    entries = entries.withColumn("_e", F.xxhash64("entry_id", "text"))
    right = kept(_sets(references.filter("ref_id is not null").withColumn("_r", F.monotonically_increasing_id()), "_r", "ref_id"), "reference-sets")
    each = right.select("_r", "kind", F.col("size").alias("ref_size"), F.explode("f").alias("feature"))
    often = kept(each.groupBy("kind", "feature").agg(F.count("*").alias("n")), "often")
    order = W.partitionBy("_r", "kind").orderBy("n", "feature")
    postings = kept(each.join(often, ["kind", "feature"]).withColumn("place", F.row_number().over(order)).drop("n"), "postings")
    known = _sets(entries, "_e").select("_e", "kind", "size", F.explode("f").alias("feature")).join(often, ["kind", "feature"])
    ranked = known.groupBy("_e", "kind").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "feature"))).alias("by"))
    open_ = kept(ranked.select("_e", "kind", "size", F.array_distinct("by.feature").alias("by")), "rarest-first")

    def scored(pairs: DataFrame) -> DataFrame:
        whole = pairs.join(open_, ["_e", "kind"]).join(right.select("_r", "ref_id", "kind", F.col("size").alias("ref_size"), "f"), ["_r", "kind"])
        common = F.size(F.array_intersect("by", "f"))
        return whole.groupBy("_e").agg(F.max(F.struct((common / (F.col("size") + F.col("ref_size") - common)).alias("score"), (-F.col("ref_id")).alias("o"))).alias("m"))

    best = kept(scored(candidates(open_.withColumns({"found": F.lit(0.0), "need": F.size("by")}), postings, 0, first)), "best")
    left = F.floor(F.size("by") - F.col("found") * F.col("size") + 1e-9) + 1
    more = open_.filter(F.size("by") > first).join(best.select("_e", F.col("m.score").alias("found")), "_e")
    more = more.withColumn("need", F.least(F.size("by"), left).cast("int")).filter(F.col("need") > first)
    top = best.unionAll(scored(candidates(more, postings, first, (1 << 31) - 1))).groupBy("_e").agg(F.max("m").alias("m"))
    top = top.select("_e", (-F.col("m.o")).alias("ref_id"), F.col("m.score").alias("score"))
    return entries.select("entry_id", "_e").join(top, "_e", "left").select("entry_id", "ref_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def candidates(open_: DataFrame, postings: DataFrame, at: int, step: int) -> DataFrame:
    """Pairs (_e, kind, _r), each once, that share one of the entry's features at + 1 .. at + step, or as many as it needs, where the
    reference can still have enough in common for the score found."""
    some = open_.select("_e", "kind", "size", "found", F.explode(F.slice("by", F.lit(at + 1), F.least(F.lit(step), F.col("need") - at))).alias("feature"))
    common = F.ceil(F.col("found") * (F.col("size") + F.col("ref_size")) / (1 + F.col("found")) - 1e-9)
    return some.join(postings, ["kind", "feature"]).filter(F.col("place") <= F.col("ref_size") - common + 1).select("_e", "kind", "_r").distinct()
