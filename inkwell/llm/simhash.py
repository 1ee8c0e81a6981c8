"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: a bit is set if it is set in over half of the text's shingle hashes. Links: covering
codes after Pagh (2016). For radius r every bit position i gets a nonzero vector m(i) of r + 1 bits;
table v (each nonzero v of r + 1 bits) keeps the positions with <m(i), v> = 1. The at most r positions
in which a pair differs span at most r dimensions, so some v is orthogonal to all of them, and in
that table the pair shares its key: 2^(r+1) - 1 tables miss no pair within the radius.

Equal fingerprints are one node, so copies cost nothing here. A table's bucket of over `block` nodes
is dealt out again by a further covering code on top of its own mask (again no pair is missed), until
the buckets are small: nodes are distinct, hence a bucket with b free bits holds 2^b at most, and
every level leaves under half of the bits free. A small bucket is compared bit by bit and gives a
spanning forest of its links, never all of its pairs.

A radius of 3 finds copies with hardly a word changed: of pairs with a shingle similarity of 0.8, few
are that close. `similar_groups` therefore adds, for a stated similarity, candidates from bands of
min-wise hashes, and links a candidate pair only if its sets of shingles have that Jaccard similarity.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components
from .shared import Scratch, mix

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; zero for no words."""
    return majority(shingle_hashes(text, words))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none without hashes."""
    if len(h) < 512:
        ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        parts = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(parts[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of docs."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, level: int) -> list[int]:
    """The masks of a covering code over 64 bits, as signed longs; each level numbers the positions in another order."""
    order = np.random.default_rng(7 + level).permutation(64)
    size = (1 << (radius + 1)) - 1
    m = [1 + int(p) % size for p in order]
    kept = ([i for i in range(64) if (m[i] & v).bit_count() % 2] for v in range(1, size + 1))
    return [x - (1 << 64) if (x := sum(1 << i for i in bits)) >> 63 else x for bits in kept]


def _forest(radius: int):
    """Links of a spanning forest of each bucket's graph of close fingerprints."""

    def run(batches):
        for b in batches:
            out = []
            for members in b.column("members"):
                x = np.unique(np.array(members.values.to_numpy(zero_copy_only=False), np.int64)).view(np.uint64)
                left = np.arange(len(x))
                while len(left) > 1:
                    front, left = [left[0]], left[1:]
                    while front and len(left):
                        i = front.pop()
                        near = np.bitwise_count(x[left] ^ x[i]) <= radius
                        if near.any():
                            hit, left = left[near], left[~near]
                            front.extend(hit.tolist())
                            out.append(np.stack((np.full(len(hit), x[i]), x[hit])))
            a, c = np.concatenate(out, 1).view(np.int64) if out else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return run


def links(nodes: DataFrame, scratch: Scratch, radius: int = 3, block: int = 1024) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) within the radius, connecting what all such links connect."""
    found, rest, level = None, nodes.select("fp", F.lit(0).cast("long").alias("mask")), 0
    while True:
        tables = F.array(*(F.lit(m).cast("long") for m in masks(radius, level)))
        dealt = rest.select("fp", F.explode(tables).alias("m"), "mask").select("fp", F.col("m").bitwiseOR(F.col("mask")).alias("mask"))
        dealt = dealt.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        dealt = scratch.keep(dealt.join(sizes, ["mask", "key"]), "dealt")
        small = dealt.filter(F.col("n") <= block).groupBy("mask", "key").agg(F.collect_list("fp").alias("members"))
        part = small.select("members").mapInArrow(_forest(radius), "a long, b long")
        found = part if found is None else found.union(part)
        rest, level = dealt.filter(F.col("n") > block).select("fp", "mask").distinct(), level + 1
        if rest.isEmpty():
            return found


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, scratch: Scratch | None = None, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable over links, itself included) of every row.

    Defined results: null and word-free texts have fingerprint zero and link like any other; repeated
    rows, ties and equal texts share a component; a null doc_id keeps its row, and its component is
    the smallest non-null doc_id of the component (null if there is none); an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "simhash")
    fps = scratch.keep(fingerprints(docs, words), "fingerprints") if rows is None else rows
    nodes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    of = components(links(nodes, scratch, radius), scratch)
    named = nodes.join(of, nodes.fp == of.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = scratch.keep(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


BANDS, ROWS = 16, 5
GROUP, SHINGLES = 4096, 500_000  # nodes and shingles of a block of a band's group
_ODD = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(w) - words + 1))


def sketch(h: np.ndarray) -> tuple[int, np.ndarray]:
    """The 64-bit SimHash and the keys of the min-wise bands of shingle hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        least = np.minimum(least, (mix(h[i : i + 1024, None] * _ODD)).min(0))
    bands = mix((least.reshape(BANDS, ROWS) * _ODD[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return majority(h), bands


def _sketches(words: int, radius: int):
    codes = np.array(masks(radius, 0), np.int64)

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t, words)
                one = np.unique(h)
                fp, bands = sketch(h)
                close = mix((np.int64(fp - (fp >> 63 << 64)) & codes).view(np.uint64) ^ mix(codes.view(np.uint64)))
                out.append((xxh64_intdigest(one.tobytes(), SEED), len(one), np.concatenate((bands, close)).view(np.int64)))
            node = pa.array(np.array([x[0] for x in out], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), node, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["doc_id", "th", "node", "size", "keys"])

    return run


def _similar_forest(words: int, similarity: float):
    """Links of a spanning forest of the nodes whose sets of shingles are similar; of two blocks, if there are two."""

    def run(batches):
        for b in batches:
            out = [np.zeros((2, 0), np.int64)]
            for members in b.column("members"):
                ids = members.values.field("node").to_numpy()
                sets = [np.unique(shingle_hashes(t, words)) for t in members.values.field("text").to_pylist()]
                size = np.array([len(x) for x in sets])
                known, flat = np.unique(np.concatenate(sets), return_inverse=True)
                start = np.cumsum(size) - size
                has = np.zeros(len(known), bool)
                left = np.flatnonzero(size)
                for i in np.flatnonzero(size == 0)[1:]:
                    out.append(np.array([[ids[np.flatnonzero(size == 0)[0]]], [ids[i]]]))
                front = []
                while len(left):
                    if not front:
                        front, left = [left[0]], left[1:]
                        flat_left = np.concatenate([flat[start[x] : start[x] + size[x]] for x in left]) if len(left) else flat[:0]
                        continue
                    i = front.pop()
                    own = flat[start[i] : start[i] + size[i]]
                    has[own] = True
                    common = np.add.reduceat(has[flat_left], np.cumsum(size[left]) - size[left], dtype=np.int64)
                    has[own] = False
                    near = common >= similarity * (size[i] + size[left] - common)
                    if near.any():
                        flat_left = flat_left[np.repeat(~near, size[left])]
                        hit, left = left[near], left[~near]
                        front.extend(hit.tolist())
                        out.append(np.stack((np.full(len(hit), ids[i]), ids[hit])))
            a, c = np.concatenate(out, 1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return run


def similar_groups(docs: DataFrame, scratch: Scratch, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """doc_id, th (xxhash64 of the text) and first (doc_id and th of the group's first row) of every row of docs.

    Rows are linked if their texts' sets of shingles have that Jaccard similarity or more. Candidates
    share a band of min-wise hashes (16 x 5 of them miss one pair in 500 at 0.8) or have SimHashes
    within the radius (a covering code's key each); every candidate is decided by its sets. Texts of
    equal sets are one node, groups of equal members are compared once. A group of over GROUP nodes
    or SHINGLES shingles is compared block by block, each pair of blocks in its own task. Null and
    word-free texts have one, empty set and are linked; see near_duplicates for other cases.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    rows = scratch.keep(texts.mapInArrow(_sketches(words, radius), "doc_id long, th long, node long, size long, keys array<long>"), "sketches")
    nodes = scratch.keep(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys")), "nodes")
    dealt = nodes.select("node", "size", F.explode("keys").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.hash("node", F.lit(2))).alias("y")).filter("n > 1")
    sizes = sizes.groupBy("n", "shingles", "x", "y").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("shingles") / SHINGLES)).cast("int")
    dealt = dealt.join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select("node", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    dealt = scratch.keep(dealt, "dealt")
    asked = nodes.join(dealt.select("node").distinct(), "node").select("node", "least.doc_id", "least.th")
    bodies = asked.join(texts.withColumnsRenamed({"doc_id": "id", "th": "of"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("of")))
    bodies = bodies.groupBy("node").agg(F.first("text").alias("text"))
    groups = dealt.join(bodies, "node").groupBy("key", "x", "y").agg(F.collect_list(F.struct("node", "text")).alias("members"))
    linked = groups.select("members").mapInArrow(_similar_forest(words, similarity), "a long, b long")
    of = components(linked, scratch)
    named = nodes.join(of, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = scratch.keep(named, "named")
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    ids = named.join(first, "component").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"))
    return rows.join(ids, "node").select("doc_id", "th", "first_id", "first_th")
