"""Document fingerprints: the k smallest hashes of a text's shingles (a bottom-k sketch).

A shingle is five words in a row (fewer words: all of them as one; none: no shingle), joined by blanks; its
hash is the first 60 bits of its MD5. A sketch holds the k smallest different hashes in ascending order; below k
it is the whole set and every estimate from it is exact. Sketches of parts merge to the sketch of the whole: the
k smallest of their union. From sketches follow

- resemblance (Jaccard): the share of the union's k smallest that both have,
- containment of one in the other, from resemblance and the two numbers of shingles,
- the number of different shingles, (k - 1) / (the k-th hash as a fraction).

The standard error of a resemblance r is sqrt(r (1 - r) / k), at most 0.044 with k = 128. All of it is
DataFrame functions. The hash is one that other engines have too, so that sketches can be compared across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
K, SHINGLE, BITS = 128, 5, 60


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """The hash of every shingle of a text, repeats included (null or without words: an empty array)."""
    blank = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")
    return F.transform(F.array(F.split(F.trim(blank), " ", -1)), lambda w: _hashes(w, n))[0]


def _hashes(words: Column, n: int) -> Column:
    one = lambda joined: F.conv(F.substring(F.md5(joined), 1, BITS // 4), 16, 10).cast("long")
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: one(F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])))
    return F.when(F.size(words) >= n, runs).when(words[0] == "", F.array().cast("array<long>")).otherwise(F.array(one(F.array_join(words, " "))))


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text: at most k different hashes, ascending."""
    return smallest(shingle_hashes(text, n), k)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two shingle sets, 0 to 1; of two empty ones 1."""
    union = F.size(merge(a, b, k))
    both = F.size(F.array_intersect(F.array_intersect(a, b), merge(a, b, k)))
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / union)


def shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles (exact below k)."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / (F.element_at(a, -1).cast("double") + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; of an empty a 1."""
    r, na, nb = resemblance(a, b, k), shingles(a, k), shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def printed(a: Column) -> Column:
    """The sketch as text: 15 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def merged(parts: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """by and the sketch of each group's parts together.

    A group may hold any number of parts: equal hashes are one row before they are ranked, and the ranking keeps k
    rows a group and task before it shuffles. Null keys are a group; groups without a hash have an empty sketch.
    """
    hashes = parts.select(*by, F.explode_outer(column).alias("h")).distinct()
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col("h").asc_nulls_last()))
    low = hashes.withColumn("at", rank).filter(F.col("at") <= k)
    return low.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(column))


def next_in_order(ids: DataFrame, scratch) -> DataFrame:
    """none, id, th of each different key of ids (none: the id is null; id; th; n) with before_none, before_id, before_th and
    before_n: the one before it in order of none, id and th; before the first stands the last.

    The ids are dealt to tasks by range and written; a window a range, and one row a range for its ends, tell the
    predecessor, so no task sees more than its range.
    """
    key = ["none", "id", "th"]
    ranged = ids.groupBy(*key).agg(F.first("n").alias("n")).repartitionByRange(*key)
    ranged = scratch.keep(ranged.withColumn("part", F.spark_partition_id()), "order")
    row = F.struct(*key, "n")
    inside = ranged.withColumn("before", F.lag(row).over(W.partitionBy("part").orderBy(*key)))
    ends = ranged.groupBy("part").agg(F.max(row).alias("end"))  # one row a range
    every = W.orderBy("part")
    last = F.max("end").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ends = ends.select(F.col("part").alias("p"), F.coalesce(F.lag("end").over(every), last).alias("end"))
    found = inside.join(F.broadcast(ends), F.col("part") == F.col("p")).withColumn("before", F.coalesce("before", "end"))
    return found.select(*key, *(F.col(f"before.{c}").alias(f"before_{c}") for c in (*key, "n")))


def edited(text: Column, after: Column) -> Column:
    """text with its last quarter of code points (rounded down) replaced by the first as many (or all) of after."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(after, F.lit(1), quarter))


def compare_neighbours(docs: DataFrame, scratch, k: int = K) -> DataFrame:
    """Each document's sketch with that of its edited text (last quarter replaced by the next document's start) and
    with the next document's: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_next (share of its shingles that the next document has) and n_shingles.

    Texts are shuffled once, by doc_id; of the next document only the part that replaces something travels, with its
    sketch. Defined results: a null text is empty; null doc_ids come last; rows that share a doc_id follow each other
    by a hash of their texts; equal rows are one document, and each gets its result; a table of one document is
    followed by itself; texts without a word have an empty fingerprint and are alike, and unlike all others; other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Keys without nulls: plain equalities, so that one dealing of the rows serves both joins and the removal of repeats.
    key = ["none", "id", "th"]
    rows = rows.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "th": F.xxhash64("text"), "n": F.length("text")})
    order = scratch.keep(next_in_order(rows.select(*key, "n"), scratch), "before")
    texts = rows.select(*key, "text", sketch(F.col("text"), k).alias("sketch"))
    start = F.substring("text", F.lit(1), F.floor(F.col("before_n") / 4).cast("int"))
    sent = texts.join(order, key).select(*(F.col(f"before_{c}").alias(c) for c in key), start.alias("start"), F.col("sketch").alias("next"))
    pairs = texts.join(sent.dropDuplicates(key), key).withColumn("id", F.when(~F.col("none"), F.col("id")))
    changed = pairs.select("id", "text", "sketch", "next", edited(F.col("text"), F.col("start")).alias("edited"))
    three = changed.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return three.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next"), k).alias("near_next"),
        containment(F.col("sketch"), F.col("next"), k).alias("contained_next"), shingles(F.col("sketch"), k).alias("n_shingles"),
    )
