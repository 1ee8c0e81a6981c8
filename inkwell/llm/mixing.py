"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 48-bit hash of its id. Tokens are summed by source and by the hash's leading
twelve bits; a running sum over that histogram (at most 4,096 rows a source, whatever the input)
shows in which bucket a source's budget is reached. Only that boundary bucket is summed again by the
next twelve bits, and so on, until the threshold lies between two hash values. A document is taken
once for each whole pass its source's target covers, and once more if its hash is under the
threshold: budgets are nested, since the smaller of two budgets keeps a subset of the larger one's
documents. No sort, no Python, no collection.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows of
one doc_id have keys of their own if their texts differ; of equal rows in the boundary as many are taken as
come nearest to the budget; an empty table gives an empty mix. Other columns of the input pass through,
and only those with the name of a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD

BITS, LEVELS = 12, 4


def n_words(text: Column) -> Column:
    """Words of a text: maximal runs without ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: the shares of a budget of share x all words by repeated weights,
    none above most x its source's words, the excess reshared by weight.

    The reshared level L solves sum(min(cap, weight * L)) = budget. With sources in order of
    cap / weight, L comes from the first source that is not capped; one row a source is compared.
    """
    by = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((n - 1) % len(weights) + 1).cast("int")).cast("double")
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    by = by.withColumn("capped_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = (F.col("budget") - F.col("capped_before")) / F.col("weight_left")
    by = by.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    by = by.withColumn("found", F.first(free, ignorenulls=True).over(every))
    return by.select("source", "source_size", F.coalesce(F.least("cap", F.col("found") * F.col("weight")), "cap").alias("target"))


def thresholds(docs: DataFrame, wanted: DataFrame, key: Column, levels: int) -> DataFrame:
    """The boundary of each source by nested histograms of the key (of BITS * levels bits): source, prefix (its key),
    under (words of smaller keys), words and rows (of the key itself) and extra, the budget that wanted has for the source."""
    edge = wanted.select("source", "extra", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("under"))
    for level in range(1, levels + 1):
        at = edge.select(F.col("source").alias("s"), "extra", "prefix", "under")
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", BITS) == F.col("prefix"))
        bucket = F.shiftright(key, BITS * (levels - level)).alias("bucket")
        histogram = docs.select("source", bucket, "size").join(at, inside).groupBy("source", "bucket").agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("extra").alias("extra"), F.first("under").alias("under")
        )
        run = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        histogram = histogram.withColumn("under", F.col("under") + F.coalesce(run, F.lit(0)))
        # The boundary bucket: the last one that starts within the budget.
        last = F.max(F.struct("bucket", "extra", "under", "words", "rows")).alias("b")
        edge = histogram.filter("under <= extra").groupBy("source").agg(last).select(
            "source", "b.extra", F.col("b.bucket").alias("prefix"), "b.under", "b.words", "b.rows"
        )
    return edge


def mix(docs: DataFrame, scratch, size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs without text, plus size, source_size, target and taken (words that the mix takes, repeats counted).

    scratch: a Scratch in which sizes and keys are written once, so that each histogram reads two
    narrow columns instead of the texts.
    """
    rest = [c for c in docs.columns if c.lower() not in ("text", "size", "source_size", "target", "taken")]
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    key = F.conv(F.substring(F.md5(whole), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    kept = F.struct(*rest) if rest else F.lit(0)
    # The number of a row tells equal rows apart; written, it stays what it is.
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << BITS * LEVELS))
    sized = docs.select(kept.alias("kept"), F.col("source").alias("source"), (n_words(F.col("text")) if size is None else size).alias("size"), key.alias("key"), row.alias("row"))
    sized = scratch.keep(sized, "sized")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    wanted = scratch.keep(targets(sized, weights, share, most).withColumn("passes", passes).withColumn("extra", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    # A single key is left in the boundary. Of its n equal rows j are taken: as many as come nearest to the budget.
    edge = thresholds(sized, wanted, F.col("key"), LEVELS)
    j = F.when(F.col("words") > 0, F.least("rows", F.floor((F.col("extra") - F.col("under")) / (F.col("words") / F.col("rows")) + 0.5))).otherwise(F.col("rows"))
    edge = scratch.keep(edge.withColumn("j", j), "edge")
    plan = wanted.join(edge.select(F.col("source").alias("s"), "prefix", F.col("rows").alias("n"), "j"), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", "passes", "prefix", "n", "j")
    some = edge.filter("j > 0 and j < rows").select("source", F.col("j").cast("double").alias("extra"), "prefix")
    last = F.lit(None).cast("long")
    if not some.isEmpty():
        same = sized.join(some.select(F.col("source").alias("s"), F.col("prefix").alias("p")), F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("p")))
        ends = thresholds(same.select("source", "row", F.lit(1).cast("long").alias("size")), some, F.col("row"), LEVELS)
        plan = plan.join(ends.select(F.col("source").alias("s2"), F.col("prefix").alias("last")), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
        last = F.col("last")
    plan = scratch.keep(plan.withColumn("last", last), "plan")  # small, so that its size is known when the join is planned
    at_edge = (F.col("key") == F.col("prefix")) & ((F.col("j") == F.col("n")) | (F.col("row") < F.col("last")))
    once_more = F.coalesce((F.col("key") < F.col("prefix")) | at_edge, F.lit(False)).cast("long")
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
    kept = [F.col("kept").getField(c).alias(c) for c in rest]
    return out.select(*kept, "size", "source_size", "target", (F.col("size") * (F.col("passes") + once_more)).alias("taken"))
