"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_hash(column: Column) -> Column:
    """A hash of the value as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(column), 11) / F.lit(float(1 << 53))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, longest: int = 32_768, metadata: list[str] = ()) -> DataFrame:
    """doc_id, text, y (0.0 or 1.0) and the metadata columns of about per_class labelled documents of each class.

    The ids come from a hash threshold over all labels for which `allowed` (on doc_id) holds, at most
    3 * per_class of them, so they are broadcast safely and the documents are not shuffled. A doc_id
    with several labels gets the label that most of its rows have (a tie counts as 1); null labels and
    ids are left out, and so are texts of over `longest` bytes: the sample holds 3 * per_class * longest
    bytes at most. Of a doc_id's rows one is taken, the one with the least hash.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & F.coalesce(allowed, F.lit(False)))
    known = known.select("doc_id", F.col(label).cast("double").alias("y"))
    n = known.agg(F.sum(F.col("y")).alias("ones"), F.count("*").alias("all")).first()
    ones, every = float(n["ones"] or 0.0), float(n["all"])
    share = F.when(F.col("y") >= 0.5, F.lit(per_class / max(ones, 1.0))).otherwise(F.lit(per_class / max(every - ones, 1.0)))
    ids = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y")).filter(unit_hash(F.col("doc_id")) < share).limit(3 * per_class)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *metadata).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    some = rows.join(F.broadcast(ids), "doc_id")
    one = F.min_by(F.struct("text", "y", *metadata), F.struct(F.xxhash64("text", *metadata), F.col("text")))
    return some.groupBy("doc_id").agg(one.alias("one")).select("doc_id", "one.*")
