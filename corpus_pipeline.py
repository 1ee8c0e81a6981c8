"""A corpus pipeline of five stages; each reads what the one before it wrote, and all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, mixing, quality, simhash, suffixes
from inkwell.llm.shared import Scratch, fresh, table

#: The stages fit a classifier and tile passages, which SQL can't express; tests use brute force.
ORACLE_SQL = None
QUALITY_AT_LEAST = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, accepts.

    Null and empty texts are scored by their statistics, very long ones as a whole; repeated rows share their score;
    other columns pass through; an empty table, or one without labelled documents of both classes, is kept whole.
    """
    metadata = [c for c in ("n_chars",) if c in docs.columns]
    model = quality.fit(docs, table(spark, sf_dir, "labels"), metadata=metadata)
    if isinstance(model, float):
        return docs
    mark = fresh("mark", docs.columns)
    scored = quality.score(docs.withColumn(mark, F.struct(*docs.columns)), model, metadata=metadata)
    return scored.filter(F.col("quality_score") >= QUALITY_AT_LEAST).select(f"{mark}.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the
    smallest doc_id, ties by a hash of the text; of equal rows one.

    Null texts and those without a word all stay; null doc_ids come last; very long texts count as a whole; other
    columns pass through, whatever their names; an empty table stays empty.
    """
    worded = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    some = docs.filter(worded)
    groups = simhash.similar_groups(some.select("doc_id", "text"), Scratch(spark, "one-of-each"))
    own, text = fresh("own_id", docs.columns), fresh("own_text", docs.columns)
    rest = groups.filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))))
    rest = rest.select(F.col("doc_id").alias("rest_id"), F.col("th").alias("rest_text")).distinct()
    hashed = some.withColumns({own: F.col("doc_id").cast("long"), text: F.xxhash64("text")})
    kept = hashed.join(rest, hashed[own].eqNullSafe(rest["rest_id"]) & (hashed[text] == rest["rest_text"]), "left_anti")
    once = kept.dropDuplicates(["doc_id", text]).drop(own, text)
    return once.unionByName(docs.filter(~worded))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that an earlier document has; see suffixes.without_repeats for every case."""
    return suffixes.without_repeats(docs, Scratch(spark, "cut-repeats"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null, empty and short texts hold none, repeated rows are treated alike,
    and other columns pass through."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*[c for c in docs.columns if c != "leaks"])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their texts and how many words it takes of each.

    Texts without a word have nothing to take and go; see mixing.mix for nulls, ties and repeated rows.
    """
    body = fresh("body", docs.columns)
    with_text = mixing.mix(docs.withColumn(body, F.col("text")), Scratch(spark, "mixed"))
    return with_text.filter("taken > 0").withColumnRenamed(body, "text")


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each stage's result is a table in the shared folder. What a stage wrote on its
    way, and the table that it read, are removed once its result is there."""
    scratch = Scratch(spark, "pipeline")
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        earlier = len(Scratch.made)
        docs = scratch.keep(stage(spark, before, sf_dir), name.replace(" ", "-"))
        for used in Scratch.made[earlier:]:
            used.remove()
        if hasattr(before, "scratch_path"):
            scratch.drop(before)
        before = docs
    return docs
