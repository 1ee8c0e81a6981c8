"""Usage, journal, edits and snapshots as append-only events: state is an aggregate of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usage_map(events: DataFrame, titles: int = 10) -> DataFrame:
    """key, count, first, last and the last distinct titles, from events (key, ts, title)."""
    t = events.groupBy("key", "title").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("a", "title"))), lambda x: x["title"])
    return t.groupBy("key").agg(F.sum("n").alias("count"), F.min("a").alias("first"), F.max("z").alias("last"), F.slice(ordered, -F.least(F.count("*"), F.lit(titles)).cast("int"), titles).alias("titles"))


def recent(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def journal(events: DataFrame, key: str | None = None, n: int = 50, window: int = 400) -> DataFrame:
    """The newest journal rows of a key among the last `window` of all."""
    last = events.orderBy(F.desc("ts"), F.desc("id")).limit(window)
    return (last if key is None else last.filter(F.col("key") == key)).orderBy(F.desc("ts"), F.desc("id")).limit(n)


def current(edits: DataFrame, key: list[str]) -> DataFrame:
    """The live rows of an append-only edit log (key, version, deleted, ...): the newest version unless it is a tombstone."""
    newest = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("version")))
    return edits.withColumn("_r", newest).filter("_r = 1 and not deleted").drop("_r", "deleted")


def conflicts(edits: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """Edits whose expected revision is not the live one: refused by optimistic concurrency."""
    live = base.select(*key, F.col("rev").alias("live_rev"))
    return edits.join(live, key, "left").filter(~F.col("rev").eqNullSafe(F.col("live_rev")))


def toggled(flags, name: str):
    """Flags with the flag added or, if it is there, taken off."""
    return F.when(F.array_contains(flags, name), F.array_remove(flags, name)).otherwise(F.array_append(flags, F.lit(name)))


def restored(edits: DataFrame, key: list[str], upto) -> DataFrame:
    """The state at a snapshot's version."""
    return current(edits.filter(F.col("version") <= upto), key)


def next_number(entries: DataFrame, prefix: str = "manual-") -> DataFrame:
    """The smallest number that no qid with the prefix uses."""
    used = entries.filter(F.col("qid").startswith(prefix)).select(F.regexp_extract("qid", r"(\d+)\z", 1).cast("int").alias("n")).distinct()
    after = used.select((F.col("n") + 1).alias("n")).union(used.sparkSession.range(1, 2).select(F.col("id").cast("int").alias("n")))
    return after.join(used, "n", "left_anti").agg(F.min("n").alias("n"))


def fresh_pick(entries: DataFrame, usage: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """n entries, the least used first, at random (by a seeded hash) among equals."""
    uses = F.coalesce("count", F.lit(0)).alias("uses")
    return entries.join(usage.select("qid", "count"), "qid", "left").select(entries["*"], uses, F.md5(F.concat(F.lit(seed), F.col("qid").cast("string"))).alias("_h")).orderBy("uses", "_h").limit(n).drop("_h")
