"""What each quality filter removes in every order of filters: a direct relational replay.

Every document gets one flag a filter (it fails or it passes). The flags are crossed with the 120 orders
of the five filters, a table of fixed size that is broadcast; each pair explodes to five steps, its first
failing step is compared with them, and sums by (part, order, step) are combined in the task that made the
rows, so that a shuffle carries one row a task, part, order and step, whatever the number of documents and
however large one part is.

Copies are found without gathering any group: the smallest doc_id of each text (a SHA-256 of it stands for
the text) is an aggregate with map-side combining, and a document fails filter E unless the pair of its
doc_id and text is among those firsts; that join is on doc_id, so a text with many copies isn't a hot key.

Defined results: a null text is empty (and equal to an empty one); a null source is the part '' together
with sources that are the empty string; a null doc_id has no smaller one, isn't smaller than any and has no
labels; rows of one doc_id are documents of their own, and equal rows are all firsts of their text, if one
is; a doc_id with several labels counts as good (toxic) if one of them says so; an empty table gives no
rows; very long texts count as a whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_filters(text: Column) -> list[Column]:
    """A to D of a text (not null): short, repetitive, shouting, marked up; true where it fails."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]


def mask(fails: list[Column]) -> Column:
    """The flags as bits of an int, the first filter's bit lowest."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)])


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (a bit for each of A to E), good, toxic: one row a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"), mask(text_filters(text)).alias("of_text"),
    )
    firsts = rows.filter("id is not null").groupBy("same").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.filter("id is not null").join(firsts, ["id", "same"], "left").join(marks, "id", "left")
    copy = F.when(F.col("first").isNull(), F.lit(16)).otherwise(F.lit(0))
    no = F.lit(False)
    known = known.select("part", F.col("of_text").bitwiseOR(copy).alias("fails"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return known.unionAll(rows.filter("id is null").select("part", F.col("of_text").alias("fails"), no.alias("good"), no.alias("toxic")))


def orders(spark, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters, with the bits of its filters in turn: n! rows."""
    data = [("".join(p), [1 << filters.index(f) for f in p]) for p in permutations(filters)]
    return spark.createDataFrame(data, "filter_order string, bits array<int>")


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of what each step of each order keeps, removes and loses.

    flags: part, fails, good, toxic of each document; other columns are not read. filters: a letter each, at most six
    (720 orders).
    """
    if not 0 < len(filters) <= 6:
        raise ValueError("between one and six filters can be audited in all orders")
    bits, steps = [F.col("bits")[k] for k in range(len(filters))], len(filters)
    fails = lambda bit: F.col("fails").bitwiseAND(bit) != 0
    first = reduce(lambda later, k: F.when(fails(bits[k]), F.lit(k + 1)).otherwise(later), reversed(range(steps)), F.lit(steps + 1))
    crossed = flags.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(orders(flags.sparkSession, filters))).withColumn("first", first)
    each = crossed.select("part", "fails", "good", "toxic", "filter_order", "first", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    gone, here = F.col("first") < F.col("step"), F.col("first") == F.col("step")
    when = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0)))
    sums = each.groupBy("part", "filter_order", "step").agg(
        when(F.col("first") > F.col("step")).alias("kept"), when(here).alias("removed"), when(gone & fails(F.col("bit"))).alias("redundant"),
        when(F.col("fails") == F.col("bit")).alias("unique_fails"), when(here & F.col("good")).alias("good_lost"), when(here & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return sums.select("part", "filter_order", "step", letter.alias("filter"), *COUNTS)


def with_shapley(steps: DataFrame) -> DataFrame:
    """The replay's rows with shapley: what the row's filter removes, summed over all orders, in its part."""
    total = steps.groupBy(F.col("part").alias("p"), F.col("filter").alias("f")).agg(F.sum("removed").alias("shapley"))
    return steps.join(total, (F.col("part") == F.col("p")) & (F.col("filter") == F.col("f"))).drop("p", "f")


def audit(docs: DataFrame, labels: DataFrame, scratch) -> DataFrame:
    """The replay of A to E over docs (doc_id, text, source), with shapley. scratch: a Scratch for the replay's rows,
    600 a part, which two steps read."""
    flags = flagged(docs, labels)
    steps = scratch.keep(replay(flags), "replay")
    return with_shapley(steps).select("part", "filter_order", F.col("step").cast("int").alias("step"), "filter", *COUNTS, "shapley")
