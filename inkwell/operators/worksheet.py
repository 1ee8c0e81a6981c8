"""Worksheets: sections, numbering, captions, layout rows, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.options import structural_type
from ..tables import kept

# Types in order of their sections.
TYPE_ORDER = ["mcq", "true_false", "fill_blank", "short_answer", "word_problem", "structured"]


def order_sections(selection: DataFrame) -> DataFrame:
    """selection (pos, type, marks) with section (A, B, ...) and number (1..n over all sections).

    Sections go by TYPE_ORDER, other types as first seen; within one by marks, none last, then pos.
    """
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(TYPE_ORDER) for x in (t, i))), F.col("type")), F.lit(len(TYPE_ORDER)))
    seen = selection.groupBy("type").agg(F.min("pos").alias("_seen")).withColumn("_rank", rank)
    seen = seen.withColumn("section_no", F.row_number().over(W.orderBy("_rank", "_seen"))).select("type", "section_no")
    out = selection.join(F.broadcast(seen), "type").withColumn("section", F.char(64 + F.col("section_no")))
    return numbered(out, [F.col("section_no"), F.col("marks").asc_nulls_last(), F.col("pos")])


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with number 1..n in that order, without bringing them together: a range sort, then partition offsets.

    The sorted rows are written first: ranges are sampled, and a plan that sorted twice could cut them in two ways.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = kept(placed, "numbered").withColumn("_p", F.shiftright("_at", 33))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before", "_first")
    return placed.join(starts, "_p").withColumn("number", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_p", "_at", "_first", "_before")


def total_marks(entries: DataFrame) -> DataFrame:
    """total: the marks of entries that have them, and with_parts: those of the rest taken from their parts."""
    return entries.agg(F.coalesce(F.sum("marks"), F.lit(0)).alias("total"), F.coalesce(F.sum(question_total(F.col("marks"), F.col("parts"))), F.lit(0)).alias("with_parts"))


def entry_type(tag: Column, shape: Column, vocabulary: list[str]) -> Column:
    """The type that groups an entry: its tag, else the vocabulary's word for its shape, else other."""
    return F.coalesce(F.nullif(tag, F.lit("")), structural_type(shape, vocabulary), F.lit("other"))


def mcq_first(cart: DataFrame) -> DataFrame:
    """cart (pos, kind) with its positions dealt anew: multiple choice first, else in the same order."""
    return numbered(cart, [F.when(F.col("kind") == "mcq", 0).otherwise(1), F.col("pos")]).withColumn("pos", F.col("number")).drop("number")


def move(cart: DataFrame, pos: int, to: int) -> DataFrame:
    """cart with the item at a position moved to another; those between make room."""
    low, high, shift = min(pos, to), max(pos, to), 1 if to < pos else -1
    new = F.when(F.col("pos") == pos, to).when(F.col("pos").between(low, high), F.col("pos") + shift).otherwise(F.col("pos"))
    return cart.withColumn("pos", new)


def remove(cart: DataFrame, positions: list[int]) -> DataFrame:
    """cart without some positions, the rest closed up."""
    gone = F.array(*(F.lit(p) for p in sorted(positions))) if positions else F.array().cast("array<int>")
    return cart.filter(~F.array_contains(gone, F.col("pos").cast("int"))).withColumn("pos", F.col("pos") - F.size(F.filter(gone, lambda p: p < F.col("pos"))))


def add(cart: DataFrame, items: DataFrame) -> DataFrame:
    """cart with items (in order of ord) after it that it does not hold yet."""
    new = items.join(cart.select("qid"), "qid", "left_anti")
    last = cart.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("_last"))
    placed = numbered(new, [F.col("ord")]).join(F.broadcast(last))
    return cart.select("pos", "qid").unionByName(placed.select((F.col("number") + F.col("_last")).alias("pos"), "qid"))


def page(rows: DataFrame, order: list[Column], pages: int = 1, size: int = 80) -> DataFrame:
    """The first pages of a listing."""
    return rows.orderBy(*order).limit(pages * size)


def question_total(marks: Column, parts: Column) -> Column:
    """Marks of a question: its own, else the sum of its parts'; none for 0."""
    return F.coalesce(marks, F.nullif(F.aggregate(parts, F.lit(0), lambda s, p: s + F.coalesce(p["marks"], F.lit(0))), F.lit(0)))


def answer_slots(parts: Column) -> Column:
    """Paths that an answer is due for: the leaves, and parents that have one."""
    leaf = lambda p: ~F.exists(parts, lambda c: c["parent_path"].eqNullSafe(p["path"]))
    return F.transform(F.filter(parts, lambda p: leaf(p) | p["answer"].isNotNull()), lambda p: p["path"])


def captions(assets: DataFrame, style: str = "per_question") -> DataFrame:
    """assets (question, kind, ord) with caption numbers: "QN.k" (per_question), running over all of a kind (continuous), or none."""
    if style == "none":
        return assets.withColumn("caption", F.lit(None).cast("string"))
    if style == "per_question":
        k = F.row_number().over(W.partitionBy("question", "kind").orderBy("ord"))
        out = assets.withColumn("_k", F.concat_ws(".", F.col("question").cast("string"), k.cast("string")))
    else:  # numbered over all kinds, then from each kind's first number on
        table = F.col("kind") == "table"
        out = numbered(assets.withColumn("_table", table), [F.col("_table"), F.col("question"), F.col("ord")])
        first = out.groupBy("_table").agg(F.min("number").alias("_first"))
        out = out.join(F.broadcast(first), "_table").withColumn("_k", (F.col("number") - F.col("_first") + 1).cast("string")).drop("_table", "_first", "number")
    return out.withColumn("caption", F.concat_ws(" ", F.when(F.col("kind") == "table", "Table").otherwise("Fig."), "_k")).drop("_k")


def layout(questions: DataFrame, teacher: bool = False, blank_lines: int = 2) -> DataFrame:
    """Rows of the printed sheet: the stem, a row a part, then a total (number, row_ord, kind, label, text, marks, blank_lines).

    The teacher's copy has an answer and, where questions have the column, a solution row after the stem or part that they belong to (text
    null where one is due and missing), and no lines to write on.
    """
    row = lambda kind, label, text, marks, lines: F.struct(F.lit(kind).alias("kind"), label.alias("label"), text.alias("text"), marks.cast("int").alias("marks"), F.lit(lines).alias("blank_lines"))
    none, lines = F.lit(None).cast("string"), 0 if teacher else blank_lines
    solved = "solution" in questions.columns

    def answered(label, of, due):
        rows = [row(kind, label, of(kind), F.lit(None), 0) for kind in ("answer", "solution") if kind == "answer" or solved]
        return F.when(due, F.array(*rows)).otherwise(F.slice(F.array(*rows), 1, 0))

    stem = F.array(row("stem", F.col("number").cast("string"), F.col("stem"), F.when(F.size("parts") == 0, F.col("marks")), lines))
    part = lambda p: F.array(row("part", p["no"], p["text"], p["marks"], lines))
    if teacher:
        slots, ask = answer_slots(F.col("parts")), part
        stem = F.concat(stem, answered(none, F.col, (F.size("parts") == 0) | F.col("answer").isNotNull()))
        part = lambda p: F.concat(ask(p), answered(p["path"], lambda kind: p[kind], F.array_contains(slots, p["path"])))
    total = F.array(row("total", none, none, question_total(F.col("marks"), F.col("parts")), 0))
    return questions.select("number", F.posexplode(F.concat(stem, F.flatten(F.transform("parts", part)), total)).alias("row_ord", "r")).select("number", "row_ord", "r.*")
