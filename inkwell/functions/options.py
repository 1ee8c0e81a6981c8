"""Multiple-choice options as array<struct<label, value>>, in the order of the paper."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import bare_label, option_index, option_label
from .let import let
from .text import strip

OPTION = "struct<label:string,value:string>"
TABLE_KEY = r"(?s)^([A-D1-4])[\s.)]*(.*)\z"  # fixed value


def canon_options(options: Column) -> Column:
    """Options relabelled (1)..(n), as structs with pos, label, value and the bare label they had (null if they don't move).

    Order follows the labels if all are readable and distinct, else stays.
    """
    index = F.transform(options, lambda o: option_index(o["label"]))
    readable = F.forall(index, lambda i: i.isNotNull()) & (F.size(F.array_distinct(index)) == F.size(options))
    placed = F.transform(options, lambda o, i: F.struct(F.when(readable, option_index(o["label"])).otherwise(i).alias("order"), o["label"].alias("label"), o["value"].alias("value")))
    new = lambda i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(")"))
    return F.transform(
        F.array_sort(placed),
        lambda o, i: F.struct((i + 1).alias("pos"), new(i).alias("label"), o["value"].alias("value"), F.when(F.trim(o["label"]) != new(i), bare_label(o["label"])).alias("was")),
    )


def remap_answer(answer: Column, canonical: Column) -> Column:
    """An answer that only names labels that moved, by their new labels; any other answer as it is."""
    tokens = F.filter(F.split(F.trim(answer), r"[\s,;/、]+", -1), lambda t: t != "")
    to = lambda t: F.try_element_at(F.filter(canonical, lambda o: o["was"] == bare_label(t)), F.lit(1))["label"]
    new = F.transform(tokens, to)
    named = F.size(tokens).between(1, 4) & F.forall(new, lambda x: x.isNotNull())
    return F.when(named, F.array_join(new, " ")).otherwise(answer)


def parse_inline_options(text: Column) -> Column:
    """Options of inline text such as "A 1.2 B 1.8": a lone, new key opens an option, other tokens extend it.

    Null with fewer than two options or an empty one.
    """
    tokens = F.filter(F.split(F.trim(text), r"\s+", -1), lambda t: t != "")
    empty = F.array().cast(f"array<{OPTION}>")
    opens = lambda got, t: t.rlike(r"^[A-D1-4]\z") & ~F.exists(got, lambda o: o["label"] == t)

    def step(got, t):
        n = F.size(got)
        last = F.element_at(got, -1)
        longer = F.struct(last["label"].alias("label"), F.trim(F.concat_ws(" ", last["value"], t)).alias("value"))
        fresh = F.concat(got, F.array(F.struct(t.alias("label"), F.lit("").alias("value"))))
        return F.when(opens(got, t), fresh).when(n > 0, F.concat(F.slice(got, 1, F.greatest(n - 1, F.lit(0))), F.array(longer))).otherwise(got)

    return let(F.aggregate(tokens, empty, step), lambda got: F.when((F.size(got) >= 2) & F.forall(got, lambda o: o["value"] != ""), got))


def parse_table_options(html: Column) -> Column:
    """Options of a table: a cell that starts with a new key opens one, and an empty one takes the next cell.

    Null with fewer than two, or if the values only repeat the keys.
    """
    cells = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: strip(F.regexp_replace(c, r"<[^>]+>", " ")))
    start = F.struct(F.array().cast(f"array<{OPTION}>").alias("got"), F.lit(False).alias("waits"))
    one = lambda k, v: F.struct(k.alias("label"), v.alias("value"))

    def step(a, cell):
        return let(F.struct(F.regexp_extract(cell, TABLE_KEY, 1).alias("key"), strip(F.regexp_extract(cell, TABLE_KEY, 2)).alias("value")), lambda c: cell_step(a, cell, c["key"], c["value"]))

    def cell_step(a, cell, key, value):
        opens = (key != "") & ~F.exists(a["got"], lambda o: o["label"] == key)
        n = F.size(a["got"])
        filled = F.concat(F.slice(a["got"], 1, F.greatest(n - 1, F.lit(0))), F.array(one(F.element_at(a["got"], -1)["label"], cell)))
        got = F.when(a["waits"], filled).when(opens, F.concat(a["got"], F.array(one(key, value)))).otherwise(a["got"])
        return F.struct(got.alias("got"), (~a["waits"] & opens & (value == "")).alias("waits"))

    same = lambda got: F.size(F.filter(got, lambda o: o["value"] == o["label"]))
    return let(F.aggregate(cells, start, step)["got"], lambda got: F.when((F.size(got) >= 2) & (same(got) < F.size(got) - 1), got))


def parse_options(text: Column) -> Column:
    return F.when(text.contains("<table"), parse_table_options(text)).otherwise(parse_inline_options(text))


def put_options(got: Column, more: Column) -> Column:
    """Options with more of them: a label that is there takes the new value, others follow."""

    def put(a, o):
        there = F.exists(a, lambda x: x["label"] == o["label"])
        return F.when(there, F.transform(a, lambda x: F.when(x["label"] == o["label"], o).otherwise(x))).otherwise(F.concat(a, F.array(o)))

    return F.aggregate(more, got, put)


def gather_options(rows: Column) -> Column:
    """Options of a question's option blocks (array of label, src, in order): parsed if they can be, else the
    block itself under its label, or under the next letter (a number after D)."""
    empty = F.array().cast(f"array<{OPTION}>")

    def step(a, r):
        n = F.size(a) + 1
        key = F.coalesce(F.nullif(r["label"], F.lit("")), F.when(n <= 4, F.char(64 + n)).otherwise(n.cast("string")))
        return let(F.coalesce(parse_options(r["src"]), F.array(F.struct(key.alias("label"), r["src"].alias("value")))), lambda more: put_options(a, more))

    return F.aggregate(rows, empty, step)


def answer_display(options: Column, answer: Column, style: str) -> Column:
    """An answer that only names options (by label, or bare unless that is an option's value) in the labels of a style."""
    tokens = F.filter(F.split(strip(answer), r"[\s,;/、]+", -1), lambda t: t != "")
    bare = lambda x: F.btrim(strip(x), F.lit("()（）"))
    values = F.transform(options, lambda o: strip(o["value"]))
    hit = lambda t: F.coalesce(
        F.try_element_at(F.filter(options, lambda o: strip(o["label"]) == t), F.lit(1))["label"],
        F.when(~F.array_contains(values, t), F.try_element_at(F.filter(options, lambda o: bare(o["label"]) == bare(t)), F.lit(-1))["label"]),
    )

    def render(hits):
        named = (F.size(hits) > 0) & (F.size(options) > 0) & F.forall(hits, lambda h: h.isNotNull())
        shown = F.array_join(F.transform(hits, lambda h: option_label(F.greatest(option_index(h) - 1, F.lit(0)), style)), ", ")
        return F.when(named, shown).otherwise(answer)

    return let(F.transform(tokens, hit), render)


def entry_shape(has_options: Column, has_parts: Column) -> Column:
    return F.when(has_options, "mcq").when(has_parts, "structured")


# Words in a type's name that stand for a shape.
SHAPE_WORDS = {"mcq": ["mcq", "choice", "multiple", "select", "option", "选择"], "structured": ["structured", "multipart", "multi_part", "subpart", "part", "结构", "多问"]}


def structural_type(shape: Column, vocabulary: list[str]) -> Column:
    """The type of the vocabulary that names the shape: equal first, else by a word in it; null if there is none."""

    def named(s: str) -> str | None:
        equal = [t for t in vocabulary if t.lower() == s]
        return next(iter(equal + [t for t in vocabulary if any(w in t.lower() for w in SHAPE_WORDS[s])]), None)

    return F.when(shape == "mcq", F.lit(named("mcq"))).when(shape == "structured", F.lit(named("structured")))
