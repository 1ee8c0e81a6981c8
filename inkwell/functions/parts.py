"""Parts of a question as a flat array<struct<path, parent_path, text, answer, solution, answer_area, ...>>.

Structs can't recurse, so a part names its parent's path; ancestors come before their children.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .text import answer_area, normalize_text

CARRIED = ["marks", "answer", "solution", "answer_area"]


def part_texts(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), " ")


def part_paths(parts: Column) -> Column:
    return F.transform(parts, lambda p: p["path"])


def has_answer(entry_value: Column, parts: Column, field: str = "answer") -> Column:
    """Whether the entry or any part has the field."""
    return F.coalesce(entry_value != "", F.lit(False)) | F.exists(parts, lambda p: F.coalesce(p[field] != "", F.lit(False)))


def polish(parts: Column) -> Column:
    """Every part's text in canonical form, its answer area lifted off (an area that is there already stays)."""

    def one(p):
        return let(answer_area(normalize_text(p["text"])), lambda split: p.withField("text", split["body"]).withField("answer_area", F.coalesce(split["area"], p["answer_area"])))

    return F.transform(parts, one)


def restore_carry(old: Column, new: Column, fields: list[str] = CARRIED) -> Column:
    """New parts with what they lack taken from the old part of the same path."""

    def one(p):
        before = F.try_element_at(F.filter(old, lambda o: o["path"] == p["path"]), F.lit(1))
        for f in fields:
            p = p.withField(f, F.coalesce(p[f], before[f]))
        return p

    return F.transform(new, one)


def restore_markers(old: Column, new: Column) -> Column:
    """New text with the image markers that only the old text has, appended."""
    markers = lambda s: F.regexp_extract_all(s, F.lit(r"!\[\]\([^)]*\)"), F.lit(0))
    lost = F.array_except(markers(old), markers(new))
    return F.when(F.size(lost) > 0, F.concat_ws("\n", new, F.array_join(lost, "\n"))).otherwise(new)


def answer_lines(entry_answer: Column, entry_solution: Column, parts: Column) -> Column:
    """(label, answer, solution) of the entry and of every part that has one of them, in order."""
    line = lambda label, a, z: F.struct(label.alias("label"), a.alias("answer"), z.alias("solution"))
    some = lambda a, z: (F.coalesce(a, F.lit("")) != "") | (F.coalesce(z, F.lit("")) != "")
    own = F.array_compact(F.array(F.when(some(entry_answer, entry_solution), line(F.lit(""), entry_answer, entry_solution))))
    theirs = F.transform(F.filter(parts, lambda p: some(p["answer"], p["solution"])), lambda p: line(p["path"], p["answer"], p["solution"]))
    return F.concat(own, theirs)
