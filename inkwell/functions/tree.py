"""Part trees in the flat model: nesting, inline parts, marks, answers packed by part. All expressions.

A part is struct<path, no, parent_path, depth, ord, text, marks, answer, solution, answer_area>; ancestors
come before their children, and one that no label stands for has the ord -1 (and no label of its own if
none is known).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import AMBIGUOUS, canon_part_no, label_groups, local_label, part_depth
from .let import let
from .text import answer_area, blank, normalize_text, part_mark, strip

# Fixed values.
INLINE_PART = r"(?m)^[ \t]*(\([a-z]{1,4}\))[ \t]+(?=\S)"
MARKER = r"(?:\(\s*[A-Za-z]{1,3}\s*\)|\(\s*\d{1,2}\s*\)){1,3}"
MARKER_LABEL = r"\(\s*([A-Za-z]{1,3}|\d{1,2})\s*\)"
CARRIED = {"marks": "int", "answer": "string", "solution": "string", "answer_area": "string"}
PLACE = "struct<path:string,no:string,parent_path:string,depth:int,ord:int>"
PART = "struct<path:string,no:string,parent_path:string,depth:int,ord:int,text:string,marks:int,answer:string,solution:string,answer_area:string>"
FLAT = "struct<no:string,text:string,marks:int,answer:string,solution:string,answer_area:string>"


def _bare(label: Column) -> Column:
    return F.lower(F.btrim(label, F.lit("() ")))


def label_depth(label: Column, following: Column, last_top: Column) -> Column:
    """Depth of a label in its sequence: a single i, v or x is roman before the roman one after it, and a letter
    after the letter before it at the top; without such neighbours it is roman."""


    def of(one):
        depth = part_depth(label)
        for name, (letter, roman) in AMBIGUOUS.items():
            depth = F.when(one == name, F.when((following != roman) & (last_top == letter), 1).otherwise(2)).otherwise(depth)
        return depth

    return let(F.when(F.size(label_groups(label)) == 1, _bare(label)), of)


def nest_parts(labels: Column) -> Column:
    """Part labels in reading order as array<struct<path, no, parent_path, depth, ord>>.

    A part is the child of the nearest part before it of less depth. Ancestors that are missing are added,
    named by the label's own groups where it has them. A label that names other ancestors than those
    that stand open opens its own ((b)(i) after (a)(i) is under a (b) of its own).
    """
    following = lambda k: F.coalesce(_bare(local_label(F.try_element_at(labels, k + 2))), F.lit(""))
    steps = F.transform(labels, lambda x, k: F.struct(x.alias("label"), k.cast("int").alias("k"), following(k).alias("next")))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("top"), F.array().cast(f"array<{PLACE}>").alias("out"))

    def place(path: Column, level: Column, ord_: Column) -> Column:
        up = lambda n: F.array_join(F.slice(path, 1, n), "")
        parent = F.when(level > 1, up(level - 1))
        return F.struct(up(level).alias("path"), F.element_at(path, level).alias("no"), parent.alias("parent_path"), level.cast("int").alias("depth"), ord_.cast("int").alias("ord"))

    def step(a, s):
        groups = F.regexp_extract_all(s["label"], F.lit(r"\([^)]*\)"), F.lit(0))
        return let(F.struct(label_depth(s["label"], s["next"], a["top"]).alias("depth"), groups.alias("groups")), lambda x: at_depth(a, s, x["depth"], x["groups"]))

    def at_depth(a, s, depth, groups):
        named = lambda level: F.when(level < F.size(groups), F.element_at(groups, level))
        open_at = lambda level: F.try_element_at(a["open"], level)
        levels = F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array().cast("array<int>"))
        fits = F.transform(levels, lambda x: open_at(x).isNotNull() & (named(x).isNull() | (named(x) == open_at(x))))
        kept = F.aggregate(fits, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda c, f: F.struct((c["n"] + (c["on"] & f).cast("int")).alias("n"), (c["on"] & f).alias("on")))["n"]

        def placed(x):
            path, kept = x["path"], x["kept"]
            added = F.transform(F.filter(levels, lambda n: n > kept), lambda n: place(path, n, F.lit(-1)))
            top = F.when((depth == 1) | (kept == 0), _bare(F.element_at(path, 1))).otherwise(a["top"])
            return F.struct(path.alias("open"), top.alias("top"), F.concat(a["out"], added, F.array(place(path, depth, s["k"]))).alias("out"))

        above = lambda kept: F.transform(levels, lambda x: F.when(x <= kept, open_at(x)).otherwise(F.coalesce(named(x), F.lit(""))))
        return let(let(kept, lambda n: F.struct(n.alias("kept"), F.concat(above(n), F.array(local_label(s["label"]))).alias("path"))), placed)

    return F.aggregate(steps, start, step)["out"]


def split_inline_parts(flat: Column) -> Column:
    """Parts whose text lists two or more parts of its own, at line starts, as an introduction and those parts."""

    def cut(p):
        marks = F.regexp_extract_all(p["text"], F.lit(INLINE_PART), F.lit(1))
        pieces = F.transform(F.split(p["text"], INLINE_PART, -1), strip)
        return let(F.struct(marks.alias("marks"), pieces.alias("pieces")), lambda x: into(p, x["marks"], x["pieces"]))

    def into(p, marks, pieces):
        child = lambda m, i: F.struct(F.concat(p["no"], m).alias("no"), F.element_at(pieces, i + 2).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in CARRIED.items()))
        whole = F.concat(F.array(p.withField("text", F.element_at(pieces, 1))), F.transform(marks, child))
        return F.when(F.size(marks) < 2, F.array(p)).otherwise(F.filter(whole, lambda x: x["text"] != ""))

    return F.flatten(F.transform(flat, cut))


def finalize_parts(flat: Column) -> Column:
    """Flat parts (FLAT, labels and texts as printed) as a tree of PART: canonical labels and texts, empty ones dropped,
    inline parts cut, nested, marks at the end of a text taken off it."""
    normal = F.transform(flat, lambda p: p.withField("no", canon_part_no(p["no"])).withField("text", normalize_text(p["text"])))

    def tree(cut):
        places = nest_parts(F.transform(cut, lambda p: p["no"]))

        def whole(x):
            own = F.when(x["ord"] >= 0, F.try_element_at(cut, F.greatest(x["ord"], F.lit(0)) + 1))
            return let(own, lambda p: let(F.struct(*(c.alias(n) for n, c in zip(("body", "marks"), part_mark(F.coalesce(p["text"], F.lit("")))))), lambda m: F.struct(
                *(x[c].alias(c) for c in ("path", "no", "parent_path", "depth", "ord")), m["body"].alias("text"), F.coalesce(m["marks"], p["marks"]).alias("marks"), *(p[c].alias(c) for c in CARRIED if c != "marks")
            )))

        return F.transform(places, whole)

    return let(split_inline_parts(F.filter(normal, lambda p: p["text"] != "")), tree)


def split_by_parts(text: Column, paths: Column) -> Column:
    """struct(lead, parts array<struct<path, text>>): a packed answer cut at the labels of parts that it prints.

    A label counts if it names a part, or a part under the last top-level label before it. One label is enough at
    the very start, else two are needed; otherwise all of the text is lead.
    """
    marks = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    pieces = F.split(text, MARKER, -1)
    segment = "struct<path:string,text:string>"
    start = F.struct(F.lit("").alias("top"), F.array(F.struct(F.lit(None).cast("string").alias("path"), F.element_at(pieces, 1).alias("text"))).cast(f"array<{segment}>").alias("got"))
    turns = F.transform(marks, lambda m, i: F.struct(m.alias("mark"), F.element_at(pieces, i + 2).alias("text")))

    def step(a, x):
        names = F.transform(F.regexp_extract_all(x["mark"], F.lit(MARKER_LABEL), F.lit(1)), lambda n: F.concat(F.lit("("), F.lower(n), F.lit(")")))
        return let(names, lambda n: let(F.array_join(n, ""), lambda own: turn(a, x, n, own)))

    def turn(a, x, names, own):
        under = F.concat(a["top"], own)
        path = F.when(F.array_contains(paths, own), own).when((F.size(names) == 1) & (a["top"] != "") & F.array_contains(paths, under), under)
        return let(path, lambda p: joined(a, x, names, own, p))

    def joined(a, x, names, own, path):
        last = F.element_at(a["got"], -1)
        longer = F.struct(last["path"].alias("path"), F.concat(last["text"], x["mark"], x["text"]).alias("text"))
        got = F.when(path.isNotNull(), F.concat(a["got"], F.array(F.struct(path.alias("path"), x["text"].alias("text"))))).otherwise(F.concat(F.slice(a["got"], 1, F.size(a["got"]) - 1), F.array(longer)))
        return F.struct(F.when((path == own) & (F.size(names) == 1), own).otherwise(a["top"]).alias("top"), got.alias("got"))

    def cut(got):
        lead = got[0]["text"]
        listed = F.coalesce((F.size(got) > 2) | ((F.size(got) == 2) & (lead == "")), F.lit(False))
        parts = F.transform(F.slice(got, 2, F.greatest(F.size(got) - 1, F.lit(0))), lambda x: x.withField("text", strip(F.btrim(strip(x["text"]), F.lit(";")))))
        none = F.array().cast(f"array<{segment}>")
        return F.struct(F.when(listed, F.btrim(lead, F.lit(" ;,\n"))).otherwise(text).alias("lead"), F.when(listed, F.filter(parts, lambda x: x["text"] != "")).otherwise(none).alias("parts"))

    return let(F.aggregate(turns, start, step)["got"], cut)


def apply_part_answers(parts: Column, value: Column, field: str) -> Column:
    """struct(parts, value): a packed answer (or solution) moved to the parts that it names.

    With fewer than two parts nothing moves. Parts that have the field keep it, and the entry's own value goes; a value
    that names no part stays with the entry. (A question of one part keeps its answer; labels are compared in small letters.)
    """
    return let(F.struct(parts.alias("parts"), value.alias("value")), lambda x: _moved(x["parts"], x["value"], field))


def _moved(parts: Column, value: Column, field: str) -> Column:
    paths = F.transform(parts, lambda p: p["path"])
    have = F.exists(parts, lambda p: F.coalesce(p[field] != "", F.lit(False)))
    several = F.size(parts) >= 2

    def after(split):
        piece = lambda p: F.try_element_at(F.filter(split["parts"], lambda x: x["path"] == p["path"]), F.lit(-1))["text"]
        spread = F.transform(parts, lambda p: p.withField(field, F.coalesce(piece(p), p[field])))
        found = F.size(split["parts"]) > 0
        new = F.when(~several, value).when(have, F.lit(None)).when(found, F.nullif(split["lead"], F.lit(""))).otherwise(value)
        return F.struct(F.when(several & ~have & found, spread).otherwise(parts).alias("parts"), new.alias("value"))

    return let(split_by_parts(F.coalesce(value, F.lit("")), paths), after)


def apply_answer_area(parts: Column) -> Column:
    """Parts with the answer area at the end of each text lifted off (one that is there already stays)."""

    def one(p):
        return let(answer_area(p["text"]), lambda split: p.withField("text", split["body"]).withField("answer_area", F.coalesce(split["area"], p["answer_area"])))

    return F.transform(parts, one)


def stem_text(stem: Column, parts: Column) -> Column:
    """The stem, or the texts of the parts if it is blank."""
    return F.when(blank(stem), F.array_join(F.transform(parts, lambda p: p["text"]), " ")).otherwise(stem)
