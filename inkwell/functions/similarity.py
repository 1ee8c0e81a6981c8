"""Lexical similarity of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .text import MATH_SPAN

NEAR_DUPLICATE = 0.5


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, MATH_SPAN, " ")), F.lit("[a-z0-9]+"), F.lit(0))


def token_sets(text: Column) -> Column:
    """struct(words, bigrams); a single token's bigrams are its words."""

    def sets(t):
        pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.struct(F.array_distinct(t).alias("words"), F.when(F.size(t) == 1, t).otherwise(F.array_distinct(pairs)).alias("bigrams"))

    return let(tokens(text), sets)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def parse_pages(spec: Column, page_count: Column | None = None) -> Column:
    """Page numbers of a specification such as "6-40,55"; with a page count, an error if one is not within 1..count."""
    pieces = F.filter(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda p: p != "")
    ends = lambda p: F.split(p, "-")
    pages = F.flatten(F.transform(pieces, lambda p: F.sequence(F.element_at(ends(p), 1).cast("int"), F.element_at(ends(p), -1).cast("int"))))
    if page_count is None:
        return pages
    bad = F.exists(pages, lambda p: (p < 1) | (p > page_count))
    return F.when(bad, F.raise_error(F.concat(F.lit("pages out of range 1.."), page_count.cast("string"), F.lit(": "), spec)).cast("array<int>")).otherwise(pages)
