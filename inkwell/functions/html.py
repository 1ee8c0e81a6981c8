"""HTML tables as grids: array<array<struct<text, colspan, rowspan>>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .text import strip

ROW, CELL = r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[dh][^>]*>.*?</t[dh]>"


def cell_text(html: Column, lines: bool = False) -> Column:
    """Text of a piece of HTML: tags become blanks, white space collapses. lines: <br> starts a line."""
    if lines:
        pieces = F.transform(F.split(html, r"(?i)<br\s*/?>", -1), lambda x: cell_text(x))
        return strip(F.array_join(pieces, "\n"))
    return strip(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))


def parse_grid(html: Column) -> Column:
    span = lambda cell, name: F.greatest(F.lit(1), F.coalesce(F.regexp_extract(cell, f'(?i)^<t[dh][^>]*\\b{name}\\s*=\\s*["\']?(\\d+)', 1).try_cast("int"), F.lit(1)))
    cell = lambda c: F.struct(cell_text(c).alias("text"), span(c, "colspan").alias("colspan"), span(c, "rowspan").alias("rowspan"))
    return F.transform(F.regexp_extract_all(html, F.lit(ROW), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(0)), cell))


def grid_width(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, lambda r: F.aggregate(r, F.lit(0), lambda n, c: n + c["colspan"]))), F.lit(0))


def grid_occupancy(grid: Column) -> Column:
    """Cells of a grid placed on rows and columns: array<struct<r, c, text, colspan, rowspan>>, every position taken once (null: empty).

    A fold over rows carries, for each column, how many further rows it is taken; a fold over a row's cells puts each on the first free column from
    where the last one ended.
    """
    placed = "array<struct<r:int,c:int,text:string,colspan:int,rowspan:int>>"
    none = lambda kind: F.array().cast(kind)
    taken = lambda a, j: F.coalesce(F.get(a["taken"], j), F.lit(0))

    def put(a, cell):
        ahead = F.sequence(a["c"], F.greatest(a["c"], F.size(a["taken"])))
        return let(F.filter(ahead, lambda j: taken(a, j) == 0)[0], lambda c: _put(a, cell, c))

    def _put(a, cell, c):
        width = F.sequence(F.lit(0), F.greatest(F.size(a["taken"]), c + cell["colspan"]) - 1)
        after = F.transform(width, lambda j: F.when((j >= c) & (j < c + cell["colspan"]), F.greatest(taken(a, j), cell["rowspan"])).otherwise(taken(a, j)))
        one = F.struct(a["r"].alias("r"), c.alias("c"), cell["text"].alias("text"), cell["colspan"].alias("colspan"), cell["rowspan"].alias("rowspan"))
        return F.struct(F.array_append(a["out"], one).cast(placed).alias("out"), after.alias("taken"), (c + cell["colspan"]).alias("c"), a["r"].alias("r"))

    start = F.struct(none(placed).alias("out"), none("array<int>").alias("taken"), F.lit(0).alias("c"), F.lit(0).alias("r"))
    down = lambda a: F.struct(a["out"].alias("out"), F.transform(a["taken"], lambda n: F.greatest(n - 1, F.lit(0))).alias("taken"), F.lit(0).alias("c"), (a["r"] + 1).alias("r"))
    rows = F.coalesce(grid, none("array<array<struct<text:string,colspan:int,rowspan:int>>>"))
    return F.aggregate(rows, start, lambda a, row: let(F.aggregate(row, a, put), down), lambda a: a["out"])


def is_question_row(row: Column, width: Column) -> Column:
    """First cell a lone number of one or two digits, all others filled, and a later one over nearly the whole width."""
    rest = F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0)))
    wide = F.exists(rest, lambda c: c["colspan"] >= F.greatest(F.lit(2), width - 1))
    number = F.coalesce(F.try_element_at(row, F.lit(1))["text"].rlike(r"^\s*(\d{1,2})\s*[.)]?\s*\z"), F.lit(False))
    return number & (F.size(row) > 1) & F.forall(rest, lambda c: c["text"] != "") & wide


def render_grid(grid: Column) -> Column:
    attr = lambda c, n: F.when(c[n] > 1, F.concat(F.lit(f' {n}="'), c[n].cast("string"), F.lit('"'))).otherwise("")
    cell = lambda c: F.concat(F.lit("<td"), attr(c, "colspan"), attr(c, "rowspan"), F.lit(">"), c["text"], F.lit("</td>"))
    rows = F.transform(grid, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))
