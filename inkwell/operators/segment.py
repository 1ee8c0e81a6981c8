"""Ordered blocks to records: noise, labels, table splitting, assembly by gaps and islands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.html import grid_width, parse_grid, render_grid
from ..functions.let import let
from ..functions.options import gather_options
from ..functions.text import blank, fix_math_spacing, strip, strip_number, strip_part_label
from ..functions.tree import FLAT
from ..tables import dealt, kept
from .model import ModelClient, run_model

# Fixed values.
NOISE_TYPES = ["page_number", "footer", "page_footnote", "header"]
MEDIA = ["image", "table", "chart"]
KNOWN_TYPES = ["text", "equation", "image", "table", "chart", "code", "header", "footer", "page_number", "page_footnote", "aside_text"]
QUESTION_CELL = r"^\s*(\d{1,2})\s*[.)]?\s*\z"
NOISE_TEXT = r"(?i)^(©|\d{1,4}\z|Educational Publishing|Page \d)"


def filter_noise(blocks: DataFrame) -> DataFrame:
    """Blocks without page furniture; furniture in mid page with real text is kept as text, in a column rescued.

    blocks: doc, i, type, text, bbox (null: mid page).
    """
    y0, y1 = F.coalesce(F.try_element_at("bbox", F.lit(2)), F.lit(0.0)), F.coalesce(F.try_element_at("bbox", F.lit(4)), F.lit(1000.0))
    text = strip(F.coalesce("text", F.lit("")))
    furniture = F.col("type").isin(NOISE_TYPES)
    noise = furniture & ((y0 >= 870) | (y1 <= 130) | text.rlike(NOISE_TEXT) | (F.length(text) < 15))
    kept = blocks.filter(~noise).withColumn("rescued", furniture)
    return kept.withColumn("type", F.when(furniture, "text").otherwise(F.col("type"))).withColumn("unknown_type", ~F.col("type").isin(KNOWN_TYPES))


def block_text(type_: Column, text: Column, table_body: Column, code_body: Column, img_path: Column) -> Column:
    """The text of a block: code without its wrapping, a table's HTML, an image's marker."""
    code = strip(F.regexp_replace(F.regexp_replace(code_body, r"(?s)^\s*(<div[^>]*>|```\w*\n?)", ""), r"(?s)(</div>|```)\s*\z", ""))
    image = F.concat(F.lit("![]("), F.coalesce(img_path, F.lit("")), F.lit(")"))
    return F.when(type_ == "code", code).when(type_ == "table", strip(F.coalesce(table_body, F.lit("")))).when(type_ == "image", image).otherwise(strip(F.coalesce(text, F.lit(""))))


def load_blocks(raw: DataFrame) -> DataFrame:
    """The blocks that count of raw ones (doc, i, type, text, table_body, code_body, img_path, page_idx, bbox), their text
    as one column and its formulas spaced as the paper has them. A document's blocks stay together, so steps by document move them no more."""
    kept = dealt(filter_noise(raw), "doc")
    body = block_text(F.col("type"), F.col("text"), F.col("table_body"), F.col("code_body"), F.col("img_path"))
    return kept.withColumn("text", fix_math_spacing(body)).drop("code_body")


def page_texts(raw: DataFrame) -> DataFrame:
    """doc, page, text: the texts of each page, joined by a blank line; running feet and page numbers are left out."""
    body = block_text(F.col("type"), F.col("text"), F.col("table_body"), F.col("code_body"), F.col("img_path"))
    some = raw.filter(~F.col("type").isin(NOISE_TYPES[:3])).select("doc", "page_idx", "i", body.alias("text")).filter("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n\n")
    return some.groupBy("doc", F.col("page_idx").alias("page")).agg(joined.alias("text"))


def listing(blocks: DataFrame, full: bool = False, keys: tuple[str, ...] = ("doc",), more: tuple[Column, ...] = ()) -> DataFrame:
    """The keys and listing: the blocks as a labeler reads them, a line each: [i] (type) text. full: whole texts, else 160 characters,
    tables 60. more: aggregates of the same blocks."""
    text = F.coalesce("text", F.lit(""))
    short = F.when(F.col("type") == "image", "<figure>").when(F.col("type").isin("table", "chart"), F.concat(F.lit("<table/chart> "), F.left(text, F.lit(60)))).otherwise(text)
    short = F.left(strip(F.regexp_replace(short, r"(?U)\s+", " ")), F.lit(160))
    whole = F.when(F.col("type") == "image", "<figure>").when(F.col("type").isin("table", "chart"), F.coalesce(F.nullif("table_body", F.lit("")), F.nullif(text, F.lit("")), F.lit("<figure>"))).otherwise(text)
    line = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] ("), F.col("type"), F.lit(") "), whole if full else short)
    row = F.struct(F.col("i"), line.alias("line"))
    rows = F.array_sort(F.collect_list(F.when(~F.col("type").isin(NOISE_TYPES[:3]), row) if full else row))
    return blocks.groupBy(*keys).agg(rows.alias("_rows"), *more).filter(F.size("_rows") > 0).withColumn("listing", F.array_join(F.transform("_rows", lambda x: x["line"]), "\n")).drop("_rows")


def heuristic_role(type_: Column, text: Column) -> Column:
    """The default labeler: figure, noise, q, part or body."""
    return F.when(type_.isin(MEDIA), "figure").when(type_.isin(NOISE_TYPES), "noise").when(text.rlike(r"^\d{1,3}[.\s)]"), "q").when(text.rlike(r"^\([a-z]\)"), "part").otherwise("body")


def heuristic_label(role: Column, text: Column) -> Column:
    return F.when(role == "q", F.regexp_extract(text, r"^(\d{1,3})", 1)).when(role == "part", F.regexp_extract(text, r"^(\([a-z]\))", 1))


def split_tables(blocks: DataFrame) -> DataFrame:
    """Numbered layout tables as the questions that they lay out; i is dealt anew, src_i kept, all other columns too.

    Each numbered row opens a question: a text block (hint q, the number as its label) of the cells over nearly the whole
    width, then one table of the rows that are left, hinted as options if nearly all of their first cells are letters or
    digits, as a figure else. Rows before the first number stay a table without a hint; spacer rows go; data tables stay as they are.
    """
    rows = blocks.withColumns({"_grid": parse_grid(F.coalesce("table_body", F.lit("")))}).withColumn("_width", grid_width(F.col("_grid")))
    full = F.greatest(F.lit(2), F.col("_width") - 1)
    said = lambda cells: F.exists(cells, lambda c: c["text"] != "")
    number = lambda r: F.nullif(F.regexp_extract(F.try_element_at(r, F.lit(1))["text"], QUESTION_CELL, 1), F.lit(""))
    asks = lambda r: (F.size(r) > 1) & number(r).isNotNull() & said(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))) & F.exists(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda c: c["colspan"] >= full)
    numbered = (F.col("type") == "table") & F.coalesce(F.exists("_grid", asks), F.lit(False))
    cells = "array<struct<text:string,colspan:int,rowspan:int>>"
    piece = f"struct<no:string,stem:array<string>,rest:array<{cells}>>"
    start = F.array(F.struct(F.lit(None).cast("string").alias("no"), F.array().cast("array<string>").alias("stem"), F.array().cast(f"array<{cells}>").alias("rest"))).cast(f"array<{piece}>")

    def step(a, r):
        return let(F.coalesce(asks(r), F.lit(False)), lambda opens: let(F.when(opens, F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r), lambda body: let(opened(a, r, opens), lambda own: F.concat(F.when(opens, a).otherwise(F.slice(a, 1, F.size(a) - 1)), F.array(filled(own, r, body))))))

    def opened(a, r, opens):
        fresh = F.struct(number(r).alias("no"), F.array().cast("array<string>").alias("stem"), F.array().cast(f"array<{cells}>").alias("rest"))
        return F.when(opens, fresh).otherwise(F.element_at(a, -1))

    def filled(own, r, body):
        wide = (F.size(body) == 1) & (body[0]["colspan"] >= full) & own["no"].isNotNull()
        return F.when(~said(body), own).when(wide, own.withField("stem", F.concat(own["stem"], F.array(body[0]["text"])))).otherwise(own.withField("rest", F.concat(own["rest"], F.array(r))))

    segments = F.aggregate("_grid", start, step)
    firsts = lambda g: F.transform(g, lambda r: r[0]["text"])
    keys = lambda g: F.size(F.filter(firsts(g), lambda x: x.rlike(r"^([A-H]|[1-9])\z")))
    hint = lambda g: F.when((keys(g) >= 2) & (keys(g) >= F.size(F.filter(firsts(g), lambda x: x != "")) - 1), "option").otherwise("figure")
    block = lambda type_, text, table, role, label: F.struct(F.lit(type_).alias("type"), text.alias("text"), table.alias("table_body"), role.alias("hint"), label.alias("label"))
    none, empty = F.lit(None).cast("string"), F.lit("")

    def blocks_of(x):
        question = block("text", F.concat(x["no"], F.lit(". "), F.array_join(x["stem"], " ")), none, F.lit("q"), x["no"])
        left = block("table", empty, render_grid(x["rest"]), F.when(x["no"].isNotNull(), hint(x["rest"])), none)
        return F.array_compact(F.array(F.when(x["no"].isNotNull(), question), F.when(F.size(x["rest"]) > 0, left)))

    pieces = F.flatten(F.transform(segments, blocks_of))
    same = F.array(F.struct("type", F.coalesce("text", F.lit("")).alias("text"), "table_body", none.alias("hint"), none.alias("label")))
    rest = [c for c in blocks.columns if c not in ("doc", "i", "type", "text", "table_body")]
    out = rows.select("doc", F.col("i").alias("src_i"), *rest, F.posexplode(F.when(numbered, pieces).otherwise(same)).alias("_n", "_piece"))
    order = W.partitionBy("doc").orderBy("src_i", "_n")
    return out.select("doc", (F.row_number().over(order) - 1).alias("i"), "src_i", *rest, "_piece.*")


def chunked(blocks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """blocks with chunk: each document's blocks in order of i, `chunk` at a time, those at a chunk's end in the next one as well if there is one."""
    doc = W.partitionBy("doc")
    at = blocks.withColumn("_at", F.row_number().over(doc.orderBy("i")) - 1).withColumn("_own", F.floor(F.col("_at") / chunk))
    at = at.withColumn("_last", F.max("_own").over(doc))
    next_ = (F.col("_at") % chunk >= chunk - overlap) & (F.col("_last") > F.col("_own"))
    return at.withColumn("chunk", F.explode(F.when(next_, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))).drop("_last")


def label_blocks(blocks: DataFrame, client: ModelClient | None = None, chunk: int = 90, overlap: int = 6, store: str | None = None) -> DataFrame:
    """blocks with role and label. Hints (columns hint and label) hold; without a client the heuristic decides the rest.

    A client reads each document's blocks in chunks, each but the first with the last blocks of the one before it; the
    first label of a block holds, a chunk with an unreadable reply falls back to the heuristic, gaps are body. store: a table of
    replies that later runs may read (see run_model).
    """
    by_rule = heuristic_role(F.col("type"), F.col("text"))
    ruled = blocks.withColumns({"role": F.coalesce("hint", by_rule), "label": F.when(F.col("hint").isNotNull(), F.col("label")).otherwise(heuristic_label(by_rule, F.col("text")))})
    if client is None:
        return ruled.drop("hint")
    # A chunk's row carries the chunk's own blocks, so replies meet them without moving any block: only the few that their own chunk's reply
    # leaves open are joined with the next chunk's. Nothing is sent whole to every executor, and nothing exploded is shuffled.
    names = [c for c in blocks.columns if c not in ("doc", "hint")] + ([] if "role" in blocks.columns else ["role"])
    own = F.col("_own") == F.col("chunk")
    edge = (F.col("_at") % chunk >= chunk - overlap).alias("_edge")
    more = (F.collect_list("i").alias("ids"), F.collect_list(F.when(~own, F.col("i"))).alias("seam"), F.collect_list(F.when(own, F.struct(*names, edge))).alias("own"))
    asked = listing(chunked(ruled.filter("hint is null"), chunk, overlap), keys=("doc", "chunk"), more=more)
    asked = asked.select("doc", "chunk", "ids", "seam", "own", F.to_json(F.struct("listing")).alias("_payload"))
    reply = run_model(asked, client, "label", F.col("_payload"), "array<struct<i:int,role:string,label:string>>", wrapped="labels", store=store)
    place = blocks.schema["i"].dataType
    reply = reply.withColumn("_said", F.transform("reply", lambda x: x["i"].cast(place)))
    out = [ruled.filter("hint is not null").select("doc", *names)]
    odd = kept(reply.filter(F.size(F.array_compact(F.array_except("_said", "ids"))) > 0).select("doc").distinct(), "odd-documents")
    if not odd.isEmpty():  # a reply that names blocks which its chunk hasn't: labels of such documents are looked for block by block
        same = F.col("doc").eqNullSafe(F.col("_odd"))
        odd = odd.withColumnRenamed("doc", "_odd").hint("merge")
        out.append(_labels_by_block(reply.join(odd, same, "left_semi"), names, place))
        reply = reply.join(odd, same, "left_anti")
    none, bad = F.lit(None).cast("string"), F.col("reply").isNull()
    at = lambda i: F.get("reply", (F.array_position("_said", i) - 1).cast("int"))
    labelled = lambda b, role, label, open_: F.struct(*((role if c == "role" else label if c == "label" else b[c]).alias(c) for c in names), open_.alias("_open"))

    def settled(b):
        said, rule = at(b["i"]), bad & b["i"].isNotNull()
        role = F.when(rule, b["role"]).otherwise(F.coalesce(said["role"], F.lit("body")))
        keep = F.when(rule, b["label"]).otherwise(said["label"])
        is_open = ~bad & b["_edge"] & said.isNull() & b["i"].isNotNull()
        return labelled(b, F.when(is_open, b["role"]).otherwise(role), F.when(is_open, b["label"]).otherwise(keep), is_open)

    each = reply.select("doc", (F.col("chunk") + 1).alias("chunk"), F.transform("own", settled).alias("own"))
    rows = lambda keep: each.select("doc", "chunk", F.explode(F.filter("own", keep)).alias("b")).select("doc", "chunk", *(F.col("b")[c].alias(c) for c in names))
    out.append(rows(lambda b: ~b["_open"]).select("doc", *names))
    seam = F.filter(F.transform(F.array_distinct("seam"), lambda i: F.struct(i.alias("i"), at(i).alias("said"))), lambda x: bad | x["said"].isNotNull())
    seam = reply.select(F.col("doc").alias("_d"), F.col("chunk").alias("_c"), bad.alias("_bad"), F.explode(seam).alias("x")).select("_d", "_c", "_bad", F.col("x.i").alias("_i"), F.col("x.said.role").alias("_role"), F.col("x.said.label").alias("_label"))
    met = rows(lambda b: b["_open"]).join(seam.hint("merge"), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("chunk") == F.col("_c")) & (F.col("i") == F.col("_i")), "left")
    role = F.when(F.col("_bad"), F.col("role")).otherwise(F.coalesce("_role", F.lit("body")))
    out.append(met.withColumns({"role": role, "label": F.when(F.col("_bad"), F.col("label")).when(~F.col("_bad"), F.col("_label")).otherwise(none)}).select("doc", *names))
    return reduce(DataFrame.unionByName, out).select("doc", "i", *(c for c in names if c != "i"))


def _labels_by_block(reply: DataFrame, names: list[str], place) -> DataFrame:
    """doc and names of chunks' own blocks with the first label that any reply of their document has for them: a join by block."""
    none = F.lit(None).cast("string")
    one = lambda i, role, label, bad: F.struct(i.cast(place).alias("i"), role.alias("role"), label.alias("label"), F.lit(bad).alias("bad"))
    each = F.when(F.col("reply").isNull(), F.transform("ids", lambda i: one(i, none, none, True))).otherwise(F.transform("reply", lambda x: one(x["i"], x["role"], x["label"], False)))
    read = reply.select("doc", "chunk", F.posexplode(each).alias("n", "x")).select("doc", "chunk", "n", "x.*").filter("i is not null")
    good = F.when(~F.col("bad"), F.struct("chunk", "n"))
    said = read.groupBy(F.col("doc").alias("_d"), F.col("i").alias("_i")).agg(F.min_by(F.struct("role", "label"), good).alias("said"), F.min(F.when(~F.col("bad"), F.col("chunk"))).alias("said_in"), F.min(F.when(F.col("bad"), F.col("chunk"))).alias("failed_in"))
    own = reply.select("doc", F.explode("own").alias("b")).select("doc", *(F.col("b")[c].alias(c) for c in names))
    all_ = own.join(said.hint("merge"), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("i") == F.col("_i")), "left")
    by_model = F.col("said_in").isNotNull() & (F.col("failed_in").isNull() | (F.col("said_in") <= F.col("failed_in")))
    role = F.when(by_model, F.coalesce("said.role", F.lit("body"))).when(F.col("failed_in").isNotNull(), F.col("role")).otherwise("body")
    label = F.when(by_model, F.col("said.label")).when(F.col("failed_in").isNotNull(), F.col("label"))
    return all_.withColumns({"label": label, "role": role}).select("doc", *names)


def number_blocks(labelled: DataFrame) -> DataFrame:
    """labelled (doc, i, type, role, label, text) with section, q_ord and part_ord of every block that counts.

    Sections carry forward; blocks before the first question form question 1's lead or, if there is a
    part among them or no question at all, an implicit question of their own (q_ord 0 otherwise).
    """
    doc = W.partitionBy("doc")
    upto = doc.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    b = labelled.filter("role <> 'noise'")
    heading = strip(F.regexp_replace(F.coalesce(F.nullif("label", F.lit("")), F.col("text")), r"(?U)\s+", " "))
    b = b.withColumn("section", F.last(F.when(F.col("role") == "section", heading), ignorenulls=True).over(upto)).filter("role <> 'section'")
    b = b.withColumn("q_ord", F.sum((F.col("role") == "q").cast("int")).over(upto))
    lead = F.col("q_ord") == 0
    implicit = F.max((lead & (F.col("role") == "part")).cast("int")).over(doc) + (F.max("q_ord").over(doc) == 0).cast("int") > 0
    b = b.withColumn("implicit", lead & implicit).withColumn("merged", lead & ~implicit)
    b = b.withColumn("q_ord", F.when(F.col("merged"), 1).otherwise(F.col("q_ord")))
    opens = (F.col("role") == "part") & ~F.col("type").isin(MEDIA)
    inside = W.partitionBy("doc", "q_ord").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    return b.withColumn("part_ord", F.sum(opens.cast("int")).over(inside))


def assemble(numbered: DataFrame) -> DataFrame:
    """One row a question: stem, parts, solutions, options text, block range, section and flags."""
    text = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("i", "text")))), lambda x: x["text"]), "\n")
    body = F.col("role").isin("q", "body", "figure", "part")
    q = numbered.groupBy("doc", "q_ord").agg(
        F.min_by("section", "i").alias("section"),
        F.min_by("label", F.when(F.col("role") == "q", F.col("i"))).alias("qno"),
        text(body & (F.col("part_ord") == 0)).alias("stem"), text(F.col("role") == "solution").alias("solution"), text(F.col("role") == "option").alias("options_text"),
        F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("blocks"),
        F.max("merged").alias("leading_content_merged"), F.max("implicit").alias("implicit_question_start"),
    )
    parts = numbered.filter(body & (F.col("part_ord") > 0)).groupBy("doc", "q_ord", "part_ord").agg(
        F.coalesce(F.min_by("label", F.when(F.col("role") == "part", F.col("i"))), F.concat(F.lit("("), F.char(96 + F.first("part_ord")), F.lit(")"))).alias("no"), text(F.lit(True)).alias("text")
    )
    parts = parts.groupBy("doc", "q_ord").agg(F.array_sort(F.collect_list(F.struct("part_ord", "no", "text"))).alias("parts"))
    return q.join(parts.hint("merge"), ["doc", "q_ord"], "left").withColumn("qid", F.format_string("%s-%03d", F.col("doc").cast("string"), F.row_number().over(W.partitionBy("doc").orderBy("q_ord")).cast("int")))


def questions(numbered: DataFrame) -> DataFrame:
    """One row a question of numbered blocks that have src_i, table_body, img_path, page_idx and bbox as well.

    doc, q_ord, position, qno, section, stem, parts (FLAT), options, solution, assets, pages, blocks, flags. Media stand in the
    text as HTML or as an image marker, and as assets; option blocks are read as options; printed numbers and part
    labels go; a question without a number has its position.
    """
    media = F.col("type").isin(MEDIA) & ~F.col("role").isin("option", "q")
    marker = F.when(blank(F.col("table_body")), F.concat(F.lit("![]("), F.coalesce("img_path", F.lit("")), F.lit(")"))).otherwise(F.col("table_body"))
    text = F.when(media, marker).when(F.col("role") == "q", strip_number(F.col("text"), F.col("label"))).when(F.col("role") == "part", strip(strip_part_label(F.col("text"), F.col("label")))).otherwise(F.col("text"))
    b = numbered.withColumns({"media": media, "line": text, "content": media | F.col("role").isin("q", "body", "figure", "part")})
    b = kept(b, "numbered-blocks")  # read twice, for questions and for their parts
    ordered = lambda keep, *fields: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("i", *fields)))), lambda x: x)
    lines = lambda keep: F.transform(ordered(keep & (F.col("line") != ""), "line"), lambda x: x["line"])
    join = lambda keep: strip(F.array_join(lines(keep), "\n"))
    none = F.lit(None).cast("string")
    opens = (F.col("role") == "part") & ~F.col("media")
    parts = b.filter(F.col("content") & (F.col("part_ord") > 0)).groupBy("doc", "q_ord", "part_ord").agg(
        F.coalesce(F.nullif(F.min_by("label", F.when(opens, F.col("i"))), F.lit("")), F.concat(F.lit("("), F.char(96 + F.first("part_ord")), F.lit(")"))).alias("no"), join(F.lit(True)).alias("text")
    )
    flat = F.struct("part_ord", "no", "text", F.lit(None).cast("int").alias("marks"), *(none.alias(c) for c in ("answer", "solution", "answer_area")))
    parts = parts.groupBy("doc", "q_ord").agg(F.array_sort(F.collect_list(flat)).alias("p"))
    parts = parts.select("doc", "q_ord", F.transform("p", lambda x: x.dropFields("part_ord")).alias("parts"))
    option = F.coalesce(F.nullif("table_body", F.lit("")), F.nullif("text", F.lit("")), F.lit(""))
    asset = F.struct("i", F.col("type").alias("kind"), F.coalesce("img_path", F.lit("")).alias("path"), F.lit("q").alias("src"), F.col("page_idx").cast("int").alias("page"), F.col("bbox").alias("bbox"))
    q = b.groupBy("doc", "q_ord").agg(
        F.min_by("section", "i").alias("section"), F.nullif(F.min_by("label", F.when(F.col("role") == "q", F.col("i"))), F.lit("")).alias("own_no"),
        join(F.col("content") & (F.col("part_ord") == 0)).alias("stem"), F.array_join(lines(F.col("role") == "solution"), "\n").alias("solution"),
        gather_options(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "option", F.struct("i", F.col("label").alias("label"), option.alias("src"))))), lambda x: x.dropFields("i"))).alias("options"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("media"), asset)), lambda x, y: F.when(x["i"] < y["i"], -1).otherwise(1)), lambda x: x.dropFields("i")).alias("assets"),
        F.array_sort(F.collect_set(F.col("page_idx").cast("int"))).alias("pages"), F.min_by("src_i", "i").cast("int").alias("lo"), F.max("src_i").cast("int").alias("hi"),
        F.max("merged").alias("merged"), F.max("implicit").alias("implicit"),
    )
    q = q.join(parts.hint("merge"), ["doc", "q_ord"], "left").withColumn("position", F.row_number().over(W.partitionBy("doc").orderBy("q_ord")))
    flags = F.array_compact(F.array(F.when(F.col("merged"), "leading_content_merged"), F.when(F.col("implicit"), "implicit_question_start")))
    return q.withColumns({"qno": F.coalesce("own_no", F.col("position").cast("string")), "section": F.coalesce("section", F.lit("")), "parts": F.coalesce("parts", F.array().cast(f"array<{FLAT}>")), "blocks": F.array("lo", "hi"), "flags": flags}).drop("own_no", "lo", "hi", "merged")


def dropped_blocks(blocks: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """Blocks (doc, i and any more columns) that no range (doc, first_i, last_i) of their document holds.

    A range anti join by bins of `width` places: a range is a row in each bin that it touches, and a block is compared with the
    ranges of its own bin only, however many its document has. Ranges of a bin are merged to the stretches that they cover first,
    so a bin holds at most width / 2 of them. Blocks without a place are in no range.
    """
    bin_ = lambda c: F.floor(F.col(c) / width)
    r = ranges.filter("first_i <= last_i").select(F.col("doc").alias("_d"), "first_i", "last_i", F.explode(F.sequence(bin_("first_i"), bin_("last_i"))).alias("_bin"))
    r = r.select("_d", "_bin", F.greatest("first_i", F.col("_bin") * width).alias("_a"), F.least("last_i", (F.col("_bin") + 1) * width - 1).alias("_z"))
    r = r.groupBy("_d", "_bin", "_a").agg(F.max("_z").alias("_z"))
    inside = W.partitionBy("_d", "_bin").orderBy("_a")
    before = F.max("_z").over(inside.rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("_new", F.coalesce(F.col("_a") > before + 1, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    r = r.groupBy("_d", "_bin", "_run").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    return blocks.withColumn("_at", bin_("i")).join(r.hint("merge"), (F.col("doc") == F.col("_d")) & (F.col("_at") == F.col("_bin")) & F.col("i").between(F.col("_a"), F.col("_z")), "left_anti").drop("_at")


def context_slice(pages: DataFrame, wanted: DataFrame, most: int = 6000) -> DataFrame:
    """wanted (doc, key, pages) with the text of its pages and the page after each, in order, cut at `most` characters."""
    need = wanted.select("doc", "key", F.explode(F.array_distinct(F.flatten(F.transform("pages", lambda p: F.array(p, p + 1))))).alias("page"))
    got = need.join(pages.select("doc", "page", "text"), ["doc", "page"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n")
    return got.groupBy("doc", "key").agg(F.left(joined, F.lit(most)).alias("context"))
