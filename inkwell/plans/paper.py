"""Queries of the record build, the bank's changes, the worksheet's cart and the model steps.

Papers are made of rows of `part`: two questions each, with parts, marks, an image, a layout table and an answer key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, options, text, tree
from ..functions import parts as part_functions
from ..operators import bank, build, edits, model, records, segment, worksheet
from ..sources import incremental
from ..sources import records as sources
from ..tables import folder, kept
from .registry import query, t


def _raw_blocks(spark, sf_dir):
    """The blocks of a paper a part: a running head, a question with two parts and an image, a layout table with options."""
    c, lit = F.col, F.lit
    table = F.concat(lit('<table><tr><td>2.</td><td colspan="3">Pick the '), c("p_type"), lit("</td></tr><tr><td>A</td><td>"), c("p_name"), lit("</td></tr><tr><td>B</td><td>"), c("p_brand"), lit("</td></tr></table>"))
    none = lit(None).cast("string")
    block = lambda type_, text_, table_=none, image=none, page=0: F.struct(lit(type_).alias("type"), text_.alias("text"), table_.alias("table_body"), none.alias("code_body"), image.alias("img_path"), lit(page).alias("page_idx"), F.array(lit(0.0), lit(200.0 if type_ != "header" else 20.0), lit(1000.0), lit(300.0 if type_ != "header" else 60.0)).alias("bbox"))
    blocks = F.array(
        block("header", lit("Running head of the paper")), block("text", F.concat(lit("1. About "), c("p_name"), lit(" [Total: "), c("p_size").cast("string"), lit("]"))), block("text", F.concat(lit("(a) Name "), c("p_brand"), lit(" $1 2$ [3]"))),
        block("image", none, image=F.concat(lit("f"), c("p_partkey").cast("string"), lit(".png")), page=1), block("text", F.concat(lit("(b) Size of "), c("p_type"), lit("\n\n____ km")), page=1), block("table", none, table_=table, page=2),
    )
    return t(spark, sf_dir, "part").select(c("p_partkey").alias("doc"), F.posexplode(blocks).alias("i", "b")).select("doc", "i", "b.*")


def _labelled(spark, sf_dir):
    return segment.label_blocks(segment.split_tables(segment.load_blocks(_raw_blocks(spark, sf_dir))))


def _papers(spark, sf_dir, labelled):
    key = lambda qno, answer: F.struct(F.lit(qno).alias("qno"), answer.alias("answer"))
    keys = F.array(key("1", F.concat(F.lit("(a) "), F.col("p_brand"), F.lit("; (b) "), F.col("p_size").cast("string"), F.lit(" km"))), key("2", F.lit("B")))
    answers = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.posexplode(keys).alias("ord", "k")).select("doc", "ord", F.lit("").alias("section"), "k.qno", F.lit("").alias("part"), "k.answer", F.lit(None).cast("string").alias("solution"))
    return build.build_entries(segment.questions(segment.number_blocks(labelled)), answers)


@query("""SELECT p_partkey AS doc, p_partkey || '-001' AS qid, 'question' AS kind, 'About ' || p_name AS stem, p_size AS marks, '' AS options, NULL AS answer,
 'Name ' || p_brand || ' $12$ [3]' || chr(10) || '![](f' || p_partkey || '.png)|Size of ' || p_type AS texts, '(a)|(b)' AS paths, p_brand || '|' || p_size || ' km' AS answers, '[ANSWER] km' AS areas, 1 AS imgs, '0,1' AS pages, '1,4' AS blocks, 'no_solution' AS flags FROM part
UNION ALL SELECT p_partkey, p_partkey || '-002', 'mcq', 'Pick the ' || p_type, NULL, '(1) ' || p_name || '|(2) ' || p_brand, '(2)', '', '', '', '', 0, '2', '5,5', 'no_solution' FROM part""")
def build_entries(spark, sf_dir):
    e = _papers(spark, sf_dir, _labelled(spark, sf_dir))
    bars = lambda f: F.array_join(F.transform("parts", f), "|")
    return e.select(
        "doc", "qid", "kind", "stem", F.col("meta.marks").alias("marks"), F.array_join(F.transform("options", lambda o: F.concat_ws(" ", o["label"], o["value"])), "|").alias("options"), F.col("answer.value").alias("answer"), bars(lambda p: p["text"]).alias("texts"), bars(lambda p: p["path"]).alias("paths"),
        bars(lambda p: p["answer"]).alias("answers"), bars(lambda p: p["answer_area"]).alias("areas"), F.size("imgs").alias("imgs"), F.array_join(F.col("meta.pages").cast("array<string>"), ",").alias("pages"), F.array_join(F.col("meta.blocks").cast("array<string>"), ",").alias("blocks"), F.array_join("flags", ",").alias("flags"),
    )


@query("SELECT p_partkey AS doc, 2 AS questions, 0 AS with_solution, 2 AS with_answer, 1 AS mcq, 2 AS flagged, 5 AS blocks_content, 0 AS blocks_dropped, 2 AS unsolved FROM part")
def segment_report(spark, sf_dir):
    labelled = kept(_labelled(spark, sf_dir), "labelled")  # read for the papers and for the report
    r = build.report(_papers(spark, sf_dir, labelled), labelled)
    return r.select("doc", "questions", "with_solution", "with_answer", "mcq", "flagged", "blocks_content", "blocks_dropped", F.col("flags")["no_solution"].alias("unsolved"))


@query("""SELECT p_partkey AS doc, 0 AS page, '1. About ' || p_name || ' [Total: ' || p_size || ']' || chr(10) || chr(10) || '(a) Name ' || p_brand || ' $1 2$ [3]' AS text FROM part
UNION ALL SELECT p_partkey, 1, '![](f' || p_partkey || '.png)' || chr(10) || chr(10) || '(b) Size of ' || p_type || chr(10) || chr(10) || '____ km' FROM part
UNION ALL SELECT p_partkey, 2, '<table><tr><td>2.</td><td colspan="3">Pick the ' || p_type || '</td></tr><tr><td>A</td><td>' || p_name || '</td></tr><tr><td>B</td><td>' || p_brand || '</td></tr></table>' FROM part""")
def page_texts(spark, sf_dir):
    return segment.page_texts(_raw_blocks(spark, sf_dir).filter("type <> 'header'"))


@query("""SELECT p_partkey AS doc, '[1] (text) 1. About ' || p_name || ' [Total: ' || p_size || ']' || chr(10) || '[2] (text) (a) Name ' || p_brand || ' $12$ [3]' || chr(10) || '[3] (image) <figure>' || chr(10) || '[4] (text) (b) Size of ' || p_type || ' ____ km' || chr(10)
|| '[5] (table) ' || left('<table/chart> ' || left('<table><tr><td>2.</td><td colspan="3">Pick the ' || p_type || '</td></tr><tr>', 60), 160) AS listing FROM part""")
def block_listing(spark, sf_dir):
    return segment.listing(segment.load_blocks(_raw_blocks(spark, sf_dir)))


@query("""SELECT p_partkey AS doc, 5 AS i, 'text' AS type, '2. Pick the ' || p_type AS text, NULL AS table_body, 'q' AS hint, '2' AS label FROM part
UNION ALL SELECT p_partkey, 6, 'table', '', '<table><tr><td>A</td><td>' || p_name || '</td></tr><tr><td>B</td><td>' || p_brand || '</td></tr></table>', 'option', NULL FROM part""")
def split_layout_tables(spark, sf_dir):
    b = segment.split_tables(segment.load_blocks(_raw_blocks(spark, sf_dir)).withColumn("i", F.col("i")))
    return b.filter("src_i = 5").select("doc", (F.col("i") + 1).alias("i"), "type", "text", "table_body", "hint", "label")


class _ListingLabeler:
    """A labeler that reads the listing: a number opens a question, brackets a part; nothing else is labelled."""

    def reply(self, task, payload):
        import re

        rows = [(int(i), line) for i, line in re.findall(r"(?m)^\[(\d+)\] \(text\) (.*)$", payload["listing"])]
        return {"labels": [{"i": i, "role": "q", "label": m[1]} for i, line in rows if (m := re.match(r"(\d+)\. ", line))] + [{"i": i, "role": "part", "label": line[:3]} for i, line in rows if line.startswith("(")]}


@query("""SELECT doc, i, CASE WHEN i % 3 = 0 THEN 'q' WHEN i % 3 = 1 THEN 'part' ELSE 'body' END AS role, CASE WHEN i % 3 = 0 THEN (i + 1)::VARCHAR WHEN i % 3 = 1 THEN '(a)' END AS label
FROM (SELECT DISTINCT l_orderkey AS doc FROM lineitem) o, range(0, 200) r(i)""")
def label_chunks(spark, sf_dir):
    """A document of 200 blocks for every order, three chunks each; every block gets its label, those on the seams once."""
    # By the keys' few bytes they would be one task, of 200 times the rows; a repartition after distinct() would be optimized away.
    docs = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc").distinct()
    line = lambda i: F.when(i % 3 == 0, F.concat((i + 1).cast("string"), F.lit(". of order "), F.col("doc").cast("string"))).when(i % 3 == 1, "(a) part").otherwise("body")
    b = docs.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("i"))
    b = b.select("doc", "i", F.lit("text").alias("type"), line(F.col("i")).alias("text"), F.lit(None).cast("string").alias("table_body"), F.lit(None).cast("string").alias("hint"), F.lit(None).cast("string").alias("label"))
    return segment.label_blocks(b, _ListingLabeler()).select("doc", "i", "role", "label")


# ---- part trees and texts


@query("""WITH v(ord, need, path, no, parent_path, depth) AS (VALUES (0, 1, '(a)', '(a)', NULL, 1), (1, 2, '(b)', '(b)', NULL, 1), (2, 3, '(b)(i)', '(i)', '(b)', 2), (3, 4, '(b)(ii)', '(ii)', '(b)', 2), (-1, 5, '(c)', '(c)', NULL, 1), (4, 5, '(c)(i)', '(i)', '(c)', 2), (5, 6, '(c)(ii)', '(ii)', '(c)', 2))
SELECT p_partkey, path, no, parent_path, depth, ord FROM part JOIN v ON need <= p_partkey % 6 + 1""")
def nest_parts(spark, sf_dir):
    names = F.array(*map(F.lit, ["(a)", "(b)", "(i)", "(ii)", "(c)(i)", "(c)(ii)"]))
    p = t(spark, sf_dir, "part").select("p_partkey", F.explode(tree.nest_parts(F.slice(names, 1, (F.col("p_partkey") % 6 + 1).cast("int")))).alias("p"))
    return p.select("p_partkey", "p.*")


_TRIMMED = "regexp_replace(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ';'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, 1 + ({_TRIMMED} <> '')::INT AS parts, md5('x' || doc_id || CASE WHEN {_TRIMMED} <> '' THEN '|' || {_TRIMMED} ELSE '' END) AS texts FROM documents")
def split_by_parts(spark, sf_dir):
    packed = F.concat(F.lit("(a) x"), F.col("doc_id").cast("string"), F.lit("; (b) "), F.col("text"))
    s = tree.split_by_parts(packed, F.array(F.lit("(a)"), F.lit("(b)")))
    return t(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s.parts").alias("parts"), F.md5(F.array_join(F.col("s.parts.text"), "|")).alias("texts"))


@query("""SELECT p_partkey, '(b)|(b)(i)|(b)(ii)' AS paths, 'Do|' || p_name || '|' || p_brand AS texts, CASE WHEN p_size BETWEEN 1 AND 99 THEN p_size END AS marks FROM part""")
def inline_parts(spark, sf_dir):
    raw = F.concat(F.lit("Do\n(i) "), F.col("p_name"), F.lit(" ["), F.col("p_size").cast("string"), F.lit("]\n(ii) "), F.col("p_brand"))
    none = F.lit(None).cast("string")
    flat = F.array(F.struct(F.lit("b.").alias("no"), raw.alias("text"), F.lit(None).cast("int").alias("marks"), *(none.alias(c) for c in ("answer", "solution", "answer_area"))))
    p = t(spark, sf_dir, "part").select("p_partkey", tree.finalize_parts(flat).alias("p"))
    return p.select("p_partkey", F.array_join("p.path", "|").alias("paths"), F.array_join("p.text", "|").alias("texts"), F.col("p")[1]["marks"].alias("marks"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'verdict-token value Fixed' END AS error, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat_ws(',', CASE WHEN doc_id % 4 = 1 THEN 'stem_qno' END, CASE WHEN doc_id % 4 = 2 THEN 'unit_note_review' END, CASE WHEN (length(replace(text, '\\$', '')) - length(replace(replace(text, '\\$', ''), '$', '')) + (doc_id % 4 = 3)::INT) % 2 = 1 OR length(replace(text, '{', '')) <> length(replace(text, '}', '')) THEN 'latex_suspect' END) END AS soft FROM documents")
def lint_fields(spark, sf_dir):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, " Fixed ").when(k == 1, F.concat(F.lit("12. "), "text")).when(k == 2, F.concat(F.col("text"), F.lit(" (Give your answer in 3 or 4 units of.)"))).otherwise(F.concat("text", F.lit(" $5")))
    out = text.lint_field(F.array(raw), is_stem=True)
    return t(spark, sf_dir, "documents").select("doc_id", out.alias("x")).select("doc_id", "x.error", F.array_join("x.soft", ",").alias("soft"))


@query("SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 5 = 0 THEN ' as shown' WHEN doc_id % 5 = 1 THEN ' cabinet ' ELSE '' END, '(?i)\\b(graph|figure|fig\\.|diagram|shown below|as shown|the table below|the diagram|the graph|net|nets|below shows)\\b') OR doc_id % 7 = 0 AS needs FROM documents")
def needs_images(spark, sf_dir):
    stem = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " as shown").when(F.col("doc_id") % 5 == 1, " cabinet ").otherwise(""))
    imgs = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("a.png"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<struct<depth:int,text:string>>")
    return t(spark, sf_dir, "documents").select("doc_id", text.needs_images(imgs, stem, none, F.array().cast("array<struct<label:string,value:string>>")).alias("needs"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'B, C' WHEN 1 THEN 'A' ELSE 'B, x' END AS letters, CASE p_partkey % 3 WHEN 0 THEN '(2), (3)' WHEN 1 THEN '(1)' ELSE 'B, x' END AS numbers FROM part")
def answer_display(spark, sf_dir):
    opts = F.array(*(F.struct(F.lit(f"({i + 1})").alias("label"), F.col(c).alias("value")) for i, c in enumerate(("p_name", "p_brand", "p_type"))))
    k = F.col("p_partkey") % 3
    answer = F.when(k == 0, "(2) 3").when(k == 1, "1").otherwise("B, x")
    return t(spark, sf_dir, "part").select("p_partkey", options.answer_display(opts, answer, "letter_bare").alias("letters"), options.answer_display(opts, answer, "num_paren").alias("numbers"))


@query("SELECT p_partkey, 'A=' || p_name || '|B=' || p_brand || '|C=' || p_type AS found FROM part")
def table_options(spark, sf_dir):
    cell = lambda v: F.concat(F.lit("<td>"), v, F.lit("</td>"))
    html_ = F.concat(F.lit("<table><tr>"), cell(F.lit("A")), cell(F.col("p_name")), F.lit("</tr><tr>"), cell(F.concat(F.lit("B. "), "p_brand")), cell(F.concat(F.lit("C) <b>"), F.col("p_type"), F.lit("</b>"))), F.lit("</tr></table>"))
    o = options.parse_options(html_)
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(o, lambda x: F.concat_ws("=", x["label"], x["value"])), "|").alias("found"))


@query("SELECT p_partkey, p_name AS part, p_brand AS stem, '7.2 of ' || p_type AS shown, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand || ' ' || p_type END AS stem_text FROM part")
def labels_off(spark, sf_dir):
    c = F.col
    shown = text.subst_placeholders(F.concat(F.lit("[QN].2 of "), c("p_type")), F.lit(7))
    pair = F.array(F.struct(c("p_brand").alias("text")), F.struct(c("p_type").alias("text")))
    return t(spark, sf_dir, "part").select(
        "p_partkey", text.strip_part_label(F.concat(F.lit("(ii) "), c("p_name")), F.when(c("p_partkey") % 2 == 0, "(ii)")).alias("part"), text.strip_number(F.concat(F.lit("12) "), c("p_brand")), F.lit("12")).alias("stem"), shown.alias("shown"),
        tree.stem_text(F.when(c("p_partkey") % 2 == 0, c("p_name")).otherwise(" "), pair).alias("stem_text"),
    )


@query("SELECT p_partkey, 'a' || p_size || '|b' || p_partkey AS rows FROM part")
def math_rows(spark, sf_dir):
    formula = F.concat(F.lit("$\\begin{aligned}a"), F.col("p_size").cast("string"), F.lit(" \\\\ b"), F.col("p_partkey").cast("string"), F.lit("\\\\\\end{aligned}$"))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.math_rows(formula), "|").alias("rows"))


@query("SELECT page_id, md5(html) AS page, '<table><tr><td colspan=\"2\">' || page_id || '</td><td>x</td></tr></table>' AS shown, 'a' || page_id || chr(10) || 'b' AS lines FROM pages")
def grid_render(spark, sf_dir):
    id_ = F.col("page_id").cast("string")
    grid = html.parse_grid(F.concat(F.lit("<table><tr><td colspan='2'>"), id_, F.lit("</td><td> x </td></tr></table>")))
    return t(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("page"), html.render_grid(grid).alias("shown"), html.cell_text(F.concat(F.lit("a"), id_, F.lit("<br/> b ")), lines=True).alias("lines"))


# ---- the bank


def _stages(spark, sf_dir):
    """Documents as entries of files (a file a source and day of the week), in up to three stages."""
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("qid"), (F.col("doc_id") % 7).cast("string").alias("file_stem"), F.col("source"), F.length("text").alias("n"), F.explode(F.array(*map(F.lit, bank.STAGES))).alias("pipeline_stage"))
    some = ~((F.col("pipeline_stage") == "tagged") & (F.col("file_stem") == "3"))
    place = {"subject": F.lit("s"), "stage": F.lit("t"), "level": F.lit("l")}
    fields = {
        "stem": F.concat_ws(":", "pipeline_stage", "qid"), "parts": F.array().cast("array<struct<path:string,text:string>>"), "options": F.array(*(F.struct(F.lit(k).alias("label"), F.lit(v).alias("value")) for k, v in (("B", "two"), ("A", "one")))),
        "answer": F.struct(F.lit("B").alias("value"), F.lit("answer_key").alias("kind")), "flags": F.when(F.col("n") % 2 == 0, F.array(F.lit("verified"))).otherwise(F.array().cast("array<string>")), "tags": F.struct(F.array("source").alias("topic"), F.lit("").alias("type"), F.lit("medium").alias("difficulty")),
    }
    return d.withColumns(place).filter(some).withColumns(fields).drop("n")


def _versions(entries):
    """The clean stage of files 0 and 1 is older than the raw one."""
    stale = (F.col("pipeline_stage") != "raw") & F.col("file_stem").isin("0", "1")
    rank = F.when(F.col("pipeline_stage") == "raw", 5).when(stale, 1).otherwise(9)
    return entries.select(*bank.COORDINATES, "file_stem", "pipeline_stage").distinct().withColumn("version", rank)


_LIVE = "CASE WHEN doc_id % 7 < 2 THEN 'raw' WHEN doc_id % 7 = 3 THEN 'clean' ELSE 'tagged' END"


@query(f"SELECT doc_id::VARCHAR AS qid, {_LIVE} AS stage, {_LIVE} || ':' || doc_id AS stem, {_LIVE} <> 'raw' AS cleaned, '(1) one|(2) two' AS options, '(2)' AS answer, 12 AS rev FROM documents")
def bank_live(spark, sf_dir):
    e = _stages(spark, sf_dir)
    out = bank.bank_entries(sources.sources_of(e, "s", "t"), _versions(e))
    shown = F.array_join(F.transform("options", lambda o: F.concat_ws(" ", o["label"], o["value"])), "|")
    return out.select("qid", F.col("pipeline_stage").alias("stage"), "stem", "cleaned", shown.alias("options"), F.col("answer.value").alias("answer"), F.length("rev").alias("rev"))


@query("SELECT doc_id::VARCHAR AS qid, 'clean' AS pipeline_stage FROM documents")
def taggable_rows(spark, sf_dir):
    return bank.taggable(_stages(spark, sf_dir)).select("qid", "pipeline_stage")


@query("SELECT string_agg(n_nationkey || ' | ' || n_name || ' | kw: ' || r_name || ', ' || n_name, chr(10) ORDER BY n_nationkey::VARCHAR) AS menu FROM nation JOIN region ON r_regionkey = n_regionkey")
def topic_menu(spark, sf_dir):
    tax = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return bank.topic_menu(tax.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name_en"), F.array("r_name", "n_name").alias("keywords")))


@query("SELECT c_mktsegment AS source, c_custkey % 100 AS qid, c_custkey // 100 AS file_stem, n_name || '|none' AS names FROM customer JOIN nation ON n_nationkey = c_nationkey")
def topic_names(spark, sf_dir):
    """Customers as entries whose qids are the same in every file."""
    e = t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("source"), F.floor(F.col("c_custkey") / 100).alias("file_stem"), (F.col("c_custkey") % 100).alias("qid"), F.array(F.col("c_nationkey").cast("string"), F.lit("none")).alias("topics"))
    tax = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name_en"))
    return bank.with_names(e, tax).select("source", "file_stem", "qid", F.array_join("topic_names", "|").alias("names"))


@query("SELECT doc_id AS qid, coalesce(n, 0) AS uses, doc_id % 10 = 3 AS in_cart FROM documents LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = doc_id")
def usage_marks(spark, sf_dir):
    usage = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("qid")).agg(F.count("*").alias("count"), F.max("ts").alias("last"))
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"))
    return bank.with_usage(d, usage, d.filter("qid % 10 = 3")).select("qid", "uses", "in_cart")


@query("SELECT p_partkey AS qid, CASE WHEN p_partkey % 3 = 0 THEN 'second' WHEN p_partkey % 3 = 1 THEN 'first' END AS dir FROM part")
def image_folders(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    e = p.select(F.col("p_partkey").alias("qid"), F.lit("s").alias("source"), F.array(F.struct("path")).alias("imgs"))
    files = p.filter("p_partkey % 3 < 2").select(F.explode(F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit("second"), F.lit("first"))).otherwise(F.array(F.lit("second")))).alias("dir"), "path")
    dirs = p.sparkSession.createDataFrame([("s", "first", 1), ("s", "second", 2)], "source string, dir string, dir_ord int")
    return bank.resolve_images(e, files, dirs).select("qid", "dir")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'own ' || n_nationkey WHEN n_nationkey % 3 = 1 THEN 'base ' || n_nationkey ELSE 'generic' END AS style FROM nation")
def solution_styles(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("subject"), F.lit("x").alias("stage"))
    style = lambda word, keep: n.filter(keep).select("subject", "stage", F.when(F.col("n_nationkey") % 3 == 2, " ").otherwise(F.concat(F.lit(word), "subject")).alias("style"))
    return bank.solution_style(n, style("own ", "n_nationkey % 3 <> 1"), style("base ", "n_nationkey % 3 < 2"), "generic").select("n_nationkey", "style")


@query("SELECT doc_id AS qid, md5('{\"qid\":' || doc_id || ',\"kind\":\"question\",\"stem\":\"s' || doc_id || '\",\"parts\":[{\"no\":\"(a)\",\"text\":\"t\"}]}') AS view FROM documents")
def entry_views(spark, sf_dir):
    none = F.lit(None).cast("string")
    e = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.lit("question").alias("kind"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("stem"), F.array().cast("array<struct<label:string,value:string>>").alias("options"), none.alias("answer"), none.alias("solution"), F.array(F.struct(F.lit("(a)").alias("path"), F.lit("t").alias("text"))).alias("parts"))
    return bank.edit_view(e).select("qid", F.md5("view").alias("view"))


# ---- changes


def _log(spark, sf_dir):
    """Events as a log of entries: user as key, time order as version, errors as deletions."""
    e = t(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("stem"))


def _editable(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    img = "array<struct<kind:string,path:string,src:string,page:int,bbox:array<double>>>"
    e = d.select(
        F.col("doc_id").alias("qid"), F.lit("question").alias("kind"), F.lit("old").alias("stem"), F.array().cast(f"array<{tree.PART}>").alias("parts"), F.array().cast("array<struct<pos:int,label:string,value:string>>").alias("options"), F.lit(None).cast(build.ANSWER).alias("answer"),
        F.lit(None).cast("string").alias("answer_area"), F.lit(None).cast("string").alias("solution"), F.array().cast(img).alias("imgs"), F.struct(F.lit(None).cast("int").alias("marks")).alias("meta"), F.array(F.lit("no_answer"), F.lit("keep")).alias("flags"), F.struct(F.array("lang").alias("topic"), F.lit("legacy").alias("type"), F.lit("medium").alias("difficulty")).alias("tags"),
    )
    return bank.with_revision(e)


@query("""WITH sent AS (SELECT doc_id AS qid, lang, unnest([1, 2, 3]) AS seq FROM documents),
told AS (SELECT *, CASE WHEN qid % 5 = 3 AND seq = 1 THEN 'bad type' WHEN qid % 5 = 2 AND seq < 3 THEN 'changed since' WHEN qid % 5 = 0 AND seq = 2 THEN 'changed since' END AS refused FROM sent),
counted AS (SELECT *, (count(*) FILTER (refused IS NULL) OVER (PARTITION BY qid ORDER BY seq))::INT AS n FROM told)
SELECT qid, seq, refused, CASE WHEN refused IS NULL THEN 'New ' || qid || ' ' || seq END AS stem, CASE WHEN refused IS NULL THEN '4' END AS marks, CASE WHEN refused IS NULL THEN 'x' || qid || '|y' END AS answers,
  CASE WHEN refused IS NULL THEN 'keep,human_edited' END AS flags, CASE WHEN refused IS NULL THEN CASE WHEN qid % 5 = 1 THEN 'legacy' WHEN qid % 5 = 3 AND seq = 2 THEN 'legacy' WHEN qid % 5 = 3 THEN 'short_answer' ELSE 'mcq' END END AS type,
  CASE WHEN refused IS NULL THEN CASE WHEN qid % 5 = 4 AND seq > 1 THEN 'own' ELSE lang END END AS topic, CASE WHEN refused IS NULL THEN 1 + n END AS version
FROM counted""")
def save_edits(spark, sf_dir):
    """Three edits an entry. By qid mod 5: 0: all have the live rev, but the last has none; 1: without revs; 2: the first two have a wrong rev; 3: the
    first has a bad type; the next, of the live rev, no type; the last a type and no rev; 4: without revs, the second gives a topic and the last keeps it."""
    live = _editable(spark, sf_dir)
    k, id_, seq = F.col("qid") % 5, F.col("qid").cast("string"), F.col("seq")
    part = lambda no, s: F.struct(F.lit(no).alias("no"), F.lit(s).alias("text"))
    none = F.lit(None).cast("string")
    type_ = F.when((k == 3) & (seq == 1), "nonsense").when((k == 3) & (seq == 3), "short_answer").when(k == 3, none).when(k == 1, "legacy").otherwise("mcq")
    edit = F.struct(
        F.concat(F.lit("New "), id_, F.lit(" "), seq.cast("string"), F.lit(" [Total: 4]")).alias("stem"), none.alias("solution"), F.lit(None).cast("map<string,string>").alias("options"), F.concat(F.lit("(a) x"), id_, F.lit("; (b) y")).alias("answer"), none.alias("answer_area"),
        F.array(part("(a)", "one"), part("b)", "two"), part("c", " ")).alias("parts"), type_.alias("type"), F.when((k == 4) & (seq == 2), F.array(F.lit("own"))).alias("topic"), none.alias("difficulty"),
    )
    rev = F.when((k == 2) & (seq < 3), "0123456789ab").when((seq < 3) & k.isin(0, 3), F.col("rev"))
    sent = live.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("qid", "seq", rev.alias("rev"), edit.alias("edit"))
    rows, refused = edits.save_edits(live, sent, ["qid"], ["mcq", "short_answer"], 2)
    saved = rows.select("qid", "seq", "stem", F.col("meta.marks").cast("string").alias("marks"), F.array_join("parts.answer", "|").alias("answers"), F.array_join("flags", ",").alias("flags"), F.col("tags.type").alias("type"), F.array_join("tags.topic", ",").alias("topic"), "version")
    both = refused.withColumnRenamed("reason", "refused").unionByName(saved, allowMissingColumns=True)
    return both.select("qid", "seq", "refused", "stem", "marks", "answers", "flags", "type", "topic", "version")


@query("""WITH used AS (SELECT DISTINCT doc_id * 2 AS n FROM documents WHERE doc_id > 0), free AS (SELECT n, row_number() OVER (ORDER BY n) AS r FROM range(1, (SELECT count(*) FROM used) + (SELECT count(*) FROM nation) + 1) x(n) WHERE n NOT IN (SELECT n FROM used))
SELECT n_nationkey AS ord, 'manual-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS qid FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) JOIN free USING (r)""")
def add_entries(spark, sf_dir):
    held = t(spark, sf_dir, "documents").filter("doc_id > 0").select(F.concat(F.lit("manual-"), (F.col("doc_id") * 2).cast("string")).alias("qid"))
    return edits.assign_manual(t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord")), held).select("ord", "qid")


@query("""SELECT user_id AS qid, CASE WHEN user_id % 3 = 0 THEN NULL ELSE last END AS stem FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY 1) WHERE user_id % 3 <> 0 AND last <> 'error'""")
def deleted_entries(spark, sf_dir):
    log = _log(spark, sf_dir)
    gone = edits.tombstones(log.filter("qid % 3 = 0").select("qid").distinct(), 1 << 40).withColumn("stem", F.lit(None).cast("string"))
    return records.current(log.unionByName(gone.select(*log.columns)), ["qid"]).select("qid", "stem")


@query("SELECT event_id AS id, event_type AS source FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 200")
def journal_window(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("source"))
    return edits.journalled(e.filter("id % 2 = 0"), e.filter("id % 2 = 1")).select("id", "source")


@query("""SELECT event_type AS source, user_id AS qid, arg_max(value, {'ts': ts, 'id': event_id}) AS content FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2""")
def restorable(spark, sf_dir):
    j = t(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("qid"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("after"))
    return edits.restorable(j).select("source", "qid", "content")


@query("""WITH e AS (SELECT source, doc_id // 20 AS qid, doc_id % 20 AS file_stem, unnest(CASE WHEN doc_id % 20 = 1 THEN ['raw'] ELSE ['raw', 'clean'] END) AS pipeline_stage, doc_id, lang AS tags FROM documents),
held AS (SELECT * FROM e WHERE qid % 3 <> 0), files AS (SELECT DISTINCT source, file_stem, pipeline_stage FROM held)
SELECT source, file_stem, qid, pipeline_stage, CASE WHEN doc_id % 2 = 0 THEN 'then' ELSE 'now' END || doc_id AS content, tags FROM held
UNION ALL SELECT d.source, f.file_stem, d.doc_id // 20, f.pipeline_stage, 'then' || d.doc_id, NULL FROM documents d JOIN files f ON f.source = d.source AND f.file_stem = d.doc_id % 20 WHERE (d.doc_id // 20) % 3 = 0 AND d.doc_id % 2 = 0""")
def restored_entries(spark, sf_dir):
    """Twenty files a source whose qids are the same; file 1 has a raw stage only. Entries of even doc_ids are restored, a third of which were deleted."""
    d = t(spark, sf_dir, "documents").withColumns({"qid": F.floor(F.col("doc_id") / 20), "file_stem": F.col("doc_id") % 20})
    named = lambda word: F.concat(F.lit(word), F.col("doc_id").cast("string")).alias("content")
    has = F.when(F.col("file_stem") == 1, F.array(F.lit("raw"))).otherwise(F.array(F.lit("raw"), F.lit("clean")))
    stages = d.filter("qid % 3 <> 0").select("source", "file_stem", "qid", F.explode(has).alias("pipeline_stage"), named("now"), F.col("lang").alias("tags"))
    return edits.restore_entries(stages, d.filter("doc_id % 2 = 0").select("source", "file_stem", "qid", named("then")))


@query(f"""WITH s AS (SELECT doc_id::VARCHAR AS qid, s AS pipeline_stage, CASE WHEN {_LIVE} = 'raw' THEN length(text) % 2 = 0 ELSE length(text) % 4 < 2 END AS live, CASE WHEN s = 'raw' THEN length(text) % 2 = 0 ELSE length(text) % 4 < 2 END AS own, doc_id % 2 = 0 AS turned
FROM documents, (VALUES ('raw'), ('clean'), ('tagged')) v(s) WHERE NOT (s = 'tagged' AND doc_id % 7 = 3))
SELECT qid, pipeline_stage, CASE WHEN turned THEN NOT live ELSE own END AS verified FROM s""")
def verified_flags(spark, sf_dir):
    """Stages that disagree about the flag: each file's live stage decides."""
    s = _stages(spark, sf_dir).join(t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("qid"), F.length("text").alias("n")), "qid")
    later = F.when(F.col("n") % 4 < 2, F.array(F.lit("verified"))).otherwise(F.array().cast("array<string>"))
    s = s.withColumn("flags", F.when(F.col("pipeline_stage") == "raw", F.col("flags")).otherwise(later)).drop("n")
    stages = _versions(s).select(F.struct(*bank.COORDINATES, "file_stem").alias("doc"), F.col("pipeline_stage").alias("stage"), "version")
    live = bank.live_stage(stages).select("doc.*", F.col("stage").alias("pipeline_stage"))
    turned = edits.verified(s, s.select("qid").filter("cast(qid as long) % 2 = 0"), live)
    return turned.select("qid", "pipeline_stage", F.array_contains("flags", "verified").alias("verified"))


@query("""SELECT doc_id::VARCHAR AS qid, s AS pipeline_stage, 'kept' AS fate FROM documents, (VALUES ('raw'), ('clean'), ('tagged')) v(s) WHERE doc_id % 7 = 6 OR (doc_id % 7 <> 6 AND s <> 'tagged')
UNION ALL SELECT doc_id::VARCHAR, 'tagged', 'parked' FROM documents WHERE doc_id % 7 NOT IN (3, 6)""")
def restored_bank(spark, sf_dir):
    """A snapshot without the tagged stage, and without file 6, which stays as it is."""
    now = _stages(spark, sf_dir).select("source", "file_stem", "pipeline_stage", "qid")
    state, parked = edits.restore_database(now, now.filter("pipeline_stage <> 'tagged' and file_stem <> '6'"))
    return state.withColumn("fate", F.lit("kept")).unionByName(parked.withColumn("fate", F.lit("parked"))).select("qid", "pipeline_stage", "fate")


@query("""SELECT doc_id AS qid, 'pending' AS state FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events) UNION ALL
SELECT doc_id, 'ai_generated' FROM documents JOIN (SELECT user_id, arg_max(event_type = 'purchase', ts) AS yes FROM events GROUP BY 1) ON user_id = doc_id WHERE yes""")
def review_queue(spark, sf_dir):
    queue = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"))
    said = t(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), "ts", (F.col("event_type") == "purchase").alias("accept"))
    return edits.pending(queue, said).withColumn("state", F.lit("pending")).unionByName(edits.accepted(queue, said).withColumnRenamed("source", "state"))


@query("""WITH c AS (SELECT user_id, max(ts) AS undone FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id AS qid, count(*) AS uses FROM events LEFT JOIN c USING (user_id) WHERE event_type <> 'error' AND (undone IS NULL OR ts > undone) GROUP BY 1""")
def cleared_usage(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.lit("l").alias("level"), F.lit("s").alias("source"), F.col("user_id").alias("qid"), "ts", "event_type")
    left = edits.cleared_usage(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'").drop("event_type"))
    return edits.usage_of(left, "l", "s").groupBy("qid").agg(F.count("*").alias("uses"))


# ---- the cart and the sheet


def _cart(spark, sf_dir):
    return t(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("pos"), F.col("p_partkey").alias("qid"), F.when(F.col("p_size") % 3 == 0, "mcq").otherwise("question").alias("kind"))


@query("SELECT p_partkey AS qid, row_number() OVER (ORDER BY CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END, p_partkey) AS pos FROM part")
def cart_mcq_first(spark, sf_dir):
    return worksheet.mcq_first(_cart(spark, sf_dir)).select("qid", "pos")


@query("SELECT p_partkey AS qid, (CASE WHEN p = 5 THEN 2 WHEN p BETWEEN 2 AND 4 THEN p + 1 ELSE p END)::BIGINT - (p > 9)::INT - (p > 11)::INT AS pos FROM (SELECT *, p_partkey + 1 AS p FROM part) WHERE p NOT IN (9, 11)")
def cart_moves(spark, sf_dir):
    return worksheet.remove(worksheet.move(_cart(spark, sf_dir), 5, 2), [9, 11]).select("qid", "pos")


@query("SELECT p_partkey AS qid, p_partkey + 1 AS pos FROM part UNION ALL SELECT n + (SELECT max(p_partkey) + 1 FROM part), (SELECT max(p_partkey) + 1 FROM part) + 1 + n FROM range(0, 10) r(n)")
def cart_additions(spark, sf_dir):
    cart = _cart(spark, sf_dir).select("pos", "qid")
    more = cart.select((F.col("qid") + 10).alias("qid"), F.col("pos").alias("ord"))
    return worksheet.add(cart, more).select("qid", "pos")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 160")
def bank_pages(spark, sf_dir):
    return worksheet.page(t(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], pages=2)


@query("""SELECT l_orderkey AS question, l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN 'Table ' ELSE 'Fig. ' END || row_number() OVER (PARTITION BY l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber) AS caption FROM lineitem""")
def captions_continuous(spark, sf_dir):
    a = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), F.when(F.col("l_returnflag") == "R", "table").otherwise("image").alias("kind"), F.col("l_linenumber").alias("ord"))
    return worksheet.captions(a, "continuous").select("question", "ord", "caption")


@query("""WITH q AS (SELECT p_partkey AS number, p_partkey % 2 = 0 AS has, p_name, p_brand FROM part)
SELECT number, 0 AS row_ord, 'stem' AS kind, p_name AS text FROM q UNION ALL SELECT number, 1, 'part', p_brand FROM q WHERE has UNION ALL SELECT number, 2, 'answer', 'yes' FROM q WHERE has UNION ALL SELECT number, 3, 'solution', NULL FROM q WHERE has
UNION ALL SELECT number, 1, 'answer', NULL FROM q WHERE NOT has UNION ALL SELECT number, 2, 'solution', NULL FROM q WHERE NOT has UNION ALL SELECT number, CASE WHEN has THEN 4 ELSE 3 END, 'total', NULL FROM q""")
def teacher_sheet(spark, sf_dir):
    none = F.lit(None).cast("string")
    part = F.array(F.struct(F.lit("(a)").alias("no"), F.lit("(a)").alias("path"), none.alias("parent_path"), F.col("p_brand").alias("text"), F.lit(1).alias("marks"), F.lit("yes").alias("answer"), none.alias("solution")))
    q = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("stem"), F.lit(2).alias("marks"), F.when(F.col("p_partkey") % 2 == 0, part).otherwise(F.slice(part, 1, 0)).alias("parts"), none.alias("answer"), none.alias("solution"))
    return worksheet.layout(q, teacher=True).select("number", "row_ord", "kind", "text")


@query("SELECT sum(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END)::BIGINT AS total, sum(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 3 END)::BIGINT AS with_parts FROM part")
def marks_total(spark, sf_dir):
    parts = F.array(F.struct(F.lit(1).alias("marks")), F.struct(F.lit(2).alias("marks")))
    return worksheet.total_marks(t(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("marks"), parts.alias("parts")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'choice_question' WHEN 2 THEN 'other' ELSE 'other' END AS type FROM part")
def entry_types(spark, sf_dir):
    k = F.col("p_partkey") % 4
    shape = F.when(k == 1, "mcq").when(k == 2, "structured")
    return t(spark, sf_dir, "part").select("p_partkey", worksheet.entry_type(F.when(k == 0, F.col("p_type")).otherwise(""), shape, ["essay", "choice_question"]).alias("type"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || CASE WHEN l_returnflag = 'R' THEN 'a' ELSE '-' END || CASE WHEN l_linestatus = 'O' THEN 's' ELSE '-' END, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus, l_partkey) AS lines FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O' GROUP BY 1")
def answer_list(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    part = F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", F.col("l_linenumber").cast("string").alias("path"), F.when(F.col("l_returnflag") == "R", "a").alias("answer"), F.when(F.col("l_linestatus") == "O", "s").alias("solution"))
    q = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    none = F.lit(None).cast("string")
    lines = part_functions.answer_lines(none, none, F.col("parts"))
    shown = F.transform(lines, lambda x: F.concat(x["label"], F.lit(":"), F.coalesce(x["answer"], F.lit("-")), F.coalesce(x["solution"], F.lit("-"))))
    return q.select("l_orderkey", F.array_join(shown, ",").alias("lines")).filter("lines <> ''")


# ---- model steps


def _taggable(spark, sf_dir):
    shape = F.when(F.col("p_size") % 2 == 0, "mcq").otherwise("short_answer")
    return t(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").cast("string").alias("qid"), F.lit("question").alias("kind"), F.col("p_name").alias("stem"), F.array().cast("array<struct<path:string,text:string>>").alias("parts"), F.array().cast("array<struct<label:string,value:string>>").alias("options"), F.array(F.lit("f")).alias("flags"), shape.alias("shape_type"))


@query("SELECT p_brand AS doc, p_partkey::VARCHAR AS qid, 't1' AS topic, CASE WHEN p_size % 2 = 0 THEN 'mcq' ELSE 'short_answer' END AS type, 'medium' AS difficulty, 'f' AS flags FROM part")
def tag_batches(spark, sf_dir):
    tagged = model.tag_entries(_taggable(spark, sf_dir), model.MockClient(), ["t1", "t2"], ["mcq", "short_answer"])
    return tagged.select("doc", "qid", F.array_join("tags.topic", ",").alias("topic"), "tags.type", "tags.difficulty", F.array_join("flags", ",").alias("flags"))


@query("SELECT p_brand AS doc, count(*) AS tagged, 0 AS bad_topic, 0 AS llm_errors, 0 AS type_overridden FROM part GROUP BY 1")
def tag_counts(spark, sf_dir):
    return model.tag_stats(model.tag_entries(_taggable(spark, sf_dir), model.MockClient(), ["t1", "t2"], ["mcq", "short_answer"]))


class _Proofreader:
    """A cleaning model that writes stems anew, calls some answers fixed, and can't read some entries."""

    def reply(self, task, payload):
        import json

        view = json.loads(payload["view"])
        n = int(view["stem"].split()[-1])
        if n % 5 == 4:
            return "I would rather not"
        return {"patch": {"stem": f"Better {n}", **({"answer": "fixed"} if n % 5 == 1 else {})}, "severe": n % 5 == 2}


def _cleaned(spark, sf_dir):
    """Entries whose qids repeat in every document: a document is a language and the rest of the id modulo 7."""
    id_ = F.col("qid").cast("string")
    e = _editable(spark, sf_dir).withColumns({"doc": F.concat_ws("-", F.col("tags.topic")[0], (F.col("qid") % 7).cast("string")), "stem": F.concat(F.lit("stem "), id_)})
    return build.clean_entries(e.withColumn("qid", F.floor(F.col("qid") / 7)), _Proofreader())


@query("""SELECT lang || '-' || doc_id % 7 AS doc, doc_id // 7 AS qid, CASE WHEN doc_id % 5 = 4 THEN 'stem ' ELSE 'Better ' END || doc_id AS stem, CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'stem' END AS changed, CASE WHEN doc_id % 5 = 1 THEN 'answer: verdict-token value fixed' ELSE '' END AS rejected,
'keep,no_solution,no_answer' || CASE WHEN doc_id % 5 = 1 THEN ',patch_rejected:answer: verdict-token value fixed' ELSE '' END || CASE WHEN doc_id % 5 <> 4 THEN ',llm_fixed:stem' ELSE '' END || CASE WHEN doc_id % 5 = 2 THEN ',llm_severe' ELSE '' END AS flags FROM documents""")
def cleaned_entries(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc", "qid", "stem", F.array_join("changed", ",").alias("changed"), F.array_join("rejected", ",").alias("rejected"), F.array_join("flags", ",").alias("flags"))


@query("SELECT lang || '-' || doc_id % 7 AS doc, count(*) AS checked, 0 AS with_images, count(*) FILTER (doc_id % 5 <> 4) AS fixed, count(*) FILTER (doc_id % 5 = 2) AS severe, count(*) FILTER (doc_id % 5 = 1) AS lint_dropped, count(*) FILTER (doc_id % 5 = 4) AS llm_errors FROM documents GROUP BY 1")
def clean_counts(spark, sf_dir):
    return build.clean_stats(_cleaned(spark, sf_dir))


@query("""SELECT 'gen-b' || p_size || '-' || CASE WHEN p_partkey < 1000 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS qid, 'mcq' AS kind, 'About ' || p_name AS stem, '(1) ' || p_brand || '|(2) x' AS options, '(2)' AS answer, CASE WHEN p_partkey % 2 = 0 THEN 't2' ELSE 't1,t2' END AS topics, 'ai_generated' AS flags FROM part WHERE p_partkey % 3 <> 0""")
def generated_entries(spark, sf_dir):
    q = F.struct(
        F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit("About "), F.col("p_name"))).alias("stem"), F.array().cast("array<struct<no:string,text:string>>").alias("parts"), F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.lit("x")).alias("options"), F.lit("B").alias("answer"), F.lit("because").alias("solution"),
        F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("t2"), F.lit("t9"))).alias("topics"), F.lit(None).cast("string").alias("type"),
    )
    replies = t(spark, sf_dir, "part").select(F.concat(F.lit("b"), F.col("p_size").cast("string")).alias("batch"), F.col("p_partkey").alias("n"), q.alias("q"))
    e = build.generated(replies, ["t1", "t2"], "")
    return e.select("qid", "kind", "stem", F.array_join(F.transform("options", lambda o: F.concat_ws(" ", o["label"], o["value"])), "|").alias("options"), F.col("answer.value").alias("answer"), F.array_join("tags.topic", ",").alias("topics"), F.array_join("flags", ",").alias("flags"))


# ---- sources


@query("SELECT 'd' || p_partkey AS doc, '/x/d' || p_partkey || '/a_content_list' || CASE WHEN p_partkey % 3 = 0 THEN '_v2' ELSE '' END || '.json' AS path FROM part")
def content_lists(spark, sf_dir):
    doc = F.concat(F.lit("d"), F.col("p_partkey").cast("string"))
    named = lambda end: F.concat(F.lit("/x/"), doc, F.lit(f"/a_content_list{end}.json"))
    files = t(spark, sf_dir, "part").select(F.explode(F.when(F.col("p_partkey") % 3 == 0, F.array(named("_v2"))).otherwise(F.array(named("_v2"), named("")))).alias("path"))
    return sources.content_lists(files)


@query("SELECT p_partkey || '.pdf' AS name FROM part WHERE p_partkey % 4 <> 0")
def pending_extraction(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("stem"))
    files = p.select(F.concat(F.lit("/raw/"), "stem", F.lit(".pdf")).alias("path"), F.lit(1_000_000).alias("length"))
    return sources.to_extract(sources.raw_files(files), p.filter("cast(stem as int) % 4 = 0")).select("name")


@query("SELECT p_partkey || '' AS doc, 2 AS questions, '(a),(b)' AS parts FROM part")
def mock_extraction(spark, sf_dir):
    names = t(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("name"))
    blocks = segment.split_tables(segment.load_blocks(sources.mock_extract(names)))
    q = segment.questions(segment.number_blocks(segment.label_blocks(blocks)))
    return q.groupBy("doc").agg(F.count("*").alias("questions"), F.max(F.array_join("parts.no", ",")).alias("parts"))


@query("""SELECT source, doc_id::VARCHAR AS qid, CASE WHEN md5(source) < '8' THEN 'changed ' || md5(text) ELSE md5(text) END AS stem, 'raw' AS pipeline_stage FROM documents""")
def bank_refreshed(spark, sf_dir):
    """The bank of a tree of files after two refreshes; before the second one about half of the sources get other files."""
    d = t(spark, sf_dir, "documents").select(F.lit("s").alias("subject"), F.lit("t").alias("stage"), F.lit("l").alias("level"), "source", F.lit("interim").alias("area"), F.col("doc_id").cast("string").alias("qid"), F.md5("text").alias("stem"))
    root, bank_, schema = folder(spark, "tree"), folder(spark, "bank"), "qid STRING, stem STRING"
    put = lambda rows: rows.repartition("source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject", "stage", "level", "source", "area").json(root)
    put(d)
    incremental.refresh(spark, root, bank_, schema, "*.json")
    put(d.filter(F.md5("source") < "8").withColumn("stem", F.concat(F.lit("changed "), "stem")))
    incremental.refresh(spark, root, bank_, schema, "*.json")
    return incremental.bank_rows(spark, bank_, schema).select("source", "qid", "stem", "pipeline_stage")


# ---- what the dashboards show


@query("SELECT p_partkey AS stem, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS report_questions, CASE WHEN p_partkey % 3 = 0 THEN 1 END AS tag_tagged, 'raw' AS stage FROM part")
def pipeline_status(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("stem", F.col("p_partkey"))
    live = bank.live_stage(p.select(F.col("stem").alias("doc"), F.lit("raw").alias("stage"), F.lit(1).alias("version"))).select(F.col("doc").alias("stem"), "stage")
    out = bank.pipeline_status(p.select("stem"), ("report", p.filter("p_partkey % 2 = 0").select("stem", F.col("p_size").alias("questions"))), ("tag", p.filter("p_partkey % 3 = 0").select("stem", F.lit(1).alias("tagged"))))
    return out.join(live, "stem", "left")


def _used(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("source").alias("file"), F.array("lang").alias("topics"), F.col("lang").alias("type"), F.when(F.col("doc_id") % 3 == 0, "basic").otherwise("medium").alias("difficulty"), F.array_compact(F.array(F.when(F.col("doc_id") % 4 == 0, F.lit("no_answer")), F.when(F.col("doc_id") % 2 == 0, F.lit("verified")))).alias("flags"), F.lower("text").alias("blob"))
    usage = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("qid")).agg(F.count("*").alias("count"))
    return d, usage, d.filter("qid % 10 < 4").select("qid")


_USED = "u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), d AS (SELECT doc_id AS qid, coalesce(n, 0) AS n, doc_id % 4 = 0 AS flagged, doc_id % 2 = 0 AS verified, CASE WHEN doc_id % 3 = 0 THEN 'basic' ELSE 'medium' END AS difficulty, doc_id % 10 < 4 AS cart FROM documents LEFT JOIN u ON user_id = doc_id)"


@query(f"""WITH {_USED} SELECT 'used' AS rule, qid FROM d WHERE n > 0 UNION ALL SELECT 'unused', qid FROM d WHERE n = 0 UNION ALL SELECT 'used_twice', qid FROM d WHERE n >= 2 UNION ALL SELECT 'in_cart', qid FROM d WHERE cart UNION ALL SELECT 'not_in_cart', qid FROM d WHERE NOT cart
UNION ALL SELECT 'flagged', qid FROM d WHERE flagged UNION ALL SELECT 'clean', qid FROM d WHERE NOT flagged UNION ALL SELECT 'verified', qid FROM d WHERE verified UNION ALL SELECT 'unverified basic', qid FROM d WHERE NOT verified AND difficulty = 'basic'""")
def bank_rules(spark, sf_dir):
    d, usage, cart = _used(spark, sf_dir)
    pick = lambda name, **want: bank.bank_filter(d, usage, cart, **want).select(F.lit(name).alias("rule"), "qid")
    rules = [pick(u, use=u) for u in ("used", "unused", "used_twice", "in_cart", "not_in_cart")] + [pick(x, state=x) for x in ("flagged", "clean", "verified")] + [pick("unverified basic", state="unverified", difficulty="basic")]
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    return out


@query("SELECT doc_id AS qid, CASE WHEN doc_id % 2 = 0 THEN 'keep' ELSE 'keep,verified' END AS flags, 'no_answer,keep,no_solution' AS fresh FROM documents")
def flags_turned(spark, sf_dir):
    flags = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("keep"), F.lit("verified"))).otherwise(F.array(F.lit("keep")))
    stale = F.array(F.lit("short_stem"), F.lit("no_answer"), F.lit("keep"))
    fresh = bank.refresh_flags(F.filter(stale, lambda f: f == "keep"), F.array(F.lit("no_solution")))
    return t(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.array_join(records.toggled(flags, "verified"), ",").alias("flags"), F.concat(F.lit("no_answer,"), F.array_join(fresh, ",")).alias("fresh"))


@query("SELECT user_id AS qid FROM (SELECT user_id, max(event_id) AS live FROM events GROUP BY 1) WHERE user_id % 2 = 1")
def edit_conflicts(spark, sf_dir):
    live = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("qid")).agg(F.max("event_id").alias("rev"))
    sent = live.select("qid", F.when(F.col("qid") % 2 == 1, F.lit(-1)).otherwise(F.col("rev")).alias("rev"))
    return records.conflicts(sent, live, ["qid"]).select("qid")


@query("SELECT p_partkey, 'Text ' || p_name || ' ![](a' || p_partkey || '.png)' AS marked, trim(p_brand) AS code, '(a)|(b)' AS parts, p_size AS marks FROM part")
def carried_parts(spark, sf_dir):
    none = F.lit(None).cast("string")
    part = lambda path, answer, marks: F.struct(F.lit(path).alias("path"), marks.alias("marks"), answer.alias("answer"), none.alias("solution"), none.alias("answer_area"))
    old = F.array(part("(a)", F.col("p_name"), F.col("p_size")), part("(c)", F.col("p_name"), F.lit(1)))
    new = F.array(part("(a)", none, F.lit(None).cast("int")), part("(b)", none, F.lit(None).cast("int")))
    image = text.image_markers(F.concat(F.lit("Text "), F.col("p_name"), F.lit(' <img width="3" src="a'), F.col("p_partkey").cast("string"), F.lit('.png"/>')))
    code = segment.block_text(F.lit("code"), none, none, F.concat(F.lit("<div class='x'> "), F.col("p_brand"), F.lit(" </div>")), none)
    p = t(spark, sf_dir, "part").select("p_partkey", image.alias("marked"), code.alias("code"), part_functions.restore_carry(old, new).alias("p"))
    return p.select("p_partkey", "marked", "code", F.array_join("p.path", "|").alias("parts"), F.col("p")[0]["marks"].alias("marks"))
