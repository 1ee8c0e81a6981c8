"""The registered queries, each over its whole tables, and their DuckDB SQL where SQL can express them.

The driver's tables carry no exam markup: where an operator reads markup it is added to the whole
texts from other columns of the row, in the same way in both engines.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrow, html, labels, options, parts, similarity, text
from ..operators import answers, bank, model, novelty, records, search, segment, worksheet
from ..streaming import assembly
from ..tables import folder
from . import paper  # noqa: F401  (registers its queries)
from .registry import oracle_sql, queries, query, t  # noqa: F401


# ---- sources, blocks, segmentation


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def discover_sources(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.sum(F.length("text")).alias("chars"))


def _lines(spark, sf_dir):
    lines = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    furniture = F.when((F.col("doc") + F.col("i")) % 7 == 0, "footer").when((F.col("doc") + F.col("i")) % 7 == 1, "header").otherwise("text")
    y = (F.col("i") * 97 % 1000).cast("double")
    return lines.withColumn("type", furniture).withColumn("bbox", F.array(F.lit(0.0), y, F.lit(1000.0), y + 40))


_LINES = "lines AS (SELECT doc_id AS doc, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(f"""WITH {_LINES}, b AS (SELECT *, (doc + i) % 7 IN (0, 1) AS furniture, (i * 97 % 1000) AS y FROM lines)
SELECT doc, count(*) AS kept, sum(furniture::INT)::BIGINT AS rescued FROM b
WHERE NOT (furniture AND (y >= 870 OR y + 40 <= 130 OR regexp_matches(trim(text), '(?i)^(©|\\d{{1,4}}$|Educational Publishing|Page \\d)') OR length(trim(text)) < 15)) GROUP BY doc""")
def blocks_from_lines(spark, sf_dir):
    kept = segment.filter_noise(_lines(spark, sf_dir))
    return kept.groupBy("doc").agg(F.count("*").alias("kept"), F.sum(F.col("rescued").cast("long")).alias("rescued"))


@query(f"""WITH {_LINES}, p AS (SELECT doc, CASE (doc + i) % 4 WHEN 0 THEN i || '. ' WHEN 1 THEN '(b) ' ELSE '' END || text AS text FROM lines),
r AS (SELECT doc, CASE WHEN regexp_matches(text, '^\\d{{1,3}}[.\\s)]') THEN 'q' WHEN regexp_matches(text, '^\\([a-z]\\)') THEN 'part' ELSE 'body' END AS role, text FROM p)
SELECT doc, role, count(*) AS n, count(DISTINCT CASE role WHEN 'q' THEN regexp_extract(text, '^(\\d{{1,3}})', 1) WHEN 'part' THEN regexp_extract(text, '^(\\([a-z]\\))', 1) END) AS n_labels FROM r GROUP BY doc, role""")
def heuristic_labels(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    kind = (F.col("doc") + F.col("i")) % 4
    prefix = F.when(kind == 0, F.concat(F.col("i").cast("string"), F.lit(". "))).when(kind == 1, "(b) ").otherwise("")
    b = lines.select("doc", F.lit("text").alias("type"), F.concat(prefix, "text").alias("text"))
    b = b.withColumn("role", segment.heuristic_role(F.col("type"), F.col("text")))
    b = b.withColumn("label", segment.heuristic_label(F.col("role"), F.col("text")))
    return b.groupBy("doc", "role").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


def _conversation_blocks(spark, sf_dir):
    return _as_blocks(t(spark, sf_dir, "conversations"))


def _as_blocks(conversations):
    role = F.when(F.col("role") == "user", "q").when(F.col("role") == "assistant", "solution").otherwise("section")
    return conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("i"), F.lit("text").alias("type"), role.alias("role"), F.lit(None).cast("string").alias("label"), "text")


_NUMBERED = r"""blocks AS (SELECT conv_id AS doc, turn AS i, role, text, last_value(CASE WHEN role = 'system' THEN trim(regexp_replace(text, '\s+', ' ', 'g')) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations),
kept AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM blocks WHERE role <> 'system'),
numbered AS (SELECT *, q = 0 AND max(q) OVER (PARTITION BY doc) = 0 AS implicit, q = 0 AND max(q) OVER (PARTITION BY doc) > 0 AS merged FROM kept)"""


_SEGMENTED = f"""WITH {_NUMBERED}
SELECT doc AS conv_id, CASE WHEN merged THEN 1 ELSE q END::BIGINT AS q_ord, arg_min(section, i) FILTER (section IS NOT NULL OR TRUE) AS section_raw,
       coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (role = 'user'), '') AS stem, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (role = 'assistant'), '') AS solution,
       min(i) AS first_i, max(i) AS last_i, count(*) AS blocks, bool_or(merged) AS leading_content_merged, bool_or(implicit) AS implicit_question_start
FROM numbered GROUP BY 1, 2""".replace("arg_min(section, i) FILTER (section IS NOT NULL OR TRUE) AS section_raw", "first(section ORDER BY i) AS section")


@query(_SEGMENTED)
def segment_conversations(spark, sf_dir):
    q = segment.assemble(segment.number_blocks(_conversation_blocks(spark, sf_dir)))
    return q.select(F.col("doc").alias("conv_id"), F.col("q_ord").cast("long").alias("q_ord"), "section", "stem", "solution", "first_i", "last_i", "blocks", "leading_content_merged", "implicit_question_start")


@query(_SEGMENTED)
def streamed_conversations(spark, sf_dir):
    """The conversations replayed as a stream, some files a micro-batch, and assembled as their documents close."""
    known = _conversation_blocks(spark, sf_dir)
    path, totals = f"{sf_dir}/conversations.parque[t]", known.groupBy("doc").agg(F.count("*").alias("total"))
    files = spark.readStream.schema(t(spark, sf_dir, "conversations").schema).option("maxFilesPerTrigger", 8).parquet(path)
    blocks = _as_blocks(files).join(totals, "doc").withColumn("ts", F.timestamp_seconds(F.lit(1_000_000_000) + F.col("i")))
    at = folder(spark, "streamed")
    query = assembly.assembled(blocks, lambda b: segment.assemble(segment.number_blocks(b)), f"{at}/questions", f"{at}/checkpoint")
    query.awaitTermination()
    q = spark.read.parquet(f"{at}/questions")
    return q.select(F.col("doc").alias("conv_id"), F.col("q_ord").cast("long").alias("q_ord"), "section", "stem", "solution", "first_i", "last_i", "blocks", "leading_content_merged", "implicit_question_start")


@query(f"WITH {_NUMBERED} SELECT doc, i, section FROM numbered")
def section_carry(spark, sf_dir):
    return segment.number_blocks(_conversation_blocks(spark, sf_dir)).select("doc", "i", "section")


@query(f"WITH {_NUMBERED} SELECT doc, sum(merged::INT)::BIGINT AS merged, sum(implicit::INT)::BIGINT AS implicit FROM numbered GROUP BY doc")
def lead_merge(spark, sf_dir):
    b = segment.number_blocks(_conversation_blocks(spark, sf_dir))
    return b.groupBy("doc").agg(F.sum(F.col("merged").cast("long")).alias("merged"), F.sum(F.col("implicit").cast("long")).alias("implicit"))


@query("""WITH ranges AS (SELECT conv_id, turn AS a, turn + 1 AS z FROM conversations WHERE role = 'user')
SELECT c.conv_id AS doc, c.turn AS i FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.conv_id = c.conv_id AND c.turn BETWEEN r.a AND r.z)""")
def dropped_blocks(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    ranges = c.filter("role = 'user'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("first_i"), (F.col("turn") + 1).alias("last_i"))
    return segment.dropped_blocks(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("i")), ranges)


@query("""WITH need AS (SELECT DISTINCT conv_id, turn AS key, unnest([turn, turn + 1]) AS page FROM conversations WHERE role = 'user')
SELECT n.conv_id AS doc, n.key, md5(left(string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn), 6000)) AS context FROM need n JOIN conversations c ON c.conv_id = n.conv_id AND c.turn = n.page GROUP BY 1, 2""")
def context_slice(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    wanted = c.filter("role = 'user'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("key"), F.array("turn").alias("pages"))
    return segment.context_slice(pages, wanted).withColumn("context", F.md5("context"))


# ---- answers


def _pairing(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    sec = lambda m: F.when(F.col("turn") % m == 0, "Section A").otherwise("")
    q = c.filter("role = 'user'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("q_ord"), sec(3).alias("section"), (F.col("turn") % 3).cast("string").alias("qno"), (F.col("turn") == 0).alias("implicit"))
    a = c.filter("role = 'assistant'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), sec(2).alias("section"), (F.col("turn") % 3).cast("string").alias("qno"), F.col("text").alias("answer"))
    return q, a


_PAIRING = """q AS (SELECT conv_id AS doc, turn AS q_ord, CASE WHEN turn % 3 = 0 THEN 'sectiona' ELSE '' END AS sec, (turn % 3)::VARCHAR AS qno, turn = 0 AS implicit FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id AS doc, turn AS ans_ord, CASE WHEN turn % 2 = 0 THEN 'sectiona' ELSE '' END AS sec, (turn % 3)::VARCHAR AS qno, text AS answer FROM conversations WHERE role = 'assistant')"""


@query(f"""WITH {_PAIRING},
p1 AS (SELECT x.doc, q_ord, ans_ord, 1 AS pass FROM (SELECT *, row_number() OVER (PARTITION BY doc, sec, qno ORDER BY q_ord) AS r FROM q WHERE sec <> '') x JOIN (SELECT *, row_number() OVER (PARTITION BY doc, sec, qno ORDER BY ans_ord) AS r FROM a WHERE sec <> '') y ON x.doc = y.doc AND x.sec = y.sec AND x.qno = y.qno AND x.r = y.r),
q2 AS (SELECT * FROM q ANTI JOIN p1 USING (doc, q_ord)), a2 AS (SELECT * FROM a ANTI JOIN p1 USING (doc, ans_ord)),
p2 AS (SELECT x.doc, q_ord, ans_ord, 2 AS pass FROM (SELECT *, row_number() OVER (PARTITION BY doc, qno ORDER BY q_ord) AS r FROM q2) x JOIN (SELECT *, row_number() OVER (PARTITION BY doc, qno ORDER BY ans_ord) AS r FROM a2) y ON x.doc = y.doc AND x.qno = y.qno AND x.r = y.r),
q3 AS (SELECT * FROM q2 ANTI JOIN p2 USING (doc, q_ord)), a3 AS (SELECT * FROM a2 ANTI JOIN p2 USING (doc, ans_ord)),
p3 AS (SELECT x.doc, q_ord, ans_ord, 3 AS pass FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY q_ord) AS r FROM q3 WHERE implicit) x JOIN (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ans_ord) AS r FROM a3) y ON x.doc = y.doc AND x.r = y.r),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
SELECT q.doc, q.q_ord, p.ans_ord, p.pass FROM q LEFT JOIN p ON p.doc = q.doc AND p.q_ord = q.q_ord""")
def match_answers(spark, sf_dir):
    return answers.match_answers(*_pairing(spark, sf_dir)).select("doc", "q_ord", "ans_ord", "pass")


@query(f"""WITH {_PAIRING}, x2 AS (SELECT doc, sec, qno, min(ans_ord) AS o FROM a GROUP BY ALL), x1 AS (SELECT doc, qno, min(ans_ord) AS o FROM a GROUP BY ALL), x0 AS (SELECT doc, min(ans_ord) AS o FROM a GROUP BY ALL),
f AS (SELECT q.doc, q.q_ord, CASE WHEN x2.o IS NOT NULL THEN 1 WHEN x1.o IS NOT NULL THEN 2 WHEN x0.o IS NOT NULL THEN 3 END AS level, coalesce(x2.o, x1.o, x0.o) AS ans_ord
  FROM q LEFT JOIN x2 ON x2.doc = q.doc AND x2.sec = q.sec AND x2.qno = q.qno LEFT JOIN x1 ON x1.doc = q.doc AND x1.qno = q.qno LEFT JOIN x0 ON x0.doc = q.doc)
SELECT f.doc, f.q_ord, f.level, f.ans_ord, a.answer FROM f LEFT JOIN a ON a.doc = f.doc AND a.ans_ord = f.ans_ord""")
def answer_fallback(spark, sf_dir):
    return answers.answer_lookup(*_pairing(spark, sf_dir)).select("doc", "q_ord", "level", "ans_ord", "answer")


@query("""SELECT conv_id AS doc, (turn % 2)::VARCHAR AS qno, min(turn) AS ord, string_agg('(' || turn || ') ' || text, '; ' ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1, 2""")
def merge_answer_records(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").filter("role = 'assistant'")
    r = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.lit("").alias("section"), (F.col("turn") % 2).cast("string").alias("qno"), F.concat(F.lit("("), F.col("turn").cast("string"), F.lit(")")).alias("part"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("solution"))
    return answers.merge_answers(r).select("doc", "qno", "ord", "answer")


@query("""WITH r AS (SELECT source AS doc, doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS sec, lang AS qno, text FROM documents)
SELECT doc, sec, qno, min(ord) AS ord, md5(arg_min(text, ord)) AS answer, md5(first(text ORDER BY length(text) DESC, ord)) AS solution, count(*) AS readings
FROM r GROUP BY doc, sec, qno, CASE WHEN sec = '' THEN left(text, 40) END, CASE WHEN sec = '' THEN left(text, 60) END""")
def dedup_answers(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    r = d.select(F.col("source").alias("doc"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("section"), F.col("lang").alias("qno"), F.lit("").alias("part"), F.col("text").alias("answer"), F.col("text").alias("solution"))
    return answers.dedup_answers(r).select("doc", "sec", "qno", "ord", F.md5("answer").alias("answer"), F.md5("solution").alias("solution"), "readings")


class _KeyReader:
    """Reads a listing as printed: headings stay in effect, a number opens a record, a figure belongs to the record before it."""

    def reply(self, task, payload):
        import re

        section, out = payload.get("context") or "", []
        for i, line in re.findall(r"(?m)^\[(\d+)\] \(\w+\) (.*)$", payload["listing"]):
            if line.startswith("Section"):
                section = line
            elif line == "<figure>" and out:
                out[-1]["figs"].append(int(i))
            elif m := re.match(r"(\d+)\. ([^;]*); (.*)", line):
                out.append({"section": section, "qno": m[1], "part": "", "answer": m[2], "solution": m[3], "figs": []})
        return out


@query("""WITH b AS (SELECT l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_linestatus, l_returnflag) - 1 AS i, l_partkey, l_linestatus, l_returnflag FROM lineitem),
s AS (SELECT *, last_value(CASE WHEN i % 100 = 50 THEN 'Section ' || l_returnflag || i END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM b)
SELECT 's' || a.doc AS doc, coalesce(a.section, '') AS section, a.i::VARCHAR AS qno, a.l_partkey::VARCHAR AS answer, a.l_linestatus AS solution, CASE WHEN f.i IS NULL THEN '' ELSE f.i::VARCHAR END AS figs
FROM s a LEFT JOIN s f ON f.doc = a.doc AND f.i = a.i + 1 AND f.i % 100 = 20 WHERE a.i % 100 NOT IN (20, 50)""")
def interpreted_answers(spark, sf_dir):
    """An answer file for every supplier, a block for each of its line items, of which some are headings or figures; read in chunks of 90."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag")
    b = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("_ans")).alias("doc"), (F.row_number().over(order) - 1).alias("i"), "l_partkey", "l_linestatus", "l_returnflag")
    line = F.when(F.col("i") % 100 == 50, F.concat(F.lit("Section "), "l_returnflag", F.col("i").cast("string"))).otherwise(F.concat(F.col("i").cast("string"), F.lit(". "), F.col("l_partkey").cast("string"), F.lit("; "), "l_linestatus"))
    kind = F.when(F.col("i") % 100 == 20, "image").otherwise("text")
    _, blocks = answers.answer_files(b.select("doc", "i", kind.alias("type"), line.alias("text"), F.lit(None).cast("string").alias("table_body")))
    return answers.interpret_answers(blocks, _KeyReader()).select("doc", "section", "qno", "answer", "solution", F.array_join(F.col("figs").cast("array<string>"), ",").alias("figs"))


# ---- text and labels


_MARKED = "text || ' ____ fig 3.' || (doc_id % 9) || ' ..... table 2.1' || chr(10) || chr(10) || chr(10) || '[Total: ' || (doc_id % 50) || '] <img src=\"a.png\"/> ( ) \\cents ……'"


def _marked():
    id_ = lambda n: (F.col("doc_id") % n).cast("string")
    return F.concat("text", F.lit(" ____ fig 3."), id_(9), F.lit(" ..... table 2.1\n\n\n[Total: "), id_(50), F.lit('] <img src="a.png"/> ( ) \\cents ……'))


def _nested(sql: str, rules) -> str:
    for pattern, to in rules:
        sql = f"regexp_replace({sql}, '{pattern}', '{to}', 'g')"
    return sql


_NORMAL = [("\\\\cents?\\b", "¢"), ("<img[^>]*\\bsrc=[\"'']([^\"'']+)[\"''][^>]*/?>", "![](\\1)"), ("(?i)[\\[（(]\\s*(?:T|total)\\b[^\\]）)]*?(\\d{1,3})\\s*[\\]）)]", ""), ("[（(]\\s*[)）]", ""), ("(?:\\\\_|_){2,}", "[ANSWER]"), ("\\.(?:\\s*\\.){3,}", "[ANSWER]"), ("…{2,}", "[ANSWER]"), ("(?i)\\btable\\.?\\s*\\d+\\.(\\d+)", "Table [QN].\\1"), ("(?i)\\bfig(?:ure)?\\.?\\s*\\d+\\.(\\d+)", "Fig. [QN].\\1"), ("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n"), ("^\\s+|\\s+$", "")]


@query(f"SELECT doc_id, md5({_nested(_MARKED, _NORMAL)}) AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(_marked())).alias("normal"))


@query("SELECT doc_id, md5(lower(regexp_replace(text, '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+', '', 'g'))) AS key FROM documents")
def norm_section(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.norm_section(F.col("text"))).alias("key"))


@query("""WITH m AS (SELECT doc_id, text || ' (Total ' || (doc_id % 40) || ' marks) [' || (doc_id % 30) || ']' AS text FROM documents)
SELECT doc_id, md5(regexp_replace(text, '\\s*[\\[（(]\\s*(\\d{1,2})\\s*[\\]）)]\\s*$', '')) AS body, regexp_extract(text, '\\s*[\\[（(]\\s*(\\d{1,2})\\s*[\\]）)]\\s*$', 1)::INT AS marks,
       nullif(regexp_extract(text, '(?i)[\\[（(]\\s*(?:T|total)\\b[^\\]）)]*?(\\d{1,3})\\s*[\\]）)]', 1), '')::INT AS total FROM m""")
def marks_extract(spark, sf_dir):
    id_ = lambda n: (F.col("doc_id") % n).cast("string")
    marked = F.concat("text", F.lit(" (Total "), id_(40), F.lit(" marks) ["), id_(30), F.lit("]"))
    d = t(spark, sf_dir, "documents").select("doc_id", marked.alias("text"))
    body, marks = text.part_mark(F.col("text"))
    return d.select("doc_id", F.md5(body).alias("body"), marks.alias("marks"), text.total_mark(F.col("text")).alias("total"))


@query()
def answer_area_split(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 3 == 0, "\n[ANSWER] km").when(F.col("doc_id") % 3 == 1, "\nequation: [ANSWER]\n\nconditions: [ANSWER]\n").otherwise(" the value is [ANSWER] and so on")
    area = text.answer_area(F.concat("text", tail))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(area["body"]).alias("body"), area["area"].alias("area"))


@query()
def math_spacing(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.fix_math_spacing(F.concat("text", F.lit(" $1 1 x + (4 x + 2 xy)$")))).alias("fixed"))


@query("""WITH s AS (SELECT doc_id, replace(text || CASE doc_id % 3 WHEN 0 THEN ' $x_{1}$' WHEN 1 THEN ' $x_{1$' ELSE ' $a\\timesb$' END, '\\$', '') AS s FROM documents)
SELECT doc_id, (length(s) - length(replace(s, '$', ''))) % 2 = 0 AND len(list_filter(regexp_extract_all(s, '\\$\\$?([^$]*)\\$\\$?', 1), lambda m: length(replace(m, '{', '')) <> length(replace(m, '}', '')) OR regexp_matches(m, '\\\\(frac|sqrt|angle|times|div|quad|circ|percent)[a-zA-Z]'))) = 0 AS ok FROM s""")
def latex_ok(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 3 == 0, " $x_{1}$").when(F.col("doc_id") % 3 == 1, " $x_{1$").otherwise(" $a\\timesb$")
    return t(spark, sf_dir, "documents").select("doc_id", text.latex_ok(F.concat("text", tail)).alias("ok"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS cell FROM pages")
def html_cell_text(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.md5(html.cell_text(F.col("html"))).alias("cell"))


def _grid():
    c = lambda v, a="": F.concat(F.lit(f"<td{a}>"), v.cast("string"), F.lit("</td>"))
    return F.concat(F.lit("<table><tr>"), c(F.col("p_size")), c(F.col("p_name"), ' colspan="2"'), F.lit("</tr><tr>"), c(F.lit("A")), c(F.col("p_brand")), c(F.col("p_type"), ' rowspan="2"'), F.lit("</tr></table>"))


@query("SELECT p_partkey, 3 AS width, p_size BETWEEN 0 AND 99 AS asks, 2 AS n_rows, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS stem FROM part")
def grid_rows(spark, sf_dir):
    g = t(spark, sf_dir, "part").select("p_partkey", html.parse_grid(_grid()).alias("g"))
    width = html.grid_width(F.col("g"))
    return g.select("p_partkey", width.alias("width"), html.is_question_row(F.col("g")[0], width).alias("asks"), F.size("g").alias("n_rows"), F.col("g")[0][1]["text"].alias("stem"))


@query("""SELECT p_partkey, v.r, v.c, CASE WHEN v.n = 1 THEN p_size::VARCHAR WHEN v.n = 2 THEN trim(regexp_replace(p_name, '\\s+', ' ', 'g')) WHEN v.n = 3 THEN 'A' WHEN v.n = 4 THEN trim(regexp_replace(p_brand, '\\s+', ' ', 'g')) ELSE trim(regexp_replace(p_type, '\\s+', ' ', 'g')) END AS text, v.colspan, v.rowspan
FROM part, (VALUES (1, 0, 0, 1, 1), (2, 0, 1, 2, 1), (3, 1, 0, 1, 1), (4, 1, 1, 1, 1), (5, 1, 2, 1, 2)) v(n, r, c, colspan, rowspan)""")
def grid_occupancy(spark, sf_dir):
    cells = html.grid_occupancy(html.parse_grid(_grid()))
    return t(spark, sf_dir, "part").select("p_partkey", F.explode(cells).alias("c")).select("p_partkey", "c.*")


def _options():
    o = lambda a, b, c: F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in ((a, F.col("p_name")), (b, F.col("p_brand")), (c, F.col("p_type")))))
    kind = F.col("p_partkey") % 4
    return F.when(kind == 0, o("B", "A", "C")).when(kind == 1, o("2.", "1.", "3.")).when(kind == 2, o("first", "B", "A")).otherwise(o("(1)", "(2)", "(3)"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_brand || '|' || p_name || '|' || p_type ELSE p_name || '|' || p_brand || '|' || p_type END AS "values",
CASE p_partkey % 4 WHEN 0 THEN '(2) (1)' WHEN 1 THEN 'B, a' WHEN 2 THEN '(2) (3)' ELSE 'B, a' END AS answer FROM part""")
def canon_options(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", options.canon_options(_options()).alias("o"))
    return p.select("p_partkey", F.array_join(F.col("o.value"), "|").alias("values"), options.remap_answer(F.lit("B, a"), F.col("o")).alias("answer"))


@query("SELECT p_partkey, p_name || '|' || p_brand AS inline_options FROM part")
def inline_options(spark, sf_dir):
    o = options.parse_inline_options(F.concat(F.lit("A "), F.col("p_name"), F.lit(" B  "), F.col("p_brand")))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(o, lambda x: x["value"]), "|").alias("inline_options"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '(a)' WHEN 1 THEN '(b)(ii)' WHEN 2 THEN 'Part a' WHEN 3 THEN '(iv)' ELSE '(b)(i)(A)' END AS label,
CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS depth FROM part""")
def part_labels(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    raw = F.when(kind == 0, "a.").when(kind == 1, "(b) (ii)").when(kind == 2, "Part a").when(kind == 3, "iv)").otherwise("(b)(i)(A)")
    label = labels.canon_part_no(raw)
    return t(spark, sf_dir, "part").select("p_partkey", label.alias("label"), labels.part_depth(label).alias("depth"))


@query("""WITH s AS (SELECT doc_id, trim(CASE doc_id % 3 WHEN 0 THEN '(B) because' WHEN 1 THEN text || chr(10) || 'so x = \\frac{1}{2}' ELSE text END) AS s FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'B' WHEN doc_id % 3 = 1 THEN '$\\frac{1}{2}$' ELSE nullif(regexp_replace(trim(regexp_extract(string_split(s, chr(10))[-1], '=\\s*([^=]{1,40})$', 1)), '^[$\\s]+|[$\\s]+$', '', 'g'), '') END AS value FROM s""")
def extract_answer(spark, sf_dir):
    kind = F.col("doc_id") % 3
    s = F.when(kind == 0, "(B) because").when(kind == 1, F.concat("text", F.lit("\nso x = \\frac{1}{2}"))).otherwise(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", text.extract_answer(s, kind == 0, F.lit(False))["value"].alias("value"))


@query()
def repair_json(spark, sf_dir):
    reply = F.concat(F.lit('```json\n{"a": "\\times 3", "t": '), F.to_json(F.struct("text")), F.lit("}\n```"))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(arrow.columns()["repair_json"](reply)).alias("json"))


@query()
def ce_expand(spark, sf_dir):
    s = F.concat("text", F.lit(r" \ce{H2SO4 -> 2H+}"))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(arrow.columns()["expand_ce"](s)).alias("latex"))


@query()
def latex_text(spark, sf_dir):
    s = F.concat("text", F.lit(r" $\frac{1}{\frac{2}{3}} \times x$"))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(arrow.columns()["latex_to_text"](s)).alias("plain"))


@query("SELECT doc_id, substr(sha1(concat_ws(chr(31), text, coalesce(lang, chr(0)), coalesce(source, chr(0)))), 1, 12) AS rev FROM documents")
def entry_rev(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.entry_revision(F.col("text"), F.col("lang"), F.col("source")).alias("rev"))


@query("SELECT doc_id, list_sum(list_concat(range(doc_id % 5 + 1, doc_id % 5 + 4), [55]))::BIGINT AS total, 4 AS n FROM documents")
def page_ranges(spark, sf_dir):
    first = F.col("doc_id") % 5 + 1
    pages = similarity.parse_pages(F.concat(first.cast("string"), F.lit("-"), (first + 2).cast("string"), F.lit(",55")))
    return t(spark, sf_dir, "documents").select("doc_id", F.aggregate(pages, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(pages).alias("n"))


# ---- bank


def _bank(spark, sf_dir):
    label = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    flag = lambda c, n: F.when(F.col(c) == 1, F.lit(n))
    d = t(spark, sf_dir, "documents").join(label, "doc_id", "left")
    flags = F.array_compact(F.array(flag("quality", "verified"), flag("toxic", "human_edited")))
    return d.select("doc_id", F.col("source").alias("file"), F.col("lang").alias("type"), F.array("lang").alias("topics"), flags.alias("flags"), text.search_blob(F.col("text")).alias("blob"))


_BANK = "lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), bank AS (SELECT d.*, coalesce(quality, 0) AS verified, coalesce(toxic, 0) AS edited FROM documents d LEFT JOIN lab USING (doc_id))"


@query(f"WITH {_BANK} SELECT doc_id FROM bank WHERE lang = 'en' AND verified <> 1 AND contains(lower(text), 'tion')")
def bank_filter(spark, sf_dir):
    return bank.bank_filter(_bank(spark, sf_dir), topic="en", state="unverified", text="TION").select("doc_id")


@query(f"WITH {_BANK} SELECT 'file' AS facet, source AS value, count(*) AS n FROM bank GROUP BY ALL UNION ALL SELECT 'type', lang, count(*) FROM bank GROUP BY ALL UNION ALL SELECT 'topic', lang, count(*) FROM bank GROUP BY ALL")
def bank_facets(spark, sf_dir):
    return bank.facets(_bank(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'ing the')")
def bank_search(spark, sf_dir):
    return bank.bank_filter(_bank(spark, sf_dir), text="ing the").select("doc_id")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(left(b.text, 12)))")
def bank_search_indexed(spark, sf_dir):
    """The beginning of every benchmark item, searched by an index of trigrams."""
    index = search.build_index(_bank(spark, sf_dir).select("doc_id", "blob"), folder(spark, "search"), "1")
    texts = t(spark, sf_dir, "benchmark").select("item_id", F.left("text", F.lit(12)).alias("text"))
    return search.search(index, texts).select("item_id", "entry.doc_id")


@query(f"WITH {_BANK} SELECT source AS file, count(*) AS n, sum((edited = 1)::INT)::BIGINT AS edited, sum((verified = 1)::INT)::BIGINT AS verified FROM bank GROUP BY ROLLUP (source)")
def risk_rollup(spark, sf_dir):
    return bank.risk(_bank(spark, sf_dir))


@query(f"""WITH {_BANK}, e AS (SELECT doc_id, row_number() OVER (PARTITION BY source, md5(lower(text)) ORDER BY doc_id) > 1 AS dup, verified = 0 AS no_kind, trim(text) = '' AS blank, lang NOT IN ('en', 'fr') AS bad FROM bank)
SELECT 'duplicate' AS error, count(*) FILTER (dup) AS n FROM e UNION ALL SELECT 'missing:kind', count(*) FILTER (no_kind) FROM e UNION ALL SELECT 'bad_topic', count(*) FILTER (bad) FROM e""")
def bank_check(spark, sf_dir):
    b = _bank(spark, sf_dir)
    e = b.select(F.lit("s").alias("s"), F.lit("t").alias("t"), F.lit("l").alias("l"), F.col("file").alias("src"), F.md5("blob").alias("qid"), F.when(F.array_contains("flags", "verified"), "question").alias("kind"), F.col("blob").alias("stem"), F.lit(False).alias("has_parts"), F.col("type").alias("topic"), F.col("doc_id").alias("ord"))
    taxonomy = spark.createDataFrame([("en", "active"), ("fr", None), ("de", "retired")], "id string, status string")
    c = bank.check(e, taxonomy)
    faults = c.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))
    return faults.unionByName(c.agg(F.count_if("bad_topic").alias("n")).withColumn("error", F.lit("bad_topic")))


@query("SELECT d.doc_id, f.first_id, f.n FROM documents d JOIN (SELECT md5(text) AS h, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1) f ON f.h = md5(d.text)")
def exact_dedup(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "h").drop("h")


@query("""WITH v AS (SELECT user_id AS doc, max(ts) FILTER (event_type = 'signup') AS r, max(ts) FILTER (event_type = 'view') AS c, max(ts) FILTER (event_type = 'purchase') AS g FROM events GROUP BY 1),
s AS (SELECT *, CASE WHEN c IS NOT NULL AND (r IS NULL OR c >= r) THEN 'clean' WHEN r IS NOT NULL THEN 'raw' END AS s1, CASE WHEN c IS NOT NULL AND (r IS NULL OR c >= r) THEN c ELSE r END AS v1 FROM v)
SELECT doc, CASE WHEN g IS NOT NULL AND (v1 IS NULL OR g >= v1) THEN 'tagged' ELSE s1 END AS stage FROM s WHERE coalesce(r, c, g) IS NOT NULL""")
def stage_resolution(spark, sf_dir):
    stage = F.when(F.col("event_type") == "signup", "raw").when(F.col("event_type") == "view", "clean").when(F.col("event_type") == "purchase", "tagged")
    v = t(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), stage.alias("stage"), F.col("ts").alias("version")).filter("stage is not null")
    return bank.live_stage(v).select("doc", "stage")


@query("SELECT o.o_orderkey AS pos, o.o_custkey AS qid, c.c_name, c.c_acctbal FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def resolve_selection(spark, sf_dir):
    cart = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("qid"))
    entries = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_custkey").alias("ord"), "c_name", "c_acctbal")
    return bank.resolve_selection(cart, entries, ["qid"]).select("pos", "qid", "c_name", "c_acctbal")


@query("""WITH RECURSIVE steps AS (SELECT 'o' || o_orderkey AS output, 1 AS page, CASE WHEN o_orderkey % 4 = 0 THEN 'raw' || o_orderkey ELSE 'o' || (o_orderkey - 1) END AS source, 1 AS source_page FROM orders),
l AS (SELECT *, 1 AS depth FROM steps UNION ALL SELECT l.output, l.page, s.source, s.source_page, l.depth + 1 FROM l JOIN steps s ON s.output = l.source AND s.page = l.source_page)
SELECT output, page, arg_max(source, depth) AS source, arg_max(source_page, depth) AS source_page, max(depth) AS depth FROM l GROUP BY output, page""")
def page_map(spark, sf_dir):
    key = F.col("o_orderkey")
    name = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    steps = t(spark, sf_dir, "orders").select(name("o", key).alias("output"), F.lit(1).alias("page"), F.when(key % 4 == 0, name("raw", key)).otherwise(name("o", key - 1)).alias("source"), F.lit(1).alias("source_page"))
    return bank.page_map(steps).drop('crops')


_SETS = "list_distinct(w) AS words, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS pairs"


_NOVELTY = f"""WITH tok AS (SELECT doc_id AS id, 0 AS ref, regexp_extract_all(lower(regexp_replace(text, '\\$\\$?[^$]+\\$\\$?', ' ', 'g')), '[a-z0-9]+') AS w FROM documents UNION ALL SELECT item_id, 1, regexp_extract_all(lower(regexp_replace(text, '\\$\\$?[^$]+\\$\\$?', ' ', 'g')), '[a-z0-9]+') FROM benchmark),
sets AS (SELECT id, ref, {_SETS} FROM tok),
feat AS (SELECT id, ref, 0 AS kind, len(words) AS size, unnest(words) AS f FROM sets UNION ALL SELECT id, ref, 1, len(pairs), unnest(pairs) FROM sets),
common AS (SELECT a.id AS entry_id, b.id AS ref_id, a.kind, count(*) AS n, first(a.size) AS x, first(b.size) AS y FROM feat a JOIN feat b ON a.ref = 0 AND b.ref = 1 AND a.kind = b.kind AND a.f = b.f GROUP BY 1, 2, 3),
s AS (SELECT entry_id, ref_id, max(n / (x + y - n)) AS score FROM common GROUP BY 1, 2),
best AS (SELECT entry_id, ref_id, score, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, ref_id) AS r FROM s)
SELECT d.doc_id AS entry_id, b.ref_id, coalesce(b.score, 0.0) AS score FROM documents d LEFT JOIN best b ON b.entry_id = d.doc_id AND b.r = 1"""


@query(_NOVELTY)
def novelty_scan(spark, sf_dir):
    return _novelty(spark, sf_dir)


@query(_NOVELTY)
def novelty_joined(spark, sf_dir):
    """As with references beyond any bound."""
    return _novelty(spark, sf_dir, bound=-1)


def _novelty(spark, sf_dir, **bound):
    return novelty.novelty(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), "text"), t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), "text"), **bound)


# ---- usage, journal, edits


def _events(spark, sf_dir):
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts", F.col("event_type").alias("title"))


@query("""WITH g AS (SELECT user_id AS key, event_type AS title, count(*) AS n, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1, 2)
SELECT key, sum(n)::BIGINT AS count, epoch_us(min(a)) AS first, epoch_us(max(z)) AS last, string_agg(title, ',' ORDER BY a, title) AS titles FROM g GROUP BY key""")
def usage_map(spark, sf_dir):
    u = records.usage_map(_events(spark, sf_dir))
    return u.select("key", "count", F.unix_micros(F.col("first").cast("timestamp")).alias("first"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"), F.array_join("titles", ",").alias("titles"))


@query("SELECT event_id AS id, user_id AS key, event_type AS title FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def usage_recent(spark, sf_dir):
    return records.recent(_events(spark, sf_dir)).select("id", "key", "title")


@query("SELECT id, key FROM (SELECT event_id AS id, event_type AS key, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 400) WHERE key = 'purchase' ORDER BY ts DESC, id DESC LIMIT 50")
def journal_topk(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), "ts")
    return records.journal(e, "purchase").select("id", "key")


@query("SELECT user_id, event_id AS version, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def current_edits(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), "event_type", (F.col("event_type") == "error").alias("deleted"))
    return records.current(e, ["user_id"])


@query("SELECT min(n)::INT AS n FROM (SELECT 1 AS n UNION SELECT doc_id + 1 FROM documents WHERE doc_id >= 0) WHERE n NOT IN (SELECT doc_id FROM documents)")
def next_manual(spark, sf_dir):
    return records.next_number(t(spark, sf_dir, "documents").select(F.concat(F.lit("manual-"), F.col("doc_id").cast("string")).alias("qid")))


@query("""WITH u AS (SELECT user_id AS qid, count(*) AS n FROM events GROUP BY 1) SELECT d.doc_id AS qid, coalesce(u.n, 0) AS uses FROM documents d LEFT JOIN u ON u.qid = d.doc_id ORDER BY uses, md5('7' || d.doc_id) LIMIT 50""")
def fresh_pick(spark, sf_dir):
    usage = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("qid")).agg(F.count("*").alias("count"))
    return records.fresh_pick(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid")), usage, 50, "7")


@query("SELECT event_id, json_extract_string(props, '$.k')::VARCHAR AS k, length(props)::INT AS n FROM events")
def json_props(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").alias("n"))


# ---- worksheets


_TYPES = "CASE p_size % 7 WHEN 0 THEN 'structured' WHEN 1 THEN 'mcq' WHEN 2 THEN 'fill_blank' WHEN 3 THEN 'true_false' WHEN 4 THEN 'word_problem' WHEN 5 THEN 'short_answer' ELSE 'other' END"


def _selection(spark, sf_dir):
    names = ["structured", "mcq", "fill_blank", "true_false", "word_problem", "short_answer", "other"]
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % 7 + 1).cast("int"))
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), kind.alias("type"), F.nullif(F.col("p_size") % 5, F.lit(0)).alias("marks"))


@query(f"""WITH s AS (SELECT p_partkey AS pos, {_TYPES} AS type, nullif(p_size % 5, 0) AS marks FROM part),
o AS (SELECT type, row_number() OVER (ORDER BY coalesce(list_position(['mcq', 'true_false', 'fill_blank', 'short_answer', 'word_problem', 'structured'], type), 7), min(pos)) AS section_no FROM s GROUP BY type)
SELECT pos, chr((64 + section_no)::INT) AS section, row_number() OVER (ORDER BY section_no, marks NULLS LAST, pos) AS number FROM s JOIN o USING (type)""")
def worksheet_order(spark, sf_dir):
    return worksheet.order_sections(_selection(spark, sf_dir)).select("pos", "section", "number")


@query("SELECT l_orderkey, nullif(sum(l_quantity::INT), 0)::INT AS total FROM lineitem GROUP BY 1")
def paper_total(spark, sf_dir):
    parts = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("int").alias("marks"))).alias("parts"))
    return parts.select("l_orderkey", worksheet.question_total(F.lit(None).cast("int"), F.col("parts")).alias("total"))


@query("""SELECT l_orderkey AS question, kind, ord, CASE kind WHEN 'table' THEN 'Table ' ELSE 'Fig. ' END || l_orderkey || '.' || row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY ord) AS caption
FROM (SELECT l_orderkey, l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN 'table' ELSE 'image' END AS kind FROM lineitem)""")
def caption_numbers(spark, sf_dir):
    a = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), F.when(F.col("l_returnflag") == "R", "table").otherwise("image").alias("kind"), F.col("l_linenumber").alias("ord"))
    return worksheet.captions(a)


@query("""WITH q AS (SELECT p_partkey AS number, p_name AS stem, p_size AS marks, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS k FROM part)
SELECT number, 0 AS row_ord, 'stem' AS kind, number::VARCHAR AS label, stem AS text, CASE WHEN k = 0 THEN marks END AS marks, 2 AS blank_lines FROM q
UNION ALL SELECT number, i, 'part', '(' || chr((96 + i)::INT) || ')', stem, i, 2 FROM q, (VALUES (1), (2)) v(i) WHERE i <= k
UNION ALL SELECT number, k + 1, 'total', NULL, NULL, nullif(marks, 0), 0 FROM q""")
def worksheet_layout(spark, sf_dir):
    part = lambda i: F.struct(F.lit(f"({chr(96 + i)})").alias("no"), F.col("p_name").alias("text"), F.lit(i).alias("marks"))
    parts = F.when(F.col("p_partkey") % 2 == 0, F.array(part(1), part(2))).otherwise(F.array().cast("array<struct<no:string,text:string,marks:int>>"))
    q = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("stem"), F.nullif("p_size", F.lit(0)).alias("marks"), parts.alias("parts"), F.lit(None).cast("string").alias("answer"))
    return worksheet.layout(q)


_PART = "array<struct<path:string,parent_path:string,text:string,marks:int,answer:string,solution:string,answer_area:string>>"


def _order_parts(spark, sf_dir):
    """Orders as questions: a part a line, the second of which lies under the first."""
    none = F.lit(None).cast("string")
    name = lambda n: F.concat(F.lit("("), n.cast("string"), F.lit(")"))
    parent = F.when(F.col("l_linenumber") == 2, "(1)")
    path = F.concat(F.coalesce(parent, F.lit("")), name(F.col("l_linenumber")))
    p = F.struct(path.alias("path"), parent.alias("parent_path"), F.concat(F.col("l_linestatus"), F.lit("\n____ km")).alias("text"), F.col("l_quantity").cast("int").alias("marks"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("answer"), none.alias("solution"), none.alias("answer_area"))
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(p)).cast(_PART).alias("parts"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS n, l_returnflag = 'R' AS has, CASE WHEN l_linenumber = 2 THEN '(1)' ELSE '' END || '(' || l_linenumber || ')' AS path FROM lineitem)
SELECT l_orderkey, string_agg(path, ' ' ORDER BY path) AS slots FROM p WHERE has OR n <> 1 OR NOT EXISTS (SELECT 1 FROM p q WHERE q.l_orderkey = p.l_orderkey AND q.n = 2) GROUP BY 1""")
def answer_slots(spark, sf_dir):
    q = _order_parts(spark, sf_dir)
    return q.select("l_orderkey", F.array_join(F.array_sort(worksheet.answer_slots(F.col("parts"))), " ").alias("slots"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS answered, count(*)::INT AS areas, string_agg(l_linestatus, '|' ORDER BY CASE WHEN l_linenumber = 2 THEN '(1)' ELSE '' END || '(' || l_linenumber || ')', l_linestatus) AS texts FROM lineitem GROUP BY 1")
def polish_parts(spark, sf_dir):
    q = _order_parts(spark, sf_dir).withColumn("parts", parts.polish(F.col("parts")))
    areas = F.size(F.filter("parts", lambda p: p["answer_area"] == "[ANSWER] km"))
    return q.select("l_orderkey", parts.has_answer(F.lit(None).cast("string"), F.col("parts")).alias("answered"), areas.alias("areas"), F.array_join(F.transform("parts", lambda p: p["text"]), "|").alias("texts"))


@query("SELECT doc_id, md5(text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '![](a.png)' ELSE ' ![](a.png)' END) AS restored FROM documents")
def restore_markers(spark, sf_dir):
    marker = F.lit(" ![](a.png)")
    new = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", marker))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(parts.restore_markers(F.concat("text", marker), new)).alias("restored"))


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'es')")
def topic_bank(spark, sf_dir):
    return bank.topic_bank(_bank(spark, sf_dir), ["de", "es"]).select("doc_id")


@query("SELECT doc_id AS qid FROM documents WHERE lang = 'fr' ORDER BY md5('3' || doc_id) LIMIT 20")
def bank_examples(spark, sf_dir):
    return bank.examples(_bank(spark, sf_dir).withColumnRenamed("doc_id", "qid"), ["fr"], 20, "3").select("qid")


# ---- model steps


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'mcq' WHEN p_size % 2 = 0 THEN 'short_answer' WHEN p_partkey % 3 = 1 THEN 'structured' END AS type, p_brand AS topic,
CASE WHEN p_partkey % 3 = 2 AND p_size % 2 = 1 THEN 'topic_invalid,no_type' ELSE 'topic_invalid' END AS flags FROM part""")
def tag_rules(spark, sf_dir):
    vocabulary = ["mcq", "short_answer", "structured"]
    shape = options.structural_type(options.entry_shape(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 3 == 1), vocabulary)
    reply = F.when(F.col("p_size") % 2 == 0, "short_answer").otherwise("nonsense")
    r = model.tag_rules(shape, reply, vocabulary, F.array(F.col("p_brand"), F.lit("unknown")), F.array("p_brand"))
    return t(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.type", F.col("r.topic")[0].alias("topic"), F.array_join("r.flags", ",").alias("flags"))


@query()
def label_model_step(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    payload = F.to_json(F.struct(F.array("lang").alias("topics"), F.lit("mcq").alias("shape")))
    return model.run_model(d, model.MockClient(), "tag", payload, "topic array<string>, type string, difficulty string").select("doc_id", F.col("reply.topic")[0].alias("topic"), "reply.type", "reply.difficulty")
