"""Golden cases of the text, label, part and option functions."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import arrow, html, labels, options, similarity, text, tree


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return df.select(column.alias("out")).first()["out"]


C = F.col


@pytest.mark.parametrize("given_, want", [("$1 1 x + (4 x + 2 x)$", "$11x + (4x + 2x)$"), ("1 1 outside", "1 1 outside"), ("$a$ 1 1 $2 3$", "$a$ 1 1 $23$")])
def test_math_spacing(spark, given_, want):
    assert one(spark, text.fix_math_spacing(C("s")), s=given_) == want


@pytest.mark.parametrize("given_, want", [("a", "(a)"), ("a)", "(a)"), ("a.", "(a)"), ("(a) (i)", "(a)(i)"), ("Part a", "Part a"), ("", "")])
def test_canon_part_no(spark, given_, want):
    assert one(spark, labels.canon_part_no(C("s")), s=given_) == want


@pytest.mark.parametrize("given_, want", [("(a)", 1), ("(b)(i)", 2), ("(i)", 2), ("(ii)", 2), ("(b)(i)(A)", 3), ("(1)", 1), ("(xi)", 1)])
def test_part_depth(spark, given_, want):
    assert one(spark, labels.part_depth(C("s")), s=given_) == want


@pytest.mark.parametrize("given_, want", [("(b)", "B"), ("B.", "B"), ("B", "B"), ("12", "12"), ("word", None)])
def test_bare_label(spark, given_, want):
    assert one(spark, labels.bare_label(C("s")), s=given_) == want


@pytest.mark.parametrize("given_, body, area", [("Find it.\n[ANSWER] km", "Find it.", "[ANSWER] km"), ("$[ANSWER]", "", "$[ANSWER]"), ("Q\na: [ANSWER]\n\nb: [ANSWER]", "Q", "a: [ANSWER]\n\nb: [ANSWER]"), ("The value is [ANSWER] cm and so on", "The value is [ANSWER] cm and so on", None), ("none", "none", None)])
def test_answer_area(spark, given_, body, area):
    got = one(spark, text.answer_area(C("s")), s=given_)
    assert (got["body"], got["area"]) == (body, area)


@pytest.mark.parametrize("given_, want", [("____ km", "[ANSWER] km"), ("figure 3.2 and Table 4.1", "Fig. [QN].2 and Table [QN].1"), ("5 \\cents", "5 ¢"), ("(())", "()"), ("x [Total: 5]", "x"), ("a\n\n\n\nb", "a\n\nb"), (None, "")])
def test_normalize(spark, given_, want):
    assert one(spark, text.normalize_text(C("s")), s=given_) == want


def test_marks(spark):
    body, marks = text.part_mark(C("s"))
    assert tuple(one(spark, F.struct(body.alias("b"), marks.alias("m")), s="Find f(2)")) == ("Find f", 2)
    body, marks = text.part_mark(C("s"), strict=True)
    assert tuple(one(spark, F.struct(body.alias("b"), marks.alias("m")), s="Find f(2)")) == ("Find f(2)", None)
    assert one(spark, text.total_mark(C("s")), s="(T = 300)") == 300


def test_inline_options(spark):
    got = one(spark, options.parse_inline_options(C("s")), s="A 1.2 B 1.8 C 4.8 D 20")
    assert [(o["label"], o["value"]) for o in got] == [("A", "1.2"), ("B", "1.8"), ("C", "4.8"), ("D", "20")]
    assert one(spark, options.parse_inline_options(C("s")), s="only A") is None


def test_canonical_answers_are_not_read_as_labels_again(spark):
    o = F.array(*(F.struct(F.lit(f"({i})").alias("label"), F.lit(str(i)).alias("value")) for i in (1, 2, 3, 4)))
    assert one(spark, options.remap_answer(C("s"), options.canon_options(o)), s="4") == "4"


def test_shape_words(spark):
    assert one(spark, options.structural_type(C("s"), ["mcq_hard", "mcq"]), s="mcq") == "mcq"
    assert one(spark, options.structural_type(C("s"), ["essay"]), s="mcq") is None


def test_question_rows(spark):
    grid = lambda s: html.parse_grid(F.lit(s))
    asks = lambda s: one(spark, html.is_question_row(grid(s)[0], html.grid_width(grid(s))))
    assert asks('<table><tr><td>2.</td><td colspan="3">Which one?</td></tr></table>')
    assert not asks("<table><tr><td>1</td><td>12</td><td>12</td><td>10</td></tr></table>")


def test_pages(spark):
    assert one(spark, similarity.parse_pages(C("s")), s="6-8,55") == [6, 7, 8, 55]


@pytest.mark.parametrize("labels_, paths", [(["(h)", "(i)", "(j)"], ["(h)", "(i)", "(j)"]), (["(b)", "(i)", "(ii)"], ["(b)", "(b)(i)", "(b)(ii)"]), (["(a)(i)", "(a)(ii)"], ["(a)", "(a)(i)", "(a)(ii)"]), (["(i)", "(ii)"], ["", "(i)", "(ii)"]), (["(a)(i)", "(b)(i)"], ["(a)", "(a)(i)", "(b)", "(b)(i)"]), (["(b)(i)(A)"], ["(b)", "(b)(i)", "(b)(i)(A)"])])
def test_nesting(spark, labels_, paths):
    assert [p["path"] for p in nested(spark, labels_)] == paths


def nested(spark, labels_):
    return spark.createDataFrame([(labels_,)], "x array<string>").select(tree.nest_parts(C("x")).alias("o")).first()["o"]


def test_split_by_parts(spark):
    labels_ = ["(a)", "(b)", "(b)(i)"]

    def cut(value):
        r = spark.createDataFrame([(value, labels_)], "t string, p array<string>").select(tree.split_by_parts(C("t"), C("p")).alias("o")).first()["o"]
        return r["lead"], [tuple(x) for x in r["parts"]]

    assert cut("(a) $6:11$; (b) Tank X: 31.2 l") == ("", [("(a)", "$6:11$"), ("(b)", "Tank X: 31.2 l")])
    assert cut("(b) 5") == ("", [("(b)", "5")])
    assert cut("as (a) says") == ("as (a) says", [])
    assert cut("all: (A) 1 (z) 2 (b) 3 (i) 4;") == ("all:", [("(a)", "1 (z) 2"), ("(b)", "3"), ("(b)(i)", "4")])
    assert cut(None) == (None, [])


def test_json_repair():
    assert arrow.repair_json('```json\n{"a": "\\times 3 \\n \\frac{1}{2}"}```') == '{"a": "\\\\times 3 \\n \\\\frac{1}{2}"}'
    assert arrow.repair_json("no json") is None
    assert arrow.repair_json('{"a": 1} as in [1]') == '{"a": 1}' and arrow.repair_json("so: [1, 2], or") == "[1, 2]"
    assert arrow.repair_json('{"a": "\\nabla \\therefore \\, \\u00e9 \\uparrow"}') == '{"a": "\\\\nabla \\\\therefore \\\\, é \\\\uparrow"}'
    assert arrow.repair_json('{"t": "line\nbreak"}') == '{"t": "line\\nbreak"}'


def test_chemistry():
    ce = arrow.expand_ce
    assert ce(r"\ce{2H2 + O2 -> 2H2O}") == r"2\mathrm{H}_{2} + \mathrm{O}_{2}  \rightarrow  2\mathrm{H}_{2}\mathrm{O}"
    assert ce(r"\ce {Fe^{3+}} x \ce{SO4^2-}") == r"\mathrm{Fe}^{3+} x \mathrm{SO}_{4}^{2-}"
    assert ce(r"\ce{A <-> B}") == r"\mathrm{A}  \leftrightarrow  \mathrm{B}" and ce("plain") == "plain" and ce(None) is None


def test_latex_as_text():
    plain = arrow.latex_to_text
    assert plain(r"\frac{1}{\dfrac{2}{x}}") == "1/2/x" and plain(r"\$5 and 50\%") == r"\$5 and 50%"
    assert plain(r"\begin{aligned}a&=b\\c&\leq d\end{aligned}") == "a=b\nc≤ d"
    assert plain(r"\ce{H2O} \text{cm}^{2} x_{1}") == "H2O cm^2 x1"


def test_occupancy(spark):
    import random

    def brute(rows):
        taken, out = set(), []
        for r, row in enumerate(rows or []):
            c = 0
            for text, colspan, rowspan in row:
                while (r, c) in taken:
                    c += 1
                taken |= {(r + i, c + j) for i in range(rowspan) for j in range(colspan)}
                out.append((r, c, text))
                c += colspan
        return out

    rng = random.Random(2)
    grids = [[[("a", 1, 2), ("b", 2, 1)], [("c", 1, 1), ("d", 1, 1)]], None, [], [[], [("x", 1, 1)]]]
    grids += [[[(f"{r}{c}", rng.randint(1, 3), rng.randint(1, 3)) for c in range(rng.randint(0, 4))] for r in range(rng.randint(1, 5))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(grids)), "n int, g array<array<struct<text:string,colspan:int,rowspan:int>>>")
    got = {r["n"]: [(x["r"], x["c"], x["text"]) for x in r["o"]] for r in df.select("n", html.grid_occupancy(F.col("g")).alias("o")).collect()}
    assert got == {n: brute(g) for n, g in enumerate(grids)}
    assert got[0] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c"), (1, 2, "d")]



def test_nesting_keeps_every_label(spark):
    rng = random.Random(3)
    lists = [[rng.choice(["(a)", "(b)", "(c)", "(i)", "(ii)", "(b)(i)", "(h)", "(v)", "word"]) for _ in range(rng.randint(0, 8))] for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in lists], "x array<string>").select("x", tree.nest_parts(C("x")).alias("o")).collect()
    for r in rows:
        assert [p["ord"] for p in r["o"] if p["ord"] >= 0] == list(range(len(r["x"])))
        assert all(p["depth"] == 1 or any(q["path"] == p["parent_path"] and q["depth"] == p["depth"] - 1 for q in r["o"][:i]) for i, p in enumerate(r["o"]))


def test_pages_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        one(spark, similarity.parse_pages(C("s"), F.lit(7)), s="6-8")
