"""Operators on small fixtures: stages, pairing, selection, edits, sources, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import answers, bank, build, edits, model, novelty, records, segment, worksheet
from inkwell.sources import records as sources
from inkwell.streaming import ingest


@pytest.mark.parametrize("versions, want", [([("raw", 1), ("clean", 2), ("tagged", 3)], "tagged"), ([("raw", 2), ("clean", 1)], "raw"), ([("raw", 3), ("clean", 1), ("tagged", 2)], "raw"), ([("raw", 1), ("clean", 1)], "clean"), ([("clean", 1)], "clean")])
def test_live_stage(spark, versions, want):
    df = spark.createDataFrame([("d", s, v) for s, v in versions], "doc string, stage string, version int")
    assert bank.live_stage(df).first()["stage"] == want


def test_pairing_uses_each_answer_once(spark):
    q = spark.createDataFrame([("d", 1, "Section A", "7", False), ("d", 2, "Section B", "7", False), ("d", 3, "", "9", True)], "doc string, q_ord int, section string, qno string, implicit boolean")
    a = spark.createDataFrame([("d", 1, "section-a", "7"), ("d", 2, "SECTION  B.", "7"), ("d", 3, "", "1")], "doc string, ord int, section string, qno string")
    got = {r["q_ord"]: (r["ans_ord"], r["pass"]) for r in answers.match_answers(q, a).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (3, 3)}


def test_selection_keeps_order_and_last_duplicate(spark):
    cart = spark.createDataFrame([(1, "b", "q"), (2, "a", "q"), (3, "z", "q")], "pos int, src string, qid string")
    e = spark.createDataFrame([("a", "q", 1, "old"), ("a", "q", 2, "new"), ("b", "q", 1, "other")], "src string, qid string, ord int, stem string")
    assert [r["stem"] for r in bank.resolve_selection(cart, e, ["src", "qid"]).collect()] == ["other", "new"]


def test_edits(spark):
    log = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, False, "y"), ("b", 1, False, "z"), ("b", 2, True, None)], "qid string, version int, deleted boolean, stem string")
    assert [(r["qid"], r["stem"]) for r in records.current(log, ["qid"]).collect()] == [("a", "y")]
    assert sorted(r["stem"] for r in records.restored(log, ["qid"], 1).collect()) == ["x", "z"]


def test_numbering_over_many_partitions(spark):
    df = spark.range(1000).withColumn("k", F.hash("id"))
    got = worksheet.numbered(df, [F.col("k"), F.col("id")]).orderBy("k", "id").collect()
    assert [r["number"] for r in got] == list(range(1, 1001))


def test_noise(spark):
    b = spark.createDataFrame([("d", 0, "page_number", "3", [480.0, 950.0, 520.0, 970.0]), ("d", 1, "footer", "A long sentence mislabelled as a footer in mid page", [60.0, 620.0, 900.0, 660.0]), ("d", 2, "footer", "another long text without any box", None), ("d", 3, "odd", "x", None)], "doc string, i int, type string, text string, bbox array<double>")
    got = {r["i"]: (r["type"], r["rescued"], r["unknown_type"]) for r in segment.filter_noise(b).collect()}
    assert got == {1: ("text", True, False), 2: ("text", True, False), 3: ("odd", False, True)}


def test_jsonl(spark, tmp_path):
    d = tmp_path / "math" / "primary" / "p6" / "bk" / "interim"
    d.mkdir(parents=True)
    (d / "ch1.clean.jsonl").write_text(json.dumps({"qid": "ch1-001", "kind": "mcq", "stem": "x"}) + "\nnot json\n")
    e = sources.refuse_blank(sources.read_entries(spark, str(tmp_path)))
    assert [(r["qid"], r["source"], r["level"], r["file_stem"]) for r in e.collect()] == [("ch1-001", "bk", "p6", "ch1")]
    assert sources.discover(spark, str(tmp_path)).collect()[0]["source"] == "bk"
    (d / "bad.jsonl").write_text("garbage\n")
    with pytest.raises(ValueError):
        sources.refuse_blank(sources.read_entries(spark, str(tmp_path)))


def test_snapshot_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    assert sources.snapshot(df, str(tmp_path / "snap"), "t1")[0] == 2
    src = tmp_path / "land"
    src.mkdir()
    (src / "a.json").write_text('{"qid": "q1"}\n')
    q = ingest.append_log(ingest.entries(spark, str(src)), str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["qid"] for r in spark.read.parquet(str(tmp_path / "log")).collect()] == ["q1"]


def test_numbers_of_a_large_pruned_table(spark):
    """1..n without gaps or losses, also when the caller drops columns that the order doesn't need."""
    df = spark.range(1_000_000).select((F.hash("id") % 1000).alias("k"), "id", F.lit("x").alias("pad"))
    got = worksheet.numbered(df, [F.col("k"), F.col("id")]).drop("pad", "k").agg(F.count("*"), F.countDistinct("number"), F.min("number"), F.max("number")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 1, 1_000_000)


def test_pages_through_long_chains(spark):
    """300 outputs, each made of the one before; crops of all steps, the innermost first; a circle is an error."""
    chain = [(f"o{i}", 1, f"o{i - 1}" if i else "paper.pdf", 1 if i else 7, f"c{i}" if i % 100 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(chain, "output string, page int, source string, source_page int, crop string")
    got = {r["output"]: r for r in bank.page_map(df).collect()}
    assert all((r["source"], r["source_page"], r["depth"]) == ("paper.pdf", 7, int(k[1:]) + 1) for k, r in got.items())
    assert got["o299"]["crops"] == ["c0", "c100", "c200"] and got["o99"]["crops"] == ["c0"]
    circle = spark.createDataFrame([("a", 1, "b", 1), ("b", 1, "a", 1)], "output string, page int, source string, source_page int")
    with pytest.raises(ValueError):
        bank.page_map(circle, rounds=4)


RAW = "doc string, i int, type string, text string, table_body string, code_body string, img_path string, page_idx int, bbox array<double>"
PAPER = [
    ("ch", 0, "header", "Page 1", None, None, None, 0, [0.0, 10.0, 1.0, 20.0]), ("ch", 1, "text", "7. What is 1? [Total: 5]", None, None, None, 0, None), ("ch", 2, "text", "(a) first $1 1$\n____ km [2]", None, None, None, 0, None),
    ("ch", 3, "text", "(b) Do:\n(i) foo\n(ii) bar", None, None, None, 1, None), ("ch", 4, "image", None, None, None, "f.png", 1, None), ("ch", 5, "text", "8. Choose", None, None, None, 2, None), ("ch", 6, "text", "A 1.2 B 1.8", None, None, None, 2, None),
    ("ch", 7, "table", None, '<table><tr><td>x</td><td>y</td></tr><tr><td>9.</td><td colspan="3">Which one?</td></tr><tr><td></td></tr><tr><td>1</td><td>2</td></tr></table>', None, "t.png", 2, None), ("ch", 8, "text", "= 5", None, None, None, 3, None),
]


def _labelled(spark, client=None):
    roles = {6: "option", 8: "solution"}
    b = segment.label_blocks(segment.split_tables(segment.load_blocks(spark.createDataFrame(PAPER, RAW))), client)
    role = F.col("role")
    for src, name in roles.items():
        role = F.when(F.col("src_i") == src, name).otherwise(role)
    return b.withColumn("role", role)


def test_a_paper_becomes_entries(spark):
    a = spark.createDataFrame([("ch", 0, "", "7", "(a)", "11 km", "", [5]), ("ch", 1, "", "7", "(b)(i)", "x", "long way", [6]), ("ch", 2, "", "8", "", "B", None, [])], "doc string, ord int, section string, qno string, part string, answer string, solution string, figs array<int>")
    figures = spark.createDataFrame([("ch", 5, "image", "s.png", 0, None), ("ch", 6, "image", "", 0, None)], "doc string, i int, type string, img_path string, page_idx int, bbox array<double>")
    missing = spark.createDataFrame([("ch", "f.png")], "doc string, path string")
    labelled = _labelled(spark)
    e = build.build_entries(segment.questions(segment.number_blocks(labelled)), a, figures, missing)
    one, two, three = e.orderBy("qid").collect()
    assert (one["qid"], one["stem"], one["meta"]["marks"], one["meta"]["blocks"], one["meta"]["pages"]) == ("ch-001", "What is 1?", 5, [1, 4], [0, 1])
    assert [(p["path"], p["text"], p["marks"], p["answer"], p["solution"], p["answer_area"]) for p in one["parts"]] == [("(a)", "first $11$", 2, "11 km", None, "[ANSWER] km"), ("(b)", "Do:", None, None, None, None), ("(b)(i)", "foo", None, "x", "long way", None), ("(b)(ii)", "bar\n![](f.png)", None, None, None, None)]
    assert [(x["path"], x["src"]) for x in one["imgs"]] == [("f.png", "q"), ("s.png", "ans")] and one["answer"] is None and "image_missing" in one["flags"]
    assert (two["kind"], [(o["label"], o["value"]) for o in two["options"]], two["answer"]["value"]) == ("mcq", [("(1)", "1.2"), ("(2)", "1.8")], "(2)")
    assert three["stem"] == "Which one?\n<table><tr><td>1</td><td>2</td></tr></table>" and three["answer"]["value"] == "5" and three["solution"] == "= 5"
    assert "<tr><td>x</td>" in two["stem"]
    r = build.report(e, labelled).first()
    assert (r["questions"], r["with_answer"], r["mcq"], r["blocks_dropped"], r["flags"]["image_missing"]) == (3, 3, 1, 0, 1)
    s = build.sidecar(a, figures).orderBy("ord").collect()
    assert [x["figs"] for x in s] == [["s.png"], [], []]


def test_blocks_of_one_file_are_read_by_all_tasks(spark):
    """rows of few bytes, on which parsing takes long, came in one task each for blocks and for entries."""
    raw = spark.createDataFrame([(f"d{k}", *b[1:]) for k in range(40) for b in PAPER], RAW).coalesce(1)
    blocks = segment.split_tables(segment.load_blocks(raw))
    assert blocks.filter("i = 0").count() == 40 and segment.load_blocks(raw).rdd.getNumPartitions() >= 4
    e = build.build_entries(segment.questions(segment.number_blocks(segment.label_blocks(blocks))))
    assert e.select("doc").distinct().count() == 40 and len(e.inputFiles()) == 4


def test_unreadable_labels_fall_back(spark):
    class Odd:
        calls = 0

        def reply(self, task, payload):
            raise TimeoutError

    b = segment.split_tables(segment.load_blocks(spark.createDataFrame(PAPER, RAW)))
    want = {r["i"]: (r["role"], r["label"]) for r in segment.label_blocks(b).collect()}
    asked = model.run_model(spark.range(1).select(F.lit("x").alias("x")), Odd(), "label", F.lit("{}"), "array<int>", tries=2, pause=0.0)
    assert asked.first()["reply"] is None

    class Prose:
        def reply(self, task, payload):
            return "no labels today"

    assert {r["i"]: (r["role"], r["label"]) for r in segment.label_blocks(b, Prose()).collect()} == want


def test_patches(spark):
    e = build.build_entries(segment.questions(segment.number_blocks(_labelled(spark))))
    none = {"stem": None, "solution": None, "answer": None, "options": None, "parts": None}
    patches = [("ch-001", {**none, "stem": "12. What $5", "parts": [("a", "new [4]"), ("(b)(ii)", "rest")]}, []), ("ch-002", {**none, "answer": " N/A "}, ["stem"]), ("ch-003", none, ["solution", "answer"])]
    df = spark.createDataFrame([(q, tuple(p.values()), n) for q, p, n in patches], f"qid string, patch {build.PATCH}, nulls array<string>")
    one, two, three = build.apply_patch(e, df).orderBy("qid").collect()
    assert one["changed"] == ["stem", "parts"] and one["soft"] == ["stem_qno", "latex_suspect"]
    assert [(p["path"], p["text"], p["marks"], p["answer_area"]) for p in one["parts"]] == [("(a)", "new", 4, "[ANSWER] km"), ("(b)", "", None, None), ("(b)(ii)", "rest\n![](f.png)", None, None)]
    assert two["rejected"] == ["answer: verdict-token value N/A"] and two["changed"] == [] and three["changed"] == ["answer", "solution"] and three["solution"] is None


def test_many_references_give_the_same_novelty(spark):
    text = lambda i: " ".join(f"w{(i * k) % 17}" for k in range(1, 9))
    e = spark.createDataFrame([(i, text(i)) for i in range(60)] + [(98, ""), (99, None)], "entry_id long, text string")
    r = spark.createDataFrame([(i, text(i + 3)) for i in range(20)], "ref_id long, text string")
    rows = lambda df: sorted((x["entry_id"], x["ref_id"], round(x["score"], 12)) for x in df.collect() if x["ref_id"] is not None)
    assert rows(novelty.novelty(e, r)) == rows(novelty.novelty(e, r, bound=0)) and novelty.novelty(e, r.limit(0)).filter("score > 0 or ref_id is not null").count() == 0


def test_settings_and_folders():
    assert sources.settings("content_root: /a\nx: 1", None, {}) == {"content_root": "/a", "x": 1} and sources.settings("{bad", "/b", {"CONTENT_ROOT": "/c"}) == {"content_root": "/b"}
    assert sources.settings(None, None, {"CONTENT_ROOT": "/c"}) == {"content_root": "/c"}
    assert sources.folders("/r/", "math", "primary", "p6", "bk")["interim"] == "/r/math/primary/p6/bk/interim"


def test_reports_and_listings(spark, tmp_path):
    df = spark.createDataFrame([("d", 1)], "doc string, n int")
    for kind in ("report", "clean"):
        sources.write_report(df, str(tmp_path / "reports"), kind)
    assert spark.read.json(str(tmp_path / "reports")).filter("kind = 'clean'").count() == 1
    files = spark.createDataFrame([("/b/bk_1.zip", 5, 1), ("/b/bk_2.zip", 6, 2), ("/b/other_1.zip", 6, 3)], "path string, length long, modificationTime int")
    assert [r["file"] for r in edits.backups(files, "bk").collect()] == ["bk_2.zip", "bk_1.zip"]
    assert sources.layout_version(spark.createDataFrame([("d", '{"_version_name": "2.5"}'), ("e", "{}")], "doc string, value string")).orderBy("doc").collect() == [("d", "2.5"), ("e", None)]
