"""Keys, edit chains, kept replies, circles, intervals and rarest-first joins of the record operators, and files read again only if changed."""

import hashlib
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.operators import answers, bank, build, edits, model, novelty, search, segment
from inkwell.plans import paper
from inkwell.sources import incremental
from inkwell.sources import records as sources

from .conftest import SMALL


def test_a_stage_is_overwritten_by_source(spark, tmp_path):
    row = lambda s, q: ("m", "p", "6", s, q)
    put = lambda *rows: sources.write_stage(spark.createDataFrame(list(rows), "subject string, stage string, level string, source string, qid string"), str(tmp_path / "out"))
    put(row("one", "a"), row("one", "b"))
    put(row("two", "c"))
    put(row("one", "d"))
    assert {(r["source"], r["qid"]) for r in spark.read.json(str(tmp_path / "out")).collect()} == {("one", "d"), ("two", "c")}
    with pytest.raises(ValueError):
        put_nothing = spark.createDataFrame([], "subject string, stage string, level string, source string, qid string")
        sources.write_stage(put_nothing, str(tmp_path / "out"))


class Counting:
    """Counts its calls in a file, over all workers; refuses what it is told to refuse."""

    def __init__(self, path, refuse=""):
        self.path, self.refuse = str(path), refuse

    def calls(self):
        return sum(1 for _ in open(self.path)) if os.path.exists(self.path) else 0

    def reply(self, task, payload):
        with open(self.path, "a") as f:
            f.write("x\n")
        if self.refuse and self.refuse in json.dumps(payload):
            raise OSError("no reply")
        if task == "clean":
            return {"patch": {"stem": "Better " + json.loads(payload["view"])["stem"]}, "severe": False}
        return {"labels": []}


def test_entries_of_two_documents_with_one_qid(spark, tmp_path):
    e = paper._editable(spark, SMALL).limit(6).withColumns({"doc": F.when(F.col("qid") % 2 == 0, "one").otherwise("two")})
    e = e.withColumns({"stem": F.concat(F.col("doc"), F.col("qid").cast("string")), "qid": F.floor(F.col("qid") / 2)})
    client = Counting(tmp_path / "calls")
    got = build.clean_entries(e, client).collect()
    assert len(got) == 6 and all(r["stem"] == f"Better {r['doc']}{2 * r['qid'] + (r['doc'] == 'two')}" for r in got) and client.calls() == 6


def test_replies_are_kept(spark, tmp_path):
    store, client = str(tmp_path / "store"), Counting(tmp_path / "calls", refuse="7")
    df = spark.createDataFrame([(i, str(i % 10)) for i in range(40)] + [(99, None)], "n int, x string")
    ask = lambda: model.run_model(df, client, "t", F.when(F.col("x").isNotNull(), F.to_json(F.struct("x"))), "array<string>", wrapped="labels", tries=2, pause=0, store=store)
    out = ask()
    assert out.filter("reply is null").count() == 5 and out.count() == 41 and client.calls() == 9 + 2  # nine payloads, and two tries of the one that fails
    assert ask().filter("reply is not null").count() == 36 and client.calls() == 9 + 4  # only the failure is asked again
    blocks = spark.createDataFrame([("d", i, "text", f"t{i}", None, None, None) for i in range(170)], "doc string, i int, type string, text string, table_body string, hint string, label string")
    labeller = Counting(tmp_path / "labels")
    assert segment.label_blocks(blocks, labeller).count() == 170 and labeller.calls() == 2


def _live(spark):
    return paper._editable(spark, SMALL).limit(3)


def _edit(stem, type_=None):
    return (stem, None, None, None, None, [], type_, None, None)


def test_of_two_edits_with_one_rev_the_first_wins(spark):
    live = _live(spark)
    rev = {r["qid"]: r["rev"] for r in live.collect()}
    a, b, c = sorted(rev)
    kind = f"qid long, rev string, seq int, edit struct<{edits.EDIT}>"
    made, _ = edits.save_edits(live, spark.createDataFrame([(a, rev[a], 1, _edit("one"))], kind), ["qid"], ["mcq"], 5)
    after = bank.with_revision(made).first()["rev"]
    sent = [(a, rev[a], 2, _edit("second")), (a, rev[a], 1, _edit("one")), (a, after, 3, _edit("third")), (b, "0" * 12, 1, _edit("x")), (c, rev[c], 1, _edit("x", "odd")), (c, rev[c], 2, _edit("y", "mcq")), (12345678, None, 1, _edit("z"))]
    rows, refused = edits.save_edits(live, spark.createDataFrame(sent, kind), ["qid"], ["mcq"], 5)
    assert sorted((r["qid"], r["stem"], r["version"]) for r in rows.collect()) == [(a, "one", 5), (a, "third", 6), (c, "y", 5)]
    assert sorted(tuple(r) for r in refused.collect()) == sorted([(a, 2, "changed since"), (b, 1, "changed since"), (c, 1, "bad type"), (12345678, 1, "unknown")])
    again = edits.save_edits(live, spark.createDataFrame([(a, rev[a], 1, _edit("one"))], kind).drop("seq"), ["qid"], ["mcq"], 5)[0]
    assert again.count() == 1


def test_manual_numbers_and_odd_names(spark):
    held = spark.createDataFrame([("manual-001",), ("manual-x",), ("manual-",), (None,), ("manual-003",), ("manual-99999999999999999999",)], "qid string")
    got = edits.assign_manual(spark.createDataFrame([(1,), (2,)], "ord int"), held).orderBy("ord").collect()
    assert [r["qid"] for r in got] == ["manual-002", "manual-004"]


def test_a_restore_knows_the_file(spark):
    cols = "source string, file_stem string, qid string, pipeline_stage string, content string, tags string"
    stages = spark.createDataFrame([("s", "one", "q1", "raw", "a", "t"), ("s", "two", "q1", "raw", "b", "t"), ("s", "two", "q1", "clean", "b2", "u")], cols)
    back = spark.createDataFrame([("s", "one", "q9", "new"), ("s", "two", "q1", "then")], "source string, file_stem string, qid string, content string")
    got = sorted(tuple(r) for r in edits.restore_entries(stages, back).fillna("-").collect())
    assert got == [("s", "one", "q1", "raw", "a", "t"), ("s", "one", "q9", "raw", "new", "-"), ("s", "two", "q1", "clean", "then", "u"), ("s", "two", "q1", "raw", "then", "t")]


def test_circles_are_named(spark):
    steps = [("a", 1, "b", 1), ("b", 1, "c", 1), ("c", 1, "a", 1), ("x", 1, "a", 1), ("ok", 1, "paper", 3)]
    df = spark.createDataFrame([(*s, "crop") for s in steps], "output string, page int, source string, source_page int, crop string")
    with pytest.raises(bank.Circle) as caught:
        bank.page_map(df)
    assert caught.value.pages and set(caught.value.pages) <= {("a", 1), ("b", 1), ("c", 1)}


def test_blocks_in_no_range(spark):
    rng = random.Random(3)
    blocks = [(d, i) for d in "ab" for i in range(-5, 700)] + [("a", None), ("c", 1)]
    ranges = [(d, s := rng.randint(-10, 650), s + rng.randint(-2, 12)) for d in "ab" for _ in range(25)] + [("a", 300, 420)]
    df = segment.dropped_blocks(spark.createDataFrame(blocks, "doc string, i int"), spark.createDataFrame(ranges, "doc string, first_i int, last_i int"), width=16)
    want = sorted((d, i) for d, i in blocks if i is not None and not any(r == d and a <= i <= z for r, a, z in ranges))
    assert sorted((r["doc"], r["i"]) for r in df.filter("i is not null").collect()) == want and df.filter("i is null").count() == 1


def test_rarest_first_finds_the_best_and_looks_up_no_stop_word(spark, monkeypatch):
    rng = random.Random(5)
    stop = [f"the{i}" for i in range(5)]
    text = lambda: " ".join(rng.sample(stop, 4) + rng.sample([f"w{g}x{i}" for g in [rng.randrange(12)] for i in range(25)], 18))
    e = [(i, text()) for i in range(80)] + [(80, " ".join(stop)), (81, ""), (82, None), (83, "alone"), (83, "alone")]
    r = [(i, text()) for i in range(60)] + [(60, e[3][1]), (61, e[3][1]), (None, e[4][1])]
    seen, real = [], novelty.candidates

    def watched(*args):
        out = real(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(novelty, "candidates", watched)
    left, right = spark.createDataFrame(e, "entry_id long, text string"), spark.createDataFrame(r, "ref_id long, text string")
    rows = lambda df: sorted((x["entry_id"], -1 if x["ref_id"] is None else x["ref_id"], round(x["score"], 12)) for x in df.collect())
    assert rows(novelty.novelty(left, right, bound=-1)) == rows(novelty.novelty(left, right))
    assert sum(seen) < 0.6 * 80 * 62  # all pairs share stop words


def test_only_changed_files_are_read(spark, tmp_path):
    root, at = tmp_path / "tree", str(tmp_path / "bank")

    def put(source, name, stems, text=None):
        d = root / "m" / "p" / "6" / source / "interim"
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(text or "".join(json.dumps({"qid": f"{name}-{i}", "stem": s}) + "\n" for i, s in enumerate(stems)))
        return d / name

    def rows():
        return sorted((r["source"], r["file_stem"], r["pipeline_stage"], r["stem"]) for r in incremental.bank_rows(spark, at).collect())

    refresh = lambda: {(os.path.basename(r["path"]), r["state"]) for r in incremental.refresh(spark, str(root), at).collect()}
    same = put("one", "a.jsonl", ["x", "y"])
    put("one", "b.clean.jsonl", ["z"])
    gone, bad = put("two", "c.jsonl", ["u"]), put("one", "d.jsonl", [], "garbage\n")
    assert refresh() == {("a.jsonl", "new"), ("b.clean.jsonl", "new"), ("c.jsonl", "new"), ("d.jsonl", "new")}
    assert rows() == [("one", "a", "raw", "x"), ("one", "a", "raw", "y"), ("one", "b", "clean", "z"), ("two", "c", "raw", "u")]
    assert [(os.path.basename(r["path"]), r["reason"]) for r in incremental.warnings(spark, at).collect()] == [("d.jsonl", "no readable row")]
    times = os.stat(same)
    same.write_text(same.read_text().replace('"x"', '"!"'))  # behind the manifest's back: if it were read, this would show
    os.utime(same, ns=(times.st_atime_ns, times.st_mtime_ns))
    put("one", "b.clean.jsonl", ["z", "new"])
    gone.unlink()
    assert refresh() == {("b.clean.jsonl", "changed"), ("c.jsonl", "gone")}
    assert rows() == [("one", "a", "raw", "x"), ("one", "a", "raw", "y"), ("one", "b", "clean", "new"), ("one", "b", "clean", "z")]
    assert refresh() == set()
    put("one", "d.jsonl", ["mended"])
    assert refresh() == {("d.jsonl", "changed")} and ("one", "d", "raw", "mended") in rows() and incremental.warnings(spark, at).count() == 0
    assert bad.exists()


def test_files_are_read_whole_or_reported(spark, tmp_path):
    for n in ("good", "short", "other", "paper_ans"):
        (tmp_path / n).write_bytes(n.encode() * 10)
    size, digest = 40, hashlib.sha256(b"good" * 10).hexdigest()
    files = [(f"file://{tmp_path}/good", size, digest), (f"file://{tmp_path}/short", 999, None), (f"file://{tmp_path}/other", None, digest), (f"file://{tmp_path}/none", None, None), (f"file://{tmp_path}/paper_ans", None, None)]
    got = incremental.read_whole(spark.createDataFrame(files, "path string, length long, sha256 string"), tries=2, pause=0)
    told = {os.path.basename(r["path"]): (r["ok"], r["reason"], r["content"] and bytes(r["content"])) for r in got.collect()}
    assert told == {"good": (True, None, b"good" * 10), "short": (False, "short read: 50 of 999 bytes", None), "other": (False, "content differs from its hash", None), "none": (False, "no such file", None), "paper_ans": (True, None, b"paper_ans" * 10)}
    sums = incremental.outcomes(got).first()
    assert sums["ok"] == 1 and set(sums["failed"]) == {"short", "other", "none"}


def test_search_finds_what_contains_finds(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "naïve", "日本語", "😀x", "100%", "a_b", ""]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(300)] + [(300, None), (301, ""), (302, "ba" * 2_500_000 + "end")]
    texts += [(400 + i, t) for i, (_, t) in enumerate(texts[:40])]  # copies
    entries = spark.createDataFrame(texts, "id int, blob string").repartition(5)
    at = search.build_index(entries, str(tmp_path / "index"), "v1")
    asked = ["NAÏVE alpha", "日", "日本語 😀X", "😀", "a", "", "xyzzy", "100% a_b", "%", "alpha  beta", "abend", "😀x 😀x 😀x", None, "beta", "beta"]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(asked)], "n int, text string")
    found = search.search(at, df)
    got = sorted((r["n"], r["entry"]["id"]) for r in found.collect())
    assert got == sorted((n, i) for n, x in enumerate(asked) if x is not None for i, t in texts if t is not None and x.lower() in t)
    assert found.columns == ["n", "text", "entry"]
    made = os.path.getmtime(f"{at}/grams/_SUCCESS")
    assert search.build_index(entries, str(tmp_path / "index"), "v1") == at and os.path.getmtime(f"{at}/grams/_SUCCESS") == made
    assert search.build_index(entries.limit(0), str(tmp_path / "index"), "v2") != at
    assert search.search(f"{tmp_path}/index/version=v2", df).count() == 0


def test_search_reads_the_folders_of_candidates(spark, tmp_path):
    entries = spark.range(4000, numPartitions=8).select("id", F.concat(F.lit("entry "), F.col("id").cast("string")).alias("blob"))
    at = search.build_index(entries, str(tmp_path / "index"), "1")
    found = search.search(at, spark.createDataFrame([("entry 777",)], "text string"))
    assert [r["entry"]["id"] for r in found.collect()] == [777]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*slab#\d+L? (=|IN)", plan)  # one folder of eight


class Key:
    """Reads a printed answer key, carrying headings on, and notes each payload in a file."""

    def __init__(self, path):
        self.path = str(path)

    def calls(self):
        return [json.loads(line) for line in open(self.path)] if os.path.exists(self.path) else []

    def reply(self, task, payload):
        with open(self.path, "a") as f:
            f.write(json.dumps(payload) + "\n")
        section, out = payload.get("context") or "", []
        for line in payload["listing"].split("\n"):
            i, text = int(line[1 : line.index("]")]), line.split(") ", 1)[1]
            if text.startswith(("Section", "Group")):
                section = text
            elif text[:1].isdigit():
                qno, answer = text.split(". ", 1)
                out.append({"section": section, "qno": f"Q{qno}", "answer": answer, "solution": " working ", "figs": [i, 9999, "x"]})
            else:
                out.append({"section": section, "qno": "", "answer": text})
        return out


def _in_turn(blocks, client, chunk, overlap):
    """The records of one document, read chunk after chunk."""
    section, seen = "", {}
    for i in range(0, len(blocks), chunk):
        part = blocks[max(0, i - overlap) : i + chunk]
        listing = "\n".join(f"[{n}] (text) {text}" for n, text in part)
        for r in client.reply("answers", {"listing": listing, **({"context": section} if section else {})}):
            if r["qno"]:
                section = r["section"] or section
                key = (r["section"], r["qno"]) if r["section"] else (r["qno"], r["answer"][:40])
                seen.setdefault(key, (r["section"], r["qno"][1:], r["answer"], r["figs"][0]))
    return list(seen.values())


@pytest.mark.parametrize("heading", ["Section {}", "Group {}"])  # guessed from the print, or learned from the replies
def test_answers_are_read_as_in_turn(spark, tmp_path, heading):
    rng, docs = random.Random(5), {}
    for d in ("one", "two", "none"):
        docs[d] = [(i, heading.format("ABCDEFGH"[i // 37 % 8]) if rng.random() < (0 if d == "none" else 0.06) else f"{i % 25}. answer {i}" if rng.random() < 0.95 else "noise of the page") for i in range({"one": 143, "two": 31, "none": 50}[d])]
    b = spark.createDataFrame([(f"{d}_ans", i, "text", x, None) for d, bs in docs.items() for i, x in bs] + [("one", 0, "text", "1. a question", None)], "doc string, i long, type string, text string, table_body string")
    questions, keys = answers.answer_files(b)
    assert [r["doc"] for r in questions.collect()] == ["one"]
    client, store = Key(tmp_path / "calls"), str(tmp_path / "store")
    read = lambda: answers.interpret_answers(keys, client, chunk=10, overlap=2, store=store).orderBy("doc", "ord").collect()
    got = read()
    for d, bs in docs.items():
        assert [(r["section"], r["qno"], r["answer"], r["figs"][0]) for r in got if r["doc"] == d] == _in_turn(bs, Key(tmp_path / "other"), 10, 2)
    assert all(9999 not in r["figs"] and r["solution"] == "working" for r in got)
    calls = client.calls()
    assert len(calls) == len({json.dumps(c, sort_keys=True) for c in calls})  # no payload twice
    assert read() == got and len(client.calls()) == len(calls)  # replies are kept


def test_answers_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc string, i long, type string, text string, table_body string")
    assert answers.interpret_answers(none, Key(tmp_path / "calls")).count() == 0
    odd = spark.createDataFrame([("d", 0, "text", None, None), ("d", 1, "footer", "foot", None)], "doc string, i long, type string, text string, table_body string")
    assert answers.interpret_answers(odd, Counting(tmp_path / "calls")).count() == 0
