"""What a plan may not do at size: send whole tables to every executor, leave out rows of a table, hold more than it reads."""

import random
import resource

import duckdb
import pytest

from inkwell.functions import arrow
from inkwell.operators import answers, bank, build, novelty, segment
from inkwell.plans import catalog, paper

from .conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().toString()


class Numbers:
    """Labels every line; the chunk that begins with line 90 - 6 can't be read."""

    def reply(self, task, payload):
        rows = [int(x.split("]")[0][1:]) for x in payload["listing"].split("\n")]
        if rows[0] == 84:
            return "unreadable"
        return {"labels": [{"i": i, "role": "part", "label": f"{rows[0]}"} for i in rows] + [{"i": rows[-1], "role": "body", "label": "again"}]}


def test_labels_of_chunks_are_joined_without_broadcasts(spark):
    blocks = spark.range(0, 200).selectExpr("1L AS doc", "id AS i", "'text' AS type", "id || '. x' AS text", "CAST(NULL AS string) AS table_body", "CAST(NULL AS string) AS hint", "CAST(NULL AS string) AS label")
    out = segment.label_blocks(blocks, Numbers())
    assert "Broadcast" not in _plan(out)
    got = {r["i"]: (r["role"], r["label"]) for r in out.collect()}
    assert all(got[i] == ("part", "0") for i in range(90))
    assert all(got[i] == ("q", str(i)) for i in range(90, 180)) and all(got[i] == ("part", "174") for i in range(180, 200))


def _shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_labelled_blocks_are_shuffled_once(spark):
    """texts were shuffled with the blocks, in the payloads by key and for the labels' join."""
    blocks = spark.range(0, 40 * 200).selectExpr("id div 200 AS doc", "id % 200 AS i", "'text' AS type", "id || '. ' || sha2('a' || id, 512) AS text", "CAST(NULL AS string) AS table_body", "CAST(NULL AS string) AS hint", "CAST(NULL AS string) AS label").repartition(4, "doc")
    before = _shuffled(spark)
    assert segment.label_blocks(blocks, Numbers()).filter("text <> '' and role <> ''").count() == 40 * 200
    assert _shuffled(spark) - before < 2 * 40 * 200 * 128


class Wild:
    """Replies by a listing's hash: some fail, leave gaps, repeat themselves or name blocks that other chunks or none have."""

    def __init__(self, wild):
        self.wild = wild

    def reply(self, task, payload):
        rng = random.Random(payload["listing"])
        rows = [int(x.split("]")[0][1:]) for x in payload["listing"].split("\n")]
        if rng.random() < 0.25:
            return "unreadable"
        named = [i for i in rows if rng.random() < 0.6] + rng.sample(rows, 3) + [rng.randrange(60) for _ in range(5 if self.wild else 0)]
        return {"labels": [{"i": i, "role": rng.choice(["q", "part", None]), "label": f"{rows[0]}/{n}"} for n, i in enumerate(named)] + [{"role": "q"}]}


def _first_labels(rows, client, chunk, overlap):
    """The labels by definition: documents one by one, chunks in order, the first word on a block holds."""
    out = {}
    for doc in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == doc)
        free, said = [r for r in mine if r[5] is None], {}
        for at in range(0, len(free), chunk):
            some = free[max(0, at - overlap) : at + chunk]
            got = client.reply("label", {"listing": "\n".join(f"[{r[1]}] (text) {r[3]}" for r in some)})
            for i, role, label in [(r[1], "rule", None) for r in some] if isinstance(got, str) else [(x.get("i"), x["role"] or "body", x.get("label")) for x in got["labels"]]:
                said.setdefault(i, (role, label))
        for _, i, _, text, _, hint, label in mine:
            rule = ("q", text.split(".")[0]) if text[0].isdigit() else ("part", text[:3]) if text[0] == "(" else ("body", None)
            got = said.get(i, ("body", None))
            out[doc, i] = (hint, label) if hint else rule if got[0] == "rule" else got
    return out


@pytest.mark.parametrize("wild", [False, True])
def test_the_first_label_of_a_block_holds(spark, wild):
    rng = random.Random(5)
    text = lambda d, i: rng.choice([f"{i}. of {d}", f"(b) of {d}", f"body of {d}"])
    rows = [(d, i, "text", text(d, i), None, *(("figure", "h") if rng.random() < 0.1 else (None, None))) for d in range(12) for i in range(rng.choice([1, 9, 10, 11, 20, 47]))]
    blocks = spark.createDataFrame(rows, "doc long, i long, type string, text string, table_body string, hint string, label string")
    out = segment.label_blocks(blocks, Wild(wild), chunk=10, overlap=3)
    assert out.columns == ["doc", "i", "type", "text", "table_body", "label", "role"]
    assert {(r["doc"], r["i"]): (r["role"], r["label"]) for r in out.collect()} == _first_labels(rows, Wild(wild), 10, 3) and out.count() == len(rows)


def test_pages_follow_their_sources_without_broadcasts(spark, monkeypatch):
    """each round sent all pages to the driver and to every executor, as their files are small."""
    plans, real = [], bank.kept
    monkeypatch.setattr(bank, "kept", lambda df, name: (plans.append(_plan(df)), real(df, name))[1])
    steps = spark.range(0, 12).selectExpr("'p' || id AS output", "1 AS page", "'p' || (id - 1) AS source", "1 AS source_page", "id AS crop")
    got = {r["output"]: (r["source"], r["depth"], r["crops"]) for r in bank.page_map(steps).collect()}
    assert got == {f"p{k}": ("p-1", k + 1, list(range(k + 1))) for k in range(12)}
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_papers_are_joined_without_broadcasts(spark, monkeypatch):
    """questions, answers and ranges went whole to the driver, as few columns of small files."""
    plans, real = [], build.kept
    for module in (build, segment, paper):
        monkeypatch.setattr(module, "kept", lambda df, name: (plans.append(_plan(df)), real(df, name))[1])
    out = paper.segment_report(spark, SMALL)
    assert len(plans) == 7 and not any("Broadcast" in p for p in [*plans, _plan(out)])


def test_a_next_chunk_needs_a_block_of_its_own(spark):
    rows = spark.createDataFrame([(d, i) for d, n in ((1, 10), (2, 11), (3, 9)) for i in range(n)], "doc int, i int")
    sizes = lambda n: {(r["doc"], r["chunk"]): r["count"] for r in n.groupBy("doc", "chunk").count().collect()}
    out = segment.chunked(rows, 10, 2)
    assert sizes(out) == {(1, 0): 10, (2, 0): 10, (2, 1): 3, (3, 0): 9} and "Join" not in _plan(out)


def test_every_order_is_a_document(spark):
    orders = duckdb.sql(f"SELECT count(DISTINCT l_orderkey) FROM '{SMALL}/lineitem.parquet'").fetchall()[0][0]
    assert catalog.queries()["label_chunks"](spark, SMALL).select("doc").distinct().count() == orders


def test_long_entries_are_compared_with_few_references(spark, monkeypatch):
    rng = random.Random(3)
    stop, words = [f"the{i}" for i in range(30)], [f"w{i}" for i in range(400)]
    r = [(i, " ".join(rng.sample(stop, 12) + rng.sample(words, 6))) for i in range(80)] + [(80, "the1 the2"), (80, "w1 w2 w3")]
    e = [(i, " ".join(rng.sample(stop, 28) + r[rng.randrange(80)][1].split() + [f"own{i}x{k}" for k in range(60)])) for i in range(60)] + [(7, "w1 w2 w3"), (90, "the1"), (91, None)]
    seen, real = [], novelty.candidates
    monkeypatch.setattr(novelty, "candidates", lambda *a: (seen.append(real(*a).count()), real(*a))[1])
    left, right = spark.createDataFrame(e, "entry_id long, text string"), spark.createDataFrame(r, "ref_id long, text string")
    rows = lambda df: sorted((x["entry_id"], -1 if x["ref_id"] is None else x["ref_id"], round(x["score"], 12)) for x in df.collect())
    assert rows(novelty.novelty(left, right, bound=-1)) == rows(novelty.novelty(left, right))
    assert sum(seen) < 0.5 * 2 * 60 * 80  # each entry shares common words, and common pairs of them, with every reference


def test_a_python_worker_gets_small_batches(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    arrow.columns()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    rows = spark.range(0, 3000, 1, 1)
    sizes = rows.mapInArrow(lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) <= 1000


def test_a_long_string_is_mended_in_little_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = '{"t": "' + "a" * 8_000_000 + '\\times"}'
    assert arrow.repair_json(text).endswith('\\\\times"}')
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def test_listings_stand_in_one_table_and_in_what_is_asked(spark, monkeypatch):
    class Key:
        def reply(self, task, payload):
            return [{"section": "", "qno": x.split()[2].rstrip("."), "part": "", "answer": "x", "solution": "", "figs": []} for x in payload["listing"].split("\n")]

    tables, real = {}, answers.kept
    monkeypatch.setattr(answers, "kept", lambda df, name: (tables.setdefault(name, df.columns), real(df, name))[1])
    rows = [("d", i, "text", f"{i}. x", None) for i in range(12)] + [("d", 12, "footer", "Section 9", None)]
    blocks = spark.createDataFrame(rows, "doc string, i long, type string, text string, table_body string")
    got = answers.interpret_answers(blocks, Key(), chunk=5, overlap=1).collect()
    assert sorted(int(r["qno"]) for r in got) == list(range(12))
    assert [n for n, c in tables.items() if "listing" in c] == ["chunks"]
