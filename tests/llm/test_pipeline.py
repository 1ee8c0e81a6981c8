"""The pipeline's stages against brute force on the small table."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline as p

from ..conftest import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts, kept = {r["doc_id"]: r["text"] for r in docs.collect()}, [docs]
    for name, stage in p.STAGES:
        out = p.Scratch(spark, "stages").keep(stage(spark, kept[-1], SMALL), name.replace(" ", "-"))
        if (name, stage) != p.STAGES[-1]:
            assert out.columns == docs.columns
        kept.append(out)
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and d in ids[0]]
    assert sum(d in ids[1] for d in good) / len(good) > 0.97
    # No two documents left after stage 2 have a shingle similarity of 0.85 or more.
    inverted, sets = collections.defaultdict(list), {}
    for d in ids[2]:
        w = texts[d].lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        for s in sets[d]:
            inverted[s].append(d)
    common = collections.Counter((a, b) for v in inverted.values() for i, b in enumerate(v) for a in v[:i])
    assert not [1 for (a, b), n in common.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.85]
    # No run of 50 words is left twice after stage 3.
    seen = collections.Counter()
    for r in kept[3].collect():
        w = r["text"].lower().split()
        seen.update({tuple(w[i : i + 50]) for i in range(len(w) - 49)})
    assert max(seen.values(), default=0) <= 1
    # No whole benchmark item is left after stage 4.
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(i in " ".join(r["text"].lower().split()) for r in kept[4].collect() for i in items)
    mixed = kept[5].agg(F.sum("taken"), F.count("*"), F.min("taken")).first()
    assert mixed[0] > 0 and mixed[2] > 0


def test_empty_and_odd_documents(spark):
    """Empty tables stay empty; texts without a word are kept by every stage but the classifier's and the mix."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if name in ("SimHash near-dedup", "suffix-array dedup", "benchmark decontamination"):
            assert stage(spark, odd, SMALL).count() == 3


def test_clashing_names(spark):
    """Columns with the names that stages use inside come out as they came."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 60")
    names = ["id", "th", "uid", "spans", "body", "key", "extra", "leaks", "quality_score", "node", "first_id"]
    some = docs.withColumns({c: F.lit(c) for c in names})
    for name, stage in p.STAGES:
        got = stage(spark, some, SMALL)
        kept = [c for c in names if not (name == "benchmark decontamination" and c == "leaks") and not (name == "quality classifier" and c == "quality_score")]
        assert {tuple(r) for r in got.select(*kept).distinct().collect()} <= {tuple(kept)} and set(kept) <= set(got.columns)


def test_run_leaves_only_its_result(spark):
    """run() gives the stages' rows, and removes what they wrote on the way."""
    before = list(p.Scratch.made)
    got = p.run(spark, SMALL)
    left = [s for s in p.Scratch.made if s not in before]
    assert len(left) == 1 and left[0].base in got.scratch_path
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SMALL)
    rows = lambda df: sorted((r["doc_id"], r["text"], r["taken"]) for r in df.select("doc_id", "text", "taken").collect())
    assert rows(got) == rows(docs) and got.count() > 0
