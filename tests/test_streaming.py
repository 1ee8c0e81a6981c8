"""Documents assembled from a stream of blocks: any order, repeats, restarts, timers and late blocks."""

import random

from pyspark.sql import functions as F

from inkwell.operators import segment
from inkwell.streaming import assembly

SCHEMA = "doc string, i int, ts timestamp, total int, type string, role string, label string, text string"


def _blocks():
    rng, rows = random.Random(1), []
    for d in range(6):
        n = 5 + d
        for i in range(n):
            role = "q" if i % 4 == 1 else "part" if i % 4 == 2 else "body"
            rows.append((f"d{d}", i, 100 * d + i, None if d == 5 else n, "text", role, "(a)" if role == "part" else None, f"{i}. of {d}" if role == "q" else f"line {i}"))
    rng.shuffle(rows)
    return rows


def _file(spark, rows, path):
    df = spark.createDataFrame([(d, i, s, *rest) for d, i, s, *rest in rows], SCHEMA.replace("ts timestamp", "s int"))
    df.withColumn("ts", F.timestamp_seconds(F.lit(1_000_000) + F.col("s"))).drop("s").coalesce(1).write.mode("append").json(path)


def _rows(df):
    return sorted(tuple(r) for r in df.select("doc", "q_ord", "qno", "stem", F.to_json("parts"), "first_i", "last_i").collect())


def test_stream_gives_the_batch_rows(spark, tmp_path):
    rows = _blocks()
    put, table, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(put)
    questions = lambda b: segment.assemble(segment.number_blocks(b)).withColumn("closed_by", F.lit("-"))
    run = lambda: assembly.assembled(stream(), questions, table, checkpoint, idle="60 seconds", late="1000 seconds").awaitTermination(200)
    third = len(rows) // 3
    _file(spark, rows[:third], put)
    _file(spark, rows[third : 2 * third] + rows[:4], put)
    assert run() is not False
    before = spark.read.parquet(table).select("doc").distinct().count()
    _file(spark, rows[2 * third :], put)  # a restart from the checkpoint goes on with what the first run held
    run()
    whole = spark.createDataFrame([r[:2] + r[4:] for r in rows], "doc string, i int, type string, role string, label string, text string")
    known = whole.filter("doc <> 'd5'")
    assert before < 5
    assert _rows(spark.read.parquet(table).filter("doc <> 'd5'")) == _rows(segment.assemble(segment.number_blocks(known)))
    _file(spark, [("z", 0, 5000, 1, "text", "q", "1", "1. last")], put)  # time passes: the document without a total closes by its timer
    run()
    _file(spark, [("y", 0, 9000, 1, "text", "q", "1", "1. more"), ("d0", 99, 9000, 5, "text", "q", "9", "9. late")], put)
    run()
    got = spark.read.parquet(table)
    assert _rows(got.filter("doc = 'd5'")) == _rows(segment.assemble(segment.number_blocks(whole.filter("doc = 'd5'"))))
    assert got.filter("doc = 'd0' and first_i = 99").count() == 1
