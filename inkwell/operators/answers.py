"""Answer records: reading by a model, deduplication, merging, and pairing with questions by occurrence rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_section, strip
from ..tables import dropped, folder, kept
from .model import ModelClient, run_model
from .segment import chunked, listing

RECORD = "array<struct<section:string,qno:string,part:string,answer:string,solution:string,figs:array<string>>>"
HEADING = r"(?i)^\s*(section|part|paper|booklet)\s+\w{1,5}\W*\z"


def answer_files(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of questions, and blocks of answers under their questions' doc: those of documents whose name ends in _ans."""
    key = F.col("doc").rlike(r"_ans\z")
    return blocks.filter(~key), blocks.filter(key).withColumn("doc", F.regexp_replace("doc", r"_ans\z", ""))


def interpret_answers(blocks: DataFrame, client: ModelClient, chunk: int = 90, overlap: int = 6, store: str | None = None) -> DataFrame:
    """doc, ord, section, qno, part, answer, solution, figs: the records that a model reads from answer files, overlapping readings as one.

    blocks: doc, i, type, text, table_body. A document is read in chunks, each but the first with the last blocks of the one before it. Headings are
    printed once, so a chunk's payload names the section in effect before it (context), which is the last one that the chunks before it gave records of.
    Reading one chunk after the other would take as many rounds as the longest document has chunks; here all chunks are asked at once with the
    heading printed before them as a guess, and asked again only while the replies say otherwise. A document's first chunk has no context,
    so its reply holds, then the second one's does, and so on: the result is that of reading in order. Replies are kept (store: as in run_model), so a payload is
    asked once. Records without a number drop out, as do figs that are no block of the document; a chunk without a readable reply gives none.
    """
    spark = blocks.sparkSession
    store = store or folder(spark, "replies-answers")
    blocks = kept(blocks, "answer-blocks")
    chunks = chunked(blocks, chunk, overlap)
    printed = F.when(F.col("text").rlike(HEADING), _one_line("text"))
    last = F.max_by(printed, F.when(printed.isNotNull() & (F.col("_own") == F.col("chunk")), F.col("i"))).alias("last")
    listings = kept(_in_effect(listing(chunks, full=True, keys=("doc", "chunk"), more=(last,))), "chunks")
    asked = listings
    while True:  # listings are the bulk: they stand in one table and in what is asked, nothing else carries them
        payload = asked.select("doc", "chunk", "context", F.to_json(F.struct("context", "listing")).alias("_payload"))
        said = run_model(payload, client, "answers", F.col("_payload"), RECORD, store=store)
        read = kept(said.select("doc", "chunk", "context", F.filter("reply", lambda r: F.coalesce(strip(r["qno"]), F.lit("")) != "").alias("reply")), "readings")
        headed = F.filter("reply", lambda r: F.coalesce(strip(r["section"]), F.lit("")) != "")
        after = kept(_in_effect(read.select("doc", "chunk", F.col("context").alias("_before"), _one_line(F.try_element_at(headed, F.lit(-1))["section"]).alias("last"))), "contexts")
        if after.filter(~F.col("context").eqNullSafe(F.col("_before"))).isEmpty():
            break
        dropped(read)
        asked = listings.drop("context").join(after.drop("_before"), ["doc", "chunk"])
    dropped(listings)
    one = read.select("doc", "chunk", F.posexplode("reply").alias("n", "r"))
    digits = F.regexp_replace("r.qno", r"\D", "")
    records = one.select(
        "doc", F.row_number().over(W.partitionBy("doc").orderBy("chunk", "n")).alias("ord"), F.coalesce(_one_line("r.section"), F.lit("")).alias("section"), F.when(digits != "", digits).otherwise(F.col("r.qno")).alias("qno"),
        F.coalesce(strip(F.col("r.part")), F.lit("")).alias("part"), F.nullif("r.answer", F.lit("")).alias("answer"), F.coalesce(strip(F.col("r.solution")), F.lit("")).alias("solution"),
        F.array_compact(F.transform(F.coalesce("r.figs", F.array().cast("array<string>")), lambda f: f.try_cast("int"))).alias("figs"),
    )
    once = kept(dedup_answers(records).drop("sec", "readings", "section_in_effect"), "answers-once")  # read for the figs and for the rest
    figs = once.select("doc", "ord", F.posexplode("figs").alias("n", "i")).join(blocks.select("doc", F.col("i").cast("int").alias("i")).distinct(), ["doc", "i"])
    figs = figs.groupBy("doc", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "i"))), lambda x: x["i"]).alias("figs"))
    out = once.drop("figs").join(figs, ["doc", "ord"], "left").withColumn("figs", F.coalesce("figs", F.array().cast("array<int>")))
    return out.select("doc", "ord", "section", "qno", "part", "answer", "solution", "figs")


def _one_line(text) -> Column:
    """The text with its white space as single blanks, null if it has nothing else."""
    text = F.col(text) if isinstance(text, str) else text
    return F.nullif(strip(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def _in_effect(chunks: DataFrame) -> DataFrame:
    """chunks with context in place of last: the last section of the chunks before; null if there is none."""
    before = W.partitionBy("doc").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return chunks.withColumn("context", F.last("last", ignorenulls=True).over(before)).drop("last")


def dedup_answers(records: DataFrame) -> DataFrame:
    """records (doc, ord, section, qno, part, answer, solution): overlapping readings as one.

    Key: section, number and part; without a section also the beginnings of answer and solution. The
    first answer and the longest solution (the first of equal ones) stay, and the figs, if there are any, of all readings.
    """
    carried = F.last(F.nullif("section", F.lit("")), ignorenulls=True).over(W.partitionBy("doc").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow))
    sec = norm_section(F.coalesce("section", F.lit("")))
    bare = sec == ""
    keyed = records.withColumn("sec", sec).withColumn("a40", F.when(bare, F.left(F.coalesce("answer", F.lit("")), F.lit(40)))).withColumn("s60", F.when(bare, F.left(F.coalesce("solution", F.lit("")), F.lit(60)))).withColumn("in_effect", carried)
    longest = F.max(F.struct(F.length("solution").alias("n"), (-F.col("ord")).alias("o"), F.col("solution").alias("solution")))
    figs = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "figs"))), lambda x: x["figs"]))) if "figs" in records.columns else None
    return keyed.groupBy("doc", "sec", "qno", "part", "a40", "s60").agg(
        F.min("ord").alias("ord"), F.min_by("section", "ord").alias("section"), F.min_by("in_effect", "ord").alias("section_in_effect"),
        F.min_by("answer", F.when(F.col("answer").isNotNull(), F.col("ord"))).alias("answer"), longest["solution"].alias("solution"), F.count("*").alias("readings"), *([] if figs is None else [figs.alias("figs")]),
    ).drop("a40", "s60")


def merge_answers(records: DataFrame) -> DataFrame:
    """One record for each section and number, its pieces joined by "; " in order, labelled by their parts."""
    sec = norm_section(F.coalesce("section", F.lit("")))
    piece = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("ord", F.concat_ws(" ", F.nullif("part", F.lit("")), c).alias("text")))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(piece(c))), lambda x: x["text"]), "; ")
    return records.groupBy("doc", sec.alias("sec"), "qno").agg(F.min("ord").alias("ord"), join("answer").alias("answer"), join("solution").alias("solution"))


def match_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions (doc, q_ord, section, qno, implicit) with ans_ord and pass of the answer (doc, ord, section, qno) paired.

    Pass 1: the i-th question of a section and number takes the i-th such answer. Pass 2: leftovers by
    number alone. Pass 3: leftover implicit questions by position. Every pass joins on key and rank, and by sort: both sides grow
    with the bank, though few columns of wide tables are estimated as few bytes.
    """
    q = questions.select("doc", "q_ord", norm_section(F.coalesce("section", F.lit(""))).alias("sec"), "qno", "implicit")
    a = answers.select("doc", F.col("ord").alias("ans_ord"), norm_section(F.coalesce("section", F.lit(""))).alias("sec"), "qno")
    found = None
    for number, keys, q_some, a_some in (
        (1, ["doc", "sec", "qno"], "sec <> ''", "sec <> ''"),
        (2, ["doc", "qno"], "true", "true"),
        (3, ["doc"], "implicit", "true"),
    ):
        rank = lambda df, order: df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(order)))  # noqa: E731, B023
        left = rank(q.filter(q_some), "q_ord").select(*keys, "rank", "q_ord")
        right = rank(a.filter(a_some), "ans_ord").select(*keys, "rank", "ans_ord")
        pairs = left.join(right.hint("merge"), [*keys, "rank"]).select("doc", "q_ord", "ans_ord", F.lit(number).alias("pass"))
        found = pairs if found is None else found.union(pairs)
        q, a = q.join(pairs.hint("merge"), ["doc", "q_ord"], "left_anti"), a.join(pairs.hint("merge"), ["doc", "ans_ord"], "left_anti")
    return questions.join(found.hint("merge"), ["doc", "q_ord"], "left")


def answer_lookup(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """The reference answer of each question: same section and number, else same number, else the document's first."""
    a = answers.select("doc", "ord", norm_section(F.coalesce("section", F.lit(""))).alias("sec"), "qno", "answer")
    first = lambda *k: a.groupBy("doc", *k).agg(F.min_by("answer", "ord").alias("answer_" + str(len(k))), F.min("ord").alias("ord_" + str(len(k))))
    q = questions.withColumn("sec", norm_section(F.coalesce("section", F.lit(""))))
    q = q.join(first("sec", "qno"), ["doc", "sec", "qno"], "left").join(first("qno"), ["doc", "qno"], "left").join(first(), "doc", "left")
    level = F.when(F.col("ord_2").isNotNull(), 1).when(F.col("ord_1").isNotNull(), 2).when(F.col("ord_0").isNotNull(), 3)
    return q.select(*questions.columns, level.alias("level"), F.coalesce("ord_2", "ord_1", "ord_0").alias("ans_ord"), F.when(level == 1, F.col("answer_2")).when(level == 2, F.col("answer_1")).otherwise(F.col("answer_0")).alias("answer"))
