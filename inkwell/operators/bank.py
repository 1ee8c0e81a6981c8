"""The bank of records: live versions, checks, filters, facets, search, selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.options import canon_options, remap_answer
from ..functions.text import entry_revision, latex_ok, strip
from ..tables import dropped, kept

# Fixed values.
STAGES = ["raw", "clean", "tagged"]
DERIVED_FLAGS = ["no_answer", "no_solution", "latex_suspect", "short_stem", "image_missing"]
NOT_A_PROBLEM = ["verified", "ai_generated"]


def live_stage(versions: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """doc and its live stage, from versions (doc, stage, version): starting at the lowest, a later stage wins if it is not older than the current one."""
    wide = versions.groupBy("doc").pivot("stage", stages).agg(F.max("version"))
    state = F.struct(F.lit(None).cast("string").alias("stage"), F.lit(None).cast(versions.schema["version"].dataType).alias("version"))
    for s in stages:
        newer = F.col(f"`{s}`").isNotNull() & (state["version"].isNull() | (F.col(f"`{s}`") >= state["version"]))
        state = F.when(newer, F.struct(F.lit(s).alias("stage"), F.col(f"`{s}`").alias("version"))).otherwise(state)
    return wide.select("doc", state["stage"].alias("stage"), state["version"].alias("version")).filter("stage is not null")


def validate(stem: Column, has_parts: Column, solution: Column, answer: Column, all_text: Column, missing_image: Column | None = None, unknown_blocks: Column | None = None) -> Column:
    """The derived flags of an entry."""
    flag = lambda when, name: F.when(when, F.lit(name))
    no = F.lit(False)
    return F.array_compact(F.array(
        flag(~latex_ok(all_text), "latex_suspect"), flag((F.length(stem) < 6) & ~has_parts, "short_stem"), flag(no if missing_image is None else missing_image, "image_missing"),
        flag(no if unknown_blocks is None else unknown_blocks, "unknown_block_type"), flag(solution.isNull(), "no_solution"), flag(answer.isNull(), "no_answer"),
    ))


def refresh_flags(flags: Column, derived: Column) -> Column:
    """Flags without stale derived ones, then the fresh ones, each once."""
    return F.array_distinct(F.concat(F.filter(flags, lambda f: ~f.isin(DERIVED_FLAGS)), derived))


#: What names an entry: qids repeat over sources, documents and files, so all of these that a table has count.
ENTRY_KEY = ["subject", "stage", "level", "source", "file_stem", "doc", "qid"]


def entry_key(*tables: DataFrame) -> list[str]:
    """The columns of ENTRY_KEY that all the tables have."""
    return [c for c in ENTRY_KEY if all(c in t.columns for t in tables)]


def check(entries: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """entries (key columns s, t, l, src, qid; kind, stem, has_parts, topic, ord) with errors and first (first of its key)."""
    key = ["s", "t", "l", "src", "qid"]
    first = F.row_number().over(W.partitionBy(*key).orderBy("ord")) == 1
    fault = lambda when, name: F.when(when, F.lit(name))
    blank = F.coalesce(strip(F.col("stem")), F.lit("")) == ""
    errors = F.array_compact(F.array(fault(F.col("qid").isNull(), "missing:qid"), fault(F.col("kind").isNull(), "missing:kind"), fault(blank & ~F.col("has_parts"), "empty:stem+parts"), fault(~F.col("first"), "duplicate")))
    out = entries.withColumn("first", first).withColumn("errors", errors)
    if taxonomy is None:
        return out
    known = taxonomy.filter(F.coalesce("status", F.lit("active")) == "active").select(F.col("id").alias("topic"), F.lit(True).alias("known"))
    return out.join(known, "topic", "left").withColumn("bad_topic", F.col("topic").isNotNull() & F.col("known").isNull()).drop("known")


def bank_filter(entries: DataFrame, usage: DataFrame | None = None, cart: DataFrame | None = None, **want) -> DataFrame:
    """Entries that meet all given conditions.

    want: files (list), text (a substring of column blob, any case), topic, type, difficulty, state
    (flagged, clean, verified, unverified), use (in_cart, not_in_cart, used, unused, used_twice).
    """
    problems = F.size(F.array_except("flags", F.array(*map(F.lit, NOT_A_PROBLEM)))) > 0
    verified = F.array_contains("flags", "verified")
    tests = {"flagged": problems, "clean": ~problems, "verified": verified, "unverified": ~verified}
    rules = {
        "files": lambda v: F.col("file").isin(v), "text": lambda v: F.col("blob").contains(v.lower()), "topic": lambda v: F.array_contains("topics", v),
        "type": lambda v: F.col("type") == v, "difficulty": lambda v: F.col("difficulty") == v, "state": lambda v: tests[v],
    }
    use = want.pop("use", None)
    out = entries.filter(reduce(lambda a, kv: a & rules[kv[0]](kv[1]), want.items(), F.lit(True)))
    if use in ("in_cart", "not_in_cart"):
        key = entry_key(out, cart)
        return out.join(cart.select(*key), key, "left_semi" if use == "in_cart" else "left_anti")
    if use:
        n, key = F.coalesce("uses", F.lit(0)), entry_key(out, usage)
        out = out.join(usage.select(*key, F.col("count").alias("uses")), key, "left")
        return out.filter({"used": n > 0, "unused": n == 0, "used_twice": n >= 2}[use])
    return out


def facets(entries: DataFrame) -> DataFrame:
    """facet, value, n of files, topics and types."""
    count = lambda name, c: entries.select(F.lit(name).alias("facet"), c.alias("value")).filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [count("file", F.col("file")), count("type", F.col("type")), count("topic", F.explode("topics"))])


def resolve_selection(cart: DataFrame, entries: DataFrame, key: list[str]) -> DataFrame:
    """The cart's entries in its order (pos); of several entries with one key the last (ord) counts; unknown keys drop out."""
    last = entries.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("ord")))).filter("_r = 1").drop("_r", "ord")
    return cart.join(last, key).orderBy("pos")


def risk(entries: DataFrame) -> DataFrame:
    """Rows, edited and verified rows by file, with a row of totals (file null)."""
    has = lambda f: F.sum(F.array_contains("flags", f).cast("long"))
    return entries.rollup("file").agg(F.count("*").alias("n"), has("human_edited").alias("edited"), has("verified").alias("verified"))


class Circle(ValueError):
    """Pages that follow each other in a circle; pages has up to ten of them as (output, page)."""

    def __init__(self, pages: list):
        super().__init__("pages lead in a circle: " + ", ".join(f"{o} page {p}" for o, p in pages))
        self.pages = pages


def _followed(at: DataFrame, crops: bool) -> DataFrame:
    """One round of pointer doubling; on: the pointer still moved. Names compress well: by the files' size Spark would take the pages
    for few and send all of them to the driver and to every executor."""
    to = at.select(F.col("output").alias("source"), F.col("page").alias("source_page"), F.col("source").alias("_s"), F.col("source_page").alias("_p"), F.col("depth").alias("_d"), *([F.col("crops").alias("_c")] if crops else []))
    moved = at.drop("on").join(to.hint("merge"), ["source", "source_page"], "left")
    path = [F.concat(F.coalesce("_c", F.slice("crops", 1, 0)), "crops").alias("crops")] if crops else []
    return moved.select("output", "page", F.coalesce("_s", "source").alias("source"), F.coalesce("_p", "source_page").alias("source_page"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), *path, F.col("_s").isNotNull().alias("on"))


def _roots(at: DataFrame, rounds: int, crops: bool) -> DataFrame:
    """at with every pointer at its end, after at most so many rounds; the table of each round goes when the next is there."""
    for _ in range(rounds):
        after = kept(_followed(at, crops), "pages")
        dropped(at)
        at = after
        if at.filter("on").isEmpty():
            break
    return at


def page_map(steps: DataFrame, rounds: int | None = None) -> DataFrame:
    """output, page, source, source_page, depth and crops: every output page's page of a source that is no output itself.

    steps: output, page (together a key), source, source_page and, where there is one, crop (of any type). Pages follow their source by pointer
    doubling: each round a page's pointer moves on to where that pointer's page points, so chains end after log2(n) rounds of one join, n being
    the number of pages. A pointer that still moves then has walked further than there are pages: it stands on a circle, and Circle names
    such pages (rounds: fewer rounds, for chains known to be shorter). crops, those of all steps on the way, the innermost first, are gathered only when there is no circle, so they
    are never longer than a chain.
    """
    plain = steps.select("output", "page", "source", "source_page", F.lit(1).cast("long").alias("depth"), F.lit(True).alias("on"))
    at = kept(plain, "pages")
    rounds = min(at.count().bit_length() + 1, rounds or 64)
    at = _roots(at, rounds, False)
    lost = at.filter("on").select("source", "source_page").distinct().orderBy("source", "source_page").limit(10).collect()
    if lost:
        raise Circle([tuple(r) for r in lost])
    if "crop" not in steps.columns:
        return at.drop("on").withColumn("crops", F.array().cast("array<string>"))
    dropped(at)
    cropped = steps.select("output", "page", "source", "source_page", F.lit(1).cast("long").alias("depth"), F.array_compact(F.array("crop")).alias("crops"), F.lit(True).alias("on"))
    return _roots(kept(cropped, "pages"), rounds, True).drop("on")


def topic_bank(entries: DataFrame, topics: list[str]) -> DataFrame:
    """Entries that share a topic with the targets."""
    return entries.filter(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))


def examples(entries: DataFrame, topics: list[str], k: int, seed: str = "0", difficulty: str | None = None, type_: str | None = None) -> DataFrame:
    """k entries of the topics (and difficulty, and type), at random by a seeded hash of qid."""
    some = topic_bank(entries, topics)
    some = some.filter(F.col("difficulty") == difficulty) if difficulty else some
    some = some.filter(F.col("type") == type_) if type_ else some
    return some.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col("qid").cast("string")))).orderBy("_h").limit(max(0, min(20, k))).drop("_h")


def pipeline_status(files: DataFrame, *reports: tuple[str, DataFrame]) -> DataFrame:
    """files (stem) with each report's columns, prefixed by its name."""
    for name, r in reports:
        files = files.join(r.select("stem", *(F.col(c).alias(f"{name}_{c}") for c in r.columns if c != "stem")), "stem", "left")
    return files


COORDINATES = ["subject", "stage", "level", "source"]


def with_revision(entries: DataFrame) -> DataFrame:
    """entries with rev, an opaque token of what an editor can change."""
    fields = ["stem", "parts", "options", "answer", "answer_area", "solution", "imgs"]
    return entries.withColumn("rev", entry_revision(*(F.to_json(F.struct(c)) for c in fields if c in entries.columns)))


def canon_entry(entries: DataFrame) -> DataFrame:
    """entries with options labelled (1)..(n), the answer's labels after them, and canonical part labels."""
    placed = canon_options(F.col("options"))
    out = entries.withColumn("_placed", F.when(F.size("options") > 0, placed))
    answer = F.when(F.col("_placed").isNotNull() & F.col("answer").isNotNull(), F.col("answer").withField("value", remap_answer(F.col("answer.value"), F.col("_placed")))).otherwise(F.col("answer"))
    fields = lambda o, pos: F.struct(pos.cast("int").alias("pos"), o["label"].alias("label"), o["value"].alias("value"))
    options = F.when(F.col("_placed").isNotNull(), F.transform("_placed", lambda o: fields(o, o["pos"]))).otherwise(F.transform("options", lambda o, i: fields(o, i + 1)))
    return out.withColumns({"answer": answer, "options": options}).drop("_placed")


def bank_entries(entries: DataFrame, versions: DataFrame) -> DataFrame:
    """The live entries of all sources: each file's rows of its live stage, canonical, with rev, stage and cleaned.

    entries have the coordinates, file_stem and pipeline_stage; versions (coordinates, file_stem, pipeline_stage, version) say how fresh each stage file
    is. One scan serves all sources: a union over them is a partition filter.
    """
    key = [*COORDINATES, "file_stem"]
    stages = versions.select(F.struct(*key).alias("doc"), F.col("pipeline_stage").alias("stage"), "version")
    live = live_stage(stages).select("doc.*", F.col("stage").alias("pipeline_stage"))
    own = entries.join(live, [*key, "pipeline_stage"])
    return with_revision(canon_entry(own)).withColumn("cleaned", F.col("pipeline_stage").isin("clean", "tagged"))


def taggable(entries: DataFrame) -> DataFrame:
    """The rows that tagging reads: each file's clean stage, or its raw one if it has none."""
    rank = F.when(F.col("pipeline_stage") == "clean", 0).when(F.col("pipeline_stage") == "raw", 1)
    best = entries.select(*COORDINATES, "file_stem", rank.alias("_rank")).filter("_rank is not null").groupBy(*COORDINATES, "file_stem").agg(F.min("_rank").alias("_best"))
    return entries.withColumn("_rank", rank).join(best, [*COORDINATES, "file_stem"]).filter("_rank = _best").drop("_rank", "_best")


def topic_menu(taxonomy: DataFrame) -> DataFrame:
    """One text: a line for each topic, id | name | kw: its first eight keywords."""
    line = F.concat_ws(" | ", "id", "name_en", F.concat(F.lit("kw: "), F.array_join(F.slice("keywords", 1, 8), ", ")))
    return taxonomy.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("menu"))


def with_names(entries: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """entries with topic_names, in the order of their topics; a topic without a name is named by its id."""
    key = entry_key(entries)
    topics = entries.dropDuplicates(key).select(*key, F.posexplode("topics").alias("n", "id"))
    each = topics.join(taxonomy.select("id", "name_en"), "id", "left")
    names = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("name_en", "id").alias("name")))), lambda x: x["name"]).alias("topic_names"))
    return entries.join(names, key, "left")


def edit_view(entries: DataFrame) -> DataFrame:
    """The entry's key and view: what a cleaning model sees of an entry, without nulls, parts flat with their whole labels."""
    parts = F.when(F.size("parts") > 0, F.transform("parts", lambda p: F.struct(p["path"].alias("no"), p["text"].alias("text"))))
    return entries.select(*entry_key(entries), F.to_json(F.struct("qid", "kind", "stem", F.when(F.size("options") > 0, F.col("options")).alias("options"), "answer", "solution", parts.alias("parts"))).alias("view"))


def example_view(entries: DataFrame) -> DataFrame:
    """What a generating model sees of an entry as an example."""
    return entries.select("qid", "kind", "stem", F.transform("parts", lambda p: F.struct(p["path"].alias("no"), p["text"].alias("text"))).alias("parts"), "options", F.col("answer.value").alias("answer"), "solution", F.col("tags.type").alias("type"), F.col("tags.difficulty").alias("difficulty"))


def solution_style(coordinates: DataFrame, overrides: DataFrame, defaults: DataFrame, generic: str) -> DataFrame:
    """coordinates (subject, stage) with style: their own override if it is not blank, else their default, else the generic one."""
    own = overrides.select("subject", "stage", F.nullif(strip(F.col("style")), F.lit("")).alias("own"))
    base = defaults.select("subject", "stage", F.col("style").alias("base"))
    return coordinates.join(own, ["subject", "stage"], "left").join(base, ["subject", "stage"], "left").select(*coordinates.columns, F.coalesce("own", "base", F.lit(generic)).alias("style"))


def resolve_images(entries: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """qid, path, dir of every image of an entry: the first of its source's folders (dirs: source, dir, dir_ord) that holds the
    file (files: dir, path); null if none does."""
    imgs = entries.select("qid", "source", F.explode("imgs").alias("img")).select("qid", "source", F.col("img.path").alias("path")).distinct()
    there = dirs.join(files, "dir").groupBy("source", "path").agg(F.min_by("dir", "dir_ord").alias("dir"))
    return imgs.join(there, ["source", "path"], "left").select("qid", "path", "dir")


def with_usage(entries: DataFrame, usage: DataFrame, cart: DataFrame) -> DataFrame:
    """entries with uses (0 if never), last_used and in_cart; usage and cart are looked up by all columns of an entry's key that they have."""
    used, put = entry_key(entries, usage), entry_key(entries, cart)
    marks = usage.select(*used, F.col("count").alias("_uses"), F.col("last").alias("last_used"))
    out = entries.join(marks, used, "left").join(cart.select(*put, F.lit(True).alias("_in")).distinct(), put, "left")
    return out.withColumns({"uses": F.coalesce("_uses", F.lit(0)), "in_cart": F.coalesce("_in", F.lit(False))}).drop("_uses", "_in")
