"""From labelled blocks to bank entries: answers, canonical fields, flags, reports, and the same for patches and new questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.options import canon_options, remap_answer
from ..functions.parts import has_answer, part_texts, restore_carry, restore_markers
from ..functions.text import answer_area, blank, extract_answer, image_markers, lint_field, normalize_text, part_mark, strip, total_mark
from ..functions.tree import FLAT, PART, apply_answer_area, apply_part_answers, finalize_parts
from ..tables import dealt, kept
from .answers import match_answers, merge_answers
from .bank import entry_key, refresh_flags, validate
from .model import ModelClient, run_model
from .segment import dropped_blocks

ANSWER = "struct<value:string,kind:string>"
SCHEMA_VERSION = 2
#: Fields that a patch may change.
PATCHABLE = ["stem", "parts", "options", "answer", "solution"]
PATCH = "struct<stem:string,solution:string,answer:string,options:map<string,string>,parts:array<struct<no:string,text:string>>>"


def build_entries(questions: DataFrame, answers: DataFrame | None = None, figures: DataFrame | None = None, missing: DataFrame | None = None, unknown: DataFrame | None = None) -> DataFrame:
    """The entries of segment.questions, polished and flagged, one a question: qid is the document's name and the question's place.

    answers (doc, ord, section, qno, part, answer, solution, figs): interpreted answer records, merged and paired first. figures (doc, i,
    type, img_path, page_idx, bbox): blocks of the answer files, for the figures that solutions name. missing (doc, path): images that no
    folder has. unknown (doc, types): block types that are not known.
    """
    # What is joined here grows with the papers, but is estimated by the size of compressed files: by sort, or it would go whole to the driver.
    q = kept(questions.withColumn("q_ord", F.col("q_ord").cast("int")), "questions")  # read by each pass of the pairing
    if answers is None:
        paired = q.select("doc", "q_ord", F.lit(None).cast("string").alias("key_answer"), F.lit(None).cast("string").alias("key_solution"), F.array().cast("array<int>").alias("figs"))
    else:
        merged = merge_answers(answers)
        first = answers.select("doc", "ord", "section")
        figs = answers.groupBy("doc", "qno").agg(F.array_distinct(F.flatten(F.collect_list("figs"))).alias("figs")) if "figs" in answers.columns else None
        merged = merged.join(first.hint("merge"), ["doc", "ord"])
        pairs = match_answers(q.select("doc", "q_ord", "section", "qno", "implicit"), merged.select("doc", "ord", "section", "qno")).select("doc", "q_ord", F.col("ans_ord").alias("ord"))
        paired = pairs.join(merged.select("doc", "ord", F.col("qno").alias("ans_no"), F.nullif("answer", F.lit("")).alias("key_answer"), F.nullif("solution", F.lit("")).alias("key_solution")).hint("merge"), ["doc", "ord"], "left")
        paired = paired.join(figs.withColumnRenamed("qno", "ans_no").hint("merge"), ["doc", "ans_no"], "left") if figs is not None else paired.withColumn("figs", F.lit(None).cast("array<int>"))
        paired = paired.select("doc", "q_ord", "key_answer", "key_solution", "figs")
    q = q.join(paired.hint("merge"), ["doc", "q_ord"], "left")
    if figures is not None:
        shown = q.select("doc", "q_ord", F.posexplode("figs").alias("n", "i")).join(figures.filter("img_path <> ''").hint("merge"), ["doc", "i"])
        image = F.struct("n", F.col("type").alias("kind"), F.col("img_path").alias("path"), F.lit("ans").alias("src"), F.col("page_idx").cast("int").alias("page"), F.col("bbox").alias("bbox"))
        images = shown.groupBy("doc", "q_ord").agg(F.array_sort(F.collect_list(image), lambda x, y: F.when(x["n"] < y["n"], -1).otherwise(1)).alias("more"))
        q = q.join(images.hint("merge"), ["doc", "q_ord"], "left").withColumn("assets", F.concat("assets", F.coalesce(F.transform("more", lambda x: x.dropFields("n")), F.slice("assets", 1, 0)))).drop("more")
    solution = F.coalesce("key_solution", F.nullif(strip(F.col("solution")), F.lit("")))
    tail = extract_answer(F.coalesce(solution, F.lit("")), F.size("options") > 0, F.size("parts") > 0)
    answer = F.when(F.col("key_answer").isNotNull(), F.struct(F.col("key_answer").alias("value"), F.lit("answer_key").alias("kind"))).otherwise(tail.cast(ANSWER))
    out = q.select(
        "doc", F.format_string("%s-%03d", F.col("doc").cast("string"), F.col("position").cast("int")).alias("qid"), F.when(F.size("options") > 0, "mcq").otherwise("question").alias("kind"),
        image_markers(strip(F.col("stem"))).alias("stem"), F.transform("parts", lambda p: p.withField("text", image_markers(strip(p["text"])))).alias("parts"), "options",
        answer.cast(ANSWER).alias("answer"), F.lit(None).cast("string").alias("answer_area"), image_markers(solution).alias("solution"), F.col("assets").alias("imgs"),
        F.struct("pages", "qno", "section", "blocks", F.lit(None).cast("int").alias("marks"), F.lit(None).cast("int").alias("schema")).alias("meta"), "flags",
    )
    return flagged(kept(polish(dealt(kept(out, "raw-entries"), "doc", "qid")), "entries"), missing, unknown)


def polish(entries: DataFrame) -> DataFrame:
    """Entries with flat parts (FLAT) and options as printed, in their canonical form.

    In this order: the total printed anywhere; texts; the parts' tree; marks at the end of a stem without parts; a flag where parts
    were empty; options, and the answer's labels after them; answer areas (one that is there already stays); packed answers to their parts.
    """
    e = entries.withColumn("_total", total_mark(F.concat_ws(" ", "stem", part_texts(F.col("parts")))))
    e = e.withColumns({"_flat": F.size(F.filter("parts", lambda p: F.coalesce(p["text"], F.lit("")) != "")), "parts": finalize_parts(F.col("parts")), "stem": normalize_text(F.col("stem"))})
    body, marks = part_mark(F.col("stem"))
    bare = F.size("parts") == 0
    e = e.withColumns({"_marks": F.coalesce("_total", F.when(bare, marks)), "stem": F.when(bare, body).otherwise(F.col("stem"))})
    e = e.withColumn("flags", F.when(F.size("parts") < F.col("_flat"), F.array_append("flags", F.lit("empty_parts_removed"))).otherwise(F.col("flags")))
    e = _canonical_options(e.withColumn("options", F.transform("options", lambda o: o.withField("value", normalize_text(o["value"])))))
    split = answer_area(F.col("stem"))
    e = e.withColumns({"stem": split["body"], "answer_area": F.coalesce(split["area"], "answer_area"), "parts": apply_answer_area(F.col("parts"))})
    e = spread(e)
    return e.withColumn("meta", F.col("meta").withField("marks", F.coalesce("_marks", F.col("meta.marks"))).withField("schema", F.lit(SCHEMA_VERSION))).drop("_total", "_flat", "_marks")


def _canonical_options(e: DataFrame) -> DataFrame:
    placed = e.withColumn("_placed", canon_options(F.col("options")))
    answer = F.when(F.size("_placed") > 0, F.col("answer").withField("value", remap_answer(F.col("answer.value"), F.col("_placed")))).otherwise(F.col("answer"))
    options = F.transform("_placed", lambda o: F.struct(o["pos"].cast("int").alias("pos"), o["label"].alias("label"), o["value"].alias("value")))
    return placed.withColumns({"answer": F.when(F.col("answer").isNotNull(), answer), "options": options}).drop("_placed")


def spread(e: DataFrame) -> DataFrame:
    """Packed answers and solutions moved to the parts that they name."""
    moved = apply_part_answers(F.col("parts"), F.col("answer.value"), "answer")
    e = e.withColumn("_moved", moved)
    answer = F.when(F.col("_moved.value").isNotNull(), F.struct(F.col("_moved.value").alias("value"), F.coalesce("answer.kind", F.lit("human")).alias("kind")))
    e = e.withColumns({"answer": answer, "parts": F.col("_moved.parts")}).withColumn("_moved", apply_part_answers(F.col("parts"), F.col("solution"), "solution"))
    return e.withColumns({"solution": F.col("_moved.value"), "parts": F.col("_moved.parts")}).drop("_moved")


def flagged(entries: DataFrame, missing: DataFrame | None = None, unknown: DataFrame | None = None) -> DataFrame:
    """entries with their derived flags made anew."""
    lost, odd, e = F.lit(False), F.lit(False), entries
    if missing is not None:
        paths = missing.groupBy("doc").agg(F.collect_set("path").alias("_lost"))
        e = e.join(paths.hint("merge"), "doc", "left")
        lost = F.coalesce(F.exists("imgs", lambda a: (a["kind"] == "image") & F.array_contains("_lost", a["path"])), F.lit(False))
    if unknown is not None:
        e = e.join(unknown.select("doc", F.size("types").alias("_odd")).hint("merge"), "doc", "left")
        odd = F.coalesce(F.col("_odd") > 0, F.lit(False))
    parts = F.col("parts")
    text = F.concat(F.col("stem"), part_texts(parts), F.coalesce("solution", F.lit("")))
    whole = lambda value, field: F.when(has_answer(value, parts, field), F.lit(""))
    derived = validate(F.col("stem"), F.size(parts) > 0, whole(F.col("solution"), "solution"), whole(F.col("answer.value"), "answer"), text, lost, odd)
    return e.withColumn("flags", refresh_flags(F.col("flags"), derived)).drop("_lost", "_odd")


def report(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """The segmentation report, a row a document: questions, with_solution, with_answer, mcq, flagged, blocks_content, blocks_dropped,
    flags (a map of their counts, by the word before a colon) and warning. blocks: doc, src_i, role, of all blocks that were labelled."""
    parts, entries, blocks = F.col("parts"), kept(entries, "reported"), kept(blocks.select("doc", "src_i", "role"), "reported-blocks")
    yes = lambda c: F.count_if(c)
    e = entries.groupBy("doc").agg(
        F.count("*").alias("questions"), yes(has_answer(F.col("solution"), parts, "solution")).alias("with_solution"), yes(has_answer(F.col("answer.value"), parts)).alias("with_answer"),
        yes(F.col("kind") == "mcq").alias("mcq"), yes(F.size("flags") > 0).alias("flagged"), F.collect_list("meta.blocks").alias("_ranges"),
    )
    names = entries.select("doc", F.explode("flags").alias("flag")).select("doc", F.substring_index("flag", ":", 1).alias("flag")).groupBy("doc", "flag").agg(F.count("*").alias("n"))
    names = names.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("flags"))
    content = blocks.filter("role not in ('noise', 'section')").select("doc", "src_i").distinct()
    used = entries.select("doc", F.col("meta.blocks")[0].alias("first_i"), F.col("meta.blocks")[1].alias("last_i"))
    lost = dropped_blocks(content.withColumnRenamed("src_i", "i"), used).groupBy("doc").agg(F.count("*").alias("_lost"))
    out = content.groupBy("doc").agg(F.count("*").alias("blocks_content")).join(lost.hint("merge"), "doc", "left").join(e.drop("_ranges").hint("merge"), "doc", "left").join(names.hint("merge"), "doc", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    warning = F.when(zero(F.col("questions")) == 0, F.concat(F.col("blocks_content").cast("string"), F.lit(" content blocks produced 0 questions"))).when(zero(F.col("_lost")) > 0, F.concat_ws("", F.col("_lost").cast("string"), F.lit("/"), F.col("blocks_content").cast("string"), F.lit(" content blocks were not placed")))
    counts = ["questions", "with_solution", "with_answer", "mcq", "flagged"]
    return out.select("doc", *(zero(F.col(c)).alias(c) for c in counts), "blocks_content", zero(F.col("_lost")).alias("blocks_dropped"), "flags", warning.alias("warning"))


def sidecar(answers: DataFrame, figures: DataFrame) -> DataFrame:
    """Every answer record with the images that it names, for looking up what pairing left out."""
    shown = answers.select("doc", "ord", F.posexplode_outer("figs").alias("n", "i")).join(figures.select("doc", "i", "img_path").filter("img_path <> ''"), ["doc", "i"], "left")
    paths = shown.groupBy("doc", "ord").agg(F.array_sort(F.collect_list(F.when(F.col("img_path").isNotNull(), F.struct("n", "img_path")))).alias("x"))
    return answers.join(paths, ["doc", "ord"]).select("doc", "ord", "section", "qno", "answer", F.coalesce("solution", F.lit("")).alias("solution"), F.transform("x", lambda x: x["img_path"]).alias("figs"))


# ---- patches


def flat_parts(parts: Column) -> Column:
    """Parts of a patch or an edit as FLAT, those without a text left out."""
    some = F.filter(parts, lambda p: ~blank(p["text"]))
    none = F.lit(None).cast("string")
    return F.transform(some, lambda p: F.struct(F.coalesce(p["no"], F.lit("")).alias("no"), p["text"].alias("text"), F.lit(None).cast("int").alias("marks"), none.alias("answer"), none.alias("solution"), none.alias("answer_area")))


def apply_patch(entries: DataFrame, patches: DataFrame) -> DataFrame:
    """entries with changed, rejected and soft, after patches (qid and what else names an entry, see bank.entry_key; patch: PATCH; nulls: fields that the patch sets to null).

    Fields are typed and made canonical; figures that a patch drops come back, and so do marks and answers of parts. A value that is a verdict
    word is refused, all else holds, and soft flags say what to look at. Only answer and solution can be cleared.
    """
    key = entry_key(entries, patches)
    e = entries.join(patches.select(*key, "patch", "nulls"), key, "left")
    cleared = lambda f: F.coalesce(F.array_contains("nulls", f), F.lit(False))
    text = lambda f: F.when(~blank(F.col(f"patch.{f}")), normalize_text(F.col(f"patch.{f}")))
    parts = F.when(F.col("patch.parts").isNotNull(), finalize_parts(flat_parts(F.col("patch.parts"))))
    option = lambda kv: F.struct(F.lit(None).cast("int").alias("pos"), kv["key"].alias("label"), normalize_text(kv["value"]).alias("value"))
    new = {
        "stem": restore_markers(F.coalesce("stem", F.lit("")), text("stem")), "solution": restore_markers(F.coalesce("solution", F.lit("")), text("solution")),
        "answer": F.when(~blank(F.col("patch.answer")), F.struct(normalize_text(strip(F.col("patch.answer"))).alias("value"), F.lit("llm").alias("kind"))),
        "options": F.when(F.size("patch.options") > 0, F.transform(F.map_entries("patch.options"), option)), "parts": F.when(parts.isNotNull(), _keep_markers(F.col("parts"), restore_carry(F.col("parts"), parts))),
    }
    e = e.withColumns({f"_{k}": v for k, v in new.items()})
    texts = {"stem": F.array("_stem"), "solution": F.array("_solution"), "answer": F.array(F.col("_answer.value")), "options": F.col("_options.value"), "parts": F.col("_parts.text")}
    e = e.withColumns({f"_lint_{k}": F.when(F.col(f"_{k}").isNotNull(), lint_field(v, k == "stem")) for k, v in texts.items()})
    fine = lambda k: F.col(f"_{k}").isNotNull() & F.col(f"_lint_{k}.error").isNull()
    differs = lambda k: ~F.to_json(F.struct(F.col(f"_{k}").alias("x"))).eqNullSafe(F.to_json(F.struct(F.col(k).alias("x"))))
    wiped = lambda k: (cleared(k) & F.col(k).isNotNull()) if k in ("answer", "solution") else F.lit(False)
    moved = {k: (fine(k) & differs(k)) | wiped(k) for k in PATCHABLE}
    changed = F.array_compact(F.array(*(F.when(moved[k], F.lit(k)) for k in PATCHABLE)))
    rejected = F.array_compact(F.array(*(F.when(F.col(f"_lint_{k}.error").isNotNull(), F.concat(F.lit(f"{k}: "), F.col(f"_lint_{k}.error"))) for k in PATCHABLE)))
    none = F.array().cast("array<string>")
    soft = F.array_distinct(F.concat(*(F.when(fine(k) & differs(k), F.col(f"_lint_{k}.soft")).otherwise(none) for k in PATCHABLE)))
    e = e.withColumns({"changed": changed, "rejected": rejected, "soft": soft})
    e = e.withColumns({k: F.when(fine(k), F.col(f"_{k}")).when(~wiped(k), F.col(k)) for k in PATCHABLE})
    return e.drop("patch", "nulls", *(f"_{k}" for k in PATCHABLE), *(f"_lint_{k}" for k in PATCHABLE))


def _keep_markers(old: Column, new: Column) -> Column:
    """New parts with the image markers that only the old ones have, after the last part's text."""
    markers = lambda p: F.flatten(F.transform(p, lambda x: F.regexp_extract_all(x["text"], F.lit(r"!\[\]\([^)]*\)"), F.lit(0))))
    lost = F.array_except(markers(old), markers(new))
    last = F.element_at(new, -1)
    longer = last.withField("text", F.concat(last["text"], F.lit("\n"), F.array_join(lost, "\n")))
    return F.when((F.size(lost) > 0) & (F.size(new) > 0), F.concat(F.slice(new, 1, F.size(new) - 1), F.array(longer))).otherwise(new)


def clean_entries(entries: DataFrame, client: ModelClient, flagged_only: bool = False, limit: int | None = None, store: str | None = None) -> DataFrame:
    """entries after a cleaning model's patches, with changed, rejected, soft, checked and failed; every row is kept.

    flagged_only and limit say which rows the model sees (limit: the first in order of qid); the others pass through. Derived flags are made
    anew, packed answers moved to their parts again, refused patches and soft flags noted among the flags. store: a table of replies that
    later runs may read (see run_model).
    """
    from .bank import edit_view

    rows = entries.withColumn("_seen", F.size("flags") > 0 if flagged_only else F.lit(True))
    if limit is not None:
        rank = F.sum(F.col("_seen").cast("int")).over(W.partitionBy("doc").orderBy("qid").rowsBetween(W.unboundedPreceding, W.currentRow))
        rows = rows.withColumn("_seen", F.col("_seen") & (rank <= limit))
    rows = kept(rows, "to-clean")
    views = edit_view(rows.filter("_seen"))
    key = entry_key(views)
    said = run_model(views, client, "clean", F.to_json(F.struct("view")), f"struct<patch:{PATCH},severe:boolean,nulls:array<string>>", store=store)
    patches = said.select(*key, F.col("reply.patch").alias("patch"), F.coalesce("reply.nulls", F.array().cast("array<string>")).alias("nulls"), F.coalesce("reply.severe", F.lit(False)).alias("severe"), F.col("reply").isNull().alias("failed"))
    out = apply_patch(rows, patches).join(patches.select(*key, "severe", "failed"), key, "left")
    notes = F.concat(F.transform("rejected", lambda r: F.concat(F.lit("patch_rejected:"), r)), F.transform("changed", lambda c: F.concat(F.lit("llm_fixed:"), c)), F.col("soft"), F.array_compact(F.array(F.when(F.col("severe"), "llm_severe"))))
    out = _canonical_options(out.withColumns({"solution": F.when(~blank(F.col("solution")), F.col("solution")), "stem": strip(F.col("stem"))}))
    out = flagged(spread(out)).withColumn("flags", F.array_distinct(F.concat("flags", notes)))
    return out.withColumns({"checked": F.col("_seen"), "severe": F.coalesce("severe", F.lit(False)), "failed": F.coalesce("failed", F.lit(False))}).drop("_seen")


def clean_stats(cleaned: DataFrame) -> DataFrame:
    """doc, checked, with_images, fixed, severe, lint_dropped, llm_errors."""
    yes = lambda c: F.count_if(c)
    return cleaned.groupBy("doc").agg(
        yes(F.col("checked")).alias("checked"), yes(F.size("imgs") > 0).alias("with_images"), yes(F.size("changed") > 0).alias("fixed"), yes(F.col("severe")).alias("severe"),
        F.sum(F.size("rejected")).alias("lint_dropped"), yes(F.col("failed")).alias("llm_errors"),
    )


# ---- generated questions


def generated(replies: DataFrame, topics: list[str], difficulty: str, with_solutions: bool = True) -> DataFrame:
    """Bank entries of a model's questions (batch, n, and q: struct of stem, parts, options, answer, solution, topics, type).

    A question without stem and parts goes. Topics are those of the asked ones that the model named, else all of them; the rows are flagged
    ai_generated and named gen-batch-n.
    """
    none = F.lit(None).cast("string")
    some = replies.filter(~blank(F.col("q.stem")) | (F.size("q.parts") > 0))
    asked = F.array(*map(F.lit, topics)).cast("array<string>")
    own = F.array_intersect(F.coalesce("q.topics", F.array().cast("array<string>")), asked)
    option = lambda kv: F.struct(F.lit(None).cast("int").alias("pos"), kv["key"].alias("label"), kv["value"].alias("value"))
    e = some.select(
        F.col("batch").alias("doc"), F.format_string("gen-%s-%03d", F.col("batch").cast("string"), F.col("n").cast("int")).alias("qid"), F.when(F.size("q.options") > 0, "mcq").otherwise("question").alias("kind"), F.coalesce("q.stem", F.lit("")).alias("stem"),
        F.coalesce(flat_parts(F.col("q.parts")), F.array().cast(f"array<{FLAT}>")).alias("parts"), F.coalesce(F.transform(F.map_entries("q.options"), option), F.array().cast("array<struct<pos:int,label:string,value:string>>")).alias("options"),
        F.when(~blank(F.col("q.answer")), F.struct(F.col("q.answer").alias("value"), F.lit("ai").alias("kind"))).alias("answer"), none.alias("answer_area"),
        (F.when(~blank(F.col("q.solution")), strip(F.col("q.solution"))) if with_solutions else none).alias("solution"), F.array().cast("array<struct<kind:string,path:string,src:string,page:int,bbox:array<double>>>").alias("imgs"),
        F.struct(F.array().cast("array<int>").alias("pages"), F.lit("").alias("qno"), F.lit("").alias("section"), F.array().cast("array<int>").alias("blocks"), F.lit(None).cast("int").alias("marks"), F.lit(None).cast("int").alias("schema")).alias("meta"), F.array(F.lit("ai_generated")).alias("flags"),
        F.struct(F.when(F.size(own) > 0, own).otherwise(asked).alias("topic"), F.coalesce("q.type", F.lit("")).alias("type"), F.lit(difficulty or "medium").alias("difficulty")).alias("tags"),
    )
    return polish(e)


def generate(spark, client: ModelClient, examples: DataFrame, topics: list[str], batch: str, n: int = 3, difficulty: str = "", prompt: str = "") -> DataFrame:
    """Entries that a model writes for the topics after a few examples (example_view); n is held within 1..20."""
    if not topics:
        raise ValueError("choose a topic at least")
    shown = examples.limit(20).agg(F.to_json(F.collect_list(F.struct("*"))).alias("examples"))
    asked = shown.select(F.lit(batch).alias("batch"), "examples", F.array(*map(F.lit, topics)).alias("topics"), F.lit(max(1, min(20, n))).alias("n"), F.lit(difficulty).alias("difficulty"), F.lit(prompt).alias("prompt"))
    kind = "array<struct<stem:string,parts:array<struct<no:string,text:string>>,options:map<string,string>,answer:string,solution:string,topics:array<string>,type:string>>"
    said = run_model(asked, client, "generate", F.to_json(F.struct("examples", "topics", "n", "difficulty", "prompt")), kind, wrapped="questions")
    return generated(said.select("batch", F.posexplode("reply").alias("n", "q")).withColumn("n", F.col("n") + 1), topics, difficulty)


__all__ = ["PART", "apply_patch", "build_entries", "clean_entries", "clean_stats", "flagged", "generate", "generated", "polish", "report", "sidecar", "spread"]
