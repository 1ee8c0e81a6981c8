"""Changes to the bank as appended versions: edits, new entries, deletions, restores, the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.options import canon_options, remap_answer
from ..functions.text import answer_area, blank, normalize_text, strip, total_mark
from ..functions.tree import apply_answer_area, finalize_parts
from ..tables import kept
from .bank import entry_key, with_revision
from .build import flat_parts, spread

#: What an editor sends: all of an entry's fields, parts flat.
EDIT = "stem string, solution string, options map<string,string>, answer string, answer_area string, parts array<struct<no:string,text:string>>, type string, topic array<string>, difficulty string"


def apply_edit_fields(entries: DataFrame, vocabulary: list[str]) -> DataFrame:
    """entries, which have a column edit (struct of EDIT), with its values in canonical form, flagged human_edited.

    An emptied field is cleared; answer areas move off the texts, packed answers to their parts. A type must be of the vocabulary or the one that
    is there (bad_type says so where it isn't, and the old one stays); topic and difficulty change only if given.
    """
    e = entries
    text = lambda f: normalize_text(F.coalesce(F.col(f"edit.{f}"), F.lit("")))
    given = lambda f: F.when(~blank(F.col(f"edit.{f}")), strip(F.col(f"edit.{f}")))
    pairs = F.filter(F.map_entries(F.coalesce("edit.options", F.create_map().cast("map<string,string>"))), lambda kv: ~blank(kv["value"]))
    options = F.transform(pairs, lambda kv: F.struct(kv["key"].alias("label"), normalize_text(kv["value"]).alias("value")))
    e = e.withColumn("_placed", canon_options(options)).withColumn("_area", answer_area(text("stem")))
    value = F.when(F.size("_placed") > 0, remap_answer(given("answer"), F.col("_placed"))).otherwise(given("answer"))
    ok = given("type").isNull() | given("type").isin(vocabulary) | given("type").eqNullSafe(F.col("tags.type"))
    tags = F.struct(
        F.coalesce(F.filter("edit.topic", lambda t: ~blank(t)), "tags.topic", F.array().cast("array<string>")).alias("topic"), F.coalesce(F.when(ok, given("type")), "tags.type", F.lit("")).alias("type"), F.coalesce(given("difficulty"), "tags.difficulty", F.lit("medium")).alias("difficulty")
    )
    stale = F.filter("flags", lambda f: ~f.isin("no_answer", "no_solution", "short_stem", "human_edited"))
    e = e.withColumns({
        "stem": F.col("_area.body"), "answer_area": F.coalesce("_area.area", given("answer_area")), "solution": F.when(~blank(F.col("edit.solution")), text("solution")),
        "answer": F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit("human").alias("kind"))), "options": F.transform("_placed", lambda o: F.struct(o["pos"].cast("int").alias("pos"), o["label"].alias("label"), o["value"].alias("value"))),
        "parts": apply_answer_area(finalize_parts(F.coalesce(flat_parts(F.col("edit.parts")), F.slice(flat_parts(F.col("edit.parts")), 1, 0)))), "kind": F.when(F.size("_placed") > 0, "mcq").otherwise("question"),
        "meta": F.col("meta").withField("marks", total_mark(F.coalesce("edit.stem", F.lit("")))), "bad_type": ~ok, "tags": tags, "flags": F.array_append(stale, F.lit("human_edited")),
    })
    return spread(e).drop("_placed", "_area", "edit")


def save_edits(entries: DataFrame, edits: DataFrame, key: list[str], vocabulary: list[str], version: int) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the log, edits that are refused with a reason).

    entries: live rows with rev (bank.with_revision), one a key. edits: key, rev, edit and, where an entry has several, seq, their order. An entry's
    edits form a chain: the first is checked against the live rev, each later one against the rev that the last accepted one made, so of two
    edits of one rev the first wins and the second has been overtaken ("changed since"). An edit without a rev isn't checked. An edit whose
    entry is unknown or whose type is neither of the vocabulary nor the one it finds is refused and changes nothing. Accepted edits are appended
    as versions version, version + 1, ...; topic, type and difficulty that an edit leaves out are those of the edit before it. Both results have seq.

    What an edit makes of an entry's text follows from the edit and the live row alone, so all edits are applied and their revisions
    made side by side; only (rev, made, type) of an entry's edits meet, in one small fold a key.
    """
    said = lambda f: F.when(~blank(F.col(f"edit.{f}")), strip(F.col(f"edit.{f}")))
    seq = F.col("seq") if "seq" in edits.columns else F.lit(0)
    sent = edits.select(*key, F.col("rev").alias("_sent"), "edit", seq.cast("long").alias("seq"))
    given = {"_type": said("type"), "_topic": F.filter("edit.topic", lambda t: ~blank(t)), "_difficulty": said("difficulty")}
    both = sent.join(entries, key, "left").withColumns(given | {"_live": F.col("rev"), "_tags": F.col("tags")})
    tried = with_revision(apply_edit_fields(both.drop("rev"), vocabulary))
    # Written once: the fold and the rows that it takes read the same numbers.
    tried = kept(tried.withColumnRenamed("rev", "_made").withColumn("_id", F.monotonically_increasing_id()), "edits")

    one = F.struct("seq", "_id", "_sent", "_made", "_type")
    start = F.struct(F.col("live").alias("rev"), F.col("type").alias("type"), F.lit(0).alias("n"), F.array().cast("array<struct<id:bigint,n:int,reason:string>>").alias("done"))

    def step(a, e):
        known = F.coalesce(e["_type"].isin(vocabulary) | (e["_type"] == a["type"]), e["_type"].isNull())
        reason = F.when(a["rev"].isNull(), "unknown").when(e["_sent"].isNotNull() & (e["_sent"] != a["rev"]), "changed since").when(~known, "bad type")
        took = reason.isNull()
        n = a["n"] + took.cast("int")
        done = F.array_append(a["done"], F.struct(e["_id"].alias("id"), n.alias("n"), reason.alias("reason")))
        return F.struct(F.when(took, e["_made"]).otherwise(a["rev"]).alias("rev"), F.when(took, F.coalesce(e["_type"], a["type"])).otherwise(a["type"]).alias("type"), n.alias("n"), done.alias("done"))

    chains = tried.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("edits"), F.first("_live").alias("live"), F.first("_tags.type").alias("type"))
    verdicts = chains.select(F.explode(F.aggregate("edits", start, step)["done"]).alias("v")).select(F.col("v.id").alias("_id"), F.col("v.n").alias("_n"), F.col("v.reason").alias("reason"))
    told = tried.join(verdicts, "_id")
    upto = W.partitionBy(*key).orderBy("_n").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    tags = F.struct(F.coalesce(last("_topic"), "_tags.topic", F.array().cast("array<string>")).alias("topic"), F.coalesce(last("_type"), "_tags.type", F.lit("")).alias("type"), F.coalesce(last("_difficulty"), "_tags.difficulty", F.lit("medium")).alias("difficulty"))
    out = told.filter("reason is null").withColumn("tags", tags).withColumns({"version": F.lit(version) + F.col("_n") - 1, "deleted": F.lit(False)})
    own = ["_id", "_n", "_sent", "_made", "_live", "_tags", *given]
    return out.drop(*own, "reason", "bad_type"), told.filter("reason is not null").select(*key, "seq", "reason")


def assign_manual(new: DataFrame, entries: DataFrame, prefix: str = "manual-") -> DataFrame:
    """new (ord, ...) with qid: the smallest numbers with the prefix that no entry uses, in order of ord.

    Other names with the prefix (manual-x) use no number. Free numbers are those up to the highest used one that aren't used, then what follows it.
    """
    from .worksheet import numbered

    tail = F.substring("qid", F.lit(len(prefix) + 1), F.length("qid"))
    used = entries.filter(F.col("qid").startswith(prefix)).filter(tail.rlike(r"^\d+\z")).select(tail.try_cast("long").alias("n")).filter("n > 0").distinct()
    count, wanted = used.count(), new.count()
    free = new.sparkSession.range(1, count + wanted + 1).select(F.col("id").alias("n")).join(used, "n", "left_anti")
    places = numbered(free, [F.col("n")])
    return numbered(new, [F.col("ord")]).join(places, "number").withColumn("qid", F.concat(F.lit(prefix), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string")))).drop("number", "n")


def tombstones(keys: DataFrame, version: int) -> DataFrame:
    """Keys as rows of the log that delete them."""
    return keys.withColumns({"version": F.lit(version), "deleted": F.lit(True)})


def journalled(journal: DataFrame, new: DataFrame, keep: int = 200) -> DataFrame:
    """The journal (source, ts, id, kind, qid, before, after) with new rows, the last `keep` of each source."""
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("ts"), F.desc("id")))
    return journal.unionByName(new).withColumn("_n", place).filter(F.col("_n") <= keep).drop("_n")


def restorable(journal: DataFrame, which: str = "after", ts: str | None = None) -> DataFrame:
    """source, file_stem (if the journal has it), qid and content: the newest journalled content of each entry (before or after the change; of one time, if it is given)."""
    some = journal.filter(F.col(which).isNotNull())
    some = some if ts is None else some.filter(F.col("ts") == ts)
    return some.groupBy(*entry_key(some)).agg(F.max_by(which, F.struct("ts", "id")).alias("content"))


def restore_entries(stages: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows of all stages (qid, pipeline_stage, content, tags and what else names an entry, see bank.entry_key) after a restore: the content of the
    journal in every stage that holds the entry, each with its own tags; an entry that none holds comes back in the stages that its own file
    has. contents: qid and content, and the source and file_stem of the entry where stages have them."""
    key = entry_key(stages, contents)
    file = [c for c in key if c != "qid"]
    got = contents.select(*key, F.col("content").alias("_new"))
    held = stages.join(got, key, "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")
    lost = got.join(stages.select(*key).distinct(), key, "left_anti").select(*key, F.col("_new").alias("content"))
    there = stages.select(*file, "pipeline_stage").distinct()
    back = (lost.join(there, file) if file else lost.crossJoin(there)).withColumn("tags", F.lit(None).cast(stages.schema["tags"].dataType))
    return held.unionByName(back, allowMissingColumns=True).select(*held.columns)


def verified(stages: DataFrame, qids: DataFrame, live: DataFrame | str) -> DataFrame:
    """Rows of all stages with the flag verified turned over for some entries: the row of the file's live stage decides for all.

    qids: qid and what else names an entry. live: the files' live stages (the columns of a file that stages have, pipeline_stage), or one stage for all."""
    key = entry_key(stages, qids)
    if isinstance(live, str):
        deciding = stages.filter(F.col("pipeline_stage") == live)
    else:
        deciding = stages.join(live.select(*entry_key(stages, live), "pipeline_stage").distinct(), [*entry_key(stages, live), "pipeline_stage"], "left_semi")
    own = entry_key(stages)
    state = deciding.join(qids.select(*key).distinct(), key, "left_semi").select(*own, (~F.array_contains("flags", "verified")).alias("_set"))
    out = stages.join(state, own, "left")
    flags = F.when(F.col("_set"), F.array_union("flags", F.array(F.lit("verified")))).when(~F.col("_set"), F.array_remove("flags", "verified")).otherwise(F.col("flags"))
    return out.withColumn("flags", flags).drop("_set").select(*stages.columns)


def restore_database(current: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the state after a restore, rows that it parks): the snapshot's files, and those files of now that it has no stage of.

    Both have source, file_stem, pipeline_stage. A later stage that the snapshot lacks is a derivative of what was rolled back: it is parked. The
    present state is written first, so that a restore can itself be undone.
    """
    now = kept(current, "before-restore")
    files = snapshot.select("source", "file_stem").distinct()
    stages = snapshot.select("source", "file_stem", "pipeline_stage").distinct()
    other = now.join(stages, ["source", "file_stem", "pipeline_stage"], "left_anti")
    parked = other.join(files, ["source", "file_stem"], "left_semi").filter("pipeline_stage in ('clean', 'tagged')")
    stay = other.join(parked.select("source", "file_stem", "pipeline_stage").distinct(), ["source", "file_stem", "pipeline_stage"], "left_anti")
    return stay.unionByName(snapshot.select(*now.columns)), parked


def backups(files: DataFrame, source: str) -> DataFrame:
    """file, size, mtime of a source's backups, the newest first (files: path, length, modificationTime)."""
    name = F.substring_index("path", "/", -1)
    return files.filter(name.startswith(f"{source}_")).select(name.alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).orderBy(F.desc("mtime"), "file")


def pending(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Generated entries that nobody has decided on."""
    return queue.join(decisions.select("qid").distinct(), "qid", "left_anti")


def accepted(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Generated entries whose last decision was to accept, as rows of the source ai_generated."""
    last = decisions.groupBy("qid").agg(F.max_by("accept", "ts").alias("_yes")).filter("_yes")
    return queue.join(last.select("qid"), "qid", "left_semi").withColumn("source", F.lit("ai_generated"))


def cleared_usage(events: DataFrame, clears: DataFrame) -> DataFrame:
    """Usage events (level, source, qid, ts) that no later clearing undoes; a clearing without a qid undoes its source's."""
    own = clears.filter("qid is not null").groupBy("level", "source", "qid").agg(F.max("ts").alias("_one"))
    whole = clears.filter("qid is null").groupBy("level", "source").agg(F.max("ts").alias("_all"))
    out = events.join(own, ["level", "source", "qid"], "left").join(whole, ["level", "source"], "left")
    gone = (F.col("ts") <= F.col("_one")) | (F.col("ts") <= F.col("_all"))
    return out.filter(~F.coalesce(gone, F.lit(False))).drop("_one", "_all")


def usage_of(events: DataFrame, level: str, source: str) -> DataFrame:
    """Events of one source of one level: usage and exports are read by both."""
    return events.filter((F.col("level") == level) & (F.col("source") == source))
