"""Chat formatting by quotation linking: DataFrame functions only.

Lines of a message have a quote level, the number of ">" before them. Consecutive lines of one level
are a passage. Hashes of normalised quoted passages and of their lines are looked up among the
passages and lines that earlier messages of the conversation wrote themselves; a message's parent is
the message that most quoted words lead to. Without a linked quote it answers the message before it.

So a conversation is a tree, and its reply order is the tree's: a message, then each of its replies with all that
follows from it, replies of one message by turn. Places in it come from the tree's tour (each message is entered, its replies
are toured in turn, it is left): every step of the tour points to the next, and by pointer doubling each learns in log2(n)
rounds of one join how much of the tour is still to come, hence its place and depth. Conversations in which every
message answers the one before it are in order already and take no part.

Messages are numbered in order of conversation and turn by a range sort, and spans of SPAN numbers cut every running value,
whose carries are joined back: neither a conversation nor a turn of any length is ever one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch

SPAN = 512
MARK = r"^((?:[ \t]*>)+)[ \t]?"
ATTRIBUTION = r"(?i)^[ \t]*(on|le|am|el)\b.*\b(wrote|écrit|schrieb|escribió)[ \t]*:[ \t]*$"


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 1), "[ \t]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def unquoted(text: Column) -> Column:
    """The text without its quoted lines and without attribution lines right before them."""
    lines = F.split(text, "\r?\n", -1)
    quoted = lambda x: x.rlike(MARK)
    after = lambda i: F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))
    kept = F.filter(lines, lambda x, i: ~quoted(x) & ~(x.rlike(ATTRIBUTION) & quoted(after(i))))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def _units(messages: DataFrame) -> DataFrame:
    """Passages and single lines: conv, t, level, words and hash of each, once a message."""
    lines = messages.select("conv", "t", "tie", F.posexplode(F.split("text", "\r?\n", -1)).alias("line_no", "line"))
    lines = lines.select("conv", "t", "tie", "line_no", level_of(F.col("line")).alias("level"), normalised(F.regexp_replace("line", MARK, "")).alias("norm"))
    island = F.col("line_no") - F.row_number().over(W.partitionBy("conv", "t", "tie", "level").orderBy("line_no"))
    lines = lines.withColumn("island", island).filter("norm <> ''")
    passages = lines.groupBy("conv", "t", "tie", "level", "island").agg(F.array_sort(F.collect_list(F.struct("line_no", "norm"))).alias("all"))
    passages = passages.select("conv", "t", "tie", "level", F.array_join(F.col("all.norm"), " ").alias("norm"))
    units = passages.union(lines.select("conv", "t", "tie", "level", "norm")).distinct()
    return units.select("conv", "t", "tie", "level", (F.size(F.split("norm", " "))).alias("words"), F.xxhash64("norm").alias("hash"))


def links(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, t, tie, level, words, origin: quoted units with the latest earlier message that wrote them."""
    units = scratch.keep(_units(messages), "units")
    quotes = units.filter("level > 0")
    wanted = quotes.select("conv", "hash").distinct()
    own = units.filter("level = 0").select("conv", "t", "hash").distinct().join(wanted, ["conv", "hash"], "left_semi")
    # What a quote leads to follows from conversation, hash and turn: each is looked up once, so a span of turns has at most
    # two rows a turn. Quotes come before what their own turn wrote, so that only earlier turns are seen.
    asked = quotes.select("conv", "hash", "t", F.lit(None).cast("long").alias("wrote")).distinct()
    both = asked.union(own.select("conv", "hash", "t", F.col("t")))
    both = scratch.keep(both.withColumn("span", F.floor(F.col("t") / SPAN)), "looked-up")
    inner = W.partitionBy("conv", "hash", "span").orderBy("t", F.col("wrote").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("conv", "hash").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    carry = both.groupBy("conv", "hash", "span").agg(F.max("wrote").alias("whole")).withColumn("carry", F.max("whole").over(before))
    seen = both.withColumn("inner", F.max("wrote").over(inner)).join(carry.drop("whole"), ["conv", "hash", "span"])
    seen = seen.filter("wrote is null").select("conv", "hash", "t", F.coalesce("inner", "carry").alias("origin")).filter("origin is not null")
    return quotes.join(seen, ["conv", "hash", "t"]).select("conv", "t", "tie", "level", "words", "origin")


def running(df: DataFrame, value: str, how, name: str, by: str = "number") -> DataFrame:
    """df (conv, span of by, by) with how() of value over the rows of the conversation up to and with this one."""
    inner = W.partitionBy("conv", "span").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    carry = df.groupBy("conv", "span").agg(how(value).alias("_whole"))
    before = W.partitionBy("conv").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    carry = carry.withColumn("_carry", how("_whole").over(before)).select("conv", "span", "_carry")
    out = df.withColumn("_inner", how(value).over(inner)).join(carry, ["conv", "span"])
    pair = F.array("_carry", "_inner")
    both = F.array_max(pair) if how is F.max else F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(F.col("_inner"), F.lit(0))
    return out.withColumn(name, both).drop("_inner", "_carry")


def numbered(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """messages (conv, t, tie) with number: 0, 1, ... in order of conv, t and tie over the whole table, equal rows in any order; and
    first, the number of the conversation's first message."""
    key = ["conv", "t", "tie", "row"]
    placed = messages.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*key).sortWithinPartitions(*key)
    placed = scratch.keep(placed.drop("row").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "messages")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("least"))  # a row a range
    starts = sizes.select("part", "least", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    rows = placed.join(F.broadcast(starts), "part").withColumn("number", F.col("at") - F.col("least") + F.col("earlier")).drop("at", "part", "least", "earlier")
    return rows.join(rows.groupBy("conv").agg(F.min("number").alias("first")), "conv")


def toured(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """number, place (0, 1, ... in reply order within the conversation) and depth of each message of a forest.

    tree: conv, number, up (the number of the message that it answers, smaller than its own; null for a conversation's first).
    """
    block = F.floor(F.col("number") / SPAN)
    # The next reply to the same message: inside the block of numbers, or the first one of a later block.
    inside = F.lead("number").over(W.partitionBy("conv", "up", "block").orderBy("number"))
    kids = tree.filter("up is not null").select("conv", "up", "number").withColumn("block", block)
    later = kids.groupBy("conv", "up", "block").agg(F.min("number").alias("least"))
    later = later.withColumn("after", F.lead("least").over(W.partitionBy("conv", "up").orderBy("block"))).drop("least")
    kids = kids.withColumn("inside", inside).join(later, ["conv", "up", "block"]).select("conv", "up", "number", F.coalesce("inside", "after").alias("next"))
    firsts = kids.groupBy("up").agg(F.min("number").alias("child"))
    nodes = tree.select("number", "up").join(firsts.withColumnRenamed("up", "number"), "number", "left").join(kids.select("number", "next"), "number", "left")
    enter, leave = 2 * F.col("number"), 2 * F.col("number") + 1
    one = lambda c: F.lit(c).cast("long")
    go = F.struct(enter.alias("step"), F.coalesce(2 * F.col("child"), leave).alias("to"), one(1).alias("left"), one(1).alias("sum"))
    back = F.struct(leave.alias("step"), F.coalesce(2 * F.col("next"), 2 * F.col("up") + 1).alias("to"), one(0).alias("left"), one(-1).alias("sum"))
    tour = scratch.keep(nodes.select(F.explode(F.array(go, back)).alias("s")).select("s.*"), "tour")
    while not tour.filter("to is not null").isEmpty():
        # Only steps that don't know yet what is to come look ahead: short conversations are done after a few rounds.
        ahead = tour.select(F.col("step").alias("to"), F.col("to").alias("beyond"), F.col("left").alias("l"), F.col("sum").alias("s"))
        moved = tour.filter("to is not null").join(ahead, "to").select("step", F.col("beyond").alias("to"), (F.col("left") + F.col("l")).alias("left"), (F.col("sum") + F.col("s")).alias("sum"))
        after = scratch.keep(tour.filter("to is null").unionByName(moved), "tour")
        scratch.drop(tour)
        tour = after
    ended = tour.filter("step % 2 = 0").select(F.floor(F.col("step") / 2).alias("number"), "left", (-F.col("sum")).alias("depth"))
    size = tree.groupBy("conv").agg(F.count("*").alias("size"))
    return tree.select("conv", "number").join(size, "conv").join(ended, "number").select("number", (F.col("size") - F.col("left")).alias("place"), "depth")


def link_conversations(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, parent_turn, by_quote, quote_levels, quotes, branch, position, place, depth, thread, reply, chat.

    parent_turn is the turn that the message answers (null for a conversation's first), by_quote
    whether a quote says so; quotes lists every message that it quotes, at any level, as (level, turn). Sorted by place
    a conversation is in reply order; depth is the number of messages above, and a thread (0, 1, ... in reply order) is a message
    with its first reply, that one's first reply, and so on. In order of turns, a branch is a run of messages each of which answers the
    one before it, and position counts from 0 within it. reply is the text without quotes and chat the reply as a chat turn.

    Defined results: a null text is an empty reply; null conv_ids are one conversation; null turns
    come first; messages of one turn are ordered by a hash of role and text, and each answers the one before it; equal rows
    are told apart no further (each is kept, with a place of its own); a quote never leads to its own turn or a later one, and leads
    to the first message of its turn; ties between parents go to the later turn. Messages, turns and conversations may be of any
    length; an empty table gives none; other columns are left out, whatever their names.
    """
    m = conversations.select(F.col("conv_id").alias("conv_id"), "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    m = m.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")), "t": F.coalesce(F.col("turn").cast("long"), F.lit(-1)), "tie": F.xxhash64("role", "text")})
    m = numbered(m, scratch)
    quoting = m.filter(F.regexp_like("text", F.lit(r"(?m)^[ \t]*>")))
    involved = m.join(quoting.select("conv").distinct(), "conv", "left_semi")
    found = scratch.keep(links(involved.select("conv", "t", "tie", "text"), scratch), "links")
    votes = found.filter("level = 1").groupBy("conv", "t", "tie", "origin").agg(F.sum("words").alias("words"))
    parents = votes.groupBy("conv", "t", "tie").agg(F.max(F.struct("words", "origin")).getField("origin").alias("quoted"))
    each = F.array_sort(F.collect_set(F.struct("level", F.col("origin").alias("turn"))))
    levels = found.groupBy("conv", "t", "tie").agg(F.max("level").alias("quote_levels"), each.alias("quotes"))
    rows = m.withColumn("span", F.floor((F.col("number") - F.col("first")) / SPAN))
    rows = rows.join(parents, ["conv", "t", "tie"], "left").join(levels, ["conv", "t", "tie"], "left")
    # The message before: inside the span, or the last one of the span before.
    last = rows.groupBy("conv", "span").agg(F.max("t").alias("last_t"))
    last = last.withColumn("carried", F.lag("last_t").over(W.partitionBy("conv").orderBy("span"))).select("conv", "span", "carried")
    inside = F.lag("t").over(W.partitionBy("conv", "span").orderBy("number"))
    rows = rows.withColumn("inside", inside).join(last, ["conv", "span"])
    rows = rows.withColumn("before", F.coalesce("inside", "carried")).withColumn("parent", F.coalesce("quoted", "before"))
    start = F.col("before").isNull() | (F.col("parent") != F.col("before"))
    rows = rows.withColumn("starts", start.cast("long")).withColumn("index", F.col("number") - F.col("first"))
    rows = running(rows, "starts", F.sum, "branch")
    rows = running(rows.withColumn("start_index", F.when(F.col("starts") == 1, F.col("index"))), "start_index", F.max, "from_index")
    rows = scratch.keep(rows, "linked")

    # Reply order, of the conversations that branch.
    branched = rows.filter("branch > 1").select("conv").distinct()
    some = rows.join(branched, "conv", "left_semi").select("conv", "t", "number", "first", "quoted")
    turns = some.groupBy("conv", "t").agg(F.min("number").alias("target")).withColumnRenamed("t", "quoted")
    tree = some.join(turns, ["conv", "quoted"], "left").select("conv", "number", F.coalesce("target", F.when(F.col("number") > F.col("first"), F.col("number") - 1)).alias("up"))
    tree = scratch.keep(tree, "tree")
    places = toured(tree, scratch)
    out = rows.join(places, "number", "left").withColumns({"place": F.coalesce("place", "index"), "depth": F.coalesce("depth", "index")})
    # In reply order a thread begins where a message doesn't answer the one before it.
    out = scratch.keep(out.withColumn("span", F.floor(F.col("place") / SPAN)), "placed")
    inside = F.lag("depth").over(W.partitionBy("conv", "span").orderBy("place"))
    ends = out.groupBy("conv", "span").agg(F.max_by("depth", "place").alias("end")).withColumn("over", F.lag("end").over(W.partitionBy("conv").orderBy("span"))).drop("end")
    out = out.withColumn("inside", inside).join(ends, ["conv", "span"])
    head = F.coalesce(F.col("depth") <= F.coalesce("inside", "over"), F.lit(False))
    out = running(out.withColumn("head", head.cast("long")), "head", F.sum, "thread", "place")

    reply = unquoted(F.col("text"))
    chat = F.concat(F.lit("<|"), F.coalesce(F.col("role"), F.lit("unknown")), F.lit("|>\n"), F.col("reply"), F.lit("\n<|end|>"))
    return out.withColumn("reply", reply).select(
        "conv_id", "turn", "role", F.when(F.col("parent") >= 0, F.col("parent")).alias("parent_turn"), F.col("quoted").isNotNull().alias("by_quote"),
        F.coalesce("quote_levels", F.lit(0)).alias("quote_levels"), F.coalesce("quotes", F.array().cast("array<struct<level:int,turn:bigint>>")).alias("quotes"), (F.col("branch") - 1).alias("branch"), (F.col("index") - F.col("from_index")).alias("position"),
        "place", "depth", "thread", "reply", chat.alias("chat"),
    )


def dialogues(linked: DataFrame, messages: int = SPAN) -> DataFrame:
    """conv_id, chunk, messages and chat: conversations as texts, in reply order, a row for every so many messages (so most are one row)."""
    chunk = F.floor(F.col("place") / messages)
    rows = F.array_sort(F.collect_list(F.struct("place", "chat")))
    return linked.groupBy("conv_id", chunk.alias("chunk")).agg(F.count("*").alias("messages"), F.array_join(F.transform(rows, lambda x: x["chat"]), "\n").alias("chat"))
