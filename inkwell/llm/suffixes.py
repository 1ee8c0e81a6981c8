"""Repeated passages by sparse suffix arrays.

Suffixes are retained at minimiser positions only: of every run of `length` words the leftmost of its
least `gram`-word hashes is kept, so equal runs keep the same position. Retained suffixes whose grams
are equal are sorted by what follows and by what precedes (read backwards); the neighbours' common
prefixes give the classes of suffixes that agree on b words to the right and a words to the left. A
run of `length` words that reaches a words left of its minimiser is a repeat if an earlier suffix is
in the same classes for a and for the words right of the gram; extending over all a gives every
repeated run, exactly. Earlier means smaller (doc_id, position).

Rows equal in doc_id and text are one document; other rows of one doc_id are told apart by a hash of
the text. Words are runs without ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fresh, hash_spans, hashed_words, ngram_hashes, slices, word_spans

LENGTH, GRAM = 50, 12
HOT = 100_000  # suffixes with one gram that a task sorts at once; more are compared by an exact aggregate
FEW, SALTS = 1000, 256  # FEW is not read any more: a suffix carries whether its gram is hot
BUCKET = 25_000  # suffixes, or spans, that a group holds at the mean


def minimisers(words: np.ndarray, cut: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in words) of the leftmost least gram of every run of `length` words inside a text, and the gram hashes."""
    grams = ngram_hashes(words, gram)
    window, n = length - gram + 1, len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams
    least, at, size = grams, np.arange(len(grams)), 1
    while size < window:
        step = min(size, window - size)
        a, b = least[: len(least) - step], least[step:]
        take = b < a
        least, at, size = np.where(take, b, a), np.where(take, at[step:], at[: len(at) - step]), size + step
    inside = np.zeros(len(words) + 1, np.int64)
    whole = np.diff(cut) >= length
    np.add.at(inside, cut[:-1][whole], 1)
    np.add.at(inside, cut[1:][whole] - length + 1, -1)
    return np.unique(at[np.cumsum(inside)[:n] > 0]), grams


def _sampled(length, gram):
    """The suffixes of a few MB of texts in one row: grams, texts (index into uids) and positions; and each distinct gram with its count."""

    def run(batches):
        n = 0
        for b in batches:
            for part in slices(b):
                words, cut = hashed_words(part.column("text"))
                at, grams = minimisers(words, cut, length, gram)
                doc = np.searchsorted(cut, at, "right") - 1
                key = grams[at].view(np.int64)
                distinct, count = np.unique(key, return_counts=True)
                one = lambda x, t: pa.array([x], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(TaskContext.get().partitionId() << 32) + n]), one(part.column("uid").to_numpy(zero_copy_only=False), pa.int64()), one(key, pa.int64()), one(doc.astype(np.int32), pa.int32()), one((at - cut[doc]).astype(np.int32), pa.int32()), one(distinct, pa.int64()), one(count, pa.int64())],
                    ["slice", "uids", "grams", "texts", "at", "distinct", "counts"],
                )
                n += 1

    return run


def _shared(batches):
    """Of each text the positions of its suffixes whose grams occur elsewhere too (a slice's row, with those grams), and whether those are hot."""
    for b in batches:
        for i in range(b.num_rows):
            get = lambda c: b.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            keep = np.isin(get("grams"), get("shared"))
            text, at, hot = get("texts")[keep], get("at")[keep], np.isin(get("grams")[keep], get("hot"))
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, int)
            offsets = np.append(first, len(text)).astype(np.int32)
            listed = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(x, t))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(get("uids")[text[first]], pa.int64()), listed(at, pa.int32()), listed(hot, pa.bool_())], ["uid", "at", "hot"])


def _binary(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The rows from each bound to the next as one value."""
    offsets = (bounds * (rows.shape[1] * 4)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _packed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, each distinct key, and the bounds of its rows in that order."""
    order = np.argsort(key, kind="stable")
    distinct, first = np.unique(key[order], return_index=True)
    return order, distinct, np.append(first, len(key)).astype(np.int32)


def _flat(table, column: str) -> pa.Array:
    """All entries of a column of lists."""
    lists = table.column(column)
    return (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()


def _tokens(column: pa.Array, reach: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.zeros((0, reach), "<u4")
    offsets = np.frombuffer(column.buffers()[1], np.int32)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[column.offset] : offsets[column.offset + len(column)]].view("<u4").reshape(-1, reach)


def _contexts(length, gram, buckets):
    """What stands around each suffix; those of a few MB of texts that go to one bucket (hot ones: -1) are one row."""
    reach = length - gram

    def run(batches):
        for b in batches:
            for part in slices(b):
                words, cut = hashed_words(part.column("text"))
                short = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                lists = part.column("at")
                own = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                at = lists.flatten().to_numpy().astype(np.int64) + cut[own]
                hot = part.column("hot").flatten().to_numpy(zero_copy_only=False)
                padded = np.concatenate((np.zeros(reach, np.uint32), short, np.zeros(length, np.uint32)))
                grams = ngram_hashes(words, gram)
                for k in range(0, len(at), 20_000):
                    p, o = at[k : k + 20_000], own[k : k + 20_000]
                    order, bucket, bounds = _packed(np.where(hot[k : k + 20_000], -1, (grams[p] % np.uint64(buckets)).astype(np.int64)))
                    p, o = p[order], o[order]
                    j = np.arange(reach)
                    left, right = padded[p[:, None] + reach - 1 - j], padded[p[:, None] + reach + gram + j]
                    nl, nr = np.minimum(reach, p - cut[o]), np.minimum(reach, cut[o + 1] - p - gram)
                    left, right = np.where(j < nl[:, None], left, 0), np.where(j < nr[:, None], right, 0)
                    ids = pa.array(o)
                    lists = [pa.ListArray.from_arrays(bounds, x) for x in (part.column("uid").take(ids), part.column("doc_id").take(ids), pa.array(grams[p].view(np.int64)), pa.array((p - cut[o]).astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), *lists, _binary(left, bounds), _binary(right, bounds)], ["bucket", "uid", "doc_id", "gram", "at", "left", "right"])

    return run


def _classes(gram: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Class of each row for every prefix length: rows of a class share the gram and that many tokens.

    From the sorted suffixes: neighbours with a common prefix of at least b are in one class for b.
    """
    n, reach = tokens.shape
    text = np.concatenate((gram.view(np.uint64).astype(">u8").view(np.uint8).reshape(n, 8), tokens.astype(">u4").view(np.uint8).reshape(n, reach * 4)), 1)
    order = np.argsort(np.ascontiguousarray(text).view(f"V{8 + reach * 4}").ravel(), kind="stable")
    g, t = gram[order], tokens[order]
    differs = t[1:] != t[:-1]
    common = np.where(differs.any(1), differs.argmax(1), reach)
    common = np.where(g[1:] == g[:-1], common, -1)
    out = np.empty((n, reach + 1), np.int32)
    out[order[0]] = 0
    out[order[1:]] = np.cumsum(common[:, None] < np.arange(reach + 1), 0, dtype=np.int32)
    return out


def _repeats(length, gram, homes):
    """Spans of one bucket's suffixes that an earlier suffix repeats, with the document of the earliest; a row for each of `homes` sets of documents."""
    reach = length - gram

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = lambda c: _flat(table, c).to_numpy()
        doc, uid, at, key = _flat(table, "doc_id").fill_null((1 << 63) - 1).to_numpy(), get("uid"), get("at").astype(np.int64), get("gram")
        order = np.lexsort((at, uid, doc))
        doc, uid, at, key = doc[order], uid[order], at[order], key[order]
        left, right = (_tokens(table.column(c).combine_chunks(), reach)[order] for c in ("left", "right"))
        nl, nr = (left > 0).sum(1), (right > 0).sum(1)
        before, after = _classes(key, left), _classes(key, right)
        none = len(at)
        first = np.full((none, reach + 1), none, np.int32)
        for a in range(reach + 1):
            rows = np.flatnonzero((nl >= a) & (nr >= reach - a))
            both = before[rows, a].astype(np.int64) * (none + 1) + after[rows, reach - a]
            _, head, of = np.unique(both, return_index=True, return_inverse=True)
            repeat = rows[head][of] != rows
            first[rows[repeat], a] = rows[head][of][repeat]
        # Neighbouring reaches are one span, with the smallest of their earliest copies' documents (rows are in order of documents).
        hit = np.zeros((none, reach + 3), np.int8)
        hit[:, 1:-1] = first < none
        edge = np.diff(hit, axis=1)
        row, a = np.nonzero(edge == 1)
        _, z = np.nonzero(edge == -1)
        bounds = np.stack((row * (reach + 1) + a, row * (reach + 1) + z), 1).ravel()
        source = doc[np.minimum.reduceat(np.append(first.ravel(), none), bounds)[::2]] if len(bounds) else np.zeros(0, np.int64)
        order, home, bounds = _packed((uid[row].view(np.uint64) % np.uint64(homes)).astype(np.int64))
        columns = {"uid": uid[row], "start": (at[row] - z + 1).astype(np.int32), "end": (at[row] - a + length).astype(np.int32), "first_doc_id": source}
        return pa.table({"home": home, **{c: pa.ListArray.from_arrays(bounds, pa.array(x[order])) for c, x in columns.items()}})

    return run


def _runs(length, gram):
    """Every run of `length` words around each suffix, by a hash; for grams with very many suffixes."""
    reach = length - gram

    def run(batches):
        for b in batches:
            left, right = (_tokens(b.column(c), reach) for c in ("left", "right"))
            key = _flat(b, "gram").to_numpy().view(np.uint64)
            at, doc, uid = _flat(b, "at").to_numpy(), _flat(b, "doc_id"), _flat(b, "uid")
            for a in range(reach + 1):
                rows = np.flatnonzero(((left > 0).sum(1) >= a) & ((right > 0).sum(1) >= reach - a))
                text = np.concatenate((key[rows, None].view(np.uint8), np.ascontiguousarray(left[rows, :a]).view(np.uint8), np.ascontiguousarray(right[rows, : reach - a]).view(np.uint8)), 1)
                h = hash_spans(text.ravel(), np.arange(len(rows)) * text.shape[1], np.full(len(rows), text.shape[1])) + np.uint64(a)
                ids = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), doc.take(ids), uid.take(ids), pa.array((at[rows] - a).astype(np.int32))], ["run", "doc_id", "uid", "start"])

    return run


def _merge(own: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Overlapping spans of each document (own: its number here) as one, with the smallest first_doc_id."""
    start, end = start.astype(np.int64) + (own << 32), end.astype(np.int64) + (own << 32)
    order = np.argsort(start, kind="stable")
    own, start, end, first = own[order], start[order], end[order], first[order]
    head = np.flatnonzero(np.concatenate(([True], start[1:] > np.maximum.accumulate(end)[:-1]))) if len(own) else np.zeros(0, int)
    end, first = (f.reduceat(x, head) if len(head) else x for f, x in ((np.maximum, end), (np.minimum, first)))
    of = own[head]
    return of, (start[head] - (of << 32)).astype(np.int32), (end - (of << 32)).astype(np.int32), pa.array(first, mask=first == (1 << 63) - 1)


def _merged(batches):
    """The spans of each document, a row with a list of them, merged."""
    for b in batches:
        lists = b.column("spans")
        span = lists.flatten()
        start, end = (span.field(c).to_numpy() for c in ("start", "end"))
        of, *rest = _merge(np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), start, end, span.field("first_doc_id").fill_null((1 << 63) - 1).to_numpy())
        yield pa.RecordBatch.from_arrays([b.column("uid").take(pa.array(of)), *map(pa.array, rest)], ["uid", "start", "end", "first_doc_id"])


def _gathered(table: pa.Table) -> pa.Table:
    """The spans of one set of documents, from the rows of all buckets, merged."""
    table = table.combine_chunks()
    get = lambda c: _flat(table, c).to_numpy()
    uids, own = np.unique(get("uid"), return_inverse=True)
    of, *rest = _merge(own, get("start"), get("end"), get("first_doc_id"))
    return pa.table([pa.array(uids[of]), *map(pa.array, rest)], ["uid", "start", "end", "first_doc_id"])


def identified(docs: DataFrame, name: str = "uid") -> DataFrame:
    """docs with a hash of doc_id and text under that name, the same for a doc_id of any type that casts to the same long."""
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """uid, start, end (word positions) and first_doc_id of the spans of each document all of whose runs of
    `length` words also occur earlier; first_doc_id is the smallest doc_id with such an earlier run.

    Defined results: null, empty and short texts have no spans; the earliest copy (ties by position)
    keeps its words; null doc_ids come last; an empty table gives none.
    """
    keyed = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    kinds = "slice long, uids array<long>, grams array<long>, texts array<int>, at array<int>, distinct array<long>, counts array<long>"
    suffixes = scratch.keep(keyed.select("uid", "text").mapInArrow(_sampled(length, gram), kinds), "suffixes")
    # A gram is counted, and its count sent back, once for each slice that has it, however many suffixes begin with it.
    each = suffixes.select("slice", F.explode(F.arrays_zip("distinct", "counts")).alias("x")).select("slice", F.col("x.distinct").alias("gram"), F.col("x.counts").alias("n"))
    grams = scratch.keep(each.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1"), "grams")
    told = F.collect_list("gram").alias("shared"), F.collect_list(F.when(F.col("n") > hot, F.col("gram"))).alias("hot")
    back = each.select("slice", "gram").join(grams, "gram").groupBy("slice").agg(*told)
    per_doc = suffixes.select("slice", "uids", "grams", "texts", "at").join(back, "slice").mapInArrow(_shared, "uid long, at array<int>, hot array<boolean>")
    per_doc = scratch.keep(per_doc, "shared")
    n, most = grams.agg(F.sum("n"), F.max("n")).first()
    buckets = 1 + (n or 0) // BUCKET
    texts = keyed.join(per_doc.dropDuplicates(["uid"]), "uid").dropDuplicates(["uid"])
    # However many suffixes a common passage has, those of a slice of texts go to a bucket in one row, and the spans found there to their documents.
    packed = "uid array<long>, doc_id array<long>, gram array<long>, at array<int>, left binary, right binary"
    context = scratch.keep(texts.select("uid", "doc_id", "text", "at", "hot").mapInArrow(_contexts(length, gram, buckets), f"bucket long, {packed}"), "context")
    spans = "uid long, start int, end int, first_doc_id long"
    some = context.filter("bucket >= 0").groupBy("bucket").applyInArrow(_repeats(length, gram, buckets), "home long, uid array<long>, start array<int>, end array<int>, first_doc_id array<long>")
    found = some.groupBy("home").applyInArrow(_gathered, spans)
    if (most or 0) <= hot:
        return found
    runs = context.filter("bucket < 0").mapInArrow(_runs(length, gram), "run long, doc_id long, uid long, start int")
    runs = scratch.keep(runs.withColumn("place", F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "uid", "start")), "runs")
    # A run of very many suffixes is dealt over SALTS tasks: each finds its least place, and learns the least of all.
    runs = runs.withColumn("salt", F.pmod(F.xxhash64("uid", "start"), F.lit(SALTS)).cast("int"))
    parts = scratch.keep(runs.groupBy("run", "salt").agg(F.min("place").alias("part")), "least")
    least = parts.groupBy("run").agg(F.min("part").alias("first"))
    told = scratch.keep(parts.select("run", "salt").join(least, "run"), "told")
    more = runs.join(told, ["run", "salt"]).filter("place > first").withColumn("doc", F.col("first.doc"))
    found = found.union(more.select("uid", "start", (F.col("start") + length).alias("end"), F.when(F.col("doc") < (1 << 63) - 1, F.col("doc"))))
    lists = found.groupBy("uid").agg(F.collect_list(F.struct("start", "end", "first_doc_id")).alias("spans"))
    return lists.mapInArrow(_merged, spans)


def repeated_spans(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """doc_id, start_word, end_word, words, first_doc_id of every repeated span."""
    found = scratch.keep(repeats(docs, scratch, **options), "spans")
    ids = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("uid", "doc_id").distinct()
    return found.join(ids, "uid").select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("words"), "first_doc_id")


def without_repeats(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """docs with repeated spans cut out of their texts (white space before the next word goes too).

    A document of which no word is left goes; texts without repeats stay as they are. n_chars, where
    there is such a column, follows the text. Defined results: null, empty and short texts stay as they
    are; very long texts are cut as a whole; repeated rows (equal doc_id and text) are one document and all
    stay, or are all cut alike; other columns pass through, whatever their names; an empty table gives none.
    """
    found = scratch.keep(repeats(docs, scratch, **options), "spans")
    uid = fresh("uid", docs.columns)
    at = fresh("spans", [*docs.columns, uid])
    lists = found.groupBy(F.col("uid").alias(uid)).agg(F.collect_list(F.struct("start", "end")).alias(at))
    keyed = identified(docs, uid).join(lists, uid, "left")
    clean, cut = keyed.filter(F.col(at).isNull()).select(*docs.columns), keyed.filter(F.col(at).isNotNull()).drop(uid)

    def run(batches):
        for b in batches:
            texts = []
            for t, spans in zip(b.column("text").to_pylist(), b.column(at).to_pylist()):
                raw = (t or "").encode()
                starts, _ = word_spans(np.frombuffer(raw, np.uint8))
                ends = np.append(starts, len(raw))
                out, done = [], 0
                for s, e in sorted((x["start"], x["end"]) for x in spans):
                    out.append(raw[done : ends[s]])
                    done = ends[e]
                texts.append((b"".join(out) + raw[done:]).decode())
            names = [c for c in b.schema.names if c != at]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names)

    cut = cut.mapInArrow(run, docs.schema).filter(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(cut)
