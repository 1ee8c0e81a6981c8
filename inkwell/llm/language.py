"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-gram sets of all languages: a cell has one bit a language,
and the AND of the cells that an n-gram hashes to is the set of languages that contain it. A text's
popcount for a language is corrected for the filter's false positives, (hits - n * f) / (1 - f) with
f the language's fill rate to the power of the number of hashes, and the largest decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .labelled import unit_hash
from .shared import flat_bytes, letters, mix, slices, small_batches, with_fields

HASHES, CELLS = 3, 1 << 20
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[:128] = 32
_SPACED[97:123] = np.arange(97, 123)


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all four-byte n-grams of the lower-cased texts, and the offset of each text's n-grams.

    Runs of anything but letters count as one space; every text starts and ends with a space.
    """
    low = pa.array([" " + (t or "").lower() for t in texts.to_pylist()], pa.large_string())
    data, offsets = flat_bytes(low, lower=False)
    data = _SPACED[data]
    space = data == 32
    keep = ~(space & np.concatenate(([False], space[:-1])))
    keep[offsets[:-1]] = True
    data, offsets = data[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
    n = max(0, len(data) - 3)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    four = np.ndarray((n,), "<u4", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64)
    inside = np.ones(n, bool)
    for back in (1, 2, 3):  # n-grams that run over the end of a text
        at = offsets[1:] - back
        inside[at[(at >= 0) & (at < n)]] = False
    cut = np.concatenate(([0], np.cumsum(inside)))[np.minimum(offsets, n)]
    return mix(four[inside]), cut


@dataclass
class LanguageFilter:
    languages: list[str]
    cells: np.ndarray  # CELLS x planes, of unsigned integers with a bit a language
    false: np.ndarray  # rate of false positives of each language
    common: int = 0  # the most frequent language

    @classmethod
    def build(cls, languages: list[str], grams: np.ndarray, members: np.ndarray, common: int = 0) -> LanguageFilter:
        """grams: hashes; members: index of a language that contains the n-gram beside it."""
        width = next((w for w in (8, 16, 32, 64) if len(languages) <= w), 64)
        planes = -(-max(1, len(languages)) // width)
        cells = np.zeros((CELLS, planes), f"u{width // 8}")
        for at in _places(grams):
            np.bitwise_or.at(cells, (at, members // width), np.left_shift(np.ones(len(members), cells.dtype), (members % width).astype(cells.dtype)))
        fill = np.array([np.count_nonzero(cells[:, i // width] >> cells.dtype.type(i % width) & 1) for i in range(len(languages))]) / CELLS
        return cls(languages, cells, fill**HASHES, common)

    def shares(self, texts: pa.Array) -> np.ndarray:
        """Corrected share of each text's n-grams that each language contains: texts x languages, at least 0."""
        h, cut = ngrams(texts)
        width, out = self.cells.dtype.itemsize * 8, np.zeros((len(cut) - 1, len(self.languages)))
        a, b, c = _places(h)
        n = np.diff(cut)
        for plane in range(self.cells.shape[1]):
            t = self.cells[:, plane]
            held = t[a] & t[b] & t[c]
            for i in range(plane * width, min(len(self.languages), (plane + 1) * width)):
                hits = np.concatenate(([0], np.cumsum(held >> t.dtype.type(i % width) & 1, dtype=np.int64)))
                out[:, i] = np.diff(hits[cut]) / np.maximum(1, n)
        return np.maximum(0, (out - self.false) / (1 - self.false))


def _places(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(20 * i) & np.uint64(CELLS - 1)).astype(np.int64) for i in range(HASHES)]


def learn(docs: DataFrame, allowed: Column, per_language: int = 2000, least: float = 1e-5, ratio: float = 0.1) -> LanguageFilter:
    """A filter from a bounded sample of the rows with a language: about per_language of each, by a hash of doc_id.

    A language contains an n-gram that makes up at least `least` of its sample's n-grams and at least
    `ratio` of that n-gram's largest share in any language; so the n-grams that come to the driver
    are at most 1 / least for each language.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.coalesce(allowed, F.lit(False)))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageFilter([], np.zeros((CELLS, 1), np.uint8), np.zeros(0))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, per_language / counts[k])))[F.col("lang")]
    sample = known.filter(unit_hash(F.coalesce(F.col("doc_id"), F.lit(0))) < share).select("lang", F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            for part in slices(b):
                h, cut = ngrams(part.column("text"))
                of = np.array([languages.index(x) for x in part.column("lang").to_pylist()])
                lang = np.repeat(of, np.diff(cut))
                for i in np.unique(lang):
                    gram, n = np.unique(h[lang == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), i, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    grams = sample.mapInArrow(run, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = F.broadcast(grams.groupBy("lang").agg(F.sum("n").alias("total")))  # a row a language
    grams = grams.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= least)
    grams = grams.withColumn("most", F.max("share").over(W.partitionBy("gram"))).filter(F.col("share") >= ratio * F.col("most"))
    got = grams.select("lang", "gram").toPandas()
    return LanguageFilter.build(languages, got["gram"].to_numpy(np.int64).view(np.uint64), got["lang"].to_numpy(np.int64), max(range(len(languages)), key=lambda i: counts[languages[i]]))


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1: the winner's part of all languages' corrected shares).

    Null texts, texts without a letter, and every text if no language was learned, are `und` with
    score 0. A text none of whose n-grams any language contains (one of a single letter has none) gets
    the most frequent language learned, with a score below that of any hit: 1 / (languages + 1). Ties
    go to the language first in order. Repeated rows are each answered, very long texts as a whole; columns of the
    same names are replaced, all others pass through; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop("lang_pred", "lang_score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: CELLS x planes
    schema = with_fields(rest, lang_pred="string", lang_score="double")

    def run(batches):
        m = held.value
        for b in batches:
            for part in slices(b):
                share = m.shares(part.column("text")) if m.languages else np.zeros((part.num_rows, 1))
                best, top, total = share.argmax(1), share.max(1), share.sum(1)
                none = np.array([not m.languages or not t or not letters(t) for t in part.column("text").to_pylist()])
                blind = top <= 0
                best = np.where(blind, m.common, best)
                name = [None if x else m.languages[i] for x, i in zip(none, best)]
                s = np.where(none, 0, np.where(blind, 1 / (len(m.languages) + 1), top / np.maximum(total, 1e-300)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x or "und" for x in name], pa.string()), pa.array(s)], names=[*part.schema.names, "lang_pred", "lang_score"])

    return rest.mapInArrow(run, schema)
