"""Substring search of a bank by an index of trigrams, built once a version of the bank.

The index is three Parquet tables below path/version=...: the entries with a number each (blobs, in at most SLABS folders), for every
trigram of UTF-8 bytes and every 64 entries a bitmap of those that hold it (postings), and how many such bitmaps a trigram has (grams).
A search reads the postings of each text's rarest trigrams only, ands their bitmaps, and compares texts in the folders that candidates lie in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import kept

SLABS = 1024
#: Trigrams of a text whose postings are read: the rarest ones. Fewer give more candidates, never other results.
RAREST = 16
#: Bytes of a text that are looked at in one step.
STEP = 1 << 22


def trigrams(text: bytes) -> np.ndarray:
    """The distinct trigrams of a text's bytes as numbers, in order; a text contains another only if it has all of its trigrams."""
    b = np.frombuffer(text, np.uint8)
    found = [np.zeros(0, np.int32)]
    for i in range(0, max(0, len(b) - 2), STEP):
        c = b[i : i + STEP + 2].astype(np.int32)
        found.append(np.unique(c[:-2] << 16 | c[1:-1] << 8 | c[2:]))
    return found[-1] if len(found) < 3 else np.unique(np.concatenate(found))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, segment and bits of the batch's entries (number, blob as bytes), each gram once a segment."""
    for b in batches:
        number = b.column("number").to_numpy()
        own = [trigrams(x.as_py()) for x in b.column("blob")]
        gram = np.concatenate([np.zeros(0, np.int32), *own])
        at = np.repeat(number, [len(g) for g in own])
        key, to = np.unique((at >> 6) << 24 | gram, return_inverse=True)
        bits = np.zeros(len(key), np.uint64)
        np.bitwise_or.at(bits, to, np.uint64(1) << (at & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array((key & 0xFFFFFF).astype(np.int32)), pa.array(key >> 24), pa.array(bits.view(np.int64))], ["gram", "segment", "bits"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_t and each of its trigrams."""
    for b in batches:
        own = [trigrams(x.as_py().encode()) for x in b.column("_t")]
        at = pa.array(np.repeat(np.arange(len(own)), [len(g) for g in own]))
        yield pa.RecordBatch.from_arrays([b.column("_t").take(at), pa.array(np.concatenate([np.zeros(0, np.int32), *own]))], ["_t", "gram"])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _blobs(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{index}/shape").schema).parquet(f"{index}/blobs")


def build_index(entries: DataFrame, path: str, version: str) -> str:
    """The folder of the index of entries (blob, lower-cased, and any other columns); only written if that version has none yet.

    A null blob is found by no text. A build that broke off is done again: what completes an index, its list of trigrams, is written last.
    Entries are numbered where they lie, so that 64 neighbours share a bitmap within a task: only bitmaps are shuffled, texts never.
    """
    at, spark = f"{path.rstrip('/')}/version={version}", entries.sparkSession
    if _exists(spark, f"{at}/grams/_SUCCESS"):
        return at
    own = entries.filter("blob is not null").select(F.struct(*(c for c in entries.columns if c != "blob")).alias("entry"), "blob", F.monotonically_increasing_id().alias("number"))
    own = own.withColumn("slab", F.shiftright("number", 33) % SLABS)
    own.limit(0).write.mode("overwrite").parquet(f"{at}/shape")  # folders of no entry tell no columns
    own.write.mode("overwrite").partitionBy("slab").parquet(f"{at}/blobs")
    blobs = _blobs(spark, at)
    each = blobs.select("number", F.col("blob").cast("binary").alias("blob")).mapInArrow(_bitmaps, "gram int, segment long, bits long")
    bits = each.groupBy("gram", "segment").agg(F.bit_or("bits").alias("bits"))
    bits.repartitionByRange("gram", "segment").sortWithinPartitions("gram", "segment").write.mode("overwrite").parquet(f"{at}/postings")
    spark.read.parquet(f"{at}/postings").groupBy("gram").agg(F.count("*").alias("segments")).write.mode("overwrite").parquet(f"{at}/grams")
    return at


def search(index: str, texts: DataFrame) -> DataFrame:
    """texts (text, any case, and any other columns but entry) with entry, a struct: a row for every entry whose blob holds the text.

    A text of fewer than three bytes has no trigram and is compared with every blob; an empty one is in all, a null one in none.
    Equal texts are searched once. What is found of the index, slabs (SLABS at most), is all that the driver sees.
    """
    spark = texts.sparkSession
    blobs = _blobs(spark, index)
    asked = kept(texts.select(F.lower("text").alias("_t")).filter("_t is not null").distinct(), "texts")
    own = asked.filter(F.octet_length("_t") >= 3).mapInArrow(_asked, "_t string, gram int").join(spark.read.parquet(f"{index}/grams"), "gram", "left")
    rank = F.row_number().over(W.partitionBy("_t").orderBy(F.coalesce("segments", F.lit(0)), "gram"))
    # A trigram that no entry has is the rarest and has no postings, so that too few meet.
    some = own.withColumn("_r", rank).filter(F.col("_r") <= RAREST).withColumn("_n", F.count("*").over(W.partitionBy("_t"))).select("_t", "gram", "_n")
    met = some.join(spark.read.parquet(f"{index}/postings"), "gram").groupBy("_t", "segment").agg(F.count("*").alias("n"), F.max("_n").alias("_n"), F.bit_and("bits").alias("bits"))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(1) == 1)
    found = met.filter("n = _n and bits <> 0").select("_t", "segment", F.explode(places).alias("place")).select("_t", (F.col("segment") * 64 + F.col("place")).alias("number"))
    found = kept(found.withColumn("slab", F.shiftright("number", 33) % SLABS), "candidates")
    slabs = [r[0] for r in found.select("slab").distinct().collect()]
    hits = found.join(blobs.filter(F.col("slab").isin(slabs)), ["slab", "number"]).filter(F.contains("blob", "_t")).select("_t", "entry")
    short = asked.filter(F.octet_length("_t") < 3)
    if not short.isEmpty():
        hits = hits.union(short.join(blobs, F.contains("blob", "_t")).select("_t", "entry"))
    return texts.withColumn("_t", F.lower("text")).join(hits, "_t").drop("_t")
