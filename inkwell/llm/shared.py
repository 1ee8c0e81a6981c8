"""Folders shared by the cluster, and vectorised word hashing over Arrow batches."""

from __future__ import annotations

import gc
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import shared_root, small_batches

WORD = r"[^\x20\x09-\x0D]+"


def fresh(name: str, columns: list[str]) -> str:
    """The name, or one like it that no column has (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Scratch:
    """Tables written in the shared folder, so that a lost executor costs no lineage.

    A plan that is still to run may read them: they stay until whoever has written its result removes them.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        Scratch.made.append(self)
        self.spark, self.base, self.n = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{name}-{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def split(self, df: DataFrame, name: str, column: str, values: list[str]) -> list[DataFrame]:
        """A table for each of the column's values, without the column; each can be dropped for itself."""
        self.n += 1
        path, out = f"{self.base}/{name}-{self.n}", []
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)
        rest = StructType([f for f in df.schema.fields if f.name != column])
        for value in values:
            at = f"{path}/{column}={value}"
            out.append(self.spark.read.schema(rest).parquet(at) if self._fs(at).exists(self._path(at)) else self.spark.createDataFrame([], rest))
            out[-1].scratch_path = at
        return out

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def sweep(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def remove(self) -> None:
        """Remove all tables; no plan may read them any more."""
        self._fs(self.base).delete(self._path(self.base), True)
        Scratch.made.remove(self)

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later plan reads."""
        self._fs(df.scratch_path).delete(self._path(df.scratch_path), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod (null for a null id)."""
    return F.crc32(column.cast("string").cast("binary")) % mod


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S31, _S33, _S29 = np.uint64(31), np.uint64(33), np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> _S31)


def flat_bytes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by a newline; offsets of the texts in it. Null counts as empty."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.binary_join_element_wise(pc.fill_null(texts, ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - (offsets[0] if len(offsets) else 0)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every maximal run of bytes other than ASCII white space."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    return starts, np.flatnonzero(edge == 1) - starts


def hash_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time over all spans at once."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    h = lens.astype(np.uint64) * _A
    live, at, left = slice(None), starts, lens
    while True:
        part = eight[np.minimum(at, len(data))] & _KEEP[np.clip(left, 0, 8)]
        x = (h[live] ^ part) * _B
        h[live] = ((x << _S31) | (x >> _S33)) * _C
        more = np.flatnonzero(left > 8)
        if not len(more):
            return mix(h)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the offset of each text's words."""
    data, offsets = flat_bytes(texts)
    starts, lens = word_spans(data)
    return hash_spans(data, starts, lens), np.searchsorted(starts, offsets)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 4_000_000):
    """The batch in runs of rows whose texts hold about size bytes (at least one row each)."""
    if not batch.num_rows:
        return
    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        done = n[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(n, done + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries, by doubling."""
    out, n = None, 0
    mult = np.uint64(0xD6E8FEB86659FD93)
    power, size, cur, rest = mult, 1, h, k
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, n = cur, size
                else:
                    m = min(len(out), max(0, len(cur) - n))
                    scale = np.uint64(pow(int(mult), size, 1 << 64))
                    out, n = out[:m] * scale + cur[n : n + m], n + size
            rest >>= 1
            if rest:
                m = max(0, len(cur) - size)
                cur, power = cur[:m] * power + cur[size : size + m], power * power
                size *= 2
    return mix(out)


def letters(text: str) -> bool:
    return bool(re.search(r"[^\W\d_]", text))


def with_fields(df: DataFrame, **fields: str) -> StructType:
    """The schema of df with more fields, given by name and type."""
    more = "".join(f", `{k}` {v}" for k, v in fields.items())[2:]
    return StructType(df.schema.fields + StructType.fromDDL(more).fields)
