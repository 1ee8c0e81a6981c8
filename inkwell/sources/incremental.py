"""A bank that is kept up to date by reading changed files only, and reads that report each file's outcome.

A manifest says of every file in the bank when it was changed and how long it is. A refresh lists the tree, compares, reads the files
that are new or changed, and writes only the partitions (a partition a source) that hold them: rows of a partition's other files
are taken from the bank itself. The manifest is written last, so a refresh that broke off is done again by the next one, with the
same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..tables import dropped, kept
from .records import ENTRY

COORDINATES = ["subject", "stage", "level", "source"]
#: More changed files than this are found by a join on their paths instead of being listed to the reader by name.
BY_NAME = 10_000


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listing(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """path, changed (time) and length of every file of the tree; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_size").alias("length"))


def differences(now: DataFrame, before: DataFrame) -> DataFrame:
    """path and state (new, changed, gone or same) of the files of two listings."""
    old = before.select("path", F.col("changed").alias("_changed"), F.col("length").alias("_length"))
    same = F.col("changed").eqNullSafe(F.col("_changed")) & (F.col("length") == F.col("_length"))
    state = F.when(F.col("_length").isNull(), "new").when(F.col("length").isNull(), "gone").when(same, "same").otherwise("changed")
    return now.join(old, "path", "full_outer").select("path", state.alias("state"))


def located(df: DataFrame, path: str = "path") -> DataFrame:
    """df with the coordinates, file_stem and pipeline_stage that a file's path says; folders may be named key=value."""
    named = "/" + "/".join(f"(?:{key}=)?({'original|raw|extracted|interim' if key == 'area' else '[^/]+'})" for key in [*COORDINATES, "area"]) + "/"
    part = lambda i: F.regexp_extract(path, named, i)
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.(?:clean|tagged))?\.jsonl?\z", 1)
    stage = F.coalesce(F.nullif(F.regexp_extract(path, r"\.(clean|tagged)\.jsonl?\z", 1), F.lit("")), F.lit("raw"))
    return df.withColumns({n: part(i) for i, n in enumerate(COORDINATES, 1)} | {"file_stem": stem, "pipeline_stage": stage})


def read_files(spark: SparkSession, root: str, wanted: DataFrame, schema: str, glob: str) -> DataFrame:
    """Rows of the wanted files (path), with path and _corrupt_record."""
    reader = spark.read.schema(schema + ", _corrupt_record STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    own = [r["path"] for r in wanted.select("path").limit(BY_NAME + 1).collect()]
    if len(own) <= BY_NAME:
        rows = reader.json(own) if own else spark.createDataFrame([], StructType.fromDDL(schema + ", _corrupt_record STRING"))
        return rows.select("*", F.col("_metadata.file_path").alias("path")) if own else rows.withColumn("path", F.lit(""))
    rows = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(root)
    return rows.select("*", F.col("_metadata.file_path").alias("path")).join(wanted.select("path"), "path", "left_semi")


def refresh(spark: SparkSession, root: str, bank: str, schema: str = ENTRY, glob: str = "*.jsonl") -> DataFrame:
    """Brings the bank (a Parquet table by source; beside it bank-manifest and bank-warnings) up to the files below root.

    Gives path and state of every file that isn't the same as before. A file with no readable row is a warning (path, reason, rows) instead of an
    error, and has no rows in the bank; it isn't read again until it changes. bank_rows and warnings read the result.
    """
    manifest, notes = f"{bank}-manifest", f"{bank}-warnings"
    now = kept(listing(spark, root, glob), "listing")
    first = not _exists(spark, manifest)
    before = now.limit(0) if first else spark.read.parquet(manifest)
    found = kept(differences(now, before).filter("state <> 'same'"), "differences")
    todo, stale = found.filter("state <> 'gone'"), found.filter("state <> 'new'")
    if not found.isEmpty():
        read = kept(read_files(spark, root, todo, schema, glob), "read")
        good = F.col("_corrupt_record").isNull()
        counts = read.groupBy("path").agg(F.count("*").alias("rows"), F.count_if(good).alias("good"))
        bad = counts.filter("good = 0").select("path", F.lit("no readable row").alias("reason"), "rows")
        fresh = located(read.filter(good).drop("_corrupt_record"))
        touched = located(found.select("path")).select(*COORDINATES).distinct()
        if first or not _exists(spark, bank):
            rows = fresh
        else:
            old = spark.read.schema(fresh.schema).parquet(bank)
            rows = old.join(touched, COORDINATES, "left_semi").join(stale.select("path"), "path", "left_anti").unionByName(fresh)
        rows = kept(rows, "rows")  # written before what it was read from is overwritten
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*COORDINATES).parquet(bank)
        _clear(spark, bank, touched.join(rows.select(*COORDINATES).distinct(), COORDINATES, "left_anti"))
        said = bad if first or not _exists(spark, notes) else spark.read.schema("path string, reason string, rows bigint").parquet(notes).join(found.select("path"), "path", "left_anti").unionByName(bad)
        kept(said, "warnings").write.mode("overwrite").parquet(notes)
        now.write.mode("overwrite").parquet(manifest)
        for table in (read, rows):
            dropped(table)
    return found


def _clear(spark: SparkSession, bank: str, empty: DataFrame) -> None:
    """Removes the partitions of sources that have no file left: a dynamic overwrite leaves what it has no row for."""
    for r in empty.collect():  # a row a source whose last file is gone
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join([bank, *(f"{c}={r[c]}" for c in COORDINATES)]))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bank_rows(spark: SparkSession, bank: str, schema: str = ENTRY) -> DataFrame:
    """The bank's entries, with coordinates, file_stem, pipeline_stage and path."""
    more = ", ".join(f"{c} STRING" for c in ["path", "file_stem", "pipeline_stage", *COORDINATES])
    return spark.read.schema(f"{schema}, {more}").parquet(bank) if _exists(spark, bank) else spark.createDataFrame([], f"{schema}, {more}")


def warnings(spark: SparkSession, bank: str) -> DataFrame:
    return spark.read.schema("path string, reason string, rows bigint").parquet(f"{bank}-warnings")


# ---- files read whole, each with its outcome


class _Files(InputPartition):
    def __init__(self, files: list):
        super().__init__(0)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        import json

        self.files, self.each = json.loads(options["files"]), int(options.get("filesperpartition", 16))
        self.tries, self.pause = int(options.get("tries", 5)), float(options.get("pause", 0.2))

    def partitions(self) -> list[InputPartition]:
        return [_Files(self.files[i : i + self.each]) for i in range(0, len(self.files), self.each)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, length, digest in partition.files:
            data, why = self._whole(path, length, digest)
            yield path, why is None, why, data if why is None else None

    def _whole(self, path: str, length: int | None, digest: str | None) -> tuple[bytes | None, str | None]:
        """The file's bytes and what is wrong with them; a short read is tried again after a pause that doubles."""
        import time

        from pyarrow import fs

        why = None
        for n in range(self.tries):
            try:
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as f:
                    data = f.read()
                if length is not None and len(data) != length:
                    why = f"short read: {len(data)} of {length} bytes"
                elif digest is not None and hashlib.sha256(data).hexdigest() != digest:
                    why = "content differs from its hash"
                else:
                    return data, None
            except FileNotFoundError:
                return None, "no such file"
            except OSError as x:
                why = f"{type(x).__name__}: {x}"[:200]
            time.sleep(self.pause * 2**n if n + 1 < self.tries else 0)
        return None, why


class WholeFiles(DataSource):
    """Files read whole and checked: path, ok, reason, content. Options: files (JSON of [path, length or null, SHA-256 or null]), tries, pause.

    Paths are URIs of stores that pyarrow opens (file, s3, gs, hdfs). A file that is missing, short or different is a row with its reason; the others are read.
    """

    @classmethod
    def name(cls) -> str:
        return "wholefiles"

    def schema(self) -> str:
        return "path string, ok boolean, reason string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_whole(files: DataFrame, tries: int = 5, pause: float = 0.2) -> DataFrame:
    """path, ok, reason and content of files (path, and length and sha256 where they are known): each read whole and checked.

    files: a listing (one short row a file), which is told to the reader by name.
    """
    import json

    spark = files.sparkSession
    spark.dataSource.register(WholeFiles)
    has = lambda c, kind: F.col(c).cast(kind) if c in files.columns else F.lit(None).cast(kind)
    rows = [tuple(r) for r in files.select("path", has("length", "long"), has("sha256", "string")).toLocalIterator()]
    return spark.read.format("wholefiles").option("files", json.dumps(rows)).option("tries", tries).option("pause", pause).load()


def outcomes(results: DataFrame) -> DataFrame:
    """ok (count) and failed (a map of file name to reason) of per-file results (path, ok, reason); answer files (stems ending in _ans), which
    are read with their question files, don't count."""
    own = results.filter(~F.col("path").rlike(r"_ans(\.[^/]*)?\z"))
    name = F.substring_index("path", "/", -1)
    return own.agg(F.count_if("ok").alias("ok"), F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct(name.alias("file"), "reason"))))).alias("failed"))
