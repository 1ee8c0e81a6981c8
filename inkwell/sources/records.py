"""Readers and writers: JSON lines, block files, taxonomy, source trees, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH = r"/([^/]+)/([^/]+)/([^/]+)/([^/]+)/(original|raw|extracted|interim)/"

ENTRY = """qid STRING, kind STRING, stem STRING,
parts ARRAY<STRUCT<path:STRING,no:STRING,parent_path:STRING,depth:INT,ord:INT,text:STRING,marks:INT,answer:STRING,solution:STRING,answer_area:STRING>>,
options ARRAY<STRUCT<pos:INT,label:STRING,value:STRING>>, answer STRUCT<value:STRING,kind:STRING>, answer_area STRING, solution STRING,
imgs ARRAY<STRUCT<kind:STRING,path:STRING,src:STRING,page:INT,bbox:ARRAY<DOUBLE>>>,
meta STRUCT<source_id:STRING,file:STRING,pages:ARRAY<INT>,qno:STRING,section:STRING,blocks:ARRAY<INT>,marks:INT,schema:INT,edited_at:STRING>,
flags ARRAY<STRING>, tags STRUCT<topic:ARRAY<STRING>,type:STRING,difficulty:STRING>"""
BLOCK = "type STRING, text STRING, table_body STRING, code_body STRING, img_path STRING, page_idx INT, bbox ARRAY<DOUBLE>"


def with_source(df: DataFrame) -> DataFrame:
    """subject, stage, level, source and file_stem from the path of each row's file."""
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, PATH, i)
    return df.select("*", *(part(i).alias(n) for i, n in enumerate(("subject", "stage", "level", "source"), 1)), F.regexp_extract(path, r"([^/]+?)(?:\.(?:clean|tagged))?\.jsonl\z", 1).alias("file_stem"))


def read_entries(spark: SparkSession, path: str, schema: str = ENTRY) -> DataFrame:
    """Entries of JSON-lines files; rows that can't be read keep their text in _corrupt_record."""
    df = spark.read.schema(schema + ", _corrupt_record STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").json(path)
    return with_source(df)


def refuse_blank(entries: DataFrame) -> DataFrame:
    """Raises when a file with rows gives no readable one; else the readable rows."""
    files = entries.groupBy("source", "file_stem").agg(F.count_if(F.col("_corrupt_record").isNull() | F.col("qid").isNotNull()).alias("good"))
    bad = files.filter("good = 0").limit(1).collect()
    if bad:
        raise ValueError(f"no readable row in {bad[0]['source']}/{bad[0]['file_stem']}")
    return entries.filter("_corrupt_record is null").drop("_corrupt_record")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of *content_list.json files (one array each), in order: doc, i and the block's fields."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*content_list.json").option("recursiveFileLookup", "true").text(path)
    rows = files.select(F.regexp_extract("_metadata.file_name", r"^(.*?)_?content_list", 1).alias("doc"), F.from_json("value", f"array<struct<{BLOCK.replace(' STRING', ':STRING').replace(' INT', ':INT').replace(' ARRAY', ':ARRAY')}>>").alias("blocks"))
    return rows.select("doc", F.posexplode("blocks").alias("i", "b")).select("doc", "i", "b.*")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """subject, stage, level, source of every source folder below root; names that start with . or _ are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("p"))
    names = files.select(*(F.regexp_extract("p", PATH, i).alias(n) for i, n in enumerate(("subject", "stage", "level", "source"), 1))).filter("source <> ''")
    hidden = F.exists(F.array("subject", "stage", "level", "source"), lambda x: x.rlike(r"^[._]"))
    return names.filter(~hidden).distinct()


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Active knowledge points of a YAML file: id, name_en, keywords."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    points = [p for p in (yaml.safe_load(text) or {}).get("knowledge_points") or [] if (p.get("status") or "active") == "active"]
    return spark.createDataFrame([(str(p["id"]), p.get("name_en"), [str(k) for k in p.get("keywords") or []]) for p in points], "id string, name_en string, keywords array<string>")


def write_stage(df: DataFrame, path: str) -> None:
    """Replaces a stage's files of the sources that df has rows of; those of other sources stay. Refuses to replace something by nothing."""
    if df.isEmpty():
        raise ValueError(f"refusing to blank {path}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject", "stage", "level", "source").json(path)


def snapshot(df: DataFrame, path: str, tag: str) -> tuple[int, int]:
    """Writes a snapshot folder and gives its row count and content hash, verified by reading it again."""
    df.write.parquet(f"{path}/snapshot_id={tag}")
    state = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(F.to_json(F.struct("*")))), F.lit(0))).first())
    wrote = state(df)
    if wrote != state(df.sparkSession.read.parquet(f"{path}/snapshot_id={tag}")):
        raise OSError(f"snapshot {tag} differs from what was written")
    return wrote


def content_lists(files: DataFrame) -> DataFrame:
    """doc and path of the block file of each document: of several (path, one folder a document) the first by name whose name lacks _v2, else the first."""
    found = files.filter(F.col("path").rlike(r"content_list\.json\z|content_list_v2\.json\z"))
    name = F.substring_index("path", "/", -1)
    rank = F.struct(name.contains("_v2").cast("int").alias("v2"), "path")
    return found.withColumn("doc", F.element_at(F.split("path", "/"), -2)).groupBy("doc").agg(F.min(rank).alias("r")).select("doc", F.col("r.path").alias("path"))


def layout_version(layouts: DataFrame) -> DataFrame:
    """doc and the version of the extractor that its layout file (doc, value: JSON) names, null if it names none."""
    return layouts.select("doc", F.get_json_object("value", "$._version_name").alias("version"))


def raw_files(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """name, size_mb and pages of the PDF files of a listing (path, length); pages (name, pages) come from whoever can count them."""
    name = F.substring_index("path", "/", -1)
    out = files.filter(F.lower("path").endswith(".pdf")).select(name.alias("name"), F.round(F.col("length") / 1e6, 1).alias("size_mb"))
    return out.join(pages, "name", "left") if pages is not None else out.withColumn("pages", F.lit(None).cast("int"))


def to_extract(raw: DataFrame, extracted: DataFrame, force: bool = False, batch: int = 10) -> DataFrame:
    """name and batch of the raw files (name) whose stem no extraction (stem) has; all of them if forced."""
    stem = F.regexp_replace("name", r"\.[^.]+\z", "")
    todo = raw.select("name", stem.alias("stem")).distinct()
    todo = todo if force else todo.join(extracted.select("stem").distinct(), "stem", "left_anti")
    batches = todo.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / batch)).alias("batches"))  # one row
    return todo.crossJoin(F.broadcast(batches)).select("name", (F.pmod(F.xxhash64("stem"), F.lit(1 << 31)) % F.col("batches")).alias("batch"))


def mock_extract(names: DataFrame) -> DataFrame:
    """Blocks (doc, i and BLOCK's fields) that stand for an extraction of each file: two questions, the same at every run."""
    doc = F.regexp_replace("name", r"\.[^.]+\z", "")
    texts = F.array(F.concat(F.lit("1. Question one of "), doc), F.lit("(a) first part"), F.lit("(b) second part"), F.concat(F.lit("2. Question two of "), doc))
    none = F.lit(None).cast("string")
    return names.select(doc.alias("doc"), F.posexplode(texts).alias("i", "text")).select("doc", "i", F.lit("text").alias("type"), "text", none.alias("table_body"), none.alias("code_body"), none.alias("img_path"), F.lit(0).alias("page_idx"), F.lit(None).cast("array<double>").alias("bbox"))


def settings(text: str | None, argument: str | None = None, environment: dict | None = None) -> dict:
    """The settings of a YAML text ({} if it can't be read), with content_root from an argument, else the environment, else the text."""
    import yaml

    try:
        got = yaml.safe_load(text or "") or {}
    except yaml.YAMLError:
        got = {}
    got = got if isinstance(got, dict) else {}
    root = argument or (environment or {}).get("CONTENT_ROOT") or got.get("content_root")
    return {**got, **({"content_root": root} if root else {})}


def folders(root: str, subject: str, stage: str, level: str, source: str) -> dict[str, str]:
    """The folders of a source by what they hold."""
    base = "/".join([root.rstrip("/"), subject, stage, level, source])
    return {name: f"{base}/{name}" for name in ("original", "raw", "extracted", "interim")} | {"source": base, "stage": "/".join([root.rstrip("/"), subject, stage])}


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """Appends rows of a report (report, segment, answers, clean or tag) to its table, one folder a kind."""
    df.select(F.lit(kind).alias("kind"), "*").write.mode("append").partitionBy("kind").json(path)


def sources_of(entries: DataFrame, subject: str, stage: str) -> DataFrame:
    """Rows of all sources of a subject and stage: a filter on partition columns, which is what a union over them comes to."""
    return entries.filter((F.col("subject") == subject) & (F.col("stage") == stage))
