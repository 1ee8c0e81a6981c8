"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bottomk, decontaminate, filter_audit, language, lexical, mixing, pitman_yor, quality, quotes, simhash, suffixes, toxicity
from .shared import Scratch, crc_mod, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, Scratch(spark, "mixing")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations have no quotes: every fourth message is given one of the message two turns before it, its first line, so that the
    query links, branches and orders something; all other texts are as they are."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    line = F.concat(F.lit("> "), F.element_at(F.split("text", "\n"), 1), F.lit("\n\n"))
    quoted = c.groupBy("conv_id", (F.col("turn") + 2).alias("turn")).agg(F.min(line).alias("quote")).filter("turn % 4 = 3")
    planted = c.join(quoted, ["conv_id", "turn"], "left").withColumn("text", F.concat(F.coalesce("quote", F.lit("")), "text")).drop("quote")
    return quotes.link_conversations(planted, Scratch(spark, "quotes"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf_dir, "documents"), Scratch(spark, "suffixes"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs, crc_mod(F.col("doc_id"), 4) != 2)
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held(4, 2), "lang_pred", F.col("lang_score").alias("score"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score(docs, crc_mod(F.col("doc_id"), 7) == 2, Scratch(spark, "pitman-yor"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), allowed=crc_mod(F.col("doc_id"), 4) != 2)
    score = F.col("toxicity").alias("score")
    return toxicity.score(docs, model).select("doc_id", held(4, 2), score, (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, Scratch(spark, "ann"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), allowed=crc_mod(F.col("doc_id"), 5) != 0, metadata=["n_chars"])
    score = F.col("quality_score").alias("score")
    return quality.score(docs, model, metadata=["n_chars"]).select("doc_id", held(5, 0), score, (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "filter-audit")).drop("filter")


def op12_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.compare_neighbours(table(spark, sf_dir, "documents"), Scratch(spark, "bottomk"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "lexical"))


def held(mod: int, rest: int):
    return F.coalesce(crc_mod(F.col("doc_id"), mod) == rest, F.lit(False)).alias("held_out")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
  FROM by_source),
filled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (
           SELECT f.level FROM filled f WHERE f.level * f.weight <= f.cap ORDER BY f.cap / f.weight, f.source NULLS LAST LIMIT 1)), cap) AS target
  FROM filled),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM targets),
keys AS (
  SELECT source, k, sum(size) AS words,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS under
  FROM sized GROUP BY source, k),
edges AS (
  SELECT p.source, max(k.k) AS k FROM passes p JOIN keys k ON p.source IS NOT DISTINCT FROM k.source
  WHERE k.under <= p.target - p.passes * p.source_size GROUP BY p.source),
told AS (
  SELECT *, row_number() OVER (PARTITION BY source, k) AS nth, count(*) OVER (PARTITION BY source, k) AS n FROM sized)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.passes + CASE WHEN d.k < e.k OR (d.k = e.k AND
         (k.words = 0 OR d.nth <= floor((p.target - p.passes * p.source_size - k.under) / (k.words / d.n) + 0.5))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM told d JOIN passes p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN edges e ON e.source IS NOT DISTINCT FROM d.source
LEFT JOIN keys k ON k.source IS NOT DISTINCT FROM e.source AND k.k = e.k
"""

OP11_SQL = r"""
WITH told AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM told),
marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM words d LEFT JOIN marks m ON m.doc_id = d.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l),
firsts AS (
  SELECT f.*, o.filter_order, coalesce(list_min([strpos(o.filter_order, x) FOR x IN string_split(f.fails, '') IF x <> '']), 6) AS fst
  FROM flags f, orders o),
steps AS (
  SELECT part, filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS filter,
         count(*) FILTER (fst > step) AS kept, count(*) FILTER (fst = step) AS removed,
         count(*) FILTER (fst < step AND contains(fails, substr(filter_order, step::INT, 1))) AS redundant,
         count(*) FILTER (fails = substr(filter_order, step::INT, 1)) AS unique_fails,
         count(*) FILTER (fst = step AND good = 1) AS good_lost, count(*) FILTER (fst = step AND toxic = 1) AS toxic_lost
  FROM firsts, range(1, 6) r(step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM steps
"""

OP12_SQL = r"""
WITH told AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
ordered AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id NULLS LAST), first_value(text) OVER (ORDER BY doc_id NULLS LAST)) AS after FROM told),
texts AS (
  SELECT *, substr(text, 1, n - n // 4) || substr(after, 1, n // 4) AS edited FROM ordered),
split AS (
  SELECT doc_id, which, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w
  FROM texts, LATERAL (SELECT unnest(['own', 'edited', 'after']) AS which, unnest([text, edited, after]) AS body)),
shingles AS (
  SELECT doc_id, which, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM split),
hashes AS (SELECT DISTINCT doc_id, which, ('0x' || substr(md5(s), 1, 15))::BIGINT AS h FROM shingles),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, which ORDER BY h) AS nth FROM hashes),
low AS (SELECT doc_id, which, list(h ORDER BY h) AS hs FROM ranked WHERE nth <= 128 GROUP BY doc_id, which),
three AS (
  SELECT t.*, coalesce(o.hs, []) AS a, coalesce(e.hs, []) AS b, coalesce(x.hs, []) AS c
  FROM texts t LEFT JOIN low o ON o.doc_id = t.doc_id AND o.which = 'own' LEFT JOIN low e ON e.doc_id = t.doc_id AND e.which = 'edited'
  LEFT JOIN low x ON x.doc_id = t.doc_id AND x.which = 'after'),
unions AS (
  SELECT *, list_sort(list_distinct(list_concat(a, b)))[1:128] AS ab, list_sort(list_distinct(list_concat(a, c)))[1:128] AS ac FROM three),
near AS (
  SELECT *, CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(a, b), ab))::DOUBLE / len(ab) END AS near_edited,
         CASE WHEN len(ac) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(a, c), ac))::DOUBLE / len(ac) END AS near_next,
         CASE WHEN len(a) < 128 THEN len(a)::DOUBLE ELSE 127 * 1152921504606846976.0::DOUBLE / (a[128]::DOUBLE + 1) END AS n_shingles,
         CASE WHEN len(c) < 128 THEN len(c)::DOUBLE ELSE 127 * 1152921504606846976.0::DOUBLE / (c[128]::DOUBLE + 1) END AS n_after
  FROM unions)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string([printf('%015x', h) FOR h IN a], '') AS fingerprint, array_to_string([printf('%015x', h) FOR h IN b], '') AS edited_fingerprint,
       near_edited, near_next,
       CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, near_next * (n_shingles + n_after) / ((1 + near_next) * n_shingles)) END AS contained_next, n_shingles
FROM near
"""

OP13_SQL = r"""
WITH told AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(w) AS n, w FROM told WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
held AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM sizes) GROUP BY ALL),
weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM held, totals GROUP BY t, docs),
asked AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN held USING (t), totals GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and "_" in k and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op11_filter_audit": OP11_SQL, "op12_bottomk": OP12_SQL, "op13_lexical": OP13_SQL}
