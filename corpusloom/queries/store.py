"""Store maintenance over two versions of ``documents``.

Version 1 is the table. In version 2 the German pages are withdrawn, the English ones revised, and all page numbers have moved by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_id
from corpusloom.operators import store as ops
from corpusloom.queries.base import Registry, table
from corpusloom.sources.changelog import delta_label, parse_entries

R = Registry()

_ID = "source || '-' || left(sha1(source || '|' || text), 14)"
_V = f"""WITH v1 AS (SELECT {_ID} AS id, source, text, doc_id AS page_start, doc_id AS page_end, lang AS section FROM documents),
v2 AS (SELECT {_ID} AS id, source, text, doc_id + 1 AS page_start, doc_id + 2 AS page_end, CASE WHEN lang = 'fr' THEN '' ELSE lang END AS section
       FROM (SELECT source, doc_id, lang, CASE WHEN lang = 'en' THEN text || ' (revised)' ELSE text END AS text FROM documents WHERE lang <> 'de')),
"""


def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(content_id(F.col("source"), F.col("text")).alias("id"), "source", "text", F.col("doc_id").alias("page_start"), F.col("doc_id").alias("page_end"), F.col("lang").alias("section"))


def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang <> 'de'").withColumn("text", F.when(F.col("lang") == "en", F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text")))
    section = F.when(F.col("lang") == "fr", "").otherwise(F.col("lang"))
    return d.select(content_id(F.col("source"), F.col("text")).alias("id"), "source", "text", (F.col("doc_id") + 1).alias("page_start"), (F.col("doc_id") + 2).alias("page_end"), section.alias("section"))


@R.add("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents")
def content_sha_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@R.add(_V + "x AS (SELECT 1) SELECT id FROM v1 WHERE source = 'src1'")
def existing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.existing_ids(v1(spark, sf_dir), "src1")


@R.add("SELECT count(*) AS n FROM documents")
def collection_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))


@R.add(_V + "x AS (SELECT 1) SELECT id, page_start FROM v2 WHERE id NOT IN (SELECT id FROM v1)")
def diff_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.new_chunks(v2(spark, sf_dir), v1(spark, sf_dir)).select("id", "page_start")


@R.add(_V + "x AS (SELECT 1) SELECT id, page_start FROM v1 WHERE id NOT IN (SELECT id FROM v2)")
def diff_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.orphans(v2(spark, sf_dir), v1(spark, sf_dir)).select("id", "page_start")


@R.add(_V + "x AS (SELECT 1) SELECT id, page_start FROM v2 WHERE id IN (SELECT id FROM v1)")
def diff_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unchanged_chunks(v2(spark, sf_dir), v1(spark, sf_dir)).select("id", "page_start")


@R.add(
    _V
    + """x AS (SELECT 1) SELECT (SELECT count(*) FROM v2) AS total, (SELECT count(*) FROM v2 WHERE id NOT IN (SELECT id FROM v1)) AS added,
(SELECT count(DISTINCT id) FROM v1 WHERE id NOT IN (SELECT id FROM v2)) AS removed, (SELECT count(*) FROM v2 WHERE id IN (SELECT id FROM v1)) AS unchanged"""
)
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.diff_stats(v2(spark, sf_dir), v1(spark, sf_dir))


@R.add(
    _V
    + """u AS (SELECT section, page_start, page_end, 1 AS a FROM v2 WHERE id NOT IN (SELECT id FROM v1) UNION ALL SELECT section, page_start, page_end, 0 FROM v1 WHERE id NOT IN (SELECT id FROM v2))
SELECT CASE WHEN coalesce(section, '') = '' THEN '(unsectioned)' ELSE section END AS section, sum(a)::BIGINT AS added, sum(1 - a)::BIGINT AS removed, min(page_start) AS page_lo, max(page_end) AS page_hi FROM u GROUP BY 1"""
)
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = v2(spark, sf_dir), v1(spark, sf_dir)
    return ops.diff_summary(ops.new_chunks(a, b), ops.orphans(a, b))


_ONE = """o AS (SELECT * FROM v2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY source, text, page_start, page_end, section) = 1),
s AS (SELECT * FROM v1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY source, text, page_start, page_end, section) = 1)"""


@R.add(_V + _ONE + " SELECT id, page_start, page_end, section FROM s WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT id, page_start, page_end, section FROM o")
def upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.upsert(ops.one_per_id(v1(spark, sf_dir)), v2(spark, sf_dir)).select("id", "page_start", "page_end", "section")


@R.add(
    _V
    + _ONE
    + " SELECT s.id, CASE WHEN o.id IS NULL THEN s.page_start ELSE o.page_start END AS page_start, CASE WHEN o.id IS NULL THEN s.page_end ELSE o.page_end END AS page_end, CASE WHEN o.id IS NULL THEN s.section ELSE o.section END AS section "
    "FROM s LEFT JOIN (SELECT id, page_start, page_end, section FROM v2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY page_start, page_end, section) = 1) o ON o.id = s.id"
)
def metadata_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.refresh_metadata(ops.one_per_id(v1(spark, sf_dir)), v2(spark, sf_dir), ["page_start", "page_end", "section"]).select("id", "page_start", "page_end", "section")


@R.add(_V + "x AS (SELECT 1) SELECT id, page_start FROM v1 WHERE id IN (SELECT id FROM v2)")
def orphan_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = v2(spark, sf_dir), v1(spark, sf_dir)
    return ops.delete_ids(b, ops.orphans(a, b)).select("id", "page_start")


@R.add("SELECT 'd' || doc_id AS name, sha256(CASE WHEN lang = 'en' THEN text || ' (revised)' ELSE text END) AS sha256 FROM documents WHERE lang IN ('en', 'es')")
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known table lacks the Spanish files, so they count as changed; the revised English ones have another hash."""
    d = table(spark, sf_dir, "documents").withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    sha = lambda c: F.sha2(c.cast("binary"), 256).alias("sha256")
    known = d.where("lang <> 'es'").select("name", sha(F.col("text")))
    text = F.when(F.col("lang") == "en", F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    return ops.changed_sources(d.select("name", sha(text)), known)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of ``events``: views are blank lines, errors broken, clicks have a field too many, signups lack the later fields."""
    n = F.col("event_id").cast("string")
    base = F.concat(
        F.lit('{"ts":"'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit('","source":"u'), F.col("user_id").cast("string"), F.lit('","broadcom_last_modified":null,"sha256":"'), n, F.lit('","bytes":'), n,
        F.lit(',"chunks_before":100,"chunks_after":'), F.col("user_id").cast("string"), F.lit(',"duration_sec":1.5'),
    )
    full = F.concat(base, F.lit(',"chunks_added":'), n, F.lit(',"chunks_removed":0}'))
    kind = F.col("event_type")
    line = F.when(kind == "view", "  ").when(kind == "error", base).when(kind == "click", F.concat(base, F.lit(',"extra":1}'))).when(kind == "signup", F.concat(base, F.lit("}"))).otherwise(full)
    return table(spark, sf_dir, "events").select(line.alias("line"))


_LOG = "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, 'u' || user_id AS source, CAST(event_id AS VARCHAR) AS sha256, user_id AS chunks_after, CASE WHEN event_type = 'purchase' THEN event_id END AS chunks_added FROM events WHERE event_type IN ('purchase', 'signup')"


@R.add(_LOG)
def changelog_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_entries(_lines(spark, sf_dir)).select("ts", "source", "sha256", "chunks_after", "chunks_added")


@R.add(
    f"""SELECT sha256, CASE WHEN chunks_added IS NOT NULL THEN CASE WHEN chunks_added = 0 THEN 'no diff' ELSE '+' || format('{{:,}}', chunks_added) || ' new' END
ELSE CASE WHEN chunks_after = 100 THEN '±0' WHEN chunks_after > 100 THEN '+' || (chunks_after - 100) ELSE CAST(chunks_after - 100 AS VARCHAR) END END || ', 2s' AS delta FROM ({_LOG})"""
)
def changelog_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_entries(_lines(spark, sf_dir)).select("sha256", delta_label().alias("delta"))
