"""Outlines, manifests, reference tables and page order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import manifest, outline, reftables
from corpusloom.queries.base import Registry, table
from corpusloom.sources import pages, registry

R = Registry()

# An outline for each region: its nations, their market segments, their customers; every second page has an entry.
_OUTLINE = """WITH raw AS (
  SELECT r_name AS source, 1 AS level, n_name AS title, n_nationkey AS a, '' AS b, 0 AS c FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT r_name, 2, c_mktsegment, n_nationkey, c_mktsegment, 0 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
  UNION ALL SELECT r_name, 3, CASE WHEN c_acctbal < 0 THEN 'Table of Contents' ELSE c_name END, n_nationkey, c_mktsegment, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
o AS (SELECT source, level, title, row_number() OVER (PARTITION BY source ORDER BY a, b, c, level) AS ord FROM raw),
t AS (SELECT *, 2 * ord AS page, row_number() OVER (PARTITION BY source ORDER BY ord) AS n FROM o WHERE lower(title) <> 'table of contents'),
j AS (SELECT i.source, i.n, i.level, i.page, j.n AS jn, j.title AS jt, j.level AS jl FROM t i JOIN t j ON j.source = i.source AND j.n <= i.n AND j.level <= i.level
      QUALIFY row_number() OVER (PARTITION BY i.source, i.n, j.level ORDER BY j.n DESC) = 1),
k AS (SELECT *, max(jn) OVER (PARTITION BY source, n ORDER BY jl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower FROM j),
p AS (SELECT source, n, level, page, string_agg(jt, ' › ' ORDER BY jl) AS path FROM k WHERE jn > coalesce(lower, 0) GROUP BY ALL)
"""


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("source"), "n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    title = F.when(F.col("c_acctbal") < 0, "Table of Contents").otherwise(F.col("c_name"))
    one = n.select("source", F.lit(1).alias("level"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c"))
    two = c.select("source", F.lit(2).alias("level"), F.col("c_mktsegment").alias("title"), F.col("n_nationkey").alias("a"), F.col("c_mktsegment").alias("b"), F.lit(0).cast("long").alias("c")).distinct()
    three = c.select("source", F.lit(3).alias("level"), title.alias("title"), F.col("n_nationkey").alias("a"), F.col("c_mktsegment").alias("b"), F.col("c_custkey").alias("c"))
    rows = one.unionByName(two).unionByName(three)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy("a", "b", "c", "level"))).withColumn("page", 2 * F.col("ord")).select("source", "ord", "level", "title", "page")


@R.add(_OUTLINE + "SELECT source, n, level, page, path FROM p")
def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.section_paths(_outline(spark, sf_dir)).select("source", "n", "level", "page", "path")


@R.add(
    _OUTLINE
    + """, g AS (SELECT source, unnest(range(1, max(2 * ord) + 2)) AS page FROM o GROUP BY source)
SELECT g.source, g.page, p.path AS section FROM g ASOF LEFT JOIN p ON p.source = g.source AND p.page <= g.page"""
)
def page_section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outline(spark, sf_dir)
    every = o.groupBy("source").agg(F.max("page").alias("m")).select("source", F.explode(F.sequence(F.lit(1), F.col("m") + 1)).alias("page"))
    return outline.attach_sections(every, outline.section_paths(o)).select("source", "page", "section")


_SECTIONS = """WITH s AS (SELECT r_name || ' › ' || n_name || ' Model › ' || c_mktsegment || ' Detailed Design' AS section FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Fast ' || n_name || ' Model' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000),
c AS (SELECT regexp_extract(trim(x), '^(.*?)\\s+(?:Detailed Design|Model)$', 1) AS name, count(*) AS n FROM (SELECT unnest(string_split(section, '›')) AS x FROM s) GROUP BY 1 HAVING length(name) > 2 AND length(name) < 40),
f AS (SELECT name, n FROM c WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM c d WHERE d.n >= 5 AND d.name <> c.name AND contains(' ' || c.name || ' ', ' ' || d.name || ' ')))
""".replace("\\\\", "\\")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat("r_name", F.lit(" › "), "n_name", F.lit(" Model › "), "c_mktsegment", F.lit(" Detailed Design"))
    return c.select(path.alias("section")).unionByName(c.where("c_acctbal > 5000").select(F.concat(F.lit("Fast "), "n_name", F.lit(" Model")).alias("section")))


@R.add(_SECTIONS + "SELECT name, n FROM c")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_counts(_sections(spark, sf_dir))


@R.add(_SECTIONS + "SELECT name, n FROM f")
def manifest_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.fold_names(manifest.manifest_counts(_sections(spark, sf_dir)))


@R.add(_SECTIONS + "SELECT name, n FROM f ORDER BY n DESC, length(name), name LIMIT 60")
def component_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.component_manifest(_sections(spark, sf_dir))


# Reference-table cells for each nation: an appliance of three sizes with disks, one of them a storage tier that no size names, and one of a single size.
_CELLS = [
    (1, "N  Edge Appliances CPU", "Value"), (2, "X Small", "2"), (3, "Large", "8"), (4, "Extra_Small", "1"), (5, "note", "n/a"),
    (6, "N  Edge RAM", "Value"), (7, "Large", "32"), (8, "Extra_Small", "4"), (9, "N Edge Disk", "Value"), (10, "Large Default", "200"), (11, "Huge", "900"),
    (12, "N Manager", "Value"), (13, "CPU", "4"), (14, "Memory", "16.5"), (15, "Colour", "7"), (16, "CPU", "6"), (17, "Size List", "Value"), (18, "Disk", "914"),
]
_PARSED = (
    "(VALUES ('A', 'Edge', 'X Small', 'cpu', '2', 2), ('A', 'Edge', 'Large', 'cpu', '8', 3), ('A', 'Edge', 'Extra Small', 'cpu', '1', 4), ('A', 'Edge', 'Large', 'ram', '32', 7), "
    "('A', 'Edge', 'Extra Small', 'ram', '4', 8), ('A', 'Edge', 'Large', 'disk', '200', 10), ('B', 'Manager', '', 'cpu', '6', 13), ('B', 'Manager', '', 'ram', '16.5', 14), "
    "('B', 'Manager', '', 'disk', '914', 18)) t(mode, a, size, metric, value, first_ord)"
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame(_CELLS, "ord int, b string, c string")
    return table(spark, sf_dir, "nation").crossJoin(F.broadcast(c)).select(F.col("n_name").alias("source"), "ord", F.regexp_replace("b", "^N ", F.concat("n_name", F.lit(" "))).alias("b"), "c")


@R.add(f"SELECT n_name AS source, mode, n_name || ' ' || a AS appl, size, metric, value, first_ord FROM nation, {_PARSED}")
def ref_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reftables.parse_tables(_cells(spark, sf_dir))


@R.add(
    """SELECT n_name AS source, 1 AS page_num, n_name || ' Manager' AS appl, n_name || ' Manager appliance resource requirements: 6 vCPU, 16.5 GB RAM, 914 GB storage.' AS text FROM nation
UNION ALL SELECT n_name, 2, n_name || ' Edge', n_name || ' Edge appliance deployment sizes and per-size resource requirements (from the VCF Planning & Preparation Workbook): Extra Small (1 vCPU, 4 GB RAM); Large (8 vCPU, 32 GB RAM, 200 GB storage); X Small (2 vCPU). The smallest available '
|| n_name || ' Edge size is Extra Small.' FROM nation"""
)
def sizing_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reftables.sizing_sentences(reftables.parse_tables(_cells(spark, sf_dir)))


_TEMPLATES = [
    ("guide-{slug}", "https://docs.example.com/pdf/guide-{slug}.pdf", "https://docs.example.com/guide/{slug}.html", "Guide", "9.1", "pdf"),
    ("book-{version}-sizing", "https://docs.example.com/assets/book-{version}.xlsx", "https://docs.example.com/book/{slug}.html", "Book", "9.1", "xlsx"),
]


@R.add(
    "SELECT * FROM (VALUES ('guide-9-1', 'https://docs.example.com/pdf/guide-9-1.pdf', 'https://docs.example.com/guide/9-1.html', 'Guide', '9.1', 'pdf'), "
    "('book-9.1-sizing', 'https://docs.example.com/assets/book-9.1.xlsx', 'https://docs.example.com/book/9-1.html', 'Book', '9.1', 'xlsx')) t(name, url, web_url, product, version, kind)"
)
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.source_registry(spark.createDataFrame(_TEMPLATES, "name string, url string, web_url string, product string, version string, kind string"))


_MESSY = r"'  ' || replace(text, ' ', E' \t ') || E'\n\n\n\nend '"
_CLEANED = r"regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')".format(_MESSY)


def _messy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with messy white space; Spanish ones are blank."""
    messy = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \t ")), F.lit("\n\n\n\nend "))
    text = F.when(F.col("lang") == "es", " \n\t ").otherwise(messy)
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.col("doc_id").cast("int").alias("page_num"), text.alias("text"), F.col("lang").alias("section"), F.lit(False).alias("atomic"))


@R.add(f"SELECT source, doc_id AS ord, {_CLEANED} AS text FROM documents WHERE lang <> 'es'")
def pages_clean_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.clean_pages(_messy_pages(spark, sf_dir)).select("source", "ord", "text")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order line's supplier: its parts as rows; those of few parts are too small to keep."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("source"), F.col("s_suppkey").alias("ord"), "s_name", "s_acctbal")
    row = F.concat(F.lit("| "), "s_name", F.lit("<br>row |  "), F.floor("s_acctbal").cast("string"), F.lit(" |"))
    md = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("| Supplier |  Balance |\n|---|---|\n"), row, F.lit("\n"), row)).otherwise(row)
    return s.select("source", "ord", F.col("ord").cast("int").alias("page_num"), md.alias("markdown"), F.when(F.col("s_acctbal") > 5000, "Rich").alias("section"))


_TABLES = r"""SELECT 'src' || s_nationkey AS source, s_suppkey AS ord, CASE WHEN s_acctbal > 5000 THEN 'Table — Rich' ELSE 'Table' END || E'\n| Supplier | Balance |\n' || r || E'\n' || r AS text
FROM (SELECT *, '| ' || s_name || ' row | ' || CAST(floor(s_acctbal) AS BIGINT) || ' |' AS r FROM supplier) WHERE s_acctbal > 0 AND length('| Supplier | Balance |') + 2 + 2 * length(r) >= 60"""


@R.add(_TABLES)
def atomic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.table_pages(_tables(spark, sf_dir)).select("source", "ord", "text")


@R.add(
    f"""WITH p AS (SELECT source, doc_id AS ord, {_CLEANED} AS text, false AS atomic FROM documents WHERE lang <> 'es'), t AS ({_TABLES}), m AS (SELECT source, max(ord) AS last FROM p GROUP BY source)
SELECT source, ord, text, atomic FROM p UNION ALL SELECT t.source, t.ord + coalesce(last, 0) + 1, t.text, true FROM t LEFT JOIN m USING (source)"""
)
def pages_union_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pages_then_tables(pages.clean_pages(_messy_pages(spark, sf_dir)), pages.table_pages(_tables(spark, sf_dir))).select("source", "ord", "text", "atomic")
