"""The answer's side over ``documents``, ``conversations`` and ``labels``, and sizing over ``part`` and ``supplier``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.operators import answers as ops
from corpusloom.operators import sizing
from corpusloom.queries.base import Registry, table

R = Registry()

# Fixed registry of three sources for the hits.
_SOURCES = [("src1", "https://x.example/1.pdf", "https://x.example/1", "pdf"), ("src2", "https://x.example/2.xlsx", "https://x.example/2", "xlsx"), ("src3", "https://x.example/3.pdf", "https://x.example/3", "pdf")]
_SOURCES_SQL = "(VALUES " + ", ".join(str(s) for s in _SOURCES) + ") r(name, url, web_url, kind)"
_HITS = "SELECT doc_id, source, doc_id AS page_start, CASE WHEN lang = 'en' THEN doc_id ELSE doc_id + 2 END AS page_end, CASE WHEN lang <> 'fr' THEN lang END AS section, text, n_chars FROM documents"
_TAG = "'[' || source || ' p.' || CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE page_start || '-' || page_end END || ']'"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("lang") == "en", F.col("doc_id")).otherwise(F.col("doc_id") + 2)
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").alias("page_start"), end.alias("page_end"), F.when(F.col("lang") != "fr", F.col("lang")).alias("section"), "text", "n_chars")


@R.add(f"SELECT doc_id, {_TAG} AS tag, CASE WHEN page_start = page_end THEN 'p.' || page_start ELSE 'p.' || page_start || '–' || page_end END AS label FROM ({_HITS})")
def cite_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("doc_id", fx.cite_tag(F.col("source"), F.col("page_start"), F.col("page_end")).alias("tag"), fx.page_label(F.col("page_start"), F.col("page_end")).alias("label"))


@R.add(f"SELECT doc_id, source, CASE WHEN kind = 'xlsx' THEN url WHEN url IS NOT NULL THEN url || '#page=' || page_start END AS pdf_url, web_url FROM ({_HITS}) LEFT JOIN {_SOURCES_SQL} ON name = source")
def hits_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame(_SOURCES, "name string, url string, web_url string, kind string")
    return ops.enrich_hits(_hits(spark, sf_dir), sources).select("doc_id", "source", "pdf_url", "web_url")


@R.add(
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM ({_HITS}) QUALIFY rank <= 6)
SELECT source, string_agg({_TAG} || CASE WHEN section IS NOT NULL THEN '  (' || section || ')' ELSE '' END || E'\\n' || text, E'\\n\\n---\\n\\n' ORDER BY rank) AS context FROM h GROUP BY source"""
)
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of a source's six longest documents: top-k is the feature."""
    top = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return ops.context_blocks(_hits(spark, sf_dir).withColumn("rank", top).where("rank <= 6"), ["source"])


@R.add("SELECT conv_id, count(*) AS n_messages, string_agg(role || ': ' || text, E'\\n' ORDER BY turn) AS messages FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> '' GROUP BY conv_id")
def history_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.history(table(spark, sf_dir, "conversations"))


_SAID = "CASE WHEN role = 'system' THEN '/nothink ' || text ELSE text END"


@R.add(
    rf"""SELECT conv_id, count(*) FILTER (role <> 'system') AS n_turns,
regexp_replace(regexp_replace(coalesce(string_agg({_SAID}, E'\n\n' ORDER BY turn) FILTER (role = 'system'), ''), '^\s+|\s+$', '', 'g'), '^/nothink\s*', '') AS system FROM conversations GROUP BY conv_id"""
)
def split_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") == "system", F.concat(F.lit("/nothink "), "text")).otherwise(F.col("text")))
    return ops.split_system(c)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: cited, except the German ones, which name their source under an optional heading; Spanish ones end in a hedge."""
    n = F.col("doc_id").cast("string")
    cites = F.concat(F.lit(" ["), "source", F.lit(" p."), n, F.lit("] and ["), "source", F.lit(" p."), n, F.lit("–"), (F.col("doc_id") + 2).cast("string"), F.lit("]"))
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("\n## Optional parts\n- "), "source")).when(F.col("lang") == "es", F.concat("text", cites, F.lit(" This is not specified in the pages."))).otherwise(F.concat("text", cites))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text.alias("answer"))


_ANSWERS = """SELECT doc_id, source, lang, CASE WHEN lang = 'de' THEN text || E'\n## Optional parts\n- ' || source WHEN lang = 'es' THEN text || c || ' This is not specified in the pages.' ELSE text || c END AS answer
FROM (SELECT *, ' [' || source || ' p.' || doc_id || '] and [' || source || ' p.' || doc_id || '–' || (doc_id + 2) || ']' AS c FROM documents)"""


@R.add("SELECT doc_id, i AS idx, source, doc_id AS page_start, doc_id + 2 * i AS page_end FROM documents, (VALUES (0), (1)) t(i) WHERE lang <> 'de'")
def extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extract_citations(_answers(spark, sf_dir), "doc_id", "answer")


@R.add(
    "SELECT doc_id, i AS idx, doc_id AS page_start, doc_id + 2 * i AS page_end, CASE WHEN lang = 'fr' THEN NULL WHEN i = 0 THEN 2 ELSE 1 END AS pos FROM documents, (VALUES (0), (1)) t(i) WHERE lang <> 'de'"
)
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of each document: one of three pages from its own on, two of its own page, one elsewhere; French ones have none that fits."""
    d = table(spark, sf_dir, "documents")
    card = lambda pos, a, b: F.struct(F.lit(pos).alias("pos"), a.cast("int").alias("page_start"), b.cast("int").alias("page_end"))
    p = F.when(F.col("lang") == "fr", -F.col("doc_id") - 10).otherwise(F.col("doc_id"))
    cards = d.select("doc_id", F.explode(F.array(card(1, p, p + 2), card(2, p, p), card(3, p, p), card(4, p + 5, p + 5))).alias("c")).select("doc_id", "c.*")
    return ops.resolve_citations(ops.extract_citations(_answers(spark, sf_dir), "doc_id", "answer").drop("source"), cards, "doc_id")


# The wording, stated here anew so that the SQL doesn't follow the module's.
_IDK = "context (provided )?does not|does not (contain|specify|provide|include|mention|detail)|not (specified|provided|mentioned|detailed|present|available) in|cannot find|no information (on|about|in|is)|don''t have (enough|that|the)"
_CITED = r"\[[^\]]*p\.[0-9]+[^\]]*\]"
_FAILS = f"""SELECT doc_id, lang, answer, list_concat(list_concat(list_concat(
  CASE WHEN quality = 1 AND NOT regexp_matches(answer, '{_CITED}') THEN ['no inline citation'] ELSE [] END,
  CASE WHEN regexp_matches(lower(answer), '{_IDK}') THEN ['said IDK on an answerable question'] ELSE [] END),
  list_transform(list_filter(['the', 'zq'], lambda t: NOT contains(lower(answer), t)), lambda t: 'missing expected term: ''' || t || '''')),
  list_concat(CASE WHEN lang = 'de' THEN ['REGRESSION: ''' || source || ''' classified under an Optional heading'] ELSE [] END,
  CASE WHEN regexp_replace(answer, '^\\s+|\\s+$', '', 'g') = '' THEN ['empty answer'] ELSE [] END)) AS fails FROM ({_ANSWERS}) JOIN labels USING (doc_id)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return a.withColumn("fails", ops.check_answer(F.col("answer"), F.col("quality") == 1, F.lit(True), F.array(F.lit("the"), F.lit("ZQ")), F.when(F.col("lang") == "de", F.col("source")))).withColumn(
        "fails", F.transform("fails", lambda x: F.replace(x, F.lit("'ZQ'"), F.lit("'zq'")))
    )


@R.add(f"SELECT doc_id, array_to_string(fails, '; ') AS fails, len(fails) = 0 AS ok FROM ({_FAILS})")
def eval_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("doc_id", F.array_join("fails", "; ").alias("fails"), (F.size("fails") == 0).alias("ok"))


@R.add(
    f"""SELECT lang AS cat, count(*) AS cases, count(*) FILTER (len(fails) = 0) AS passed, CAST(sum(len(list_distinct(regexp_extract_all(answer, '{_CITED}')))) AS BIGINT) AS citations FROM ({_FAILS}) GROUP BY lang"""
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.size(F.array_distinct(F.regexp_extract_all("answer", F.lit(fx.ANY_CITATION), F.lit(0))))
    return _checked(spark, sf_dir).groupBy(F.col("lang").alias("cat")).agg(F.count("*").alias("cases"), F.count(F.when(F.size("fails") == 0, 1)).alias("passed"), F.sum(cited).alias("citations"))


@R.add("SELECT doc_id, lang IN ('fr', 'es') AS optional FROM documents")
def under_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers in which the source is mentioned below a required heading, an optional one, in the heading itself, or not at all."""
    s = F.col("source")
    text = (
        F.when(F.col("lang") == "en", F.concat(F.lit("# Optional parts\n- other\n**Needed**\n- "), F.upper(s), F.lit("\n## Optional\n- "), s))
        .when(F.col("lang") == "fr", F.concat(F.lit("# Needed\n- other\n## OPTIONAL add-ons\nplain **x** line\n- "), s))
        .when(F.col("lang") == "es", F.concat(F.lit("intro\n  ** "), s, F.lit(" (optional)**\n# Needed\n"), s))
        .otherwise(F.lit("# Optional\nnothing"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", ops.under_optional(text, s).alias("optional"))


@R.add(
    rf"""SELECT doc_id, doc_id || '. **' || source || ' p.' || CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE page_start || '–' || page_end END || E'** — d=0.250\n   > ' ||
left(array_to_string(list_filter(string_split(text, E'\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')[1:6], ' '), 480) || '…' AS entry FROM ({_HITS})"""
)
def export_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir).withColumn("pos", F.col("doc_id")).withColumn("distance", F.lit(0.25))
    return h.select("doc_id", ops.export_entry().alias("entry"))


# The inputs, stated here anew so that the SQL doesn't follow the module's.
_OPTIONS_SQL = """(VALUES ('host_ops_reserve_pct', 'E8', '30', false), ('storage_growth_pct', 'E9', '10', false), ('host_cpu_cores', 'E13', '64', false), ('host_ram_gb', 'E14', '512', false),
('cpu_oversubscription', 'E15', '1', false), ('memory_oversubscription', 'E16', '1', false), ('instance_model', 'E20', 'First Instance', false), ('availability_model', 'E21', 'Simple', false),
('size', 'E22', 'Small', false), ('log_management', 'E25', NULL, false), ('log_management_replicas', 'E26', NULL, false), ('vcf_operations_for_networks', 'E27', NULL, false),
('realtime_metrics', 'E28', NULL, false), ('software_depot', 'E29', NULL, false), ('identity_broker', 'E30', NULL, false), ('vcf_operations', 'E32', 'Include', true),
('vcf_automation', 'E33', NULL, false), ('cloud_proxy', 'E34', NULL, false)) o(name, cell, default_value, required)"""


@R.add(f"SELECT * FROM {_OPTIONS_SQL}")
def plan_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.plan_options(spark)


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each supplier: its host size, a toggle, and a name that no cell has."""
    kv = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    s = table(spark, sf_dir, "supplier")
    pairs = F.array(kv("host_ram_gb", F.col("s_nationkey").cast("string")), kv("cloud_proxy", F.when(F.col("s_acctbal") > 0, "Include").otherwise("Exclude")), kv("unknown", F.lit("1")))
    return s.select(F.col("s_suppkey").alias("plan"), F.explode(pairs).alias("p")).select("plan", "p.name", "p.value")


@R.add(
    f"""SELECT s_suppkey AS plan, cell, CASE name WHEN 'host_ram_gb' THEN CAST(s_nationkey AS VARCHAR) WHEN 'cloud_proxy' THEN CASE WHEN s_acctbal > 0 THEN 'Include' ELSE 'Exclude' END ELSE default_value END AS value
FROM supplier, {_OPTIONS_SQL} WHERE default_value IS NOT NULL OR name = 'cloud_proxy'"""
)
def plan_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.plan_overrides(_inputs(spark, sf_dir), "plan")


@R.add(
    """WITH d AS (SELECT o_custkey AS plan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority AS vcenter_size, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus ELSE '' END AS nsx_model FROM orders)
SELECT plan, 'C' || (42 + i) AS cell, 'Included' AS value FROM d WHERE i <= 35 UNION ALL SELECT plan, 'D' || (42 + i), vcenter_size FROM d WHERE i <= 35 UNION ALL SELECT plan, 'H' || (42 + i), nsx_model FROM d WHERE i <= 35 AND nsx_model <> ''"""
)
def wld_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders stand for its domains; at most 35 fit on the sheet, which is the feature."""
    o = table(spark, sf_dir, "orders")
    i = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("i")
    model = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise("")
    d = o.select(F.col("o_custkey").alias("plan"), i, F.col("o_orderpriority").alias("vcenter_size"), model.alias("nsx_model"), F.lit(None).cast("string").alias("nsx_size"))
    return sizing.domain_overrides(d, "plan")


_PARTS = """SELECT name, CAST(nodes AS DOUBLE) AS nodes, CAST(vcpu AS DOUBLE) AS vcpu, CAST(ram_gb AS DOUBLE) AS ram_gb, CAST(disk_gb AS DOUBLE) AS disk_gb FROM (
SELECT p_brand AS name, count(*) AS nodes, sum(p_size) AS vcpu, 4 * sum(p_size) AS ram_gb, 64 * count(*) AS disk_gb FROM part GROUP BY p_brand)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cells: a component for each brand, with units in the text, then a blank label, and an excluded component."""
    p = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("name")).agg(F.count("*").alias("n"), F.sum("p_size").alias("s"))
    rows = p.select("name", F.col("n").cast("string").alias("nodes"), F.concat(F.col("s").cast("string"), F.lit(" vCPUs")).alias("vcpu"), (4 * F.col("s")).cast("string").alias("ram_gb"), F.concat((64 * F.col("n")).cast("string"), F.lit(" GB")).alias("disk_gb"))
    more = spark.createDataFrame([(" ", "1", "1", "1", "1"), ("Off", "3", "0", None, "n/a")], "name string, nodes string, vcpu string, ram_gb string, disk_gb string")
    return rows.unionByName(more)


@R.add(_PARTS)
def plan_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.components(_parts(spark, sf_dir))


@R.add(f"SELECT sum(nodes) AS nodes, sum(vcpu) AS vcpu, sum(ram_gb) AS ram_gb, sum(disk_gb) AS disk_gb FROM ({_PARTS})")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.totals(sizing.components(_parts(spark, sf_dir)))


@R.add(
    f"""SELECT format('{{:,}}', CAST(sum(vcpu) AS BIGINT)) AS vcpu, format('{{:,}}', CAST(sum(ram_gb) AS BIGINT)) || ' GB' AS ram,
CASE WHEN sum(disk_gb) >= 1024 THEN printf('%.1f', round(sum(disk_gb) / 1024, 1)) || ' TB' ELSE format('{{:,}}', CAST(sum(disk_gb) AS BIGINT)) || ' GB' END AS storage, format('{{:,}}', CAST(sum(nodes) AS BIGINT)) AS vms FROM ({_PARTS})"""
)
def plan_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.headline(sizing.components(_parts(spark, sf_dir)))


@R.add(
    """SELECT n_nationkey AS ord, n_name AS label, CASE n_regionkey WHEN 0 THEN CAST(n_nationkey AS VARCHAR) WHEN 1 THEN n_nationkey || ' CPUs' WHEN 2 THEN n_nationkey || '.5' ELSE 'vSAN' END AS value FROM nation WHERE n_regionkey <> 4"""
)
def host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    r = F.col("n_regionkey")
    value = F.when(r == 0, F.concat(k, F.lit(".0"))).when(r == 1, F.concat(F.lit(" "), k, F.lit(" CPUs"))).when(r == 2, F.concat(k, F.lit(".5"))).when(r == 3, "vSAN")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.col("n_name"), F.lit(" ")).alias("label"), value.alias("value"))
    more = spark.createDataFrame([(100, "Management Hosts", "x"), (101, " ", "1"), (102, "Blank", " ")], "ord int, label string, value string")
    return sizing.host_summary(rows.unionByName(more))
