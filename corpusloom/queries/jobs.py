"""Whole jobs over the tables: updates by source, extraction by suffix, plans through an engine, messages, and a question from end to end."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import answers, sizing
from corpusloom.operators import retrieval as retrieval_ops
from corpusloom.operators.store import one_per_id
from corpusloom.plans.ask import AskSettings, Models, breadth, finish
from corpusloom.plans.maintenance import index_incremental
from corpusloom.queries.base import Registry, table
from corpusloom.queries.store import _V, v1, v2
from corpusloom.sources import pages

R = Registry()

_UPDATED = "('src1', 'src2')"
_ONE = f"""o AS (SELECT * FROM v2 WHERE source IN {_UPDATED} QUALIFY row_number() OVER (PARTITION BY id ORDER BY source, text, page_start, page_end, section) = 1),
s AS (SELECT * FROM v1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY source, text, page_start, page_end, section) = 1)"""


def _update(spark: SparkSession, sf_dir: str):
    chunks = v2(spark, sf_dir).where(f"source IN {_UPDATED}")
    return index_incremental(one_per_id(v1(spark, sf_dir)), chunks)


@R.add(_V + _ONE + f" SELECT id, source, page_start, page_end, section FROM s WHERE source NOT IN {_UPDATED} UNION ALL SELECT id, source, page_start, page_end, section FROM o")
def maintain_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after an update of two of its sources: all others stay as they were."""
    return _update(spark, sf_dir)[0].select("id", "source", "page_start", "page_end", "section")


@R.add(
    _V
    + f"""x AS (SELECT 1), n AS (SELECT source, count(*) AS total, count(*) FILTER (id NOT IN (SELECT id FROM v1)) AS added, count(*) FILTER (id IN (SELECT id FROM v1)) AS unchanged FROM v2 WHERE source IN {_UPDATED} GROUP BY source),
g AS (SELECT source, count(DISTINCT id) AS removed FROM v1 WHERE source IN {_UPDATED} AND id NOT IN (SELECT id FROM v2) GROUP BY source)
SELECT source, total, added, coalesce(removed, 0) AS removed, unchanged FROM n LEFT JOIN g USING (source)"""
)
def maintain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _update(spark, sf_dir)[1].select("source", "total", "added", "removed", "unchanged")


_SHEET = [("Edge CPU", "Value"), ("Small", "2"), ("Large", "8"), ("Edge RAM", "Value"), ("Large", "32"), ("Manager", "Value"), ("CPU", 4), (None, None), ("Memory", "16.5")]


def _read_sheet(content: bytes) -> dict:
    return {"Static Reference Tables": _SHEET, "Other": [("Lost CPU", "Value")]} if b"the" in content else {"Other": _SHEET}


def _parse_pages(content: bytes) -> list[tuple[int, str]]:
    text = content.decode()
    return [(1, text), (2, " \n "), (3, json.dumps(len(text)))]


def _find_tables(content: bytes):
    def failing():
        raise ValueError("a page that can't be read")

    row = f"| Characters | {len(content.decode())} |"
    return [(1, lambda: [f"| What | How many |\n|---|---|\n{row}\n{row}\n{row}"]), (2, failing)]


_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')"
_MANY = "Edge appliance deployment sizes and per-size resource requirements (from the VCF Planning & Preparation Workbook): Small (2 vCPU); Large (8 vCPU, 32 GB RAM). The smallest available Edge size is Small."


@R.add(
    rf"""WITH d AS (SELECT 'd' || doc_id AS source, text, lang FROM documents), r AS (SELECT *, '| Characters | ' || length(text) || ' |' AS r FROM d WHERE lang <> 'de')
SELECT source, 1 AS page_num, {_STRIPPED} AS text, false AS atomic FROM d WHERE lang <> 'de' AND {_STRIPPED} <> ''
UNION ALL SELECT source, 3, CAST(length(text) AS VARCHAR), false FROM d WHERE lang <> 'de'
UNION ALL SELECT source, 1, E'Table\n| What | How many |\n' || r || E'\n' || r || E'\n' || r, true FROM r
UNION ALL SELECT source, 1, 'Manager appliance resource requirements: 4 vCPU, 16.5 GB RAM.', true FROM d WHERE lang = 'de' AND contains(text, 'the')
UNION ALL SELECT source, 2, '{_MANY}', true FROM d WHERE lang = 'de' AND contains(text, 'the')"""
)
def extract_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: German ones are workbooks, the others prose of three pages with a table on the first and a failing second."""
    d = table(spark, sf_dir, "documents")
    end = F.when(F.col("lang") == "de", ".XLSX").otherwise(".pdf")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    files = d.select(name.alias("name"), F.concat(F.lit("/in/"), name, end).alias("path"), F.col("text").cast("binary").alias("content"))
    return pages.extract_sources(files, _parse_pages, _read_sheet, _find_tables).select("source", "page_num", "text", "atomic")


def _engine():
    """A stand-in for a compiled sheet: one component from the host's memory, and a totals row that isn't its sum."""

    def calculate(o: dict[str, str]) -> dict[str, object]:
        ram = float(o["E14"])
        return {"G8": " Ops ", "J8": 2, "K8": f"{ram:g} vCPUs", "L8": ram * 2, "M8": 100, "G9": "Off", "K9": 0, "G10": 5.0, "J33": 3, "K33": ram + 0.5, "L33": None, "M33": "700 GB", "O8": "Hosts", "R8": o["E34"]}

    return calculate


@R.add("SELECT s_suppkey AS plan, 3.0::DOUBLE AS nodes, s_nationkey + 0.5::DOUBLE AS vcpu, 0.0::DOUBLE AS ram_gb, 700.0::DOUBLE AS disk_gb FROM supplier")
def plan_computed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.totals_row(_computed(spark, sf_dir), "plan")


@R.add("SELECT s_suppkey AS plan, 'Ops' AS name, 2.0::DOUBLE AS nodes, s_nationkey::DOUBLE AS vcpu, 2.0::DOUBLE * s_nationkey AS ram_gb, 100.0::DOUBLE AS disk_gb FROM supplier")
def plan_computed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.components(sizing.component_cells(_computed(spark, sf_dir), "plan"), "plan").where("name = 'Ops'")


def _computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    pairs = F.array(kv("host_ram_gb", F.col("s_nationkey").cast("string")), kv("cloud_proxy", F.lit("Include")))
    given = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("plan"), F.explode(pairs).alias("p")).select("plan", "p.name", "p.value")
    return sizing.compute(sizing.plan_overrides(given, "plan"), "plan", _engine)


@R.add(
    """WITH t AS (SELECT conv_id, 1 AS part, turn AS o, role, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> ''
UNION ALL SELECT DISTINCT conv_id, 0, 0, 'system', 'Be brief.' FROM conversations
UNION ALL SELECT DISTINCT conv_id, 2, 0, 'user', E'Context snippets (each prefixed with its citation marker):\\n\\nc' || conv_id || E'\\n\\nQuestion: why?' FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, o) - 1 AS pos, role, content FROM t"""
)
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id").distinct().withColumn("context", F.concat(F.lit("c"), F.col("conv_id").cast("string"))).withColumn("question", F.lit("why?"))
    return answers.messages("Be brief.", turns, asked)


@R.add("SELECT count(*) AS chunks, count(DISTINCT source) AS sources, (SELECT max(strftime(ts, '%Y-%m-%d')) FROM events) AS last_update, 'log' AS last_source FROM documents")
def status_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("ts"), F.lit("log").alias("source"))
    return answers.status(table(spark, sf_dir, "documents"), entries)


@R.add("SELECT p.p_partkey AS pos, t.new_pos FROM (VALUES (7, 1), (2, 2), (11, 3)) t(i, new_pos) JOIN part p ON p.p_partkey = t.i + 1")
def select_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_ops.select_positions(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("pos")), [7, 2, -5, 11])


QUESTION = "List the memory of all components"


@R.add(
    f"""WITH n AS (SELECT count(*) AS n FROM embeddings), c AS (SELECT n_name AS c, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation WHERE n_regionkey = 1),
subs AS (SELECT 0 AS qi, '{QUESTION}' AS sub UNION ALL SELECT 2 * i - 1, c || ' — {QUESTION}' FROM c
  UNION ALL SELECT 2 * i, 'Is ' || c || ' a required, optional, essential, or always-deployed management component of the VCF management domain?' FROM c),
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS n FROM e),
q AS (SELECT qi, u.n FROM subs, n JOIN u ON u.vec_id = length(sub) % n.n),
d AS (SELECT qi, u.vec_id, u.label, round(1 - list_dot_product(q.n, u.n), 9) AS distance FROM q, u),
k AS (SELECT qi, row_number() OVER (PARTITION BY qi ORDER BY distance, vec_id) - 1 AS rank, vec_id, label, distance FROM d QUALIFY rank < 100),
m AS (SELECT vec_id, label, rank, qi, distance FROM k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY rank, qi) = 1),
p AS (SELECT vec_id, label, row_number() OVER (ORDER BY rank, qi) AS pos FROM m QUALIFY pos <= 100)
SELECT vec_id, pos, row_number() OVER (ORDER BY label DESC, pos) AS new_pos FROM p WHERE label <> 3 QUALIFY new_pos <= 24"""
)
def ask_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for all components from sub-queries to the reranked cut. The encoder takes the vector numbered by a text's length, the reranker prefers high labels."""
    v = table(spark, sf_dir, "embeddings")
    n = v.count()

    def encode(texts: list[str]) -> list[list[float]]:
        wanted = {len(t) % n for t in texts}
        rows = {r.vec_id: [float(x) for x in r.embedding] for r in v.where(F.col("vec_id").isin(*wanted)).select("vec_id", "embedding").collect()}
        return [rows[len(t) % n] for t in texts]

    store = v.withColumn("text", F.col("label").cast("string"))
    names = [r.n_name for r in table(spark, sf_dir, "nation").where("n_regionkey = 1").orderBy("n_nationkey").collect()]
    models = Models(encode, rerank=lambda _, texts: [(i, float(t)) for i, t in enumerate(texts) if t != "3"])
    hits = breadth(store, names, QUESTION, models, AskSettings())
    return finish(hits, store, QUESTION, models.rerank, retrieval_ops.BREADTH_KEEP).select("vec_id", "pos", "new_pos")

