"""Text cleaning, tokens, chunking and batching, over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.operators import answers, chunking, reftables, retrieval
from corpusloom.queries.base import Registry, table

R = Registry()
TARGET, OVERLAP, BUDGET = 220, 40, 500

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_TOKENS = r"regexp_extract_all({0}, '\s*\S+')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@R.add(rf"""SELECT doc_id, {_STRIP.format(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g')")} AS cleaned FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", fx.clean_text(F.col("text")).alias("cleaned"))


_PARS = rf"""SELECT doc_id, list_filter(list_transform(string_split(text, E'\n'), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS ps FROM documents"""


@R.add(f"SELECT doc_id, unnest(range(len(ps))) AS par, unnest(ps) AS paragraph FROM ({_PARS})")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(fx.paragraphs(F.col("text"), "\n")).alias("par", "paragraph"))


@R.add(f"SELECT doc_id, len({_TOKENS.format('text')}) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", fx.token_count(F.col("text")).alias("n_tokens"))


@R.add(
    rf"""WITH t AS (SELECT doc_id, {_TOKENS.format(_STRIP.format("text"))} AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(1, len(t) + 1, {TARGET})) AS i FROM t WHERE len(t) > {TARGET})
SELECT doc_id, 0 AS par, (i - 1) // {TARGET} AS slice, len(t[i:i + {TARGET - 1}]) AS n_tokens, array_to_string(t[i:i + {TARGET - 1}], '') AS slice_text FROM s"""
)
def hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.hard_split(_docs(spark, sf_dir).select("doc_id", "text"), "text", TARGET).drop("text")


def _fold_sql(key: str, pieces: str) -> str:
    """A recursive fold of pieces ``(key, k, page, section, over, tok)`` into intervals."""
    return f"""pc AS ({pieces}),
fold AS (
  SELECT DISTINCT {key}, 0::BIGINT AS k, 1::BIGINT AS s, 0::BIGINT AS e, []::STRUCT(s BIGINT, e BIGINT)[] AS emitted FROM pc
  UNION ALL
  SELECT {key}, k, CASE WHEN post THEN greatest(s, e - {OVERLAP - 1}) ELSE s END, e, CASE WHEN post THEN list_append(emitted, {{'s': s, 'e': e}}) ELSE emitted END
  FROM (SELECT {key}, k, s, e, emitted, over AND e - s + 1 >= {TARGET} AS post
        FROM (SELECT {key}, k, CASE WHEN pre THEN greatest(s, e - {OVERLAP - 1}) ELSE s END AS s, e + n AS e, CASE WHEN pre THEN list_append(emitted, {{'s': s, 'e': e}}) ELSE emitted END AS emitted, over
              FROM (SELECT {", ".join(f"f.{c.strip()}" for c in key.split(","))}, f.k + 1 AS k, f.s, f.e, f.emitted, p.over, len(p.tok) AS n, f.e - f.s + 1 > 0 AND f.e - f.s + 1 + len(p.tok) > {TARGET} AS pre
                    FROM fold f JOIN pc p ON {" AND ".join(f"p.{c.strip()} = f.{c.strip()}" for c in key.split(","))} AND p.k = f.k + 1)))
),
cs AS (
  SELECT {key}, unnest(range(len(c))) AS chunk, unnest(c) AS c
  FROM (SELECT {key}, CASE WHEN e - s + 1 > 0 THEN list_append(emitted, {{'s': s, 'e': e}}) ELSE emitted END AS c FROM fold QUALIFY k = max(k) OVER (PARTITION BY {key}))
)"""


_LINES = rf"l AS (SELECT doc_id, source, lang, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS page FROM documents)"
_PIECES = rf"""SELECT doc_id, page, lang AS section, len(t) > {TARGET} AS over, t[i:i + {TARGET - 1}] AS tok, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) AS k
  FROM (SELECT doc_id, page, lang, t, unnest(CASE WHEN len(t) <= {TARGET} THEN [1::BIGINT] ELSE range(1, len(t) + 1, {TARGET}) END) AS i
        FROM (SELECT doc_id, page, lang, {_TOKENS.format(_STRIP.format("line"))} AS t FROM l WHERE {_STRIP.format("line")} <> ''))"""


@R.add(f"WITH RECURSIVE {_LINES}, {_fold_sql('doc_id', _PIECES)} SELECT doc_id, chunk, c.s AS tok_start, c.e AS tok_end FROM cs")
def chunk_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf_dir), TARGET, OVERLAP, section="lang").select("doc_id", "chunk", "tok_start", "tok_end")


def _rebuilt(key: str) -> str:
    on = " AND ".join(f"t.{c.strip()} = c.{c.strip()}" for c in key.split(","))
    return f"""tk AS (SELECT {key}, page, section, k, CASE WHEN i = 1 THEN E'\\n\\n' || x ELSE x END AS x, row_number() OVER (PARTITION BY {key} ORDER BY k, i) AS n
  FROM (SELECT {key}, page, section, k, unnest(tok) AS x, generate_subscripts(tok, 1) AS i FROM pc)),
b AS (SELECT {key}, chunk, c.s AS s, c.e AS e, lag(c.e) OVER (PARTITION BY {key} ORDER BY chunk) AS before FROM cs),
j AS (SELECT {", ".join(f"c.{x.strip()}" for x in key.split(","))}, c.chunk, c.s, c.e, any_value(c.before) AS before,
        regexp_replace(string_agg(t.x, '' ORDER BY t.n), '^\\s+', '') AS text, max(CASE WHEN t.n = c.e THEN t.page END) AS page_end,
        max(CASE WHEN t.n = coalesce(c.before, c.s) THEN t.page END) AS page_start,
        max(CASE WHEN t.n = coalesce(c.before + 1, c.s) THEN t.section END) AS section
      FROM b c JOIN tk t ON {on} AND t.n BETWEEN c.s AND c.e GROUP BY ALL)"""


@R.add(
    f"WITH RECURSIVE {_LINES}, {_fold_sql('doc_id', _PIECES)}, {_rebuilt('doc_id')} "
    "SELECT doc_id, source || '-' || left(sha1(source || '|' || j.text), 14) AS id, chunk, e - s + 1 AS n_tokens, page_start, page_end, section, j.text FROM j JOIN documents USING (doc_id)"
)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf_dir), TARGET, OVERLAP, section="lang").select("doc_id", "id", "chunk", "n_tokens", "page_start", "page_end", "section", "text")


#: Lines of under so many characters stand for atomic pages.
ATOMIC = 40
_SEG = rf"""sg AS (SELECT doc_id, page, lang, line, length(line) < {ATOMIC} AS atomic, sum(CASE WHEN length(line) < {ATOMIC} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS segment FROM l)"""
_SEG_PIECES = rf"""SELECT doc_id, segment, page, section, len(t) > {TARGET} AS over, t[i:i + {TARGET - 1}] AS tok, row_number() OVER (PARTITION BY doc_id, segment ORDER BY page, i) AS k
  FROM (SELECT doc_id, segment, page, lang AS section, t, unnest(CASE WHEN len(t) <= {TARGET} THEN [1::BIGINT] ELSE range(1, len(t) + 1, {TARGET}) END) AS i
        FROM (SELECT doc_id, segment, page, lang, {_TOKENS.format(_STRIP.format("line"))} AS t FROM sg WHERE NOT atomic AND {_STRIP.format("line")} <> ''))"""


@R.add(
    f"""WITH RECURSIVE {_LINES}, {_SEG}, {_fold_sql("doc_id, segment", _SEG_PIECES)}, {_rebuilt("doc_id, segment")},
u AS (SELECT doc_id, segment, chunk, e - s + 1 AS n_tokens, page_start, page_end, section, text FROM j
      UNION ALL SELECT doc_id, segment, -1, len({_TOKENS.format("line")}), page, page, lang, line FROM sg WHERE atomic)
SELECT 'doc' || doc_id || '-' || left(sha1('doc' || doc_id || '|' || text), 14) AS id, 'doc' || doc_id AS source, segment, chunk, n_tokens, page_start, page_end, section, text FROM u"""
)
def chunks_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), F.col("lang").alias("section"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    pages = lines.select("source", "ord", (F.col("ord") + 1).alias("page_num"), "text", "section", (F.length("text") < ATOMIC).alias("atomic"))
    return chunking.chunk_pages(pages, TARGET, OVERLAP).select("id", "source", "segment", "chunk", "n_tokens", "page_start", "page_end", "section", "text")


@R.add(
    f"""WITH RECURSIVE p AS (SELECT doc_id, unnest(range(len(ps))) AS item, len({_TOKENS.format("unnest(ps)")}) AS n FROM ({_PARS})),
f AS (
  SELECT DISTINCT doc_id, -1::BIGINT AS item, 0::BIGINT AS batch, 0::BIGINT AS b, 0::BIGINT AS sum FROM p
  UNION ALL
  SELECT doc_id, item, own, CASE WHEN n >= {BUDGET} THEN own + 1 ELSE own END, CASE WHEN n >= {BUDGET} THEN 0 WHEN sum > 0 AND sum + n > {BUDGET} THEN n ELSE sum + n END
  FROM (SELECT f.doc_id, p.item, p.n, f.sum, f.b + CASE WHEN f.sum > 0 AND (p.n >= {BUDGET} OR f.sum + p.n > {BUDGET}) THEN 1 ELSE 0 END AS own FROM f JOIN p ON p.doc_id = f.doc_id AND p.item = f.item + 1)
) SELECT doc_id, item, batch FROM f WHERE item >= 0"""
)
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.transform(fx.paragraphs(F.col("text"), "\n"), fx.token_count)
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.token_batches(counts, BUDGET)).alias("item", "batch"))


@R.add(f"SELECT doc_id, par, par // 10 AS batch FROM (SELECT doc_id, unnest(range(len(ps))) AS par FROM ({_PARS}))")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_batches(paragraphs(spark, sf_dir).drop("paragraph"), 10, ["doc_id"], ["par"])


@R.add("SELECT doc_id, source || '-' || left(sha1(source || '|' || text), 14) AS id FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", fx.content_id(F.col("source"), F.col("text")).alias("id"))


@R.add("SELECT doc_id, CASE WHEN lang = 'en' THEN 'search_document: ' || text ELSE text END AS document, CASE WHEN lang = 'en' THEN 'search_query: ' || text ELSE text END AS query FROM documents")
def embed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("lang") == "en", "text-Nomic-Embed-v1").otherwise("other")
    return _docs(spark, sf_dir).select("doc_id", fx.embed_input(F.col("text"), model).alias("document"), fx.embed_input(F.col("text"), model, "query").alias("query"))


@R.add(
    r"""SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(p_brand, '-?[0-9]+(\.[0-9]+)?'), '') AS DOUBLE), 0) AS brand_number,
coalesce(try_cast(nullif(regexp_extract(p_name, '-?[0-9]+(\.[0-9]+)?'), '') AS DOUBLE), 0) AS name_number FROM part"""
)
def num_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fx.leading_number(F.col("p_brand")).alias("brand_number"), fx.leading_number(F.col("p_name")).alias("name_number"))


@R.add(
    "SELECT p_partkey, CASE WHEN p_retailprice >= 1024 THEN printf('%.1f', round(p_retailprice / 1024, 1)) || ' TB' ELSE format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) || ' GB' END AS storage, "
    "CASE WHEN p_name LIKE '%/%' THEN substr(p_name, strpos(p_name, '/') + 1) ELSE p_name END AS model, "
    "replace(replace(replace(replace(replace(p_brand || '<\"&''>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM part"
)
def fmt_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        fx.storage_label(F.col("p_retailprice")).alias("storage"),
        fx.model_name(F.col("p_name")).alias("model"),
        fx.escape_attribute(F.concat("p_brand", F.lit("<\"&'>"))).alias("escaped"),
    )


NOW = "2024-07-01 12:00:00"


@R.add(
    f"""WITH a AS (SELECT event_id, ts, greatest(1, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) AS s FROM events),
b AS (SELECT *, floor(s / 60 + 0.5) AS m FROM a), c AS (SELECT *, floor(m / 60 + 0.5) AS h FROM b), d AS (SELECT *, floor(h / 24 + 0.5) AS d FROM c)
SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN m < 60 THEN CAST(m AS BIGINT) || 'm ago' WHEN h < 24 THEN CAST(h AS BIGINT) || 'h ago' WHEN d < 30 THEN CAST(d AS BIGINT) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS ago FROM d"""
)
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", fx.relative_time(F.col("ts").cast("timestamp"), now).alias("ago"))


@R.add(
    """SELECT conv_id, turn, 'event: ' || role || E'\\ndata: ' || data || E'\\n\\n' AS frame, role AS event, data
FROM (SELECT conv_id, turn, role, '{"turn":' || turn || ',"chars":' || length(text) || '}' AS data FROM conversations)"""
)
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.to_json(F.struct("turn", F.char_length("text").alias("chars")))
    frames = table(spark, sf_dir, "conversations").select("conv_id", "turn", fx.sse_frame(F.col("role"), data).alias("frame"))
    return frames.select("*", fx.sse_event(F.col("frame")).alias("event"), fx.sse_data(F.col("frame")).alias("data"))


_QUESTION_SQL = "CASE WHEN contains(text, 'the') THEN 'List every component: ' || text ELSE text END"


# The wording, stated here anew so that the SQL doesn't follow the module's.
_EVERYTHING = r"\b(all|every|each|full|complete|entire)\b[^.?!]{0,40}\bcomponents?\b|\bcomponents?\b[^.?!]{0,40}\b(all|every|each|list)\b"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.contains("text", F.lit("the")), F.concat(F.lit("List every component: "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", q.alias("question"))


@R.add(f"SELECT item_id, CASE WHEN regexp_matches(lower({_QUESTION_SQL}), '{_EVERYTHING}') THEN 'breadth' ELSE 'specific' END AS route, 'single' AS route_off FROM benchmark")
def route_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("item_id", retrieval.route(F.col("question")).alias("route"), retrieval.route(F.col("question"), multi_query=False).alias("route_off"))


@R.add(
    f"""WITH q AS (SELECT item_id, {_QUESTION_SQL} AS question FROM benchmark), c AS (SELECT n_name AS c, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation WHERE n_regionkey = 1),
s AS (SELECT item_id, 0 AS si, question AS sub FROM q UNION ALL SELECT item_id, 2 * i - 1, c || ' — ' || question FROM q, c
      UNION ALL SELECT item_id, 2 * i, 'Is ' || c || ' a required, optional, essential, or always-deployed management component of the VCF management domain?' FROM q, c)
SELECT item_id, si, sub, least(30, greatest(6, 2 * (1 + 2 * (SELECT count(*) FROM c)))) AS k_total FROM s"""
)
def fan_out_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a region has a handful of nations
    parts = table(spark, sf_dir, "nation").where("n_regionkey = 1").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("cs"))
    q = _questions(spark, sf_dir).crossJoin(F.broadcast(parts.select(F.transform("cs", lambda c: c["n_name"]).alias("names"))))
    return retrieval.fan_out(q, F.col("names")).select("item_id", "si", "sub", "k_total")


@R.add(
    """WITH n AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos FROM nation)
SELECT n_regionkey, pos, n_name AS name FROM n UNION ALL SELECT n_regionkey, max(pos) + 1, 'Last One' FROM n GROUP BY n_regionkey"""
)
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("xs"))
    upper = F.transform("xs", lambda x: F.concat(F.lit('"'), x["n_name"], F.lit('","'), F.lower(x["n_name"]), F.lit('"')))
    raw = names.select("n_regionkey", F.concat(F.lit("found: ["), F.array_join(upper, ","), F.lit(',"x",1,null,["y"]," Last One "] end')).alias("raw"))
    return answers.salvage_names(raw, "n_regionkey", "raw")


@R.add(
    r"""WITH m AS (SELECT n_regionkey, string_agg('| ' || n_name || ' |  ' || n_nationkey || '<br>x |', E'\n' ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, E'Table — Region ' || n_regionkey || E'\n| Name | Key |\n' || replace(replace(rows, '<br>', ' '), '  ', ' ') AS block FROM m"""
)
def table_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("| "), F.col("n_name"), F.lit(" |  "), F.col("n_nationkey").cast("string"), F.lit("<br>x |"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("rs"))
    md = F.concat(F.lit("| Name |  Key |\n|---|:--|\n|  |  |\n"), F.array_join(F.transform("rs", lambda r: r["r"]), "\n"))
    return rows.select("n_regionkey", reftables.table_text(md, F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))).alias("block"))
