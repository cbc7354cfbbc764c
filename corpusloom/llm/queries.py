"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.binary_shards import write_shards
from corpusloom.llm.common import Scratch, table
from corpusloom.llm.ego_join import near_duplicates
from corpusloom.llm.html_extract import extract_main_text
from corpusloom.llm.jaccard_join import jaccard_components
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.piece_sampling import sample_segmentations
from corpusloom.llm.quality import classify_quality
from corpusloom.llm.sharding import shard_by_bytes
from corpusloom.llm.topk import exact_top_k
from corpusloom.llm.toxicity import classify_toxicity


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four samples of each text, one for each epoch over repeated data, with their ids."""
    return sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=4)


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-shards").path("shards")
    return write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || ' #' || len(ws)] ELSE [] END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT a AS node, a AS reached FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.reached
), low AS (SELECT node, min(reached) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.node = d.doc_id
"""

OP6_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

# The tables' pages hold their text in one article element of plain blocks, with two kinds of character references.
OP8_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1), '<[^>]*$', '') AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(string_split(regexp_replace(body, '</?(?:p|h1|br)[^>]*>', chr(30), 'g'), chr(30)),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a
), c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""

OP10_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), reach AS (
  SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.reached
), low AS (SELECT node, min(reached) AS c FROM reach GROUP BY node), n AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT x.vec_id, coalesce(n.k, 0) AS n_links, coalesce(low.c, x.vec_id) AS component_id, coalesce(low.c, x.vec_id) = x.vec_id AS kept
FROM embeddings x LEFT JOIN n ON n.a = x.vec_id LEFT JOIN low ON low.node = x.vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_sharding": op3_sharding,
    "op4_sentencepiece_sampling": op4_sentencepiece_sampling,
    "op5_token_id_output": op5_token_id_output,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_toxicity": op7_toxicity,
    "op8_html_extraction": op8_html_extraction,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op6_exact_top_k": OP6_SQL,
    "op8_html_extraction": OP8_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
}
