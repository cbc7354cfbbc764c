"""The corpus pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's result to the
shared folder and rereads it as the next one's documents. All stages but the last return the columns of
``documents``. A stage works on whatever its predecessor kept, and handles what its operator handles
(nulls, empty and long texts, repeated rows, empty tables); columns beyond ``doc_id`` and ``text`` pass through.
Ties: a score of exactly 0.5 counts as good in the first stage and as toxic in the second; of equal or near texts the smallest id stays; equal
lengths are packed in any order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, table
from corpusloom.llm.jaccard_join import jaccard_components
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality import fit_quality, with_quality
from corpusloom.llm.toxicity import fit_toxicity, held_out, with_toxicity

_SCORE = "__corpusloom_score"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose chance of being good is under 0.5; texts without words are among them."""
    return with_quality(docs, fit_quality(docs), _SCORE).where(F.col(_SCORE) >= 0.5).drop(_SCORE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is 0.5 or more."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("label_id")))
    return with_toxicity(docs, model, _SCORE).where(F.col(_SCORE) < 0.5).drop(_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; rows without an id are kept, repeated rows of an id and text become one.

    Different texts of one id are documents of their own, each judged by its own group.
    """
    node, told = "__corpusloom_id", F.coalesce(F.concat(F.lit("t"), F.col("text").cast("string")), F.lit(""))
    named = docs.where("doc_id is not null")
    texts = named.groupBy("doc_id").agg(F.min(F.xxhash64(told)).alias("low"), F.max(F.xxhash64(told)).alias("high"))
    if texts.where("low <> high").isEmpty():
        named = named.dropDuplicates(["doc_id"]).withColumn(node, F.col("doc_id"))
        groups = jaccard_components(docs)
    else:
        # numbers in the order of the ids, one for each text of an id
        digest = "__corpusloom_digest"
        pairs = named.select("doc_id", F.sha2(told, 256).alias(digest)).distinct().orderBy("doc_id", digest).withColumn(node, F.monotonically_increasing_id())
        pairs = Scratch(spark, "texts").save(pairs, "pairs")
        named = named.withColumn(digest, F.sha2(told, 256)).dropDuplicates(["doc_id", digest]).join(pairs, ["doc_id", digest]).select(*docs.columns, node)
        groups = jaccard_components(named, id_col=node)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(node)).distinct()
    return named.join(first, node, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("best-fit packing", pack),
]

#: The label models and the packing can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
