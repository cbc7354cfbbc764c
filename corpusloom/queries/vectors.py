"""Retrieval over ``embeddings``: labels stand for components, the vector of a label's smallest id for the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as ops
from corpusloom.operators.sizing import rank_by
from corpusloom.queries.base import Registry, table

R = Registry()

_U = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS n FROM e),
"""
_BATCH = """d AS (SELECT q.vec_id AS qi, u.vec_id, round(1 - list_dot_product(q.n, u.n), 9) AS distance FROM u q JOIN u ON q.vec_id % 50 = 0),
k AS (SELECT qi, row_number() OVER (PARTITION BY qi ORDER BY distance, vec_id) - 1 AS rank, vec_id, distance FROM d QUALIFY rank < {k}),
"""
_RR = "m AS (SELECT vec_id, rank, qi, distance FROM k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY rank, qi) = 1)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _query(vectors: DataFrame, pick) -> list[float]:
    return [float(x) for x in vectors.agg(pick("embedding", "vec_id").alias("v")).first().v]


def _queries(vectors: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qi"), F.col("embedding").alias("q"))


def _labels(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))


@R.add(_U + "q AS (SELECT n FROM u ORDER BY vec_id LIMIT 1) SELECT vec_id, round(distance, 6) AS distance FROM (SELECT vec_id, round(1 - list_dot_product(u.n, q.n), 9) AS distance FROM u, q ORDER BY distance, vec_id LIMIT 6)")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ops.top_k(v, _query(v, F.min_by), 6).withColumn("distance", F.round("distance", 6))


@R.add(_U + _BATCH.format(k=10) + "x AS (SELECT 1) SELECT qi, rank, vec_id, round(distance, 6) AS distance FROM k")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ops.top_k_batch(v, _queries(v), 10).withColumn("distance", F.round("distance", 6))


@R.add(_U + _BATCH.format(k=30) + _RR + " SELECT rank, qi, vec_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY rank, qi) AS pos FROM m QUALIFY pos <= 30")
def rr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ops.round_robin(ops.top_k_batch(v, _queries(v), 30), 30).withColumn("distance", F.round("distance", 6))


_SCORES = """l AS (SELECT label, v FROM u QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1), q AS (SELECT n, v FROM u ORDER BY vec_id DESC LIMIT 1),
s AS (SELECT label, round(list_dot_product(l.v, q.n) / (sqrt(list_dot_product(l.v, l.v)) + 1e-9), 9) AS score FROM l, q ORDER BY score DESC, label LIMIT 7)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ops.select_components(_labels(v), _query(v, F.max_by), 7)


@R.add(_U + _SCORES + " SELECT label, round(score, 6) AS score FROM s")
def select_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumn("score", F.round("score", 6))


@R.add(_U + _SCORES + " SELECT label, round(score, 6) AS score FROM s WHERE score >= round((SELECT max(score) FROM s) - 0.04, 9)")
def scope_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.within_margin(_scored(spark, sf_dir)).withColumn("score", F.round("score", 6))


@R.add(
    _U
    + _SCORES
    + """, w AS (SELECT label FROM s WHERE score >= round((SELECT max(score) FROM s) - 0.3, 9)),
qs AS (SELECT 0 AS qi, n FROM q UNION ALL SELECT row_number() OVER (ORDER BY w.label), list_transform(l.v, lambda x: x / sqrt(list_dot_product(l.v, l.v))) FROM w JOIN l USING (label)),
d AS (SELECT qs.qi, u.vec_id, round(1 - list_dot_product(qs.n, u.n), 9) AS distance FROM qs, u),
k AS (SELECT qi, row_number() OVER (PARTITION BY qi ORDER BY distance, vec_id) - 1 AS rank, vec_id, distance FROM d QUALIFY rank < 10), """
    + _RR
    + " SELECT rank, qi, vec_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY rank, qi) AS pos FROM m QUALIFY pos <= 6"
)
def specific_multiquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question and each label in scope, with a wide margin, as queries; six results."""
    v = _vectors(spark, sf_dir)
    scope = ops.within_margin(_scored(spark, sf_dir), 0.3).join(_labels(v), "label")
    question = spark.createDataFrame([(0, _query(v, F.max_by))], "qi int, q array<double>")
    q = question.unionByName(rank_by(scope, "label").select(F.col("pos").alias("qi"), F.col("embedding").cast("array<double>").alias("q")))
    return ops.round_robin(ops.top_k_batch(v, q, 10), 6).withColumn("distance", F.round("distance", 6))


@R.add(
    _U
    + """q AS (SELECT n FROM u ORDER BY vec_id LIMIT 1), c AS (SELECT vec_id, label, round(1 - list_dot_product(u.n, q.n), 9) AS distance FROM u, q),
p AS (SELECT vec_id, label, row_number() OVER (ORDER BY distance, vec_id) AS pos FROM c QUALIFY pos <= 100)
SELECT vec_id, pos, row_number() OVER (ORDER BY label DESC, pos) AS new_pos FROM p WHERE label <> 3 QUALIFY new_pos <= 24"""
)
def rerank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in reranker prefers high labels, and leaves out label 3."""
    v = _vectors(spark, sf_dir)
    pool = rank_by(ops.top_k(v, _query(v, F.min_by), ops.candidate_count(6, True, 100)), "distance", "vec_id")
    scores = pool.join(v.select("vec_id", "label"), "vec_id").where("label <> 3").select((F.col("pos") - 1).alias("index"), F.col("label").cast("double").alias("relevance"))
    return ops.rerank(pool, scores, ops.BREADTH_KEEP).select("vec_id", "pos", "new_pos")


@R.add(
    """SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, n_name AS name FROM nation UNION ALL SELECT -pos, name FROM (SELECT row_number() OVER (ORDER BY r_regionkey) AS pos, r_name AS name FROM region)"""
)
def breadth_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as an extracted inventory; then the regions as the manifest that is used when nothing was extracted (positions negative)."""
    nations = rank_by(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name")), "n_nationkey")
    regions = rank_by(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name")), "r_regionkey")
    full = ops.breadth_components(nations, regions)
    bare = ops.breadth_components(nations.limit(0), regions).withColumn("pos", -F.col("pos"))
    return full.unionByName(bare)
