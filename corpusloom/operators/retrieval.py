"""Vector retrieval: exact top-k, multi-query fusion, component selection, reranking, and query planning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import asks_breadth, classification_question
from corpusloom.functions.vectors import dot, unit, usable

#: Bytes of a query table's components that may go to every executor; a larger one is joined in blocks.
MAX_BROADCAST_BYTES = 32 << 20
#: Margin of similarity within which components are in scope, caps of fan-outs. Fixed values.
SCOPE_MARGIN, FAN_OUT_CAP, BREADTH_CAP, BREADTH_KEEP, MIN_PER_QUERY = 0.04, 30, 28, 24, 10
#: Decimals kept of a distance, so that sums in another order still tie.
DIGITS = 9


def top_k(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``(id_col, distance)`` of the k nearest by cosine distance, ties to the smaller id: one scan, a top-k heap for each task.

    Vectors that are null or empty, of another length than the query, or hold null or non-finite components take no part; a zero vector has distance 1.
    """
    q = unit(F.array(*[F.lit(float(x)) for x in query]))
    v = F.col(vector).cast("array<double>")
    rows = vectors.where(usable(v) & (F.size(v) == len(query))).select(id_col, F.round(1 - dot(unit(v), q), DIGITS).alias("distance"))
    return rows.orderBy("distance", id_col).limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", id_col: str = "vec_id", blocks: int = 64) -> DataFrame:
    """``(qi, rank, id_col, distance)`` for queries ``(qi, q)``: ranks from 0, ties to the smaller id.

    Queries are read up to ``MAX_BROADCAST_BYTES`` of components; such a matrix goes to the executors, which multiply it with batches of
    vectors and keep k rows for each query and batch. More queries than that meet the vectors in blocks, by an equi-join.
    What takes part is as in :func:`top_k`; a query that can't be compared has no rows. ``id_col`` is a 64-bit integer in
    the first case, any type in the second.
    """
    v = vectors.select(id_col, F.col(vector).cast("array<double>").alias("_v")).where(usable(F.col("_v")))
    q = queries.select("qi", F.col("q").cast("array<double>").alias("_q")).where(usable(F.col("_q")))
    head = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_q")), F.lit(0)).alias("numbers")).first()
    best = Window.partitionBy("qi").orderBy("distance", id_col)
    if 8 * head.numbers <= MAX_BROADCAST_BYTES and dict(v.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        scored = _matrix_scores(v, q, k, id_col)
    else:
        copies = q.withColumn("_q", unit(F.col("_q"))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = v.withColumn("_v", unit(F.col("_v"))).withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")).join(copies, "_b").where(F.size("_v") == F.size("_q"))
        scored = met.select("qi", id_col, F.round(1 - dot(F.col("_v"), F.col("_q")), DIGITS).alias("distance"))
    return scored.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k).select("qi", "rank", id_col, "distance")


def _matrix_scores(v: DataFrame, q: DataFrame, k: int, id_col: str) -> DataFrame:
    """``(qi, id_col, distance)``: of each batch of vectors the k nearest to each query."""
    qi_type, id_type = dict(q.dtypes)["qi"], dict(v.dtypes)[id_col]
    by_length: dict[int, tuple[list, np.ndarray]] = {}
    rows = q.orderBy("qi").collect()  # the caller has checked their size
    for length in {len(r._q) for r in rows}:
        own = [r for r in rows if len(r._q) == length]
        by_length[length] = ([r.qi for r in own], _unit_rows(np.array([r._q for r in own], np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["_v"].map(len).to_numpy()
            for length, (names, matrix) in by_length.items():
                at = np.flatnonzero(size == length)
                if not len(at):
                    continue
                ids = pdf[id_col].to_numpy()[at]
                for begin in range(0, len(names), 256):
                    part = matrix[begin : begin + 256]
                    far = np.round(1 - part @ _unit_rows(np.stack(pdf["_v"].to_numpy()[at])).T, DIGITS) + 0.0
                    order = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :k]
                    which = np.repeat(np.arange(len(part)), order.shape[1])
                    yield pd.DataFrame({"qi": [names[begin + i] for i in which], id_col: ids[order.ravel()], "distance": far[which, order.ravel()]})

    return v.mapInPandas(run, f"qi {qi_type}, `{id_col}` {id_type}, distance double")


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=x.copy(), where=n > 0)


def round_robin(hits: DataFrame, k_total: int, id_col: str = "vec_id") -> DataFrame:
    """Fusion of ``(qi, rank, id_col, distance)``: by rank and then query, ids once, ``k_total`` rows with ``pos`` from 1."""
    first = hits.groupBy(id_col).agg(F.min(F.struct("rank", "qi", "distance")).alias("m"))
    top = first.select(F.col("m.rank").alias("rank"), F.col("m.qi").alias("qi"), id_col, F.col("m.distance").alias("distance")).orderBy("rank", "qi").limit(k_total)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("rank", "qi")))  # over k_total rows


def select_components(labels: DataFrame, question: list[float], top_n: int, vector: str = "embedding", name: str = "label") -> DataFrame:
    """``(name, score)`` of the most similar labels. A zero question has norm 1, and 1e-9 is added to the labels' norms."""
    n = sum(x * x for x in question) ** 0.5 or 1.0
    v = F.col(vector).cast("array<double>")
    q = F.array(*[F.lit(float(x) / n) for x in question])
    score = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / (F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + 1e-9)
    return labels.select(name, F.round(score, DIGITS).alias("score")).orderBy(F.desc("score"), name).limit(top_n)


def within_margin(scored: DataFrame, margin: float = SCOPE_MARGIN) -> DataFrame:
    """Rows whose score is within ``margin`` of the best; the best is one row, so its broadcast has a fixed size."""
    best = scored.agg(F.max("score").alias("_best"))
    return scored.crossJoin(F.broadcast(best)).where(F.col("score") >= F.round(F.col("_best") - margin, DIGITS)).drop("_best")


def rerank(candidates: DataFrame, scores: DataFrame | None, keep: int, position: str = "pos") -> DataFrame:
    """Candidates in the order of an external reranker's ``(index, relevance)``, cut to ``keep``, with ``new_pos``.

    Indices count from 0 in candidate order; those outside and candidates that the reranker left out are dropped. Without scores (it is off)
    the candidates come back as they were, uncut. A reranker that failed has given no usable row: the candidates keep their order and are cut.
    One candidate or none needs no order.
    """
    if scores is None or len(candidates.limit(2).take(2)) <= 1:
        return candidates.withColumn("new_pos", F.col(position))
    ranked = candidates.join(scores.withColumn(position, F.col("index") + 1), position)
    if ranked.isEmpty():
        return candidates.withColumn("new_pos", F.row_number().over(Window.orderBy(position))).where(F.col("new_pos") <= keep)
    top = ranked.orderBy(F.desc("relevance"), position).limit(keep)
    return top.withColumn("new_pos", F.row_number().over(Window.orderBy(F.desc("relevance"), position)))  # over keep rows


def select_positions(candidates: DataFrame, indices: list[int], position: str = "pos") -> DataFrame:
    """The candidates at these places, from 0, in this order, with ``new_pos`` from 1; places outside are left out."""
    wanted = candidates.sparkSession.createDataFrame([(i + 1, n) for n, i in enumerate(indices)], "_at long, _n long")
    hit = candidates.join(F.broadcast(wanted), F.col(position) == F.col("_at"))  # as long as the caller's list
    return hit.withColumn("new_pos", F.row_number().over(Window.orderBy("_n"))).drop("_at", "_n")


def candidate_count(top_k: int, rerank_on: bool, pool: int) -> int:
    """How many candidates are fetched before the final cut."""
    return pool if rerank_on else top_k


def route(question: Column, multi_query: bool = True) -> Column:
    """``single``, ``breadth`` or ``specific``."""
    return F.when(F.lit(not multi_query), "single").when(asks_breadth(question), "breadth").otherwise("specific")


def fan_out(questions: DataFrame, components: Column, top_k: int = 6, classify: bool = True) -> DataFrame:
    """With ``si, sub, k_total``: the question itself, then for each component its sub-query, and one that asks how it is classified."""
    own = lambda c: F.concat(c, F.lit(" — "), F.col("question"))
    each = F.transform(components, lambda c: F.array(own(c), classification_question(c)) if classify else F.array(own(c)))
    subs = F.concat(F.array("question"), F.flatten(each))
    total = F.least(F.lit(FAN_OUT_CAP), F.greatest(F.lit(top_k), 2 * F.size(subs)))
    return questions.select("*", total.alias("k_total"), F.posexplode(subs).alias("si", "sub"))


def breadth_components(extracted: DataFrame, manifest: DataFrame, cap: int = BREADTH_CAP) -> DataFrame:
    """The extracted inventory's names in order, or if there are none the manifest's; at most ``cap``, with ``pos``."""
    first = extracted.select("pos", "name").orderBy("pos").limit(cap).withColumn("_from", F.lit(0))
    second = manifest.select("pos", "name").orderBy("pos").limit(cap).withColumn("_from", F.lit(1))
    both = first.unionByName(second)
    chosen = both.agg(F.min("_from").alias("_use"))
    return both.crossJoin(F.broadcast(chosen)).where("_from = _use").select("pos", "name")
