"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Method. Rows lie in blocks, which stay where they are. In a block every dimension is a list sorted by component; a query reads each list
from the end that its own component favours, in steps, so the values it meets only get worse. What it has met of a row adds up; the
row's upper bound takes the value at the reading front for each list in which it hasn't met it, and of a row that no
list has shown yet it is the sum of the fronts. The lower bound to beat is the query's k-th best score so far: a first bounded sample of rows gives
one, and each block that a task has finished raises it. A block whose fronts can't reach it at the outset is skipped unread.
Reading stops for a query when few rows can still reach its bound; only their final scores are resolved, and rows outside
them can't qualify. A query that never gets there reads its lists to the end, where bounds are scores.

Queries go to the tasks as a matrix of bounded size; more of them are answered in several passes over the blocks. Of
each task and query only the k best rows leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, spread
from corpusloom.llm.vectors import is_usable, pack_rows

#: Bytes of query vectors in a pass, rows of the first sample, queries of a step's matrices.
QUERY_BYTES, SEED_ROWS, TOGETHER = 32 << 20, 2048, 256
#: Shares of the lists that are read before bounds are looked at; a query stops reading when at most this share of rows is possible.
STEPS, FEW = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0), 1 / 32


class Best:
    """The k best rows of each query so far: best scores first, ties to smaller ids, a row's id and score once."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.floor = np.full(len(ids), -np.inf)
        self.q, self.row, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        far = self.ids[q] != row
        q, row, score = (np.concatenate(x) for x in ((self.q, q[far]), (self.row, row[far]), (self.score, score[far])))
        order = np.lexsort((row, -score, q))
        q, row, score = q[order], row[order], score[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (row[1:] != row[:-1]) | (score[1:] != score[:-1])
        q, row, score = q[fresh], row[fresh], score[fresh]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.row, self.score = q[keep], row[keep], score[keep]
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])


def search(best: Best, rows: np.ndarray, ids: np.ndarray) -> tuple[int, int]:
    """Adds a block's rows that can be among the best, with their scores; entries read and rows resolved, over all queries.

    All values are integers, kept as doubles, so that sums are exact.
    """
    n, dim = rows.shape
    up = np.sort(rows, axis=0)
    rank = np.argsort(np.argsort(rows, axis=0, kind="stable"), axis=0, kind="stable")
    read = resolved = 0
    for begin in range(0, len(best.ids), TOGETHER):
        active = np.arange(begin, min(begin + TOGETHER, len(best.ids)))
        plus, minus = np.maximum(best.queries[active], 0), np.minimum(best.queries[active], 0)
        reach = plus @ up[-1] + minus @ up[0] >= best.floor[active]
        active, plus, minus = active[reach], plus[reach], minus[reach]
        seen, depth = np.zeros((len(active), n)), 0
        for step in STEPS:
            if not len(active):
                break
            last, depth = depth, max(1, round(step * n))
            if depth == last:
                continue
            # what this step meets in lists read from the top, and from the bottom
            seen += plus @ np.where((rank >= n - depth) & (rank < n - last), rows, 0).T + minus @ np.where((rank < depth) & (rank >= last), rows, 0).T
            upper = seen if depth == n else seen + (plus * up[n - depth]) @ (rank < n - depth).T.astype(float) + (minus * up[depth - 1]) @ (rank >= depth).T.astype(float)
            possible = upper >= best.floor[active][:, None]
            read += len(active) * (depth - last) * dim
            stop = (possible.sum(axis=1) <= max(best.k, n * FEW)) | (depth == n)
            a, r = np.nonzero(possible & stop[:, None])
            for i in range(0, len(a), 1 << 16):
                q, own = active[a[i : i + (1 << 16)]], r[i : i + (1 << 16)]
                best.add(q, ids[own], (best.queries[q] * rows[own]).sum(axis=1).astype(np.int64))
            resolved += len(a)
            active, plus, minus, seen = active[~stop], plus[~stop], minus[~stop], seen[~stop]
    return read, resolved


def exact_top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    query_every: int = 50,
    row_block: int = 4096,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for each query, ranks from 1.

    Components become ``floor(scale * x)`` and the score is the integer inner product; ties go to
    the smaller id. Queries are the rows whose id is divisible by ``query_every``,
    candidates all rows of the same length but the query's own id. With fewer candidates than k, all are returned.

    Vectors that are null or empty, or hold null or non-finite components, and rows without an id take no part.
    Of rows that repeat an id, each is a candidate for other ids, and as a query each is
    answered; of their results the best k count, a row with the same id and score once. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    used = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & is_usable(F.col("v"), zero_counts=True))
        .withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    )
    n = used.count()
    blocks = scratch.save(pack_rows(used.repartition(spread(spark, n, 32 * row_block)), row_block), "blocks")
    # repeated rows are one query
    asked = scratch.save(used.where(F.pmod("id", F.lit(query_every)) == 0).distinct().withColumn("pass", F.xxhash64("id", "v")), "questions")
    numbers = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    passes = max(1, -(-8 * numbers // QUERY_BYTES))
    luck = F.pmod(F.xxhash64("id", "v", F.lit(3)), F.lit(1 << 30))
    seeds = used.where(luck < int((1 << 30) * min(1.0, SEED_ROWS / max(1, n)))).distinct().collect()
    by_length = lambda rows: {d: (np.array([r.v for r in own], np.float64), np.array([r.id for r in own], np.int64)) for d in {len(r.v) for r in rows} if (own := [r for r in rows if len(r.v) == d])}
    sample = by_length(seeds)

    def answered(rows: list) -> DataFrame:
        questions = {d: Best(vecs, ids, k) for d, (vecs, ids) in by_length(rows).items()}
        for d, best in questions.items():
            if d in sample:
                search(best, *sample[d])
        floors = {d: (best.queries, best.ids, best.floor) for d, best in questions.items()}

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = {}
            for d, (vecs, ids, floor) in floors.items():
                found[d] = Best(vecs, ids, k)
                found[d].floor = floor.copy()
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    vecs = np.frombuffer(r.vecs).reshape(r.n, -1)
                    if vecs.shape[1] in found:
                        search(found[vecs.shape[1]], vecs, np.frombuffer(r.ids, np.int64))
            for best in found.values():
                yield pd.DataFrame({"query_id": best.ids[best.q], "vec_id": best.row, "score": best.score})

        return blocks.select("n", "ids", "vecs").mapInPandas(task, "query_id long, vec_id long, score long")

    scored = None
    for i in range(passes):
        rows = asked.where(F.pmod("pass", F.lit(passes)) == i).select("id", "v").collect()  # about QUERY_BYTES
        part = scratch.save(answered(rows), f"found{i}")
        scored = part if scored is None else scored.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
