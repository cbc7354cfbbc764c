"""Embedding near-duplicates by an epsilon grid order join.

Method. Vectors of unit length whose cosine is at least t are at most eps = sqrt(2 - 2t) apart. Leading principal
dimensions come from a bounded sample (they only steer the pruning, never the result); each group is sorted by
the grid cells, eps wide, of its vectors on them. Consecutive rows form sequence intervals. As linked vectors lie in the same or in
neighbouring cells, intervals meet by the cells of the first dimension, and two whose boxes are over eps apart are skipped unseen. A
box covers the leading dimensions and the length of what lies outside them, in which linked vectors can't differ by more either. The others are
joined recursively, halving both and skipping distant halves, down to small blocks that are compared
by cosine in double precision. A pair of intervals reports each vector's number of links and a
spanning forest of them, never the links themselves.

Where directions are spread evenly over many dimensions every box touches every other, and a label is compared whole, in blocks; the
time is then that of the products, and what moves is each interval once for each other one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, connected_components, spread
from corpusloom.llm.vectors import is_usable

#: Rows from which the principal dimensions are taken; leading dimensions; those that order the grid; rows of an interval and of a leaf.
SAMPLE, LEADING, GRID, INTERVAL, LEAF = 20_000, 16, 4, 8192, 128
#: Room for rounding in the projections.
_SAFE = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is linked with, directly or not."""
    low = np.arange(n)
    while len(a):
        la, lb = low[a], low[b]
        m = np.minimum(la, lb)
        np.minimum.at(low, la, m)
        np.minimum.at(low, lb, m)
        low = low[low]
        while True:
            nxt = low[low]
            if (nxt == low).all():
                break
            low = nxt
        differ = low[a] != low[b]
        a, b = a[differ], b[differ]
    return low


def _links(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, t: float, eps: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of the sequence intervals x and y, in parts; of x and itself, if they are the same."""
    work = [(0, len(x), 0, len(y))]
    while work:
        a, b, c, d = work.pop()
        if same and c < a:
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if max(b - a, d - c) <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= t)
            i, j = i + a, j + c
            if same and a == c:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        left = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > LEAF else [(a, b)]
        right = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > LEAF else [(c, d)]
        work += [(*p, *q) for p in left for q in right]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Only rows with equal labels (and vectors of one length) are compared; they link when their cosine, in double precision,
    is at least ``threshold``. ``n_links`` counts the other rows linked directly, the component is the
    smallest id reachable by links, and the row that bears it is kept.

    Rows with a null label, and vectors that are null, empty, zero, or hold null or non-finite components, link with
    nothing and are kept. A row with a null id isn't compared, has a null component and isn't kept. Rows that repeat
    an id are one node in components; each has its own links. An empty table gives no rows. Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ego")
    eps = math.sqrt(2 - 2 * threshold) + _SAFE
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & is_usable(F.col("v"), zero_counts=False)
    # 128 bits stand for a row's label and vector: copies are compared once
    same = F.transform("v", lambda x: x + 0.0)
    seen = rows.withColumn("c1", F.when(fit, F.xxhash64("label", same))).withColumn("c2", F.when(fit, F.xxhash64(F.lit(11), "label", same)))
    distinct = scratch.save(
        seen.where("c1 is not null")
        .groupBy("c1", "c2")
        .agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v"), F.first("label").cast("string").alias("label"))
        .select(F.monotonically_increasing_id().alias("cls"), "c1", "c2", "rep", "w", "v", F.concat_ws(":", F.size("v").cast("string"), "label").alias("grp")),
        "distinct",
    )
    n = distinct.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = [np.array(r.v) for r in distinct.where(F.pmod(F.col("c2"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("v").limit(2 * SAMPLE).collect()]
    axes: dict[int, np.ndarray] = {}
    for dim in {len(v) for v in sample}:
        u = unit(np.stack([v for v in sample if len(v) == dim]))
        axes[dim] = np.linalg.eigh(u.T @ u)[1][:, ::-1][:, :LEADING]

    def project(u: np.ndarray) -> np.ndarray:
        """On the leading dimensions, and the length outside them; a length that the sample lacks keeps its first ones. Missing dimensions are 0."""
        out = np.zeros((len(u), LEADING + 1))
        p = u @ axes[u.shape[1]] if u.shape[1] in axes else u[:, :LEADING]
        out[:, : p.shape[1]] = p
        out[:, LEADING] = np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))
        return out

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.zeros((len(pdf), GRID), np.int64)
            size = pdf["v"].map(len).to_numpy()
            for dim in np.unique(size):
                at = np.nonzero(size == dim)[0]
                cell[at] = np.floor(project(unit(np.stack(pdf["v"].to_numpy()[at])))[:, :GRID] / eps)
            yield pdf.assign(**{f"c{i}": cell[:, i] for i in range(GRID)})

    order = ["grp", *(f"c{i}" for i in range(GRID)), "cls"]
    keyed = scratch.save(
        distinct.select("grp", "cls", "rep", "w", "v").mapInPandas(cells, "grp string, cls long, rep long, w long, v array<double>, " + ", ".join(f"c{i} long" for i in range(GRID))),
        "keyed",
    )

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Consecutive rows of a group, in grid order, with their box."""
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, None

        def row(g: pd.DataFrame) -> tuple:
            nonlocal seq
            seq += 1
            raw = np.stack(g["v"].to_numpy())
            p = project(unit(raw))
            first = g["c0"].to_numpy()
            return (part * (1 << 32) + seq, g["grp"].iloc[0], len(g), int(first[0]), int(first[-1]), list(p.min(0)), list(p.max(0)), *(g[c].to_numpy(np.int64).tobytes() for c in ("cls", "rep", "w")), raw.tobytes())

        names = ["block", "grp", "n", "c_lo", "c_hi", "lo", "hi", "cls", "rep", "w", "vecs"]
        for pdf in batches:
            pdf = pd.concat([held, pdf]) if held is not None else pdf
            out = []
            grp = pdf["grp"].to_numpy()
            starts = [0, *(np.nonzero(grp[1:] != grp[:-1])[0] + 1), len(pdf)]
            held = None
            for i, j in zip(starts, starts[1:], strict=False):
                full = i + (j - i) // INTERVAL * INTERVAL
                out += [row(pdf.iloc[k : k + INTERVAL]) for k in range(i, full, INTERVAL)]
                if full < j:
                    if j == len(pdf):
                        held = pdf.iloc[full:j]
                    else:
                        out.append(row(pdf.iloc[full:j]))
            if out:
                yield pd.DataFrame(out, columns=names)
        if held is not None and len(held):
            yield pd.DataFrame([row(held)], columns=names)

    blocks = scratch.save(
        keyed.repartitionByRange(max(1, -(-n // (8 * INTERVAL))), *order).sortWithinPartitions(*order).mapInPandas(
            intervals, "block long, grp string, n int, c_lo long, c_hi long, lo array<double>, hi array<double>, cls binary, rep binary, w binary, vecs binary"
        ),
        "blocks",
    )
    # an interval's rows are sorted by their first cell: it meets those that have a cell of its own or a neighbour
    box = blocks.select("block", "grp", "lo", "hi", F.explode(F.sequence("c_lo", "c_hi")).alias("cell"))
    other = blocks.select(F.col("block").alias("block2"), "grp", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(F.col("c_lo") - 1, F.col("c_hi") + 1)).alias("cell"))
    gap = "aggregate(zip_with(zip_with(lo, hi2, (x, y) -> x - y), zip_with(lo2, hi, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)), 0D, (s, x) -> s + x * x)"
    pairs = scratch.save(
        box.join(other, ["grp", "cell"])
        .where("block <= block2")
        .where(F.expr(gap) <= eps * eps)
        .select("block", "block2")
        .distinct(),
        "pairs",
    )
    second = blocks.select(F.col("block").alias("block2"), *(F.col(c).alias(f"{c}2") for c in ("n", "cls", "rep", "w", "vecs")))
    met = pairs.repartition(spread(spark, 0, 1), "block", "block2").join(blocks.select("block", "n", "cls", "rep", "w", "vecs"), "block").join(second, "block2")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                same = r.block == r.block2
                x = unit(np.frombuffer(r.vecs).reshape(r.n, -1))
                y = x if same else unit(np.frombuffer(r.vecs2).reshape(r.n2, -1))
                cls, rep, w = (np.concatenate([np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)]) for a, b in ((r.cls, r.cls2), (r.rep, r.rep2), (r.w, r.w2)))
                off = 0 if same else r.n
                count, low = np.zeros(r.n + r.n2, np.int64), np.arange(r.n + r.n2)
                for i, j in _links(x, y, project(x), project(y), threshold, eps, same):
                    j = j + off
                    np.add.at(count, i, w[j])
                    np.add.at(count, j, w[i])
                    low = _merge(low, i, j)
                at = np.nonzero(count)[0]
                yield pd.DataFrame({"cls": cls[at], "links": count[at], "a": rep[at], "b": rep[low[at]]})

    joined = scratch.save(met.mapInPandas(join, "cls long, links long, a long, b long"), "joined")
    links = joined.groupBy("cls").agg(F.sum("links").alias("links"))
    per_class = scratch.save(distinct.select("cls", "c1", "c2", "rep", "w").join(links, "cls", "left").select("c1", "c2", "rep", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links")), "linked")
    rowed = seen.select("id", "c1", "c2").join(per_class, ["c1", "c2"], "left")
    edges = joined.select("a", "b").unionByName(rowed.where("rep is not null and id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comps = scratch.save(connected_components(edges, scratch), "components")
    return rowed.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
    )


def _merge(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after linking i with j."""
    return forest(len(low), low[i], low[j])[low]
