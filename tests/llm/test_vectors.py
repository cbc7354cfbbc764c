import math
import random

import numpy as np
import pytest

from corpusloom.llm.ego_join import near_duplicates
from corpusloom.llm import ego_join, topk
from corpusloom.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def links(rows, t=0.93):
    n = [0] * len(rows)
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, v, x) in enumerate(rows):
        for j, (b, w, y) in enumerate(rows[:i]):
            if None in (a, b, x, y) or x != y or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            p, q = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
            if p.any() and q.any() and p @ q / math.sqrt((p @ p) * (q @ q)) >= t:
                n[i] += 1
                n[j] += 1
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted(((r[0], k, None if r[0] is None else find(r[0]), r[0] is not None and find(r[0]) == r[0]) for r, k in zip(rows, n, strict=True)), key=str)


def near(spark, rows):
    return sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def clustered(n=300, dim=8, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    out = []
    for i in range(n):
        v = centres[r.integers(12)] + r.normal(size=dim) * r.choice([0.0, 0.1, 0.3, 0.6])
        out.append((i, [float(np.float32(x)) for x in v], int(r.integers(3))))
    random.Random(seed).shuffle(out)
    return out


@pytest.mark.parametrize("interval, leaf", [(1024, 128), (16, 4)])
def test_near_duplicates(spark, monkeypatch, interval, leaf):
    monkeypatch.setattr(ego_join, "INTERVAL", interval)
    monkeypatch.setattr(ego_join, "LEAF", leaf)
    rows = clustered()
    assert near(spark, rows) == links(rows)


def test_near_duplicate_edge_cases(spark):
    v = [1.0, 0.5, 0.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, [float("nan"), 1.0, 0.0], 1)]
    rows += [(9, [float("inf"), 1.0, 0.0], 1), (None, v, 1), (10, [1.0, 0.5], 1), (11, [2.0, 1.0, 0.0], 1), (12, [-1.0, -0.5, -0.0], 1), (13, [1e30, 5e29, 0.0], 1)]
    assert near(spark, rows) == links(rows)
    assert near(spark, []) == []
    clash = spark.createDataFrame([(1, v, 1, 2.0, "x")], "vec_id long, embedding array<double>, label int, w double, cls string")
    assert [tuple(r) for r in near_duplicates(clash).collect()] == [(1, 0, 1, True)]


def best(rows, k=5):
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in ((r[0], r[1]) for r in rows) if i is not None and usable(v)]
    out = []
    for i, v in q:
        if i % 50 == 0:
            s = sorted({(-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in q if j != i and len(v) == len(w)})[:k]
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


def top(spark, rows, **kw):
    return sorted(tuple(r) for r in exact_top_k(spark.createDataFrame(rows, SCHEMA), **kw).collect())


@pytest.mark.parametrize("block", [4096, 37])
def test_top_k(spark, block):
    rows = clustered(400, 16, 2)
    assert top(spark, rows, row_block=block) == best(rows)


def test_top_k_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 300)
    rows = clustered(400, 16, 2)
    assert top(spark, rows, row_block=64) == best(rows)


def test_lists_are_not_read_to_the_end():
    r = np.random.default_rng(6)
    rows = np.floor(256 * ego_join.unit(r.normal(size=(6000, 24))))
    ids = np.arange(6000)
    found = topk.Best(rows[::200], ids[::200], 5)
    topk.search(found, rows[:1000], ids[:1000])
    read, resolved = topk.search(found, rows[1000:], ids[1000:])
    assert read < 0.8 * 30 * 5000 * 24 and resolved < 30 * 5000 / 16
    scores = rows[::200] @ rows.T
    scores[np.arange(30), ids[::200]] = -np.inf
    assert (np.sort(found.score.reshape(30, 5), axis=1) == np.sort(scores, axis=1)[:, -5:]).all()
    # a block whose fronts can't reach the bound isn't read
    assert topk.search(found, np.zeros((100, 24)), np.arange(10_000, 10_100)) == (0, 0)


def test_distant_intervals_are_skipped():
    """Two far clusters: of the block products between them none is made, and no link is lost."""
    r = np.random.default_rng(7)
    a, b = np.zeros(8), np.zeros(8)
    a[0], b[1] = 1, 1
    x, y = (ego_join.unit(c + 0.05 * r.normal(size=(700, 8))) for c in (a, b))
    eps = 0.5
    assert not list(ego_join._links(x, y, x[:, :4], y[:, :4], 1 - eps * eps / 2, eps, False))
    mixed = np.concatenate((x, y))
    got = {(int(i), int(j)) for i, j in zip(*(np.concatenate(z) for z in zip(*ego_join._links(mixed, mixed, mixed[:, :4], mixed[:, :4], 1 - eps * eps / 2, eps, True), strict=True)), strict=True)}
    i, j = np.nonzero(np.triu(mixed @ mixed.T >= 1 - eps * eps / 2, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))


def test_top_k_edge_cases(spark):
    v = [0.5, -0.25]
    rows = [(0, v, 1), (1, v, None), (2, v, 1), (3, None, 1), (4, [None, 1.0], 1), (None, v, 1), (50, [0.0, 0.0], 1), (5, [float("nan"), 0.0], 1), (100, [1.0], 1), (-50, [9.0, 9.0], 1)]
    assert top(spark, rows) == best(rows)
    assert top(spark, []) == [] and top(spark, [(1, v, 1)]) == []
    ties = [(i, v, 1) for i in range(40)]
    assert top(spark, ties) == best(ties)
    clash = spark.createDataFrame([(0, v, 1, 3), (1, v, 2, 4)], "vec_id long, embedding array<float>, n int, rank int")
    assert [tuple(r) for r in exact_top_k(clash).collect()] == [(0, 1, 1, 128 * 128 + 64 * 64)]
