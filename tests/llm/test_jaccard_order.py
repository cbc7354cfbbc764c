"""Links must not depend on the order of rows, nor on which evaluation of the input chose a copy."""

from collections.abc import Iterator

import numpy as np
import pandas as pd

from corpusloom.llm import jaccard_join
from corpusloom.llm.jaccard_join import Bands, Buckets, _cell_pairs, jaccard_components


def _texts(groups: int, words: int = 60) -> list[tuple[int, str]]:
    rng = np.random.default_rng(5)
    rows = []
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, words)]
        near = [*base[:-1], "other"]
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(base)), (3 * g + 2, " ".join(near))]
    return rows


def test_rows_in_another_order_at_each_evaluation(spark):
    def shuffled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.iloc[np.random.default_rng().permutation(len(pdf))]

    docs = spark.createDataFrame(_texts(300), "doc_id long, text string").coalesce(1).mapInPandas(shuffled, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert len(got) == 900
    assert got == {d: d // 3 * 3 for d in got}


def test_repeated_rows_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 80)]
    rows = []
    for d in range(120):  # a chain: each document differs from the next by a few words
        rows.append((d, " ".join([*base[d // 4 :], *(f"t{x}" for x in range(d // 4))])))
    rows += [rows[0]] * 20
    words = {}
    for d, t in rows:
        w = t.split()
        words[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    low = {d: d for d in words}
    changed = True
    while changed:
        changed = False
        for a in words:
            for b in words:
                both = len(words[a] & words[b])
                if 100 * both >= 80 * (len(words[a]) + len(words[b]) - both) and low[b] > low[a]:
                    low[b], changed = low[a], True
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == low


def test_a_band_of_few_segments_fills_many_buckets():
    bands = Bands(80, 100)
    buckets = Buckets(bands, {0: 1_000_000_000, 3: 1_000_000_000})
    key = np.random.default_rng(1).integers(0, 1 << 63, 10_000).astype(np.uint64)
    at = buckets.of(np.zeros(10_000, np.int64), np.zeros(10_000, np.int64), key)
    assert len(np.unique(at)) > 300 and at.max() < buckets.total
    again = buckets.of(np.full(10_000, 3), np.ones(10_000, np.int64), key)
    assert again.max() < buckets.total and not set(again) & set(at)


def test_cells_compare_only_probing_documents_of_other_components():
    bands = Bands(80, 100)
    bits = [np.zeros(2, np.uint64).tobytes()] * 4
    cell = {"doc": [1, 2, 3, 4], "comp": [1, 1, 3, 4], "n": [50] * 4, "sketch": bits, "left": [True, False, False, False], "right": [True] * 4}
    cell = pd.DataFrame(cell).assign(gid=1, i=0, j=0)
    pairs = pd.concat(_cell_pairs(bands, None)(iter([cell])))
    assert sorted(map(tuple, pairs[["a", "b"]].to_numpy().tolist())) == [(1, 3), (1, 4)] and not pairs["rest"].any()


def test_a_cell_with_plenty_of_pairs_gives_the_closest_first():
    bands = Bands(80, 100)
    far = np.zeros(2, np.uint64)
    far[0] = 7
    cell = {"doc": [1, 2, 3, 4], "comp": [1, 1, 9, 9], "n": [50] * 4, "sketch": [far.tobytes(), *[np.zeros(2, np.uint64).tobytes()] * 3], "left": [True] * 4, "right": [True] * 4}
    cell = pd.DataFrame(cell).assign(gid=1, i=0, j=0)
    pairs = pd.concat(_cell_pairs(bands, 1)(iter([cell])))
    assert pairs.to_numpy().tolist() == [[2, 3, True]]


def test_cells_with_plenty_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PLENTY", 0)
    rows = _texts(40)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d // 3 * 3 for d in got}
