import random

import numpy as np
import pytest

from corpusloom.llm import jaccard_join as jj
from corpusloom.llm.shingles import differences_at_least, overlap, parity_bits, shingle_set

SCHEMA = "doc_id long, text string"


def brute(rows, num=80, den=100, words=5):
    """Components by comparing all pairs of word-tuple sets."""

    def grams(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\f\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    sets = [(d, grams(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x & y and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def got(spark, rows, **kw):
    return sorted((tuple(r) for r in jj.jaccard_components(spark.createDataFrame(rows, SCHEMA), **kw).collect()), key=str)


def corpus(seed, n=120):
    """Families of edited copies, texts of a few words, texts that share a passage, and repeats."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(400))
    passage = [word() for _ in range(40)]
    rows, k = [], 0
    while k < n:
        base = [word() for _ in range(r.choice([1, 3, 5, 6, 8, 12, 20, 60, 200]))]
        if r.random() < 0.4:
            base = base + passage
        for _ in range(r.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                i = r.randrange(len(t) or 1)
                t[i : i + r.randrange(2)] = [word()] if r.random() < 0.7 else []
            rows.append((k, r.choice([" ", "  ", "\n"]).join(t)))
            k += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_stars_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 3)
    rows = corpus(5, 150)
    assert got(spark, rows) == brute(rows)


def test_other_threshold(spark):
    rows = corpus(9, 80)
    assert got(spark, rows, num=1, den=2, words=2) == brute(rows, 1, 2, 2)


def test_edge_cases(spark):
    rows = [(5, None), (4, ""), (3, " \n\t"), (None, "a b c d e f"), (2, "A b C"), (9, "a B c"), (7, "a b c d e f"), (6, "a b c d e f"), (1, "x" * 200_000), (0, "x" * 200_000 + " y"), (8, "é É b c d"), (10, "É É b c d")]
    assert got(spark, rows) == brute(rows)


def test_rows_that_repeat_an_id_are_one_node(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b)]
    assert [r[2] for r in got(spark, rows)] == [1] * 5


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, "a b c", 7, "x")], "doc_id long, text string, n int, component_id string")
    assert [tuple(r) for r in jj.jaccard_components(df).collect()] == [(1, 1, 1)]


def test_pigeonhole_holds_for_every_pair():
    """Each linked pair meets under a key that one of them probes, whatever counts as frequent."""
    bands, rng = jj.Bands(80, 100), np.random.default_rng(3)
    for n in (4, 5, 9, 10, 31, 200):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            cut, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
            b = np.unique(np.concatenate((a[cut:], rng.integers(0, 1 << 63, add).astype(np.uint64))))
            both = overlap(a, b)
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            hot = np.full(jj.HOT_BITS // 8, rng.choice([0, 85, 255]), np.uint8)
            at, key, kind, *_ = jj._entries([a, b], bands, hot)
            mine = lambda i, k: set(key[(at == i) & np.isin(kind, k)].tolist())  # noqa: E731, B023
            every = (jj.FULL, jj.DELETED, jj.INDEX)
            assert mine(0, (jj.FULL,)) & mine(1, every) or mine(1, (jj.FULL,)) & mine(0, every)


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 10, 100, 1000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 1 << 63, n * 2).astype(np.uint64))))
        difference = len(a) + len(b) - 2 * overlap(a, b)
        assert 0 < differences_at_least([parity_bits(a)], [parity_bits(b)])[0] <= difference


def test_words_longer_than_a_part():
    long = b"a" * 3_000_000
    assert len(shingle_set(long + b" b c d e f")) == 2 and len(shingle_set(b"x y z " * 500_000)) == 3
