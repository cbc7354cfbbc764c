import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import chunking


def intervals(spark, counts, target, overlap):
    rows = [(i, [(n, over) for n, over in c]) for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, "id int, c array<struct<n:int,over:boolean>>")
    out = df.select("id", chunking.fold_intervals(F.col("c"), target, overlap).alias("x")).orderBy("id").collect()
    return [[(y.s, y.e) for y in r.x] for r in out]


def by_hand(counts, target, overlap):
    """The packing loop, over token numbers."""
    buf, out, at = [], [], 0

    def flush():
        if buf:
            out.append((buf[0], buf[-1]))
            buf[:] = buf[-overlap:] if overlap else []

    for n, over in counts:
        if buf and len(buf) + n > target:
            flush()
        buf.extend(range(at + 1, at + n + 1))
        at += n
        if over and len(buf) >= target:
            flush()
    flush()
    return out


VECTORS = [
    ([(10, True), (10, True), (5, True)], [(1, 10), (8, 10), (8, 20), (18, 25)]),
    ([(10, True), (10, True)], [(1, 10), (8, 10), (8, 20), (18, 20)]),
    ([(10, True), (10, True), (8, True)], [(1, 10), (8, 10), (8, 20), (18, 20), (18, 28), (26, 28)]),
    ([(9, False), (9, False)], [(1, 9), (7, 18)]),
    ([(3, False)] * 4, [(1, 9), (7, 12)]),
]


def test_worked_vectors(spark):
    assert intervals(spark, [c for c, _ in VECTORS], 10, 3) == [x for _, x in VECTORS]


def test_without_overlap(spark):
    assert intervals(spark, [[(10, True), (10, True), (5, True)], [(9, False), (9, False)]], 10, 0) == [[(1, 10), (11, 20), (21, 25)], [(1, 9), (10, 18)]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 10), st.booleans()), max_size=12), min_size=1, max_size=40), st.integers(0, 4))
def test_fold_matches_the_loop(spark, counts, overlap):
    got = intervals(spark, counts, 10, overlap)
    assert got == [by_hand(c, 10, overlap) for c in counts]
    for c, x in zip(counts, got, strict=True):
        assert set(range(1, sum(n for n, _ in c) + 1)) == {t for a, b in x for t in range(a, b + 1)}
        assert all(b - a + 1 <= 10 + overlap for a, b in x)


def test_token_batches(spark):
    df = spark.createDataFrame([([200, 300, 1, 500, 499, 2],), ([],)], "c array<int>")
    got = [list(r[0]) for r in df.select(chunking.token_batches(F.col("c"), 500)).collect()]
    assert got == [[0, 0, 1, 2, 3, 4], []]


def test_chunk_ids_ignore_pages(spark):
    def run(first):
        rows = [("s", i, first + i, f"w{i} " * 30, None, False) for i in range(5)]
        pages = spark.createDataFrame(rows, "source string, ord int, page_num int, text string, section string, atomic boolean")
        return {r.id for r in chunking.chunk_pages(pages, 40, 5).collect()}

    assert run(1) == run(100)


@pytest.mark.parametrize("text", [None, "", "  \n "])
def test_texts_without_words(spark, text):
    docs = spark.createDataFrame([(1, "s", text)], "doc_id int, source string, text string")
    assert chunking.chunk_documents(docs, 10, 3).count() == 0


def test_atomic_pages_cut_the_flow(spark):
    rows = [("s", 0, 1, "a b c", "x", False), ("s", 1, 1, "T T", "y", True), ("s", 2, 2, "d e", "z", False)]
    pages = spark.createDataFrame(rows, "source string, ord int, page_num int, text string, section string, atomic boolean")
    got = sorted((r.text, r.section, r.page_start, r.page_end) for r in chunking.chunk_pages(pages, 10, 3).collect())
    assert got == [("T T", "y", 1, 1), ("a b c", "x", 1, 1), ("d e", "z", 2, 2)]
