import random
import zlib

from corpusloom.llm.sharding import LARGE, place_groups, shard_by_bytes

SCHEMA = "doc_id long, text string"


def check(rows, docs, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t in docs)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return {s: sum(r.size for r in rows if r.shard == s) for s in slots}


def test_near_equal_sizes(spark):
    r = random.Random(1)
    docs = [(i, "x" * r.choice([0, 10, 100, 500, 900])) for i in range(3000)]
    docs = [(i, t + str(i)) if i % 3 else (i, t) for i, t in docs]  # a third are copies
    sizes = check(shard_by_bytes(spark.createDataFrame(docs, SCHEMA), 7).collect(), docs, 7)
    mean = sum(sizes.values()) / 7
    assert len(sizes) == 7 and all(abs(x - mean) <= 0.02 * mean + 1000 for x in sizes.values())


def test_groups_of_copies_stay_whole_where_small(spark):
    docs = [(i, f"text {i // 4} " + "y" * 50) for i in range(4000)]
    rows = shard_by_bytes(spark.createDataFrame(docs, SCHEMA), 10).collect()
    check(rows, docs, 10)
    of = {}
    for r in rows:
        of.setdefault(r.doc_id // 4, set()).add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_one_text_only(spark):
    docs = [(i, "same") for i in range(1000)]
    sizes = check(shard_by_bytes(spark.createDataFrame(docs, SCHEMA), 4).collect(), docs, 4)
    assert sorted(sizes.values()) == [250 * 20] * 4


def test_edge_cases(spark):
    docs = [(None, None), (None, "a"), (1, ""), (1, ""), (2, "z" * 100_000), (3, None)]
    check(shard_by_bytes(spark.createDataFrame(docs, SCHEMA), 40).collect(), docs, 40)
    assert shard_by_bytes(spark.createDataFrame([], SCHEMA), 40).count() == 0
    clash = spark.createDataFrame([(1, "a", 5, "z")], "doc_id long, text string, size int, range string")
    assert shard_by_bytes(clash, 2).count() == 1


def test_groups_of_all_sizes_stay_whole_if_a_shard_can_hold_them(spark):
    r = random.Random(3)
    docs, k = [], 0
    for g, copies in enumerate([1] * 1500 + [3] * 200 + [20] * 30 + [60] * 6 + [150] * 2 + [700]):
        text = f"text {g} " + "z" * r.choice([10, 60, 90])
        for _ in range(copies):
            docs.append((k, text))
            k += 1
    r.shuffle(docs)
    rows = shard_by_bytes(spark.createDataFrame(docs, SCHEMA).repartition(5), 8).collect()
    sizes = check(rows, docs, 8)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(x - mean) <= mean / LARGE + 120 for x in sizes.values())
    text_of, of = dict(docs), {}
    for x in rows:
        of.setdefault(text_of[x.doc_id], set()).add(x.shard)
    bytes_of = {}
    for _, t in docs:
        bytes_of[t] = bytes_of.get(t, 0) + len(t) + 16
    assert [t for t, s in of.items() if len(s) > 1] == [t for t, b in bytes_of.items() if b > mean]


def test_groups_are_placed_by_brute_force():
    """Against a plain search for the shard with most room, row by row for groups that fit nowhere."""
    groups = [(g, s * n, n) for g, (s, n) in enumerate([(10, 30), (7, 50), (100, 1), (5, 400), (1, 90), (10, 30)])]
    pieces, room = place_groups(groups, 4, 800.0)
    left, plain = [800.0] * 4, {}
    for g, size, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        at, each = 0, size / n
        while at < n:
            s = max(range(4), key=lambda i: (left[i], -i))
            take = n - at if left[s] >= (n - at) * each else max(1, int(left[s] // each))
            for k in range(at, at + take):
                plain[g, k] = s
            left[s] -= take * each
            at += take
    assert {(g, k): s for g, a, b, s in pieces for k in range(a, b)} == plain and all(abs(x - y) < 1e-6 for x, y in zip(room, left, strict=True))


def test_repeated_rows_are_divided_between_ranges(spark):
    docs = [(1, "the same row")] * 3000 + [(i, f"other {i}") for i in range(1500)]
    sizes = check(shard_by_bytes(spark.createDataFrame(docs, SCHEMA), 5).collect(), docs, 5)
    assert max(sizes.values()) - min(sizes.values()) <= 100
