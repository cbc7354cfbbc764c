import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from corpusloom.llm import piece_sampling as ps
from corpusloom.llm.binary_shards import feistel_slots, read_shards, stride_of, write_shards
from corpusloom.llm.tokens import ByteBpe

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        for key in (1, 99):
            assert sorted(feistel_slots(np.arange(n), n, key).tolist()) == list(range(n))
    a, b = feistel_slots(np.arange(1000), 1000, 1), feistel_slots(np.arange(1000), 1000, 2)
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.1


def test_shards_give_back_the_texts(spark, tmp_path):
    docs = [(1, "Hello there, " * 200), (2, None), (3, ""), (None, "x\ny\n\n z"), (4, "é" * 700), (5, "dup"), (5, "dup")]
    path = str(tmp_path / "out")
    rows = write_shards(spark.createDataFrame(docs, SCHEMA).repartition(3), BPE, path, length=16, per_shard=10).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    records = {r.slot: r.ids for r in read_shards(spark, path, 16, with_ids=True).collect()}
    bpe = ByteBpe(BPE)
    for doc, text in docs[:3] + docs[4:5]:
        parts = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        ids = [i for r in parts for i in records[r.slot]]
        assert ids[-1] == 2 and bpe.decode(ids[:-1]) == (text or "")
        assert all(r.ids_crc32 == zlib.crc32(np.array(records[r.slot], "<u4").tobytes()) and r.n_ids == len(records[r.slot]) for r in parts)
    one = next(r for r in rows if r.doc_id == 4 and r.piece == 3)
    (file,) = (tmp_path / "out" / f"shard={one.shard}").glob("part-*")
    raw = file.read_bytes()
    assert len(raw) % stride_of(16, 2) == 0
    assert int.from_bytes(raw[one.offset : one.offset + 8], "little") == one.slot
    assert np.frombuffer(raw[one.offset + 12 : one.offset + 12 + 2 * one.n_ids], "<u2").tolist() == list(records[one.slot])


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert write_shards(spark.createDataFrame([], SCHEMA), BPE, str(tmp_path / "a")).count() == 0
    clash = spark.createDataFrame([(1, "a", 5, "z")], "doc_id long, text string, shard int, part string")
    assert write_shards(clash, BPE, str(tmp_path / "b")).count() == 1


def every(model, text):
    """All segmentations of a short text and their chances, by enumeration."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    t = ps.MARK + text.replace(" ", ps.MARK)

    def go(i):
        if i == len(t):
            yield (), 0.0
        for j in range(i + 1, len(t) + 1):
            if t[i:j] in vocab:
                ids, w = (vocab[t[i:j]],), model.weight[vocab[t[i:j]]]
            elif j == i + 1:
                ids, w = tuple(model.byte_id[b] for b in t[i:j].encode()), model.byte_weight * len(t[i:j].encode())
            else:
                continue
            yield from ((ids + rest, w + x) for rest, x in go(j))

    found = dict(go(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {ids: w - total for ids, w in found.items()}


def test_samples_follow_the_distribution():
    model = ps.piece_model(PIECES, 0.15)
    for text in ("ab it", "qé\nz"):
        chances = every(model, text)
        n = 6000
        got = ps.sample_texts(model, [text] * n, np.arange(1, n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
        first, second = Counter(tuple(x[0][0].tolist()) for x in got), Counter(tuple(tuple(y[0].tolist()) for y in x[:2]) for x in got)
        for ids, p in chances.items():
            assert abs(first[ids] / n - math.exp(p)) < 0.03
        for (a, b), c in second.most_common(5):
            expected = math.exp(chances[a]) * math.exp(chances[b]) / (1 - math.exp(chances[a]))
            assert abs(c / n - expected) < 0.03
        for x in got:
            assert len({tuple(y[0].tolist()) for y in x}) == len(x) == min(3, len(chances))
            assert all(abs(y[1] - chances[tuple(y[0].tolist())]) < 1e-6 for y in x) and [y[2] for y in x] == sorted((y[2] for y in x), reverse=True)
        if len(chances) > 3:  # inclusion scores weigh the samples to one on average
            assert abs(np.mean([sum(math.exp(y[1] - y[3]) for y in x) for x in got]) - 1) < 0.1


def test_round_trip_and_edge_cases(spark):
    texts = ["", None, " ", "  lead and trail  ", "é中\U0001f600\n\tß", "a" * 5000, "word " * 3000, "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "same"), (3, texts[3])]
    out = ps.sample_segmentations(spark.createDataFrame(rows, SCHEMA), PIECES, k=2)
    got = out.collect()
    assert all(r.round_trip for r in got)
    assert sum(r.doc_id in (0, 1) for r in got) == 2
    three = [r for r in got if r.doc_id == 3]
    assert len(three) == 4 and len({r.ids_crc32 for r in three}) == 2
    decoded = ps.decode_segmentations(out, PIECES).select("doc_id", "decoded").collect()
    assert {r.decoded for r in decoded if r.doc_id == 4} == {texts[4]}
    assert ps.sample_segmentations(spark.createDataFrame([], SCHEMA), PIECES).count() == 0
    clash = spark.createDataFrame([(1, "a", 5, "z")], "doc_id long, text string, sample int, ids string")
    assert ps.sample_segmentations(clash, PIECES).count() >= 1


def test_samples_depend_on_the_row_alone(spark):
    rows = [(i, f"some words of text {i} again") for i in range(50)]
    key = lambda df: sorted((r.doc_id, r.sample, r.ids_crc32) for r in ps.sample_segmentations(df, PIECES, with_ids=False).collect())
    assert key(spark.createDataFrame(rows, SCHEMA).coalesce(1)) == key(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7))


def test_others_of_an_edge_by_brute_force():
    """However unlikely the others are; a lone edge has none."""
    for alpha in (1.0, 6.0, 40.0):
        model = ps.piece_model(PIECES, alpha)
        model.of(["some words of a text and others", "x"])
        edges = np.arange(model.n_edges)
        for e, got in zip(edges, model.beside(edges), strict=True):
            others = [math.log(model.chance[x]) for x in model.edges_beside(e) if x != e]
            expected = np.logaddexp.reduce(others) if others else -np.inf
            assert got == expected or abs(got - expected) < 1e-6


def test_long_texts_and_unlikely_segmentations():
    """A text over the size that is taken together, and one whose other segmentations are all very unlikely."""
    model = ps.piece_model(PIECES, 8.0)
    long = "some words of text " * 60_000
    assert len(long) > ps.TOGETHER
    (rows,) = ps.sample_texts(model, [long], np.array([5], np.uint64), 3)
    assert len({tuple(x[0].tolist()) for x in rows}) == 3 and all(model.decode(x[0]) == long for x in rows)
    sharp = ps.piece_model(PIECES, 60.0)
    for text in ("the", "the of", "in"):
        (rows,) = ps.sample_texts(sharp, [text], np.array([3], np.uint64), 3)
        (many,) = ps.sample_texts(model, [text], np.array([3], np.uint64), 3)
        assert len(rows) == len(many) == len({tuple(x[0].tolist()) for x in rows})


def test_the_query_gives_four_whole_segmentations_of_each_text(spark):
    from corpusloom.llm.queries import QUERIES

    data = "/root/testdata/sf0.001"
    got = QUERIES["op4_sentencepiece_sampling"](spark, data)
    texts = {r.doc_id: r.text.replace(ps.MARK, " ") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    samples = {}
    for r in ps.decode_segmentations(got, PIECES).collect():
        assert r.decoded == texts[r.doc_id] and r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        samples.setdefault(r.doc_id, []).append(tuple(r.ids))
    assert samples.keys() == texts.keys() and all(len(set(x)) == len(x) == 4 for x in samples.values())
