import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm.packing import best_fit, cut, pack_documents
from corpusloom.llm.tokens import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


TEXTS = ["", " ", "a", "Hello world's  end\n\n\tx 123", "é中\U0001f600 ß", "<|endoftext|> a<|endoftext|>b", "\x00\x01\x85 y", " " * 3000 + "q", "ab" * 4000, "'S 'll ''re"]


def test_same_ids_as_the_tokenizer(tokenizer):
    bpe = ByteBpe(PATH)
    assert bpe._fast is not None
    for t in TEXTS:
        assert bpe.encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert bpe.decode(bpe.encode(t)) == t


def check(rows, docs, tokenizer, capacity=1024):
    """Every document whole and once, within the capacity, without gaps."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert len(parts) == 1 if len(ids) <= capacity else all(r.length == capacity for r in parts[1:])
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_many_partitions(spark, tokenizer):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("the cat sat onn a mat quite".split()) for _ in range(r.choice([0, 3, 50, 400, 900, 3000])))) for i in range(300)]
    rows = pack_documents(spark.createDataFrame(docs, SCHEMA).repartition(20), PATH).collect()
    check(rows, docs, tokenizer)
    n, total = len({x.sequence_id for x in rows}), sum(x.length for x in rows)
    assert n <= 1.02 * -(-total // 1024) + 1


def test_edge_cases(spark, tokenizer):
    docs = [(1, None), (2, ""), (3, "x y " * 30_000), (4, "a")]
    rows = pack_documents(spark.createDataFrame(docs, SCHEMA), PATH).collect()
    check(rows, docs, tokenizer)
    again = pack_documents(spark.createDataFrame([(None, "a b"), (1 << 62, "a b"), (7, "q"), (7, "q")], SCHEMA), PATH).collect()
    assert sorted((str(r.doc_id) for r in again)) == [str(1 << 62), "7", "7", "None"] and len({(r.sequence_id, r.offset) for r in again}) == 4
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    clash = spark.createDataFrame([(1, "a", 5, "z")], "doc_id long, text string, piece int, node string")
    assert pack_documents(clash, PATH).count() == 1


def test_a_node_that_sends_little_up_loses_nothing(spark, tokenizer):
    docs = [(i, "word " * 700) for i in range(60)]
    check(pack_documents(spark.createDataFrame(docs, SCHEMA).repartition(9), PATH, residual=1, fan_in=2).collect(), docs, tokenizer)


def test_best_fit():
    bins = best_fit([600, 500, 424, 300, 200], 1024)
    assert [sorted(b) for b in bins] == [[0, 2], [1, 3, 4]]
    assert cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and cut(1024, 1024) == [(0, 1024)] and cut(2048, 1024) == [(0, 1024), (1024, 1024)]
