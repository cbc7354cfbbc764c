import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.packing import pack_documents
from tests.llm.test_packing import PATH, SCHEMA, check, tokenizer  # noqa: F401


@pytest.mark.parametrize("residual", [4, 10, 1000])
def test_bins_beyond_residual_still_meet_what_fills_them(spark, tokenizer, residual):  # noqa: F811
    """One partition of documents of 601 tokens, one of 401, far more bins than a node may hold."""
    docs = [(i, "word " * (600 if i < 80 else 400)) for i in range(160)]
    lengths = {len(tokenizer.encode(t).ids) for _, t in docs}
    assert max(lengths) + min(lengths) + 2 <= 1024 < 3 * min(lengths)
    frame = spark.createDataFrame(docs, SCHEMA).repartitionByRange(2, "doc_id")
    assert frame.select(F.spark_partition_id()).distinct().count() == 2
    rows = pack_documents(frame, PATH, residual=residual, fan_in=4).collect()
    check(rows, docs, tokenizer)
    assert len({r.sequence_id for r in rows}) == 80


def test_documents_that_never_fit_together_are_whole(spark, tokenizer):  # noqa: F811
    docs = [(i, "word " * 600) for i in range(60)]
    rows = pack_documents(spark.createDataFrame(docs, SCHEMA).repartition(9), public_tokenizers.path("byte_bpe_50k.json"), residual=2, fan_in=2).collect()
    check(rows, docs, tokenizer)
    assert len({r.sequence_id for r in rows}) == 60
