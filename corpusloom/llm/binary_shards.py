"""Token sequences in training order: fixed-stride binary shards behind a keyed permutation.

Method. Documents are tokenised once; their sequences get consecutive numbers from the exact counts of
the input's partitions. A keyed Feistel network over the smallest even number of bits that holds all numbers permutes them; cycle
walking applies it again while a result lies outside, so every sequence gets its own slot out of exactly so many.
Slots are range-partitioned over shards; a shard is one file of records of one length, in slot order. Any reader
finds slot s at byte ``(s % per_shard) * stride`` of shard ``s // per_shard``, so reading is sequential, and resumes at any slot.

A record is the slot (8 bytes), the number of ids (4 bytes), the ids (2 bytes each, or 4 if the vocabulary needs them) padded
with zeros, all little-endian, and one byte, 0x0A, that ends it. Files are written by Spark's own text
writer, which puts raw bytes and that end mark, so that they reach any store Spark reaches, by its commit protocol.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch
from corpusloom.llm.shingles import mix
from corpusloom.llm.tokens import byte_bpe

_HEAD = struct.Struct("<qi")
#: Ids of a block, which is compressed as one, and whose part for each shard is.
BLOCK_IDS = 4_000_000


def feistel_slots(numbers: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """The slots, out of n, of sequence numbers below n: a keyed permutation."""
    bits = max(2, int(n - 1).bit_length() if n > 1 else 1)
    half = np.uint64((bits + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))
    x = numbers.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def stride_of(length: int, width: int) -> int:
    return _HEAD.size + length * width + 1


def _records(blob: bytes, length: int, width: int, size: np.ndarray) -> np.ndarray:
    """Padded ids of sequences stored one after the other."""
    ids = np.frombuffer(blob, f"<u{width}")
    out = np.zeros((len(size), length), f"<u{width}")
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
    out[row, col] = ids
    return out


def write_shards(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 256,
    key: int = 20_240_601,
    end_id: int = 2,
    per_shard: int = 16_384,
    width: int = 2,
    waves: int = 4,
) -> DataFrame:
    """Writes the shards below ``path`` and returns ``(doc_id, piece, n_ids, ids_crc32, slot, shard, offset)``, a row for each sequence.

    A document's ids, with ``end_id`` after them, are cut into sequences of ``length``; the last may be shorter. ``path`` gets one
    folder ``shard=N`` for each shard, with one file in it, in so many ``waves``. The permutation depends on ``key`` and the number of sequences alone.

    A null or empty text is one sequence with ``end_id`` alone. Null ids stay null; repeated rows are written as often as they
    occur. An empty table writes nothing and gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of sequences: their documents, pieces and lengths, and all ids, compressed."""
        bpe, part, first = byte_bpe(tokenizer_path), TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=6)
        doc, known, piece, size, ids, held = [], [], [], [], [], 0

        def block() -> tuple:
            nonlocal first, held
            row = (part, first, len(doc), np.array(doc, "<i8").tobytes(), bytes(known), np.array(piece, "<i4").tobytes(), np.array(size, "<i4").tobytes(), pack.compress(np.concatenate(ids).tobytes()))
            first += len(doc)
            held = 0
            for x in (doc, known, piece, size, ids):
                x.clear()
            return row

        names = ["part", "first", "n", "doc", "known", "piece", "size", "ids"]
        for pdf in batches:
            for d, text in zip(pdf["doc_id"].astype(object), pdf["text"], strict=True):
                got = np.append(bpe.encode(text), np.uint32(end_id))
                if width == 2 and int(got.max()) > 0xFFFF:
                    raise ValueError("ids need four bytes: pass width=4")
                ids.append(got.astype(f"<u{width}"))
                for k, s in enumerate(range(0, len(got), length)):
                    doc.append(0 if pd.isna(d) else int(d))
                    known.append(not pd.isna(d))
                    piece.append(k)
                    size.append(min(length, len(got) - s))
                held += len(got)
                if held > BLOCK_IDS:
                    yield pd.DataFrame([block()], columns=names)
        if doc:
            yield pd.DataFrame([block()], columns=names)

    schema = "part int, first long, n int, doc binary, known binary, piece binary, size binary, ids binary"
    blocks = scratch.save(rows.mapInPandas(tokenise, schema), "tokens")
    counts = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    total, before = 0, {}
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    shards = max(1, -(-total // per_shard))

    def route(batches: Iterator[pd.DataFrame], low: int, high: int) -> Iterator[pd.DataFrame]:
        """The sequences of a block for each shard of a wave, with their slots."""
        pack, unpack = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                size = np.frombuffer(r.size, "<i4").astype(np.int64)
                ids = np.frombuffer(unpack.decompress(r.ids), f"<u{width}")
                slot = feistel_slots(np.arange(r.n) + before[r.part] + r.first, total, key)
                start = np.cumsum(size) - size
                order = np.argsort(slot)
                order = order[(slot[order] >= low * per_shard) & (slot[order] < high * per_shard)]
                shard = slot[order] // per_shard
                out = []
                for s in np.unique(shard):
                    at = order[shard == s]
                    row = np.repeat(start[at] - (np.cumsum(size[at]) - size[at]), size[at]) + np.arange(int(size[at].sum()))
                    out.append((int(s), len(at), slot[at].tobytes(), size[at].astype("<i4").tobytes(), pack.compress(ids[row].tobytes())))
                yield pd.DataFrame(out, columns=["shard", "n", "slot", "size", "ids"])

    def lay(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A shard's records in slot order."""
        unpack = zstandard.ZstdDecompressor()
        slots, rows = [], []
        for r in pdf.itertuples(index=False):
            slots.append(np.frombuffer(r.slot, np.int64))
            size = np.frombuffer(r.size, "<i4").astype(np.int64)
            rec = np.zeros((r.n, stride_of(length, width) - 1), np.uint8)
            rec[:, :8] = slots[-1].astype("<i8").view(np.uint8).reshape(-1, 8)
            rec[:, 8:12] = size.astype("<i4").view(np.uint8).reshape(-1, 4)
            rec[:, 12:] = _records(unpack.decompress(r.ids), length, width, size).view(np.uint8)
            rows.append(rec)
        order = np.argsort(np.concatenate(slots))
        rows = np.concatenate(rows)[order]
        # one row for the whole shard: inner records end with the mark here, the last by the writer
        whole = np.full((len(rows), stride_of(length, width)), 10, np.uint8)
        whole[:, :-1] = rows
        return pd.DataFrame({"shard": [int(key[0])], "records": [whole.tobytes()[:-1]]})

    # in waves, so that only a part of the ids is in shuffle files at a time, and a wave that is written stays so
    sent = blocks.select("part", "first", "n", "size", "ids")
    for wave in range(waves):
        low, high = shards * wave // waves, shards * (wave + 1) // waves
        if low < high or wave == 0:
            routed = sent.mapInPandas(functools.partial(route, low=low, high=high), "shard long, n int, slot binary, size binary, ids binary")
            records = routed.repartition(max(1, high - low), "shard").groupBy("shard").applyInPandas(lay, "shard long, records binary")
            out = records.select("shard", F.col("records").cast("string").alias("records")).write.mode("append" if wave else "overwrite")
            out.partitionBy("shard").option("lineSep", "\n").text(path)
            scratch.release()
    written = read_shards(spark, path, length, width)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                doc, known = np.frombuffer(r.doc, "<i8"), np.frombuffer(r.known, np.uint8).astype(bool)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series(doc, dtype="Int64").where(known),
                        "piece": np.frombuffer(r.piece, "<i4"),
                        "slot": feistel_slots(np.arange(r.n) + before[r.part] + r.first, total, key),
                    }
                )

    names = blocks.select("part", "first", "n", "doc", "known", "piece").mapInPandas(named, "doc_id long, piece int, slot long")
    return names.join(written, "slot").select(
        "doc_id",
        "piece",
        "n_ids",
        "ids_crc32",
        "slot",
        F.floor(F.col("slot") / per_shard).cast("long").alias("shard"),
        (F.pmod("slot", F.lit(per_shard)) * stride_of(length, width)).cast("long").alias("offset"),
    )


def read_shards(spark: SparkSession, path: str, length: int, width: int = 2, with_ids: bool = False) -> DataFrame:
    """``(slot, n_ids, ids_crc32[, ids])`` of every record below ``path``; ids are counted as unsigned 32-bit ones in the crc."""
    stride = stride_of(length, width)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                data = np.frombuffer(content, np.uint8)
                if len(data) % stride or (data[stride - 1 :: stride] != 10).any():
                    raise ValueError("a shard isn't whole records")
                data = data.reshape(-1, stride)
                slot = data[:, :8].copy().view("<i8").ravel()
                size = data[:, 8:12].copy().view("<i4").ravel()
                ids = data[:, 12:-1].copy().view(f"<u{width}").astype("<u4")
                out = {"slot": slot, "n_ids": size, "ids_crc32": [zlib.crc32(x[:n].tobytes()) for x, n in zip(ids, size, strict=True)]}
                if with_ids:
                    out["ids"] = [x[:n].astype(np.int64) for x, n in zip(ids, size, strict=True)]
                yield pd.DataFrame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(parse, "slot long, n_ids int, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
