"""Hierarchical best-fit packing of token sequences into fixed-length training sequences.

Method. Each input partition tokenises its documents, cuts longer ones, and packs the pieces
by best fit, largest first. Nearly full bins are final. Underfull bins go up a tree that
merges so many partitions at each step: a node takes them as items of another best-fit
round, takes apart the bins that are still underfull and packs their pieces anew, and
keeps whichever of the two needs fewer bins. What counts as nearly full is relaxed at each
step; the root emits all. All underfull bins go up. So that memory is bounded, a node of more than ``fan_in`` times
``residual`` bins is split into several, to which the bins of each fill are dealt in turn, so that each
sees the same mix. A root that is split is repeated with what stays underfull, until one node holds it, or until a round takes away under a tenth of the
bins: equal mixes then hold hardly any bins that fit together, and the emptiest of all meet in a last node.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch
from corpusloom.llm.tokens import byte_bpe

_BIN = "node long, sequence_id long, done boolean, doc_id array<long>, known array<boolean>, piece array<int>, start array<long>, length array<long>, crc array<long>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items go, largest first, into the fullest bin with room for them."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in order:
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        open_bins[room].append(b)
        rooms |= 1 << room
    return bins


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which takes the rest."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def _rows(bins: list[list[tuple]], node: int, level: int, full: list[bool]) -> pd.DataFrame:
    """Bins of pieces (doc_id, whether it has one, piece, start, length, crc) as rows; a bin's id holds its level, node and number."""
    out = [(node, (level << 56) | (node << 28) | k, done, *(list(x) for x in zip(*b, strict=True))) for k, (b, done) in enumerate(zip(bins, full, strict=True))]
    return pd.DataFrame(out, columns=["node", "sequence_id", "done", "doc_id", "known", "piece", "start", "length", "crc"])


def _fill(b: list[tuple]) -> int:
    return sum(p[4] for p in b)


def _repack(bins: list[list[tuple]], capacity: int, enough: int) -> list[list[tuple]]:
    """One node: bins as items, then the pieces of those still underfull as items, if that needs fewer."""
    merged = [[p for i in group for p in bins[i]] for group in best_fit([_fill(b) for b in bins], capacity)]
    loose = [p for b in merged if _fill(b) < enough for p in b]
    kept = [b for b in merged if _fill(b) >= enough]
    anew = [[loose[i] for i in group] for group in best_fit([p[4] for p in loose], capacity)]
    return kept + anew if len(kept) + len(anew) <= len(merged) else merged


def _merger(capacity: int, enough: int, level: int, stride: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Merges the bins of one node, or of one part of a node. Ids of a node's parts lie ``stride`` apart."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence_id")
        bins = [list(zip(*r, strict=True)) for r in zip(pdf["doc_id"], pdf["known"], pdf["piece"], pdf["start"], pdf["length"], pdf["crc"], strict=True)]
        bins = [[(int(d), bool(x), int(k), int(s), int(n), int(c)) for d, x, k, s, n, c in b] for b in bins]
        bins = _repack(bins, capacity, enough)
        out = _rows(bins, int(key[0]), level, [last or _fill(b) >= enough for b in bins])
        out["sequence_id"] += int(key[1]) * stride
        return out

    return merge


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    fan_in: int = 8,
    slack: float = 0.004,
    residual: int = 20_000,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row for each piece.

    A document's tokens are the ids of its whole text and then ``end_id``. Documents of over
    ``capacity`` tokens are cut into pieces of ``capacity``, the first of which
    may be shorter; no other document is cut. ``offset`` is the piece's place in its
    sequence, without gaps; a sequence never holds over ``capacity`` tokens.

    A null or empty text is one piece with ``end_id`` alone. A null id stays null.
    Repeated rows are packed as often as they occur. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def enough(level: int) -> int:
        return max(1, round(capacity * (1 - slack * 2**level)))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, node = byte_bpe(tokenizer_path), TaskContext.get().partitionId()
        full, items = [], []
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].astype(object), pdf["text"], strict=True):
                ids = np.append(bpe.encode(text), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    p = (0 if pd.isna(doc) else int(doc), not pd.isna(doc), k, start, length, zlib.crc32(ids[start : start + length]))
                    (full if length == capacity else items).append(p)
        bins = [[p] for p in full] + [[items[i] for i in b] for b in best_fit([p[4] for p in items], capacity)]
        done = [_fill(b) >= enough(0) for b in bins]
        for at in range(0, len(bins), 20_000):
            part = _rows(bins[at : at + 20_000], node, 0, done[at : at + 20_000])
            part["sequence_id"] += at
            yield part

    packed = rows.mapInPandas(local, _BIN)
    current, level = scratch.save(packed, "level0"), 0
    nodes = (current.agg(F.max("node")).first()[0] or 0) + 1
    finals = [current.where("done")]
    limit, root, held = fan_in * residual, 0, 0
    while nodes > 1 or root:
        level += 1
        nodes = -(-nodes // fan_in)
        up = current.where("not done").withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        counts = {r["node"]: r["count"] for r in up.groupBy("node").count().collect()}
        bins_up = sum(counts.values())
        if root and 10 * bins_up > 9 * held:
            fill = F.expr("aggregate(length, 0L, (a, x) -> a + x)")
            chosen = scratch.save(up.select("sequence_id", fill.alias("fill")).orderBy("fill", "sequence_id").limit(limit).select("sequence_id"), "emptiest")
            finals.append(up.join(chosen, "sequence_id", "left_anti"))
            merge = _merger(capacity, enough(root), level, limit, True)
            left = up.join(chosen, "sequence_id", "left_semi").withColumn("part", F.lit(0).cast("long"))
            finals.append(scratch.save(left.groupBy("node", "part").applyInPandas(merge, _BIN), f"level{level}"))
            break
        split = {n: -(-k // limit) for n, k in counts.items() if k > limit}
        if nodes == 1 and split:
            root, held = root or level, bins_up
        last = nodes == 1 and not split
        up = up.withColumn("part", F.lit(0).cast("long"))
        if split:
            parts = F.coalesce(F.create_map(*(F.lit(x).cast("long") for pair in split.items() for x in pair))[F.col("node")], F.lit(1).cast("long"))
            up = up.withColumn("fill", F.expr("aggregate(length, 0L, (a, x) -> a + x)"))
            turn = F.row_number().over(Window.partitionBy("node", "fill").orderBy("sequence_id"))
            up = up.withColumn("part", F.pmod(turn + 7919 * F.col("fill"), parts)).drop("fill")
        merge = _merger(capacity, enough(root or level), level, limit + capacity + 1, last)
        current = scratch.save(up.groupBy("node", "part").applyInPandas(merge, _BIN), f"level{level}")
        finals.append(current.where("done"))
        if last:
            break
    if level == 0:
        finals = [current]
    everything = finals[0]
    for part in finals[1:]:
        everything = everything.unionByName(part)
    before = "aggregate(slice(length, 1, i), 0L, (a, x) -> a + x)"
    return (
        everything.withColumn("offset", F.expr(f"transform(length, (x, i) -> {before})"))
        .select("sequence_id", F.explode(F.arrays_zip("doc_id", "known", "piece", "start", "length", "crc", "offset")).alias("p"))
        .select(F.expr("if(p.known, p.doc_id, null)").alias("doc_id"), "p.piece", "p.start", "p.length", F.col("p.crc").alias("ids_crc32"), "sequence_id", "p.offset")
    )
