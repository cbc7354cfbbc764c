"""Sharding by sampled splitters.

Method. Rows are ordered by the hash of their text and then by a hash of their id, so that equal texts lie together.
A sample drawn in proportion to size gives quantile boundaries, which range-partition the records into
many more ranges than shards; a text's copies are divided by boundaries like any other rows. The ranges' exact bytes and rows are then
summed; each range orders its rows, and a row's place among all bytes follows from the sums of the ranges before its own.
Shards take even parts of that line: a range that is overfull for its shard is so subdivided between shards.

Groups of equal texts stay whole as long as sizes stay near equal. The large ones (``1 / LARGE`` of a shard or more, so at most ``LARGE`` for each
shard) are taken off the line and given whole, largest first, to the shard with most room; only one that no shard has room for is
divided. Shards then take of the line what room they have left. A small group that such a cut would divide goes whole to the shard of its middle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch

#: Ranges and large groups for each shard, sampled rows for each range.
RANGES, LARGE, SAMPLED = 32, 64, 64
_RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def place_groups(groups: list[tuple[int, int, int]], shards: int, target: float) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """Pieces ``(group, first row, end, shard)`` of groups ``(group, bytes, rows)``, and the room left in each shard.

    The largest group goes first, whole if the shard with most room can hold it; else rows go to whichever shard has most room at a time.
    """
    room = [(-target, s) for s in range(shards)]
    heapq.heapify(room)
    pieces = []
    for g, size, rows in sorted(groups, key=lambda x: (-x[1], x[0])):
        each, at = size / rows, 0
        while at < rows:
            left, s = heapq.heappop(room)
            many = min(rows - at, max(1, int(-left / each + 1e-9)))
            pieces.append((g, at, at + many, s))
            heapq.heappush(room, (left + many * each, s))
            at += many
    return pieces, [-left for left, _ in sorted(room, key=lambda x: x[1])]


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row for each row of ``docs``.

    The law is ``bytes``: sizes (UTF-8 bytes of the text plus ``overhead``) of shards 0 to ``shards - 1`` are near
    equal: they differ by a row or by ``1 / LARGE`` of a shard. A group of equal texts lies in one shard unless no shard has room for all of it.
    ``slot`` numbers a shard's rows from 0 without gaps. ``grown_shard`` is null, as it belongs to another law.

    A null text counts no bytes, has the crc32 of no bytes, 0, and is equal to an empty one. A null id is an id like others.
    Repeated rows are sharded as often as they occur, in any order among themselves. With fewer rows than shards some
    shards are empty; an empty table gives no rows. Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("there must be one shard or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # rows that repeat an id differ in the lower bits of their tie, so that boundaries can lie between them
    tie = F.shiftleft(F.shiftright(F.xxhash64(F.col(id_col).cast("long"), F.lit(5)), 24), 24).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 24) - 1)))
    sized = scratch.save(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            tie.alias("tie"),
        ),
        "sized",
    )
    total, n = sized.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return sized.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

    # at most LARGE groups for each shard
    target = total / shards
    large = [(r.h, r.b, r.n) for r in sized.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("b") * LARGE >= target)).collect()]

    ranges = shards * RANGES
    step = max(1, total // (ranges * SAMPLED))
    # drawn in proportion to size, by a hash of the row rather than by chance, so that a retried task draws alike
    luck = F.pmod(F.xxhash64("h", "tie", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn = sized.where(luck * step < F.col("size")).groupBy("h", "tie").agg(F.sum(F.greatest("size", F.lit(step))).alias("w")).collect()
    drawn = sorted((r.h, r.tie, r.w) for r in drawn)
    cum = list(accumulate(w for _, _, w in drawn))
    cuts = sorted({drawn[int(np.searchsorted(cum, cum[-1] * i / ranges))][:2] for i in range(1, ranges)}) if drawn else []
    cut_h = np.array([h for h, _ in cuts], np.int64)
    cut_tie = np.array([t for _, t in cuts], np.int64)

    def in_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, t = pdf["h"].to_numpy(np.int64), pdf["tie"].to_numpy(np.int64)
            lo, hi = np.searchsorted(cut_h, h, "left"), np.searchsorted(cut_h, h, "right")
            at = lo.copy()
            for k in np.unique(lo[lo < hi]):  # texts of a boundary: their ties decide
                own = np.flatnonzero((lo == k) & (lo < hi))
                at[own] = k + np.searchsorted(cut_tie[k : hi[own[0]]], t[own], "right")
            yield pdf.assign(range=at)

    taken = spark.createDataFrame([(h, True) for h, _, _ in large], "h long, large boolean")
    ranged = scratch.save(
        sized.mapInPandas(in_range, "doc_id long, size long, text_crc32 long, h long, tie long, range long")
        .join(F.broadcast(taken), "h", "left")
        .withColumn("small", F.when(F.col("large"), 0).otherwise(1))
        .drop("large"),
        "ranged",
    )
    # a row for each range
    sums = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.count("*"), F.sum("small"), F.sum(F.col("small") * F.col("size"))).collect())
    before = list(accumulate(sums, lambda a, b: (b[0], *(x + y for x, y in zip(a[1:], b[1:], strict=True))), initial=(None, 0, 0, 0)))
    before = spark.createDataFrame([(s[0], *b[1:]) for s, b in zip(sums, before, strict=False)], "range long, rows0 long, small0 long, bytes0 long")

    run = Window.partitionBy("range").orderBy("h", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = scratch.save(
        ranged.join(F.broadcast(before), "range")
        .withColumn("row", F.col("rows0") + F.count("*").over(run) - 1)
        .withColumn("nth", F.col("small0") + F.sum("small").over(run) - 1)
        .withColumn("from", F.col("bytes0") + F.sum(F.col("small") * F.col("size")).over(run) - F.col("size"))
        .select("doc_id", "size", "text_crc32", "h", "small", "row", "nth", "from"),
        "placed",
    )
    pieces, room = place_groups(large, shards, target)
    room = np.maximum(np.array(room), 0)
    rest = total - sum(b for _, b, _ in large)
    ends = np.cumsum(room * (rest / max(room.sum(), 1e-9)))[:-1].tolist()

    def part(at):
        """Which part of the line a place is in: the number of cuts at or before it."""
        return F.size(F.filter(F.array(*map(F.lit, ends)).cast("array<double>"), lambda c: c <= at)).cast("int")

    line = placed.where("small = 1")
    middle = F.col("from") + F.col("size") / 2
    # the groups in which the cuts lie: one for each cut
    cut_by = [r.h for r in line.where(part(F.col("from")) < part(F.col("from") + F.col("size"))).select("h").distinct().collect()]
    cut_by = line.join(F.broadcast(spark.createDataFrame([(h,) for h in cut_by], "h long")), "h").groupBy("h").agg(F.min("from").alias("g0"), F.max(F.col("from") + F.col("size")).alias("g1"))
    whole = cut_by.where(F.col("g1") - F.col("g0") <= target / LARGE + F.lit(overhead)).select("h", part((F.col("g0") + F.col("g1")) / 2).alias("kept")).collect()
    whole = spark.createDataFrame([tuple(r) for r in whole], "h long, kept int")
    line = line.join(F.broadcast(whole), "h", "left").withColumn("shard", F.coalesce("kept", part(middle)))
    small = {r.shard: (r.first, r.n) for r in line.groupBy("shard").agg(F.min("nth").alias("first"), F.count("*").alias("n")).collect()}
    first = spark.createDataFrame([(s, f) for s, (f, _) in small.items()], "shard int, first long")
    result = [line.join(F.broadcast(first), "shard").withColumn("slot", F.col("nth") - F.col("first"))]
    if large:
        groups = placed.where("small = 0")
        rows0 = {r.h: r.row0 for r in groups.groupBy("h").agg(F.min("row").alias("row0")).collect()}
        held = {s: k for s, (_, k) in small.items()}
        table = []
        for h, a, b, s in pieces:
            table.append((h, rows0[h] + a, rows0[h] + b, s, held.get(s, 0)))
            held[s] = held.get(s, 0) + b - a
        table = spark.createDataFrame(table, "h long, a long, b long, shard int, base long")
        result.append(groups.join(F.broadcast(table), "h").where("row >= a and row < b").withColumn("slot", F.col("base") + F.col("row") - F.col("a")))
    result = [r.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")) for r in result]
    return result[0] if len(result) == 1 else result[0].unionByName(result[1])
