"""Vectors in Spark columns: which of them count, and their rows packed into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: Column, zero_counts: bool) -> Column:
    """Neither null nor empty, with finite components only; and not all zero, unless that counts."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.lit(True) if zero_counts else F.exists(v, lambda x: x != 0.0)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & some, F.lit(False))


def pack_rows(rows: DataFrame, per_block: int, group: str | None = None) -> DataFrame:
    """Blocks ``(part, seq, [group,] n, ids, vecs)`` of up to ``per_block`` consecutive rows ``([group,] id, v)``.

    ``ids`` holds 64-bit integers and ``vecs`` doubles, row after row. A block holds
    vectors of one length (and of one group).
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: dict[tuple, list] = {}

        def block(key: tuple, got: list) -> tuple:
            nonlocal seq
            seq += 1
            ids = np.array([i for i, _ in got], np.int64)
            vecs = np.array([v for _, v in got], np.float64)
            return (part, seq, *key[:-1], len(ids), ids.tobytes(), vecs.tobytes())

        names = ["part", "seq", *([group] if group else []), "n", "ids", "vecs"]
        for pdf in batches:
            out = []
            groups = pdf[group] if group else [None] * len(pdf)
            for g, i, v in zip(groups, pdf["id"], pdf["v"], strict=True):
                key = ((g, len(v)) if group else (len(v),))
                got = held.setdefault(key, [])
                got.append((i, v))
                if len(got) == per_block:
                    out.append(block(key, held.pop(key)))
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([block(k, g) for k, g in held.items()], columns=names)

    extra = f"{group} {rows.schema[group].dataType.simpleString()}, " if group else ""
    return rows.mapInPandas(pack, f"part int, seq int, {extra}n int, ids binary, vecs binary")
