"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

Method. Overlapping heuristic labellers look at a whole text and vote good, junk, or nothing. Votes of all documents
are counted by pattern (three to the power of the labellers at most); expectation-maximisation over these counts estimates each
labeller's accuracy without any gold label. The posterior labels of a bounded sample of documents then train
a linear scorer over hashed word shapes and text statistics, which scores every document.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch
from corpusloom.llm.label_model import ABSTAIN, NEGATIVE, POSITIVE, LinearScorer, fit_label_model, fit_linear

DIMS = 1 << 14
#: Documents that train the scorer, at most about so many.
TRAIN_ROWS = 20_000

SYMBOLS, SHOUT, BARE, BANG, STOP, LETTERS = (1 << (16 + i) for i in range(6))
_RUN = re.compile(r"[#$%&*~^=+<>|@\\]{2,}")


class _Shapes(dict):
    """What is known of a word: its hashed shape in the low bits, and flags above them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        shape, last = [], ""
        for ch in word:
            kind = "X" if ch.isupper() else "x" if ch.isalpha() else "9" if ch.isdigit() else ch
            if kind != last:
                shape.append(kind)
            last = kind
        letters = sum(map(str.isalpha, word))
        known = xxhash.xxh32_intdigest("".join(shape)) % (DIMS // 2)
        known |= SYMBOLS if _RUN.search(word) else 0
        known |= SHOUT if letters > 1 and word == word.upper() and word != word.lower() else 0
        known |= 0 if any(map(str.isalnum, word)) else BARE
        known |= BANG if word.endswith("!!") else 0
        known |= STOP if word[-1] in ".!?" else 0
        known |= LETTERS if 2 * letters >= len(word) else 0
        if len(word) <= 64:  # longer words hardly ever recur
            self[word] = known
        return known


_shapes = _Shapes()

#: Statistic, good if within these, junk if outside those.
LABELLERS = (
    ("symbols", (0, 0.03), (0, 0.15)),
    ("shout", (0, 0.1), (0, 0.5)),
    ("repeats", (0, 0.05), (0, 0.25)),
    ("bare", (0, 0.03), (0, 0.15)),
    ("bangs", (0, 0.05), (0, 0.25)),
    ("letters", (0.9, 1), (0.7, 1)),
    ("growth", (0.75, 1), (0.55, 1)),
    ("lines", (0, 0.35), (0, 0.6)),
    ("stops", (0.02, 0.4), (0, 0.7)),
)


def statistics(text: str) -> tuple[dict[str, float], np.ndarray]:
    """The labellers' statistics of a whole text, and its words' shapes."""
    words = text.split()
    n = len(words)
    known = np.fromiter(map(_shapes.__getitem__, words), np.int64, n)
    flags = [float(np.count_nonzero(known & f)) / max(n, 1) for f in (SYMBOLS, SHOUT, BARE, BANG, STOP, LETTERS)]
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "symbols": flags[0],
        "shout": flags[1],
        "repeats": sum(map(operator.eq, words, words[1:])) / max(n - 1, 1),
        "bare": flags[2],
        "bangs": flags[3],
        "stops": flags[4] if n >= 10 else 0.1,  # a few words may well end a sentence each
        "letters": flags[5],
        "growth": math.log(len(set(words))) / math.log(n) if n > 20 else 1.0,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) > 2 else 0.0,
        "words": n,
    }, known & 0xFFFF


def votes(stats: dict[str, float]) -> int:
    """One base-3 digit for each labeller. Texts of under three words get no votes."""
    code = 0
    for name, good, fair in LABELLERS:
        x = stats[name]
        vote = ABSTAIN if stats["words"] < 3 else POSITIVE if good[0] <= x <= good[1] else ABSTAIN if fair[0] <= x <= fair[1] else NEGATIVE
        code = code * 3 + vote
    return code


def features(stats: dict[str, float], shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, and steps of each statistic."""
    idx, val = [], []
    if len(shapes):
        kinds, many = np.unique(shapes, return_counts=True)
        # shares of a few words say little, so they shrink towards none
        idx, val = list(kinds), list(many / (len(shapes) + 8))
    for name, _, _ in LABELLERS:
        idx.append(DIMS // 2 + xxhash.xxh32_intdigest(name) % (DIMS // 2))
        val.append(stats[name])
        idx.append(DIMS // 2 + xxhash.xxh32_intdigest(f"{name}:{min(10, int(stats[name] * 10))}") % (DIMS // 2))
        val.append(0.5)
    return np.array(idx, np.int32), np.array(val, np.float32)


def fit_quality(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> LinearScorer:
    """A scorer of the chance that a text is good. It reads the whole text of all rows; training keeps about ``train_rows``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    n = max(1, docs.count())
    step = 1 << 30
    chosen = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(step)) < int(step * min(1.0, train_rows / n))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, wanted in zip(pdf["text"], pdf["wanted"], strict=True):
                stats, shapes = statistics(text)
                idx, val = features(stats, shapes) if wanted else (None, None)
                out.append((votes(stats), idx.tobytes() if wanted else None, val.tobytes() if wanted else None))
            yield pd.DataFrame(out, columns=["code", "idx", "val"])

    seen = scratch.save(texts.withColumn("wanted", chosen).mapInPandas(look, "code long, idx binary, val binary"), "votes")
    patterns = seen.groupBy("code").count().collect()
    k = len(LABELLERS)
    digits = lambda code: [code // 3 ** (k - 1 - j) % 3 for j in range(k)]
    table = np.array([digits(r["code"]) for r in patterns], np.int64).reshape(-1, k)
    many = np.array([r["count"] for r in patterns], float)
    start = np.where((table == NEGATIVE).any(axis=1), 0.1, 0.9)
    model = fit_label_model(table, many, start)
    label = dict(zip((r["code"] for r in patterns), model.posterior(table), strict=True))
    sample = seen.where("idx is not null").limit(2 * train_rows).collect()
    rows = [(np.frombuffer(r.idx, np.int32), np.frombuffer(r.val, np.float32)) for r in sample]
    target = np.array([label[r.code] for r in sample])
    return fit_linear(rows, target, DIMS)


def with_quality(docs: DataFrame, scorer: LinearScorer, column: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the score of each row's whole text as ``column``; texts that are null, or without words, get 0."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            stats, shapes = statistics(text) if text else ({"words": 0}, None)
            out.append(scorer.score(*features(stats, shapes)) if stats["words"] else 0.0)
        return pd.Series(out, dtype="float64")

    return docs.withColumn(column, score(F.col(text_col).cast("string")))


def classify_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, keep)``, one row for each row of ``docs``: the chance of being good, and whether it is 0.5 or more.

    Texts that are null or empty, or hold no words, score 0 and aren't kept. Repeated rows score alike. Null ids stay null.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_quality(rows, fit_quality(rows), "score")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).alias("keep"))
