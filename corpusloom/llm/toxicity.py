"""Toxicity classifier: a generative label model over many voters trains a hashed linear classifier.

Method. From a bounded sample of labelled rows, words and word beginnings that go with the label are gathered
and dealt by hash into many lexicon voters; pattern voters (letters replaced by symbols, drawn-out letters, shouted
or repeated lexicon words) stand beside them. A generative model with expectation-maximisation estimates
the voters' accuracies, and from what remains of their correlation within the classes, how far they repeat each
other. Its posterior labels train a sparse linear classifier over hashed words and word beginnings, and over those of them that make
up a share of the text's words; its intercept is set by the labels of the same rows. It scores whole texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch
from corpusloom.llm.label_model import NEGATIVE, POSITIVE, LabelModel, fit_label_model, fit_linear

#: Labelled rows that the fit reads at most, voters from words and from word beginnings.
TRAIN_ROWS, LEXICONS, BEGINNINGS = 20_000, 24, 8
#: A feature is dense in a text if so many of its words have it, and so large a share of them; what tells its hash from the plain feature's.
DENSE_WORDS, DENSE_SHARE, DENSE = 2, 0.01, 0x2A5B6C7D8E9F1031
#: Lengths of word beginnings that are features beside the word.
PREFIXES = (3, 4, 5, 6, 7)

_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’…–—¡¿"
# Symbols that stand for letters.
_AS_LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_DRAWN = re.compile(r"(.)\1{2,}")
_PATTERNS = ("masked", "drawn", "shouted", "several")


def word_features(word: str) -> list[int]:
    """The hashed features of a word, without the marks around it: itself, then its beginnings."""
    w = word.strip(_EDGE).lower()
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in (w, *(f"^{w[:k]}" for k in PREFIXES if len(w) > k))] if w else []


class _Features(dict):
    """Features of the words met lately."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 50_000:
            self.clear()
        self[word] = tuple(word_features(word))
        return self[word]


_features = _Features()


def is_dense(count: int, words: int) -> bool:
    return count >= DENSE_WORDS and count >= DENSE_SHARE * words


def features(text: str) -> np.ndarray:
    """The distinct hashed features of a whole text, and once more those that are dense in it."""
    words = Counter(text.split())
    total = sum(words.values())
    found: dict[int, int] = defaultdict(int)
    for word, many in words.items():
        for f in _features[word]:
            found[f] += many
    dense = [f ^ DENSE for f, many in found.items() if is_dense(many, total)]
    return np.fromiter((*found, *dense), np.int64, len(found) + len(dense))


@dataclass
class ToxicityModel:
    weights: dict[int, float]
    bias: float
    voters: LabelModel | None = None
    names: tuple[str, ...] = ()

    def scorer(self):
        """A function from a whole text to its score; made once for each copy of the model."""
        if "_score" in self.__dict__:
            return self.__dict__["_score"]
        weights, bias = self.weights, self.bias
        cache: dict[str, tuple] = {}
        nothing: tuple = ()

        def known(word: str) -> tuple:
            got = cache.get(word)
            if got is None:
                if len(cache) > 200_000:
                    cache.clear()
                forms = {word, word.translate(_AS_LETTERS), _DRAWN.sub(r"\1", word)}
                hits = {f for x in forms for f in word_features(x) if f in weights or f ^ DENSE in weights}
                got = cache[word] = tuple(hits) if hits else nothing
            return got

        def score(text: str | None) -> float:
            words = Counter((text or "").split())
            count: dict[int, int] = {}
            for word, many in words.items():
                for f in known(word):
                    count[f] = count.get(f, 0) + many
            z = bias
            if count:
                total = sum(words.values())
                for f, many in count.items():
                    z += weights.get(f, 0.0)
                    if f ^ DENSE in weights and is_dense(many, total):
                        z += weights[f ^ DENSE]
            return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        self.__dict__["_score"] = score
        return score


def _votes(text_words: list[str], counted: set[int], lexicon: dict[int, int], prefix_lexicon: dict[int, int]) -> list[int]:
    """One vote for each voter: a hit is positive, its absence negative."""
    cast = [NEGATIVE] * (LEXICONS + BEGINNINGS + len(_PATTERNS))
    for f in counted:
        if f in lexicon:
            cast[lexicon[f]] = POSITIVE
        elif f in prefix_lexicon:
            cast[LEXICONS + prefix_lexicon[f]] = POSITIVE
    at = LEXICONS + BEGINNINGS
    hits = 0
    for w in set(text_words):
        own = _features[w]
        if own and own[0] in lexicon:
            hits += 1
            if len(w) > 2 and w == w.upper() != w.lower():
                cast[at + 2] = POSITIVE
        else:
            for k, form in ((0, w.translate(_AS_LETTERS)), (1, _DRAWN.sub(r"\1", w))):
                if form != w and (fs := _features[form]) and fs[0] in lexicon:
                    cast[at + k] = POSITIVE
    if hits > 1:
        cast[at + 3] = POSITIVE
    return cast


def best_cut(z: np.ndarray, label: np.ndarray) -> float:
    """Where to cut the scores so that label 1 is found best (by the harmonic mean of precision and recall): of the gap that does so, the place nearest 0.

    A fit that parts its rows wholly so keeps its own cut.
    """
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], np.cumsum(label[order])
    found = np.arange(1, len(z) + 1)
    f1 = 2 * hit / (found + max(1, hit[-1]))
    f1[:-1][z[:-1] == z[1:]] = -1  # equal scores aren't parted
    at = int(np.argmax(f1))
    high, low = z[at], z[at + 1] if at + 1 < len(z) else z[at] - 1
    edge = (high - low) / 10
    return float(np.clip(0, low + edge, high - edge))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """A model fitted on at most ``train_rows`` labelled rows, chosen by a hash of the id among those that ``usable`` admits.

    ``usable`` is a condition on ``label_id``, the labels' id. Rows with a null label or id, and texts
    without words, train nothing; of different texts of one id one trains, of different labels the larger. Without any usable row
    the model scores every text 0. All features of these rows that go with the label are kept, however many.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label_id is not null and label in (0, 1)")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("label_id").agg(F.max("label").alias("label"))
    # a bounded table, as it is cut to train_rows rows
    chosen = known.orderBy(F.xxhash64("label_id", F.lit(5)), "label_id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    # repeated rows of an id are one, so that the sample is as large as the labels
    texts = texts.join(F.broadcast(scratch.save(chosen, "labels")), "label_id")
    sample = scratch.save(texts.groupBy("label_id", "label").agg(F.min("text").alias("text")), "sample")
    # which features go with the label: counted by Spark, and only the telling ones come back
    total = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1:
        return ToxicityModel({}, -60.0)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"f": np.concatenate(f) if f else np.empty(0, np.int64), "label": np.repeat(pdf["label"].to_numpy(), [len(x) for x in f])})

    base = n1 / (n1 + n0)
    counts = sample.mapInPandas(spread, "f long, label int").groupBy("f").agg(F.sum("label").cast("double").alias("a"), F.count("*").cast("double").alias("n"))
    # in how many standard deviations a feature's share of the label lies over the average, and the share itself, smoothed
    z = (F.col("a") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1e-9)
    telling = counts.where("a >= 2").withColumn("z", z).withColumn("share", (F.col("a") - 0.5) / (F.col("n") + 0.5)).where("z > 3 and share > 0.6").select("f").collect()
    keep = np.array(sorted(r.f for r in telling), np.int64)
    column = {int(f): i for i, f in enumerate(keep)}

    lexicon_of, prefix_of = {}, {}

    def split_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Which of the telling features are whole words."""
        for pdf in batches:
            words = {fs[0] for t in pdf["text"] for w in set(t.split()) if (fs := _features[w])}
            yield pd.DataFrame({"f": [f for f in column if f in words]}, dtype="int64")

    whole = {r.f for r in sample.mapInPandas(split_features, "f long").distinct().collect()}
    for f in map(int, keep):
        if f in whole:
            lexicon_of[f] = f % LEXICONS
        else:
            prefix_of[f] = f % BEGINNINGS

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, label in zip(pdf["text"], pdf["label"], strict=True):
                found = set(map(int, features(t))) & column.keys()
                idx = np.array(sorted(column[f] for f in found), np.int32)
                out.append((label, bytes(_votes(t.split(), found, lexicon_of, prefix_of)), idx.tobytes()))
            yield pd.DataFrame(out, columns=["label", "votes", "idx"])

    rows = sample.mapInPandas(cast, "label int, votes binary, idx binary").collect()
    votes = np.array([list(r.votes) for r in rows], np.int64)
    patterns, inverse, many = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    first = np.bincount(inverse, [r.label for r in rows]) / many
    voters = fit_label_model(patterns, many.astype(float), np.clip(first, 0.05, 0.95), correlated=True)
    posterior = voters.posterior(patterns)[inverse]
    sparse = [(i := np.frombuffer(r.idx, np.int32), np.ones(len(i), np.float32)) for r in rows]
    scorer = fit_linear(sparse, posterior, max(1, len(keep)), l2=1e-6)
    z = np.array([scorer.bias + scorer.weights[i].sum() for i, _ in sparse])
    bias = scorer.bias - best_cut(z, np.array([r.label for r in rows]))
    names = (*(f"words{i}" for i in range(LEXICONS)), *(f"beginnings{i}" for i in range(BEGINNINGS)), *_PATTERNS)
    return ToxicityModel({int(f): float(w) for f, w in zip(keep, scorer.weights, strict=True) if w}, float(bias), voters, names)


def with_toxicity(docs: DataFrame, model: ToxicityModel, column: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the score of each row's whole text as ``column``; null texts score as empty ones."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        of = model.scorer()
        return pd.Series([of(t) for t in texts], dtype="float64")

    return docs.withColumn(column, score(F.col(text_col).cast("string")))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id's decimal text leaves no remainder; such rows never train."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def classify_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each row of ``docs``.

    Scores come from the text alone. Null and empty texts score as texts without any telling word. A null id is never
    held out and stays null. Repeated rows score alike. An empty table gives no rows; without labels every score is near 0. Other columns are ignored.
    """
    model = fit_toxicity(docs, labels, ~held_out(F.col("label_id")), id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_toxicity(rows, model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
