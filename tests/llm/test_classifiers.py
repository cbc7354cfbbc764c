import os
import re

import numpy as np
import pytest
import xxhash

from corpusloom.llm.label_model import NEGATIVE, POSITIVE, LinearScorer, fit_label_model
from corpusloom.llm.quality import classify_quality, features, statistics
from corpusloom.llm.toxicity import DENSE, ToxicityModel, best_cut, classify_toxicity, fit_toxicity

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


def test_label_model_finds_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.3
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(r.random((20_000, 4)) < right, truth[:, None], ~truth[:, None])
    patterns, many = np.unique(np.where(votes, POSITIVE, NEGATIVE), axis=0, return_counts=True)
    model = fit_label_model(patterns, many.astype(float), (patterns == POSITIVE).mean(axis=1))
    assert np.abs(model.accuracy() - right).max() < 0.02 and abs(model.prior - 0.3) < 0.02


def test_repeated_voters_count_less():
    r = np.random.default_rng(2)
    truth = r.random(5000) < 0.5
    one = np.where(r.random(5000) < 0.7, truth, ~truth)
    own = np.where(r.random((5000, 2)) < 0.8, truth[:, None], ~truth[:, None])
    votes = np.where(np.column_stack((one, one, one, one, own)), POSITIVE, NEGATIVE)
    patterns, many = np.unique(votes, axis=0, return_counts=True)
    model = fit_label_model(patterns, many.astype(float), (patterns == POSITIVE).mean(axis=1), correlated=True)
    assert model.weight[:4].max() < 0.5 < model.weight[4:].min()


@here
def test_quality_on_labels_it_never_saw(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = classify_quality(docs).join(labels, "doc_id").toPandas()
    assert ((got.keep) & (got.quality == 0)).sum() <= 2 and ((~got.keep) & (got.quality == 1)).sum() <= 4


@here
def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = classify_toxicity(docs, labels)
    assert out.count() == docs.count()
    got = out.join(labels, "doc_id").where("held_out").toPandas()
    found = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert found / (got.toxic == 1).sum() >= 0.85 and found / (got.predicted == 1).sum() >= 0.9


LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the tables aren't here")
def test_toxicity_recall_and_precision_held_out(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    got = classify_toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").toPandas()
    found = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert found / (got.toxic == 1).sum() >= 0.9 and found / (got.predicted == 1).sum() >= 0.95


def test_scores_by_brute_force():
    """Each word's forms and beginnings one by one, against the scorer."""
    words = ["Zork", "zorkling", "mild", "Mildly!", "st0ne", "stone", "soooo", "so"]
    known = {w: 0.3 * i - 1 for i, w in enumerate(["zork", "^zor", "^zork", "mild", "^mil", "stone", "^sto", "so"])}
    weights = {xxhash.xxh3_64_intdigest(w) >> 1: x for w, x in known.items()}
    weights |= {f ^ DENSE: 2 * x for f, x in list(weights.items())[:5]}
    score = ToxicityModel(weights, -0.4).scorer()
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 40, 400):
        text = [words[i] for i in r.integers(0, len(words), n)] + ["filler"] * (n * 3)
        count = {}
        for w in text:
            forms = {w, w.translate(str.maketrans("0!", "oi")), re.sub(r"(.)\1\1+", r"\1", w)}
            seen = set()
            for f in forms:
                bare = f.strip("!").lower()
                seen |= {bare, *(f"^{bare[:k]}" for k in (3, 4, 5, 6, 7) if len(bare) > k)}
            for x in seen:
                count[x] = count.get(x, 0) + 1
        z = -0.4
        for x, many in count.items():
            f = xxhash.xxh3_64_intdigest(x) >> 1
            z += weights.get(f, 0) + (weights.get(f ^ DENSE, 0) if many >= 2 and 100 * many >= len(text) else 0)
        assert abs(score(" ".join(text)) - 1 / (1 + np.exp(-z))) < 1e-9


def test_best_cut_by_brute_force():
    r = np.random.default_rng(4)
    for _ in range(50):
        z, y = r.normal(size=30).round(1), (r.random(30) < 0.4).astype(int)
        y[0] = 1
        f1 = lambda c: 2 * ((z > c) & (y == 1)).sum() / ((z > c).sum() + y.sum())  # noqa: E731, B023
        assert f1(best_cut(z, y)) >= max(f1(c) for c in [*z, z.min() - 1]) - 1e-12


def test_quality_statistics_by_brute_force():
    """The labellers' statistics word by word, and a score from them."""
    text = "GOOD words!! here, here. && ok 12 $$$ Line\nLine\nLine\nfin." + " and more plain words follow." * 4
    words, lines = text.split(), text.split("\n")
    got, shapes = statistics(text)
    share = lambda f: sum(map(f, words)) / len(words)
    assert got["words"] == len(words) == len(shapes)
    assert got["bangs"] == share(lambda w: w.endswith("!!")) and got["bare"] == share(lambda w: not any(c.isalnum() for c in w))
    assert got["stops"] == share(lambda w: w[-1] in ".!?") and got["shout"] == share(lambda w: sum(c.isalpha() for c in w) > 1 and w.isupper())
    assert got["repeats"] == sum(a == b for a, b in zip(words, words[1:], strict=False)) / (len(words) - 1)
    assert got["lines"] == 1 - len(set(lines)) / len(lines) and got["symbols"] == share(lambda w: bool(re.search(r"[#$%&*~^=+<>|@\\]{2,}", w)))
    idx, val = features(got, shapes)
    w = np.random.default_rng(5).normal(size=1 << 14)
    plain = sum(float(w[i]) * float(x) for i, x in zip(idx, val, strict=True)) + 0.3
    assert abs(LinearScorer(w, 0.3).score(idx, val) - 1 / (1 + np.exp(-plain))) < 1e-5


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "A fine text of a few words."), (4, "word " * 50_000), (5, "x"), (5, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    q = classify_quality(docs).collect()
    assert len(q) == 7 and all(not r.keep and r.score == 0 for r in q if r.doc_id in (1, 2, 3))
    t = classify_toxicity(docs, labels).collect()
    assert len(t) == 7 and all(0 <= r.score <= 1 and r.predicted == 0 for r in t)
    none = spark.createDataFrame([], SCHEMA)
    assert classify_quality(none).count() == 0 and classify_toxicity(none, labels).count() == 0
    clash = spark.createDataFrame([(1, "a b", 0.5, "z")], "doc_id long, text string, score double, keep string")
    assert classify_quality(clash).count() == 1 and classify_toxicity(clash, labels).count() == 1


def test_toxicity_learns_words_and_beginnings(spark):
    docs = [(i, f"plain words here number w{i % 17} " + (f"zork{i % 9}ly" if i % 4 == 0 else f"mild{i % 9}")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    score = fit_toxicity(spark.createDataFrame(docs, SCHEMA), labels).scorer()
    assert score("so ZORK3LY!") > 0.5 and score("a zork3lying thing") > 0.5 > score("mild3 words") and score("") < 0.5 and score(None) < 0.5
