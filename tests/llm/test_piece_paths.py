"""The sampler's memory, its hashes of words, and the steps it leaves out."""

import numpy as np
import public_tokenizers

from corpusloom.llm import piece_sampling as ps

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held(model):
    return sum(x.nbytes for x in vars(model).values() if isinstance(x, np.ndarray)) + 100 * len(getattr(model, "words", ()))


def test_kept_lattices_are_bounded():
    """However many different words a worker meets: an executor's memory holds two workers and the JVM."""
    model = ps.PieceModel(PIECES, 1.0)
    rng = np.random.default_rng(3)
    most = 0
    for _ in range(10):
        letters = rng.integers(97, 123, (40_000, 9), np.uint8)
        model.of([" ".join(bytes(x).decode() for x in letters)])
        most = max(most, held(model))
    assert most < 150e6


def flat(rows):
    return [(tuple(x[0].tolist()), *(round(v, 6) for v in x[1:])) for x in rows]


def some_texts():
    texts = ["", "the", " ", "▁▁a ▁ b  ", "\0 é中\U0001f600\n\tß", "a" * 700, "some words of a text " * 60, "Überraschend, said the 2nd of them. " * 20]
    return texts, np.arange(1, len(texts) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def test_steps_that_are_left_out_cannot_matter(monkeypatch):
    """Looking at all steps of each path gives the same samples, values and thresholds."""
    texts, seeds = some_texts()
    for alpha, k in ((0.3, 6), (1.0, 4), (8.0, 5), (60.0, 4)):
        model = ps.piece_model(PIECES, alpha)
        monkeypatch.setattr(ps, "NEAR", 100_000)
        whole = [flat(x) for x in ps.sample_texts(model, texts, seeds, k)]
        for near, steps in ((1, 3), (20, 50)):
            monkeypatch.setattr(ps, "NEAR", near)
            monkeypatch.setattr(ps, "STEPS", steps)
            assert [flat(x) for x in ps.sample_texts(model, texts, seeds, k)] == whole


def test_words_with_equal_hashes_stay_apart(monkeypatch):
    texts, seeds = some_texts()
    expected = [flat(x) for x in ps.sample_texts(ps.PieceModel(PIECES, 1.0), texts, seeds, 3)]
    for kept in (lambda size: size % 2, lambda size: size):
        monkeypatch.setattr(ps.PieceModel, "_hash", lambda self, codes, start, size, kept=kept: kept(size).astype(np.uint64))
        assert [flat(x) for x in ps.sample_texts(ps.PieceModel(PIECES, 1.0), texts, seeds, 3)] == expected


def test_round_trip_is_checked_on_the_ids():
    model = ps.piece_model(PIECES, 1.0)
    texts = ["a text", "", "  two é", "▁x"]
    rows = [x[0][0] for x in ps.sample_texts(model, texts, np.arange(1, 5).astype(np.uint64), 1)]
    start = np.cumsum([0, *map(len, rows)])
    ids = np.concatenate(rows).astype(np.int32)
    assert model.gives_back(ids, start, texts, np.arange(4)) == [True] * 4
    assert model.gives_back(ids, start, ["a texts", "x", " two é", " x"], np.arange(4)) == [False, False, False, True]
