import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom import __main__ as commands
from corpusloom.operators import answers, chunking, embedding, retrieval, sizing
from corpusloom.plans.ask import AskSettings, LabelCache, Models, ask, fused, specific
from corpusloom.plans.maintenance import StoreTable
from corpusloom.sources import fetch
from corpusloom.sources.registry import read_sidecars


def limited(most):
    def encode(texts):
        if sum(map(len, texts)) > most:
            raise ValueError("input is too large to process")
        return [[float(len(t)), 1.0] for t in texts]

    return encode


def test_adaptive_encoding():
    assert embedding.encode_adaptive(limited(10), ["abcd", "efgh", "ijkl"]) == [[4.0, 1.0]] * 3
    assert embedding.encode_adaptive(limited(300), ["x" * 1000]) == [[250.0, 1.0]]
    with pytest.raises(ValueError):
        embedding.encode_adaptive(limited(10), ["x" * 150])
    with pytest.raises(ValueError):
        embedding.encode_adaptive(limited(10), ["abcd", "efgh", "ijkl"], (KeyError,))
    with pytest.raises(KeyError):
        embedding.encode_adaptive(lambda _: {}["no"], ["a"])


def test_only_the_encoders_own_markers_cut_a_text():
    asked = []

    def failing(message):
        def encode(texts):
            asked.append(len(texts[0]))
            raise RuntimeError(message)

        return encode

    for message in ("Max retries exceeded", "maximum context"):
        with pytest.raises(RuntimeError):
            embedding.encode_adaptive(failing(message), ["x" * 8000])
    assert asked == [8000, 8000]
    asked.clear()
    with pytest.raises(RuntimeError):
        embedding.encode_adaptive(failing("input is larger than physical batch size"), ["x" * 800])
    assert asked == [800, 400, 200]
    assert embedding.encode_adaptive(limited(10), []) == []


def test_vectors_that_cannot_be_compared_have_no_distance(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [0.0, 1.0]), (7, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in retrieval.top_k(v, [2.0, 0.0], 9).collect()] == [(1, 0.0), (4, 1.0), (6, 1.0)]
    q = spark.createDataFrame([(0, [2.0, 0.0]), (1, None), (2, [3.0])], "qi int, q array<double>")
    expected = [(0, 0, 1, 0.0), (0, 1, 4, 1.0), (0, 2, 6, 1.0), (2, 0, 3, 0.0)]
    assert [tuple(r) for r in retrieval.top_k_batch(v, q, 9).orderBy("qi", "rank").collect()] == expected


def test_large_query_tables_meet_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7) + 1, float(i % 11), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 10 = 0").selectExpr("vec_id as qi", "embedding as q")
    small = sorted(map(tuple, retrieval.top_k_batch(v, q, 5).collect()))
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(tuple, retrieval.top_k_batch(v, q, 5).collect())) == small


def test_a_failed_reranker_leaves_the_order(spark):
    pool = spark.createDataFrame([(i, 100 - i) for i in range(1, 6)], "pos long, vec_id long")
    none = spark.createDataFrame([], "index long, relevance double")
    assert [r.pos for r in retrieval.rerank(pool, none, 3).orderBy("new_pos").collect()] == [1, 2, 3]
    assert retrieval.rerank(pool.limit(1), none, 3).count() == 1 and retrieval.rerank(pool, None, 3).count() == 5


def test_ask_from_end_to_end(spark):
    store = spark.createDataFrame([(i, [1.0, i / 10, 0.0], f"text {i}", "Book › Ops Model") for i in range(30)], "vec_id long, embedding array<double>, text string, section string")
    asked = []

    def encode(texts):
        asked.extend(texts)
        return [[1.0, float(len(t) % 5), 0.0] for t in texts]

    settings = AskSettings(probes=("probe",))
    said = ask("what of every component?", store, Models(encode, extract=lambda _: 'so: ["Ops", "Logs"]', rerank=lambda _, texts: [(i, float(i)) for i in range(len(texts))]), settings)
    assert asked[:3] == ["probe", "what of every component?", "Ops — what of every component?"] and said.count() == 24
    asked.clear()

    def broken(*_):
        raise OSError("gone")

    kept = LabelCache()
    hits = ask("what of every component?", store, Models(encode, extract=broken, rerank=broken), settings, kept, "k").orderBy("new_pos").collect()
    assert "Ops — what of every component?" in asked and [r.pos for r in hits] == list(range(1, 25))
    asked.clear()
    assert ask("how?", store, Models(encode), settings, kept, "k").count() == 6 and "Ops" not in asked
    assert ask("how?", store, Models(encode), AskSettings(multi_query=False)).count() == 6


def test_fetching(spark, tmp_path):
    registry = spark.createDataFrame([("a", "u:a", "P", "1", "pdf"), ("b", "u:b", "P", "1", "xlsx")], "name string, url string, product string, version string, kind string")
    asked = []

    def transport(url, since):
        asked.append((url, since))
        return fetch.Response(304) if since else fetch.Response(200, "Mon", [b"one ", url.encode()])

    path = str(tmp_path / "in")
    first = fetch.fetch_sources(registry, path, transport).orderBy("name").collect()
    assert [(r.name, r.bytes, r.cached) for r in first] == [("a", 7, False), ("b", 7, False)] and first[0].sha256 == hashlib.sha256(b"one u:a").hexdigest()
    again = fetch.fetch_sources(registry, path, transport).orderBy("name").collect()
    assert [r.cached for r in again] == [True, True] and [r.sha256 for r in again] == [r.sha256 for r in first] and asked[2:] == [("u:a", "Mon"), ("u:b", "Mon")]
    assert not any(fetch.fetch_sources(registry, path, transport, force=True).toPandas()["cached"])
    assert {r.name: r.bytes for r in read_sidecars(spark, f"{path}/*.meta.json").collect()} == {"a": 7, "b": 7}
    assert not list((tmp_path / "in").glob("*.part"))
    with pytest.raises(OSError, match="status 500"):
        fetch.fetch_sources(registry, path, lambda *_: fetch.Response(500))


def test_another_tokenizer(spark):
    df = spark.createDataFrame([(1, "s", "abcdef\nghij")], "doc_id long, source string, text string")
    got = chunking.chunk_documents(df, 4, 1, tokenizer=list).orderBy("chunk").collect()
    assert [(r.text, r.n_tokens) for r in got] == [("abcd", 4), ("d\n\nef", 3), ("f\n\nghij", 5)]


def test_commands(spark, tmp_path, capsys):
    store = StoreTable(spark, str(tmp_path / "store"))
    store.write(spark.createDataFrame([("a", "s", 1, 1, "x", "t")], commands.STORE))
    commands.main(["status", "--store", str(tmp_path / "store")])
    assert json.loads(capsys.readouterr().out) == {"chunks": 1, "sources": 1, "last_update": None, "last_source": None}
    assert commands.hook("json:loads") is json.loads


def test_budget_batches():
    words = lambda n: "w " * n
    texts = [words(n) for n in (200, 300, 1, 500, 499, 2)]
    assert [len(b) for b in embedding.budget_batches(texts, 500)] == [2, 1, 1, 1, 1]


def test_embed(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, text string")
    rows = embedding.embed(df, limited(100), "nomic-embed-x").orderBy("id").collect()
    assert [r.embedding and r.embedding[0] for r in rows] == [20.0, None, 17.0] and rows[0].text == "abc"


def test_ask(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(20)], "vec_id long, embedding array<double>")
    labels = spark.createDataFrame([("Ops", [1.0, 0.0]), ("Logs", [1.0, 0.1]), ("Far", [0.0, 1.0])], "label string, embedding array<double>")
    asked = []

    def encode(texts):
        asked.extend(texts)
        return [[1.0, 0.5 * i] for i, _ in enumerate(texts)]

    hits = specific(v, labels, "how?", encode, AskSettings()).orderBy("pos").collect()
    assert asked == ["how?", "Logs — how?", "Ops — how?"] and len(hits) == 6 and hits[0].vec_id == 0
    assert fused(v, [[1.0, 0.0]], 2).count() == 2


def test_exports(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a\nb"), (1, 2, "assistant", " c "), (1, 3, "user", "d")], "conv_id long, turn long, role string, text string")
    text = answers.export_session(turns).first().markdown
    assert text == "---\n\n## Q1\n\n> a\n> b\n\n### A1\n\nc\n\n---\n\n## Q2\n\n> d\n"
    hits = spark.createDataFrame([(1, 2, "b" * 10), (1, 1, "a")], "q int, rank int, text string")
    assert answers.inventory_text(hits, ["q"], chars=5).first().text == "a bbb"
    s = "array<struct<section:string,added:int,removed:int,pages:array<int>>>"
    df = spark.createDataFrame([([("A", 2, 0, [1, 1]), (None, 1, 3, [2, 4]), ("C", 0, 1, None)],)], f"s {s}")
    assert df.select(answers.shown_sections(F.col("s"), 2)).first()[0] == "+2 A p.1\n+1 −3 (unsectioned) pp.2–4\n…and 1 more section"


def test_form(spark):
    fields = spark.createDataFrame([(1, "a", "checkbox", "true"), (1, "b", "checkbox", "false"), (1, "c", "number", ""), (1, "d", "number", "3"), (1, "e", "select", "Small")], "plan int, name string, kind string, raw string")
    assert sorted((r.name, r.value) for r in sizing.form_inputs(fields, "plan").collect()) == [("a", "Include"), ("b", "Exclude"), ("d", "3"), ("e", "Small")]
