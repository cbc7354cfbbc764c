import json

from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.operators import answers, manifest, outline, reftables, retrieval, sizing, store
from corpusloom.plans.maintenance import StoreTable, index_incremental, update_job
from corpusloom.sources.changelog import parse_entries
from corpusloom.streaming.watch import maintain


def entries(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "source string, ord int, level int, title string, page int")


def test_section_paths(spark):
    rows = [(1, "A", 1), (2, "B", 2), (3, "C", 2), (2, "D", 4), (1, "E", 7)]
    paths = outline.section_paths(entries(spark, rows))
    assert [r.path for r in paths.orderBy("n").collect()] == ["A", "A › B", "A › B › C", "A › D", "E"]
    pages = spark.range(1, 10).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("page"))
    got = [r.section for r in outline.attach_sections(pages, paths).orderBy("page").collect()]
    assert got == ["A", "A › B › C", "A › B › C", "A › D", "A › D", "A › D", "E", "E", "E"]


def test_pages_before_the_first_heading(spark):
    paths = outline.section_paths(entries(spark, [(1, "A", 3)]))
    pages = spark.createDataFrame([("s", 1), ("s", 3)], "source string, page int")
    assert [r.section for r in outline.attach_sections(pages, paths).orderBy("page").collect()] == [None, "A"]


def test_outlines_deeper_than_nine_levels(spark):
    rows = [(level, f"T{level}", level) for level in range(1, 13)] + [(11, "U", 20)]
    paths = [r.path for r in outline.section_paths(entries(spark, rows)).orderBy("n").collect()]
    assert paths[11] == " › ".join(f"T{k}" for k in range(1, 13)) and paths[12] == " › ".join([*(f"T{k}" for k in range(1, 11)), "U"])


def test_contents_title_closes_nothing(spark):
    rows = [(1, "A", 1), (2, "B", 2), (1, " Table of Contents ", 3), (3, "C", 4), (2, " ", 5)]
    assert [r.path for r in outline.section_paths(entries(spark, rows)).orderBy("n").collect()] == ["A", "A › B", "A › B › C"]


def test_round_robin(spark):
    hits = [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c"), (2, 0, "d"), (2, 1, "a")]
    df = spark.createDataFrame([(q, r, i, 0.1) for q, r, i in hits], "qi int, rank int, id string, distance double")
    for k, expected in ((3, ["a", "d", "b"]), (2, ["a", "d"]), (9, ["a", "d", "b", "c"])):
        assert [r.id for r in retrieval.round_robin(df, k, "id").orderBy("pos").collect()] == expected


def test_large_query_tables_take_blocks(spark, monkeypatch):
    v = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.col("id") + 1.0, F.lit(3.0)).alias("embedding"))
    q = v.select(F.col("vec_id").alias("qi"), F.col("embedding").alias("q"))
    small = sorted(retrieval.top_k_batch(v, q, 3).collect())
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_BYTES", 24)
    assert sorted(retrieval.top_k_batch(v, q, 3, blocks=4).collect()) == small


def test_margin(spark):
    df = spark.createDataFrame([("a", 0.90), ("b", 0.87), ("c", 0.85)], "label string, score double")
    assert sorted(r.label for r in retrieval.within_margin(df).collect()) == ["a", "b"]


def test_rerank_off_keeps_all(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "pos int, id string")
    assert retrieval.rerank(df, None, 1).count() == 2
    scores = spark.createDataFrame([(1, 0.9), (7, 1.0)], "index int, relevance double")
    assert [(r.id, r.new_pos) for r in retrieval.rerank(df, scores, 5).collect()] == [("b", 1)]


def test_manifest_fold(spark):
    counts = spark.createDataFrame([("Ops", 9), ("Simple Ops", 7), ("Storage", 6), ("Fast Storage", 5), ("Rare", 4)], "name string, n long")
    assert sorted(r.name for r in manifest.fold_names(counts).collect()) == ["Ops", "Storage"]


def test_reference_tables(spark):
    rows = [("X CPU", "Value"), ("Small", "4"), ("Large", "8"), ("X Disk", "Value"), ("Small Default", "100"), ("Huge", "900"), ("Y", "Value"), ("CPU", "4"), ("RAM", "16"), ("Disk", "900")]
    cells = spark.createDataFrame([("s", i, b, c) for i, (b, c) in enumerate(rows)], "source string, ord int, b string, c string")
    parsed = reftables.parse_tables(cells)
    specs = {(r.appl, r.size): r.spec for r in reftables.specs(parsed).collect()}
    assert specs == {("X", "Small"): "4 vCPU, 100 GB storage", ("X", "Large"): "8 vCPU", ("Y", ""): "4 vCPU, 16 GB RAM, 900 GB storage"}
    texts = [r.text for r in reftables.sizing_sentences(parsed).orderBy("page_num").collect()]
    assert texts[0].startswith("Y appliance resource requirements: 4 vCPU") and "smallest available X size is Small." in texts[1]


def test_number_coercion(spark):
    df = spark.createDataFrame([(None,), ("114 vCPUs",), ("-3.5 x",), ("n/a",)], "v string")
    assert [r[0] for r in df.select(fx.leading_number(F.col("v"))).collect()] == [0.0, 114.0, -3.5, 0.0]


def test_json_salvage(spark):
    raw = spark.createDataFrame([(1, 'ok: ["Ops","ops","x",1,"NSX"] end'), (2, "none"), (3, None), (4, "[broken")], "id int, raw string")
    assert [(r.id, r.pos, r.name) for r in answers.salvage_names(raw, "id", "raw").orderBy("id", "pos").collect()] == [(1, 1, "Ops"), (1, 2, "NSX")]


def test_citations(spark):
    df = spark.createDataFrame([(1, "s", 4, 4), (2, "s", 4, 6)], "id int, source string, a int, b int")
    assert [r[0] for r in df.orderBy("id").select(fx.cite_tag(F.col("source"), F.col("a"), F.col("b"))).collect()] == ["[s p.4]", "[s p.4-6]"]
    text = spark.createDataFrame([(1, "a [s p.4] b [t-1.2 p.7–9]"), (2, None)], "id int, t string")
    got = [(r.source, r.page_start, r.page_end) for r in answers.extract_citations(text, "id", "t").orderBy("idx").collect()]
    assert got == [("s", 4, 4), ("t-1.2", 7, 9)]


def test_diff_summary(spark):
    schema = "section string, page_start int, page_end int"
    added = spark.createDataFrame([("S1", 3, 4), ("S1", 9, 9)], schema)
    removed = spark.createDataFrame([("S1", 1, 2), (None, 5, 5)], schema)
    got = [tuple(r) for r in store.diff_summary(added, removed).collect()]
    assert got == [("S1", 2, 1, 1, 9), ("(unsectioned)", 0, 1, 5, 5)]


CHUNKS = "id string, source string, page_start int, page_end int, section string, text string"


def test_second_update_changes_nothing(spark):
    chunks = spark.createDataFrame([("a", "s", 1, 1, "x", "t"), ("b", "s", 2, 2, None, "u"), ("a", "s", 1, 1, "x", "t")], CHUNKS)
    new, stats, _ = index_incremental(spark.createDataFrame([], CHUNKS), chunks)
    assert tuple(stats.first()) == ("s", 3, 3, 0, 0) and new.count() == 2
    again, stats, summary = index_incremental(new, chunks)
    assert tuple(stats.first()) == ("s", 3, 0, 0, 3) and summary.count() == 0 and again.count() == 2


def test_empty_chunk_sets(spark):
    old = spark.createDataFrame([("a", "s", 1, 1, "x", "t")], CHUNKS)
    none = spark.createDataFrame([], CHUNKS)
    source = spark.createDataFrame([("s",)], "source string")
    for kept, stats, _ in (index_incremental(old, none), index_incremental(old, none, source)):
        assert kept.count() == 1 and stats.count() == 0
    gone, stats, _ = index_incremental(old, none, source, keep_when_empty=False)
    assert gone.count() == 0 and tuple(stats.first()) == ("s", 0, 0, 1, 0)


def test_an_update_of_one_source_leaves_the_others(spark):
    old = spark.createDataFrame([("a", "A", 1, 1, "x", "t"), ("b", "B", 1, 1, "x", "u"), ("gone", "A", 1, 1, "x", "v")], CHUNKS)
    new, stats, _ = index_incremental(old, spark.createDataFrame([("a", "A", 5, 5, "x", "t")], CHUNKS))
    assert sorted((r.id, r.page_start) for r in new.collect()) == [("a", 5), ("b", 1)] and tuple(stats.first()) == ("A", 1, 0, 1, 1)


def test_update_job_and_store_parts(spark, tmp_path):
    table = StoreTable(spark, str(tmp_path / "store"), parts=8)
    chunks = lambda *rows: spark.createDataFrame(list(rows), CHUNKS)
    known = spark.createDataFrame([], "name string, sha256 string")
    fetched = spark.createDataFrame([("A", "1"), ("B", "2")], "name string, sha256 string")
    both = chunks(("a", "A", 1, 1, "x", "t"), ("b", "B", 2, 2, "y", "u"))
    entries = update_job(table, both, CHUNKS, known, fetched, "now").collect()
    assert sorted((r.source, r.chunks_before, r.chunks_after, r.chunks_added, r.chunks_removed, len(r.diff_sections)) for r in entries) == [("A", 0, 2, 2, 0, 1), ("B", 0, 2, 2, 0, 1)]
    folders = table.folders()
    after = spark.createDataFrame([("A", "3"), ("B", "2")], "name string, sha256 string")
    entries = update_job(table, chunks(("c", "A", 1, 1, "x", "w")), CHUNKS, fetched, after, "now").collect()
    assert [(r.source, r.chunks_before, r.chunks_after, r.chunks_added, r.chunks_removed) for r in entries] == [("A", 2, 2, 1, 1)]
    assert sorted(r.id for r in table.read(CHUNKS).collect()) == ["b", "c"]
    assert len(set(folders.values()) & set(table.folders().values())) == 1  # the other source's part isn't rewritten
    assert update_job(table, both, CHUNKS, after, after, "now").count() == 0
    update_job(table, both, CHUNKS, after, after, "now", force=True).collect()
    assert sorted(r.id for r in table.read(CHUNKS).collect()) == ["a", "b"]
    table.reset()
    assert table.read(CHUNKS).count() == 0


def test_stream_of_whole_sources_deletes_orphans(spark, tmp_path):
    table, files = StoreTable(spark, str(tmp_path / "store")), str(tmp_path / "in")
    for rows in ([("a", "s", 1, 1, "x", "t"), ("b", "s", 2, 2, "x", "u"), ("z", "other", 1, 1, "x", "t")], [("b", "s", 3, 3, "x", "u")]):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(files)
        maintain(spark, files, CHUNKS, table, str(tmp_path / "cp"), whole_sources=True).awaitTermination()
    assert sorted((r.id, r.page_start) for r in table.read(CHUNKS).collect()) == [("b", 3), ("z", 1)]


def test_changelog(spark):
    base = {"ts": "2024-01-01T00:00:00", "source": "s", "broadcom_last_modified": None, "sha256": "x", "bytes": 1, "chunks_before": 1, "chunks_after": 2, "duration_sec": 1.0}
    full = base | {"ts": "2024-01-02T00:00:00", "chunks_added": 1, "chunks_removed": 0, "diff_sections": [{"section": "a", "added": 1, "removed": 0, "pages": [1, 2]}]}
    lines = [json.dumps(base), "", "{broken", json.dumps(base | {"what": 1}), json.dumps(full), json.dumps({"ts": "x"})]
    got = parse_entries(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.ts[:10] for r in got] == ["2024-01-02", "2024-01-01"] and got[1].chunks_added is None and got[0].diff_sections[0].pages == [1, 2]


def test_host_values(spark):
    rows = spark.createDataFrame([(1, "A", "5.0"), (2, "B", " 38 CPUs "), (3, "Component", "x"), (4, None, "1"), (5, "C", None)], "ord int, label string, value string")
    assert [(r.label, r.value) for r in sizing.host_summary(rows).orderBy("ord").collect()] == [("A", "5"), ("B", "38 CPUs")]
    assert sizing.pick(rows, "nothing").first().value == "—"


def test_checks(spark):
    rows = [("# Optional\n- Ops here", "Ops"), ("# Needed\nOps\n# Optional\nOps", "Ops"), ("nothing", "Ops")]
    df = spark.createDataFrame(rows, "answer string, c string")
    assert [r[0] for r in df.select(answers.under_optional(F.col("answer"), F.col("c"))).collect()] == [True, False, False]
    out = spark.createDataFrame([("  ",)], "answer string").select(answers.check_answer(F.col("answer"), F.lit(True), F.lit(True), F.array(F.lit("Zed")), F.lit(None).cast("string")).alias("f")).first().f
    assert out == ["no inline citation", "missing expected term: 'Zed'", "empty answer"]


def test_stream_maintains_the_store(spark, tmp_path):
    table = StoreTable(spark, str(tmp_path / "store"))
    files = str(tmp_path / "in")
    run = lambda rows: spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(files)
    run([("a", "s", 1, 1, "x", "t")])
    maintain(spark, files, CHUNKS, table, str(tmp_path / "cp")).awaitTermination()
    run([("a", "s", 2, 2, "x", "t"), ("b", "s", 3, 3, "y", "u")])
    maintain(spark, files, CHUNKS, table, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.id, r.page_start) for r in table.read(CHUNKS).collect()) == [("a", 2), ("b", 3)]
