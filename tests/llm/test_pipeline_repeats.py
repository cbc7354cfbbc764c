from corpus_pipeline import drop_near_duplicates


def test_different_texts_of_an_id_are_judged_each(spark):
    a, b, c = ("red fox ran over nine cold hills at dawn", "my old boat sank near that green island", "prices of tea rose again in late spring")
    rows = [(5, a, "x"), (5, b, "y"), (5, b, "y"), (9, b, "z"), (3, a, "w"), (7, c, "v"), (None, a, "u"), (8, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(str, (tuple(r) for r in drop_near_duplicates(spark, docs, "").collect())))
    assert got == sorted(map(str, [(5, b, "y"), (3, a, "w"), (7, c, "v"), (None, a, "u"), (8, None, "t")]))
    plain = docs.where("source in ('x', 'w', 'v')")
    assert sorted(r.doc_id for r in drop_near_duplicates(spark, plain, "").collect()) == [3, 7]
