from corpusloom.llm.quality import _Shapes


def test_a_long_word_is_looked_at_whole():
    shapes = _Shapes()
    a, b = "x" * 80, "x" * 80 + "9Z" * 40
    assert shapes[a] & 0xFFFF == shapes["x"] & 0xFFFF != shapes[b] & 0xFFFF
    assert set(shapes) == {"x"}
