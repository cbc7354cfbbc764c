from tests.llm.test_html import FRAME, run


def test_names_around_and_inside_an_article(spark):
    inside = '<h2 id="related">Head</h2><section id="search"><p>Found</p></section><h2 id="related-work">Work</h2><section id="search-and-rescue"><p>Rescue</p></section><div class="side-by-side"><p>Both</p></div>'
    pages = {i: f'<div class="{name}"><article><p>Text {i}</p>{inside}</article></div>' for i, name in enumerate(["has-sidebar", "layout no-sidebar", "content-sidebar-wrap", "sidebar", "widget main-widget"])}
    got = run(spark, [(i, f"http://j{i}.example/", FRAME.format(i, p)) for i, p in pages.items()])
    assert got == {i: f"Text {i}\nHead\nFound\nWork\nRescue\nBoth" for i in pages}


def test_a_hint_drops_only_what_its_host_repeats(spark):
    body = lambda i: f'<article><p>Text {i}<span class="ad"> now {i}</span></p>' + ('<div class="notice"><p>Once</p></div>' if i == 2 else "") + f'<div class="share"><p>Send {i}</p></div></article>'
    got = run(spark, [(i, f"http://k.example/{i}", FRAME.format(i, body(i))) for i in range(5)])
    assert got == {i: f"Text {i}\nOnce" if i == 2 else f"Text {i}" for i in range(5)}


def test_a_hint_on_pages_without_an_article(spark):
    page = '<div class="sidebar"><ul><li>Side {0}</li></ul></div><div class="post"><p>Post {0}</p></div>'
    assert run(spark, [(i, "http://l.example/", FRAME.format(i, page.format(i))) for i in range(4)])[3] == "Post 3"
