from callgrain.llm import html_text as m

LONG = "The house that we saw was on the hill and it had a door that was not as old as the one in the town, so they went there with us. " * 2


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="page menu">
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></ul></nav><div class="ad">Buy the house that was on the hill.</div>
    <div id="cookie-notice">{LONG}</div><article class="post"><header><h1>Head &amp; line</h1></header><p><b>One
    two.<br><p>{LONG}</p><!-- gone <p>no</p> --><aside>{LONG}</aside><p>xqz xqz | &eacute;&#8364; &lt;tag&gt;</p>
    <form><p>{LONG}</p><button>Go</button></form><ul class="related-posts"><li><a href=1>{LONG}</a></ul><p>Short.</p>
    <section class="comments"><p>{LONG}</p></section></article><footer>&copy; {LONG}</footer></body></html>"""
    assert m.main_text(page).split("\n\n") == ["Head & line", "One two.", LONG.strip(), "xqz xqz | é€ <tag>", "Short."]


def test_pages_without_an_article_go_by_the_rules_and_neighbours():
    page = f"<body><div><a href=1>home</a> <a href=2>news</a></div><div>Head</div><div>{LONG}</div><div>Short but in between.</div><div>{LONG}</div><div>xq zq wq xq zq wq xq zq wq xq zq wq xq zq wq xq zq wq xq zq wq xq zq wq xq zq</div><div><a href=3>{LONG}</a></div><div>tiny</div></body>"
    page_blocks = m.main_text(page).split("\n\n")
    assert page_blocks[-3:] == [LONG.strip(), "Short but in between.", LONG.strip()]


def test_odd_pages():
    assert m.main_text(None) == m.main_text("") == m.main_text("<p") == m.main_text("<script>var x") == ""
    assert m.main_text("plain text that is all of it") == "plain text that is all of it"
    assert m.main_text(f"<article><p>{LONG}</p><p>cut off <a href='x") .startswith(LONG.strip())
    assert m.main_text("<article><p>a < b &amp; c</p></article>") == "a < b & c"
    assert len(m.main_text("<article>" + "<p>word and word</p>" * 20000 + "</article>").split("\n\n")) == 20000


def test_rows(spark):
    rows = [(1, "u", "<article><p>Text of it</p></article>", "x"), (1, "u", "<article><p>Text of it</p></article>", "x"), (None, None, None, "x"), (2, "v", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in m.extract(df).collect()) == [("1", "Text of it"), ("1", "Text of it"), ("2", ""), ("None", "")]
    assert m.extract(df.limit(0)).count() == 0


def test_names_of_a_layout_do_not_put_an_article_out():
    for wrap in ("layout has-sidebar", "content-with-sidebar", "sidebar-left", "widget", "comments-open", "modal"):
        for inside in (LONG, "A short note."):
            assert m.main_text(f'<body><div class="{wrap}"><article><p>{inside}</p></article></div></body>') == inside.strip(), wrap
    for wrap in ("has-sidebar", "content-with-sidebar", "share", "notice"):
        assert m.main_text(f'<body><div class="{wrap}"><h1>Head</h1><p>{LONG}</p></div></body>').split("\n\n") == ["Head", LONG.strip()], wrap
    page = f'<article><p>{LONG}</p><section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section><div class="share"><p>Tell all of them.</p></div></article>'
    assert m.main_text(page).split("\n\n") == [LONG.strip(), "Discussion", LONG.strip()]
    assert m.main_text(f'<div class="search"><main><p>Found by it.</p></main></div><article><p>{LONG}</p></article>').split("\n\n") == ["Found by it.", LONG.strip()]


def test_what_is_never_the_text_stays_out():
    for name in ("comments", "comment-list", "cookie-notice", "ads"):
        assert m.main_text(f'<body><article><p>{LONG}</p></article><div class="{name}"><article><p>Not of the page. {LONG}</p></article></div></body>') == LONG.strip()
        assert m.main_text(f'<body><div class="{name}"><p>Not of the page. {LONG}</p></div><p>{LONG}</p></body>') == LONG.strip()
    assert m.main_text(f'<body><div class="sidebar"><p>In short.</p></div><p>{LONG}</p><div class="related-posts"><p>One more.</p></div></body>') == LONG.strip()
    for name in ("comments", "related-posts"):  # an article there is not the page's where there is other prose
        assert m.main_text(f'<body><div><h1>Head</h1><p>{LONG}</p></div><div class="{name}"><article><p>Not of the page.</p></article></div></body>').endswith(LONG.strip())
    assert m.main_text('<body><article><div class="ad">Buy the house that was on the hill.</div></article></body>') == ""


def test_quotes_in_unquoted_values_are_characters():
    assert m.main_text(f"<article><p title=don't>Text of it</p><p>It's {LONG}</p></article>") == f"Text of it\n\nIt's {LONG.strip()}"
    assert m.main_text("<article><p title=\"a > b\" id='x>y'>One</p><p data-x=a\"b>Two</p><p title=\"open>Three</p></article>") == "One\n\nTwo\n\nThree"


def test_headings_and_paragraphs_keep_their_text():
    for name in ("discussion", "related", "search", "share", "side", "comments"):
        assert m.main_text(f'<article><h2 id="{name}">Head</h2><p>{LONG}</p></article>') == f"Head\n\n{LONG.strip()}"
    assert m.main_text(f'<article><p class="notice">Mind it.</p><p class="ad">Buy it.</p><p>{LONG}</p></article>') == f"Mind it.\n\n{LONG.strip()}"


def test_formulas_are_text():
    assert m.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>") == "So x=2 holds"


def test_pages_in_other_languages_go_by_length_and_links():
    russian = "Дом, который мы видели на холме, был старше всех домов этого города, и поэтому они поехали туда вместе с нами прошлой осенью. " * 2
    chinese = "我们在山上看到的那座房子比镇上最古老的房子还要古老所以他们去年秋天和我们一起去了那里并且在那里住了很长一段时间直到雪融化为止然后我们又回到了镇上继续过着平静的生活。"
    for text in (russian.strip(), chinese):
        assert m.main_text(f"<body><div><a href=1>дом</a> <a href=2>новости</a></div><div>{text}</div><div>{text}</div><div><a href=3>{text}</a></div></body>") == f"{text}\n\n{text}"


def test_a_teaser_is_no_core():
    assert m.main_text(f"<body><article><p>A teaser.</p></article><div>{LONG}</div><div>{LONG}</div></body>").endswith(f"{LONG.strip()}\n\n{LONG.strip()}")
    assert m.main_text(f"<body><article><p>{LONG}</p></article><div>{LONG}</div></body>") == LONG.strip()


def test_unclosed_raw_elements_take_linear_time():
    import time

    began = time.perf_counter()
    assert m.main_text("<article><p>Text of it</p>" + "<svg>" * 50_000 + "</article>") == "Text of it"
    assert time.perf_counter() - began < 2


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Text of it</p></article>", 5, "old")], "page_id long, url string, html string, n_chars long, text string")
    assert [tuple(r) for r in m.extract(df).collect()] == [(1, "u", "Text of it")]
