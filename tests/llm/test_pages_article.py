from skarn.llm import pages


def test_article_text_outside_the_main_path(spark):
    """The body holds nine tenths of the article; title, lead and closing words stay, what all pages share doesn't."""
    long = " ".join(f"word{i}" for i in range(120))
    page = '<body><nav>m</nav><article><header class="entry-header"><h1>Title {0}</h1><p>Spread the word</p></header><div class="body"><p>{0} ' + long + "</p><p>{0} more</p></div><section><p>Closing {0}</p></section></article><p>Bye {0}</p></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(8)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n\n{i} {long}\n\n{i} more\n\nClosing {i}" for i in range(8)}


def test_equal_articles_keep_their_titles(spark):
    page = "<body><article><header><h1>Same title</h1></header><div class='body'><p>" + "the same words " * 30 + "</p></div></article></body>"
    rows = [(i, "http://h.example/", page) for i in range(5)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("Same title\n\nthe same") for r in got) and len(got) == 5


def texts(spark, sources, host="http://h.example/"):
    rows = [(i, f"{host}{i}", x) for i, x in enumerate(sources)]
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def body(i, more=""):
    return f"<body><nav><p>Menu</p></nav><article><h1>Title {i}</h1><p>Story {i} goes on.</p>{more}</article><footer>End</footer></body>"


def test_classes_settle_doubtful_names(spark):
    """One and the same name is the template's on one host, and one page's own section on another."""
    section = '<section id="related-work" class="side-effects"><p>Text {0}</p></section>'
    every = texts(spark, [body(i, section.format(i)) for i in range(9)])
    assert every == {i: f"Title {i}\n\nStory {i} goes on." for i in range(9)}
    once = texts(spark, [body(i, section.format(i) if i == 4 else "") for i in range(9)])
    assert once == {i: f"Title {i}\n\nStory {i} goes on." + ("\n\nText 4" if i == 4 else "") for i in range(9)}
    blocks = pages.read_page(body(4, section.format(4)))[1]  # what no template would leave
    assert "Text 4" not in pages.choose(blocks, None, set()) and "Text 4" in pages.choose(blocks, None, set(), doubted=set())
    assert texts(spark, [body(0, section.format(0))]) == {0: "Title 0\n\nStory 0 goes on."}  # a host of one page


def test_whole_words_always_leave_out(spark):
    more = '<div class="comments"><p>First!</p></div><p class="ad">Buy</p>'
    assert texts(spark, [body(i, more if i == 2 else "") for i in range(6)])[2] == "Title 2\n\nStory 2 goes on."


def test_headers_and_forms_inside_articles(spark):
    page = '<body><form action="x"><div class="post"><div class="post-header"><h1>Title {0}</h1></div><p>Story {0} goes on.</p><form><p>Sign</p></form></div></form></body>'
    assert texts(spark, [page.format(i) for i in range(5)])[3].startswith("Title 3\n\nStory 3 goes on.")
    assert texts(spark, [body(0, "<form><p>Your mail</p></form>")]) == {0: "Title 0\n\nStory 0 goes on."}


def test_a_very_long_page_and_constant_text_of_marked_pages(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    page = "<body><div class='content'><p>Share this</p><article><p>{0}</p></article><p>Share this too</p></div></body>"
    got = texts(spark, [page.format(f"{i} {long if i == 1 else 'short'}") for i in range(5)])
    assert got == {i: f"{i} {long if i == 1 else 'short'}" for i in range(5)}
