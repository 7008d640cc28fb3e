import random

import pytest

from skarn.llm import decontam, pages

ITEM = "Yesterday it was seen that John had 5 red apples in a big basket and then John gave 2 kg to her friend."
FILL = "some quite ordinary words stand here"
DOCS = {
    1: f"{FILL} {ITEM} {FILL}",
    2: f"{FILL} Yesterday it was seen that Mary had 7 red apples in a big basket and then Mary gave 31 kg to her friend. {FILL}",
    3: f"{FILL} Yesterday it was seen that Mary had 7 red apples in a big basket and then Bob gave 31 kg to her friend. {FILL}",
    4: f"{FILL} {FILL}",
    5: f"{FILL} red apples in a big basket and then {FILL}",
    6: ITEM.replace(" ", "  \n"),
    7: None,
    8: "",
    9: "word " * 5000 + ITEM,
    10: "1 2 3 4 5 6 7 8 9 10",
}
KIND = "doc_id long, text string, item_id string, w int"


def frames(spark):
    docs = spark.createDataFrame([*((d, t, "x", 0) for d, t in DOCS.items()), (1, DOCS[1], "x", 0), (None, DOCS[1], "x", 0)], KIND)
    items = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (2, "a few words", 0), (3, None, 0), (4, "", 0), (5, "3 4 5 6 7 8 9 10", 0)], "item_id long, text string, doc_id int")
    return docs, items


def test_leaks_and_slots(spark):
    docs, items = frames(spark)
    got = decontam.leaks(docs, items)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in got.collect()) == [(False, 1, 1), (False, 2, 1), (False, 6, 1), (False, 9, 1), (False, 10, 5), (True, 0, 1)]
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7, 8]


def test_short_item_is_looked_for_at_its_width(spark):
    docs = spark.createDataFrame([(1, "just A few words more"), (2, "few words a")], "doc_id long, text string")
    items = spark.createDataFrame([(2, "a few words")], "item_id long, text string")
    assert [r.doc_id for r in decontam.leaks(docs, items).collect()] == [1]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert decontam.leaks(docs, items.limit(0)).collect() == [] and decontam.leaks(docs.limit(0), items).collect() == []


def test_random_passages_against_search(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "ijklmnop"]
    words = ["".join(w.split()) for w in words]
    items = {i: " ".join(rng.choices(words, k=rng.choice([12, 30, 50]))) for i in range(20)}
    docs, wanted = {}, set()
    for d in range(60):
        parts = rng.choices(words, k=60)
        if d % 3 == 0:
            i = rng.randrange(20)
            parts[10:10] = items[i].upper().split() if d % 2 else items[i].split()
            wanted.add((d, i))
        docs[d] = " ".join(parts)
    df, bench = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert found == wanted
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)  # the shuffled way
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == wanted


@pytest.mark.parametrize("broken", [False, True])
def test_page_blocks(broken):
    end = "" if broken else "</p>"
    source = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="page">
      <header><p>Site</p></header><nav><ul><li>A<li>B</ul></nav><div class="cookie-notice">We use</div><!-- <p>no</p> -->
      <article><header><h1>Title &amp;  more</h1></header><p>One <b>two</b><br>three{end}<p>Four &lt;five&gt; &copy;{end}<div class="ad">Buy</div><ul><li>x<li>y</ul>
      <form><p>Mail</p></form><section id="comments"><p>First!</p></section></article><aside>Side</aside><footer>End</footer></body></html>"""
    blocks = pages.read_page(source)[1]
    assert [b.text for b in blocks if b.kept] == ["Title & more", "One two three", "Four <five> ©", "x", "y"]
    assert pages.choose(blocks, "/html/body.cpage/article", set()) == "Title & more\n\nOne two three\n\nFour <five> ©\n\nx\n\ny"


def test_template_without_marks(spark):
    """No element says what it is: the host's constant text goes, the varying slot stays."""
    page = "<html><body><div><p>Welcome to all</p><p>Pick one</p></div><div><p>{0} a long story of its own</p><p>{0} goes on and on</p></div><div><p>All rights</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"Page {i}"), "x") for i in range(8)]
    rows += [(50, None, "<article><p>lone &nbsp; page</p></article>", "x"), (51, "http://h.example/q", None, "x"), (52, "no url", "", "x"), (None, "http://h.example/0", rows[0][2], "x")]
    got = {(r.page_id, r.n_chars): r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    texts = {k[0]: v for k, v in got.items()}
    assert texts[3] == "Page 3 a long story of its own\n\nPage 3 goes on and on"
    assert texts[50] == "lone page" and texts[51] == texts[52] == ""
    assert texts[None] == texts[0] and len(got) == len(rows)
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_equal_articles_are_kept(spark):
    rows = [(i, "http://x.example/", "<body><nav>m</nav><article><p>The same on every page</p></article></body>") for i in range(9)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"The same on every page"}
