"""Contexts of the language model over word boundaries."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.llm import lm
from skarn.llm.textbatch import Texts


@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_contexts_cross_words_but_not_texts(monkeypatch, stretch):
    monkeypatch.setattr(lm, "STRETCH", stretch)
    texts = ["Ab cd  abc\nx", None, "", " q\x00 longerword abcdefghij é", "ab cd", "Ab cd  abc\nx"]
    wanted, got = [], []
    for i, t in enumerate(texts):
        past = b""
        for w in [*(w + b" " for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())), lm.END]:
            for k in range(len(w)):
                wanted.append((i, w[k], past[-lm.REACH :], w[:k]))
                past += w[k : k + 1]
    for of, event, _, window, so_far in lm.spelt(Texts.of(pa.array(texts, pa.string()))):
        s = lm.spelling(window, so_far)
        got += [(int(o), int(s.byte[e]), s.contexts[e].tolist()) for o, e in zip(of, event, strict=True)]
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    for i, n in enumerate([*lm.ORDERS, None]):  # the same context just where the same bytes (or the same word so far) are before
        before = [w[2][-n:] if n else w[3] for w in wanted]
        assert len(set(before)) == len({g[2][i] for g in got}) == len({(b, g[2][i]) for b, g in zip(before, got, strict=True)})


def test_score_depends_on_the_order_of_words(spark):
    texts = ["red fox tin can " * 20, "blue fox old can " * 20] * 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, "red fox tin can"), (101, "can tin fox red"), (102, "tin fox red can")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < 100).collect()}
    assert found[100] > found[101] + 1 and found[100] > found[102] + 1


def test_counts_of_events_are_of_all_training_texts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    wanted: dict = {}
    for _, event, _, window, so_far in lm.spelt(Texts.of(pa.array(texts[:30]))):
        for e in event:
            k = int(window[e]), int(so_far.view(np.int64)[e])
            wanted[k] = wanted.get(k, 0) + 1
    for _ in range(2):
        assert {(r.window, r.so_far): r.n for r in lm.event_counts(docs, F.col("doc_id") < 30).collect()} == wanted
        monkeypatch.setattr(lm, "KEPT", 50)  # a task passes sums on several times


def test_scores_kept_from_before_are_the_same(spark, monkeypatch):
    texts = Texts.of(pa.array(["ab cd ef " * 5, "ab ce ef gh", "xy"]))
    words = spark.createDataFrame([(i, w, 3) for i, w in enumerate([b"ab", b"cd", b"ef", b"gh"])], "hash long, word binary, n long")
    tables = lm.train(words, 4)
    once, sizes = tables.text_scores(texts)
    monkeypatch.setattr(lm, "PLACE_BITS", 1)
    tables.met = None
    for _ in range(2):
        assert tables.text_scores(texts)[0].tolist() == once.tolist()
    assert sizes.tolist() == [46, 13, 4]
