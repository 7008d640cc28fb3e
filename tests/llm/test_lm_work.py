"""The language model's work: events summed in tasks and buckets, and neighbouring slots."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skarn.llm import lm
from skarn.llm.textbatch import Texts


def test_tally_passes_every_event_on(monkeypatch):
    rng = np.random.default_rng(4)
    texts = Texts.of(pa.array([" ".join("".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(40)) for _ in range(50)] + ["", None, "abc " * 300]))
    wanted: dict = {}
    for _, event, _, window, so_far in lm.spelt(texts):
        for e in event:
            wanted[int(window[e]), int(so_far[e])] = wanted.get((int(window[e]), int(so_far[e])), 0) + 1
    monkeypatch.setattr(lm, "STRETCH", 200)
    for bits, waiting, kept in ((20, 1 << 20, 1 << 20), (3, 50, 1 << 20), (3, 50, 100)):  # places that events take from each other
        monkeypatch.setattr(lm, "TALLY_BITS", bits)
        monkeypatch.setattr(lm, "KEPT", kept)
        tally, found, rows = lm.Tally(), {}, 0
        passed = []
        for _, _, window, so_far in lm.Row.of(texts).stretches():
            tally.add(window, so_far)
            if tally.sum(waiting):
                passed.append(tally.passed[0])
                tally.passed = [tuple(x[:0] for x in tally.passed[0])]
        for window, so_far, n, _ in [*passed, *tally.rest()]:
            rows += len(n)
            for w, s, k in zip(window.tolist(), so_far.tolist(), n.tolist(), strict=True):
                found[w, s] = found.get((w, s), 0) + k
        assert found == wanted
        assert rows == len(wanted) or kept == 100  # once for each, if all can be kept


def test_events_are_summed_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 500)
    docs = spark.createDataFrame([(i, f"ab cd{i % 7} ef " * 20) for i in range(60)], "doc_id long, text string").repartition(5)
    events = lm.event_counts(docs, F.lit(True))
    assert "HashAggregate" not in events._jdf.queryExecution().toString()  # no row for each event goes through an aggregation
    rows = events.collect()
    assert len({(r.window, r.so_far) for r in rows}) == len(rows)
    assert sum(r.n for r in rows) == sum(20 * (3 + 4 + 3) + 1 for _ in range(60))
    assert {r.hash: r.n for r in lm.tokens_of(events).collect()}[-1] == 60


def test_slots_of_four_bits_are_neighbours():
    s = lm.spell([b"abcdefgh", b"xyz", b"\xc3\xa9\xff\x01"])
    for half in range(2):
        slots = np.array([lm.slots_of(s, 4 * half + b)[0][:, 1:] for b in range(4)])
        assert (slots // 16 == slots[0] // 16).all()
        assert all(len(set(x)) == 4 for x in slots.reshape(4, -1).T.tolist())
