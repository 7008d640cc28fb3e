import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.llm import lm, pu
from skarn.llm.textbatch import Texts

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def corpus(spark, n=500):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        toxic, bad = i % 4 == 0, i % 5 == 0
        w = rng.choices(WORDS, k=rng.randint(15, 90))
        if toxic:
            w[3:3] = rng.sample(["loser", "scum", "Moron,"], 2)
        if bad:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "x", 1))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(None, "plain words", "x", 1), (3, None, "x", 1), (4, "", "x", 1), (5, "b " * 60_000, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, _y int"), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "label", "folds", "held"), [(pu.quality, "quality", 3, 1), (pu.toxicity, "toxic", 5, 0)])
def test_held_out_accuracy(spark, run, label, folds, held):
    docs, labels = corpus(spark)
    got = run(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.collect()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {i: int(i % 5 != 0) if label == "quality" else int(i % 4 == 0) for i in range(500)}
    tested = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id not in (3, 4, 5)]
    assert np.mean(tested) > 0.97
    # labels of held-out rows change nothing
    again = run(docs, labels.withColumn(label, F.when(pu.fold("doc_id", folds) == held, 1 - F.col(label)).otherwise(F.col(label))))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_classifier_without_labels(spark):
    docs, labels = corpus(spark, 30)
    assert {r.score for r in pu.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in pu.toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert pu.quality(docs.limit(0), labels).collect() == []


def test_prior_is_estimated_and_sums_cover_all_rows(spark):
    docs, labels = corpus(spark, 1500)
    model, table = pu.fit(docs, labels, "toxic", pu.word_features, pu.WORD_DIMS)
    assert model.prior == pytest.approx(0.25, abs=0.05)
    lists = [r["columns"] for r in table.select("columns").collect()]
    assert len(lists) == docs.count()
    kept = np.flatnonzero(np.bincount(np.concatenate([np.array(x, int) for x in lists]), minlength=pu.WORD_DIMS))
    number = np.full(pu.WORD_DIMS, -1)
    number[kept] = np.arange(len(kept))
    w = np.random.default_rng(2).normal(size=len(kept) + 1)
    z = np.array([sum(w[number[c]] for c in x) + w[-1] for x in lists])
    loss, slope, bins = pu.unlabelled_sums(table.repartition(5), number, w)
    assert loss == pytest.approx(np.log1p(np.exp(z)).sum()) and bins.sum() == len(lists)
    few = pu.unlabelled_sums(table.repartition(9), number, w, len(lists))
    assert few[0] == loss and np.array_equal(few[1], slope) and np.array_equal(few[2], bins)
    wanted = np.zeros(len(w))
    for x, p in zip(lists, 1 / (1 + np.exp(-z)), strict=True):
        wanted[[*(number[c] for c in x), -1]] += p
    assert np.allclose(slope, wanted)


def test_risk_against_plain_descent():
    """The quasi-Newton steps end about where many small plain steps do, and never below zero for the negatives."""
    rng = np.random.default_rng(7)
    x, y = (rng.random((4000, 12)) < 0.1).astype(float), np.zeros(4000)
    y[:1200] = 1
    x[:1200, :6] = rng.random((1200, 6)) < 0.7
    rows, columns = np.nonzero(x)
    everything = pu.Sample(rows, columns, len(x))
    positive = everything.pick(rng.random(4000) < 0.25 * y)

    def sums(w):
        z = x @ w[:-1] + w[-1]
        p = 1 / (1 + np.exp(-z))
        return np.logaddexp(0, z).sum(), np.append(x.T @ p, p.sum()), np.bincount(pu._bins(z), minlength=pu.BINS)

    def risk(w):
        zp = positive.apply(w[:-1]) + w[-1]
        negative = sums(w)[0] / 4000 - 0.3 * np.logaddexp(0, zp).mean()
        return 0.3 * np.logaddexp(0, -zp).mean() + max(0, negative) + pu.DECAY / 2 * (w[:-1] @ w[:-1]), negative

    w, bins = pu.nn_pu(positive, sums, 4000, 0.3, np.full(13, 2.0))
    v = np.zeros(13)
    for _ in range(6000):
        zp = positive.apply(v[:-1]) + v[-1]
        g = 0.3 * pu._slope(positive, 1 / (1 + np.exp(-zp)) - 1, 12) / positive.n + sums(v)[1] / 4000 - 0.3 * pu._slope(positive, 1 / (1 + np.exp(-zp)), 12) / positive.n
        g[:-1] += pu.DECAY * v[:-1]
        v -= 0.3 * g
    assert risk(w)[0] <= risk(v)[0] + 2e-3 and risk(w)[1] >= 0
    assert pu.class_prior(bins, pu._bins(positive.apply(w[:-1]) + w[-1])) == pytest.approx(0.3, abs=0.06)


def test_word_features_fold_case():
    a, b = (pu.word_features(Texts.of(pa.array([t])))[1].tolist() for t in ("Loser, loser!", "LOSER"))
    assert a == b and len(a) == 1


def test_base_scores_and_counts(spark):
    docs, _ = corpus(spark, 120)
    rows = lm.language_model(docs).collect()
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    texts = docs.select("doc_id", "text").collect()
    c = Counter(x for d in texts if not held(d.doc_id) for x in tokens(d.text))
    total, distinct = sum(c.values()), len(c)
    wanted = []
    for d in texts:
        t = tokens(d.text)
        wanted.append((str(d.doc_id), held(d.doc_id), len(t), sum(c[x] > 0 for x in t), total, round(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in t), 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == sorted(wanted)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in rows)


def test_rare_words_are_joined(spark, monkeypatch):
    docs, _ = corpus(spark, 60)
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6))
    one = sorted(map(key, lm.language_model(docs).collect()))
    monkeypatch.setattr(lm, "LEAST_SHARE", 20)  # nearly all words take the shuffle
    assert sorted(map(key, lm.language_model(docs).collect())) == one


@pytest.mark.parametrize("prefix", [b"", b"b", b"bans", b"zzzzqq"])
def test_probabilities_of_all_next_bytes_sum_to_one(spark, prefix):
    docs, _ = corpus(spark, 60)
    counts = lm.word_counts(docs, F.lit(True)).cache()
    tables = lm.train(counts, counts.count())
    s = lm.spell([prefix, *(prefix + bytes([b]) for b in range(256) if b != lm.STOP and prefix + bytes([b]) != lm.END)])  # the first is the stop
    begin = np.flatnonzero(np.append(True, s.word[1:] != s.word[:-1]))
    found = (10 ** tables.event_scores(s)[s.event[begin + len(prefix)]]).sum()
    if not prefix:
        found += 10 ** tables.word_scores([lm.END])[0]
    assert found == pytest.approx(1)
    frequent = counts.orderBy(F.desc("n")).first()
    assert tables.word_scores([frequent.word])[0] > tables.word_scores([b"zzqzzqzz"])[0]


def random_words(n, seed=3):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices("abcdefgh", k=rng.randint(1, 7))).encode() for _ in range(n)})


def test_scores_do_not_depend_on_partitions_or_batches(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLICE_WORDS", 150)  # several slices
    rng, words = random.Random(5), [w.decode() for w in random_words(700)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=40))) for i in range(300)] + [(900, "x" * 30_000)], "doc_id long, text string")
    found = []
    for parts, rows in ((4, 10_000), (16, 10_000), (3, 90)):
        with monkeypatch.context():
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            try:
                found.append(sorted((r.doc_id, r.score, r.base_score) for r in lm.language_model(docs.repartition(parts)).collect()))
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", 4)
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for other in found[1:]:
        assert np.allclose([r[1:] for r in other], [r[1:] for r in found[0]], rtol=1e-9, atol=0) and [r[0] for r in other] == [r[0] for r in found[0]]


def test_mixer_against_a_scalar_one(spark):
    """Counts, Newton steps, map and scores, event by event and bit by bit."""
    words = random_words(2500)
    n = [1 + len(w) * 7 % 11 for w in words]
    df = spark.createDataFrame(list(zip(range(len(words)), words, n, strict=True)), "hash long, word binary, n long")
    tables = lm.train(df, len(words))
    order = df.selectExpr("word", "n").collect()
    s, w = lm.spell([bytes(r.word) for r in order]), [r.n for r in order]
    weight = [0] * len(s.byte)
    for word, event in zip(s.word, s.event, strict=True):
        weight[event] += w[word]
    at = [[(slots[e].tolist(), int(y[e])) for slots, y in [lm.slots_of(s, bit)]] for bit in range(8) for e in range(len(s.byte))]
    at = {(bit, e): at[bit * len(s.byte) + e][0] for bit in range(8) for e in range(len(s.byte))}
    seen = {}
    for (_, e), (slots, y) in at.items():
        for slot in slots:
            seen.setdefault(slot, [0, 0])[y] += weight[e]
    code = lambda x: x if x < 15.5 else min(255, 16 + round(8 * math.log2(max(x, 16) / 16)))
    back = lambda c: c if c < 16 else 16 * 2 ** ((c - 16) / 8)
    for slot, (z, o) in list(seen.items())[::97]:
        assert tables.pairs[slot] == (code(z) << 8 | code(o))

    def inputs(slots, y=None):
        logits, levels = [], []
        for slot in slots:
            z, o = (back(code(x)) for x in seen[slot])
            z, o = max(0, z - (y == 0)), max(0, o - (y == 1))
            logits.append(math.log((o + 0.3) / (z + 0.3)))
            levels.append(sum(z + o > x for x in (0, 3, 30, 300, 3000)))
        return np.array([*logits, 1.0]), levels

    weights, past = lm.first_weights(), {}
    cells = {}
    line = np.argsort(lm.mix(s.contexts[:, -1]), kind="stable")
    mean = sum(weight) / len(weight)
    for turn in range(2):  # the first slice alone, then it again with all (there is one)
        for low in range(0, len(line), lm.MINI_BATCH):
            for bit in range(8):
                slope, met = {}, []
                for e in line[low : low + lm.MINI_BATCH]:
                    slots, y = at[bit, e]
                    x, levels = inputs(slots, y)
                    g = (bit * lm.LEVELS + levels[3]) * lm.LEVELS + levels[5]
                    mixed = float(x @ weights[g])
                    p = 1 / (1 + math.exp(-max(-16, min(16, mixed))))
                    if turn:
                        place = max(0, min(lm.STEPS - 1.001, mixed + lm.STEPS / 2))
                        node = (int(s.byte[e]) | 256) >> (8 - bit)
                        cell = ((int(s.contexts[e, 0]) & 255) << 8 | node) * lm.STEPS + int(place) + (place - int(place) > 0.5)
                        cells.setdefault(cell, [0, 0])[y] += weight[e]
                    k = weight[e] / mean
                    slope[g] = slope.get(g, 0) + x * (y - p) * k
                    past[g] = past.get(g, 20 * np.eye(lm.INPUTS)) + np.outer(x, x) * k * max(p * (1 - p), 1e-4)
                for g, d in slope.items():
                    weights[g] = np.clip(weights[g] + np.clip(np.linalg.solve(past[g], d), -0.2, 0.2), -1, 2)
    assert np.allclose(tables.weights, weights, atol=2e-3)
    some = [c for c, (z, o) in cells.items() if z + o > 200][::7]
    for c in some:
        z, o = cells[c]
        start = 1 / (1 + math.exp(-(c % lm.STEPS - lm.STEPS / 2)))
        assert tables.refined[c] == pytest.approx((o + 10 * start) / (z + o + 10), abs=0.02)
    spelt = [bytes(r.word) for r in order]
    for i in range(0, len(spelt), 211):
        score = 0.0
        for event in s.event[s.word == i]:
            for bit in range(8):
                slots, y = at[bit, event]
                x, levels = inputs(slots)
                z = float(x @ tables.weights[(bit * lm.LEVELS + levels[3]) * lm.LEVELS + levels[5]])
                place = max(0, min(lm.STEPS - 1.001, z + lm.STEPS / 2))
                cell = ((int(s.contexts[event, 0]) & 255) << 8 | ((int(s.byte[event]) | 256) >> (8 - bit))) * lm.STEPS + int(place)
                up = place - int(place)
                p = 0.5 / (1 + math.exp(-max(-16, min(16, z)))) + 0.5 * ((1 - up) * tables.refined[cell] + up * tables.refined[cell + 1])
                p = max(1e-6, min(1 - 1e-6, p))
                score += math.log10(p if y else 1 - p)
        assert tables.word_scores([spelt[i]])[0] == pytest.approx(score, rel=1e-4)


def test_a_very_long_word_is_spelt(spark):
    s = lm.spell([b"ab" * 200_000, b"ab", b"abab"])
    assert len(s.word) == 400_001 + 3 + 5
    assert s.event[400_001] == s.event[0] == s.event[400_004] and s.event[1] == s.event[400_005]  # the same beginnings


def test_no_training_rows(spark):
    docs, _ = corpus(spark, 5)
    assert {r.base_score for r in lm.score(docs, F.lit(False)).collect()} == {0.0}
    assert lm.language_model(docs.limit(0)).collect() == []
