import random
import re

import numpy as np

from skarn.llm import neardup
from skarn.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    links, top = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, least[root(i)], links[i], len(sets[i])) for i, (d, _) in enumerate(rows)]


def rows():
    rng = random.Random(5)
    out = []
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.choice([6, 40, 120, 400]))
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append((len(out), " ".join(copy)))
    long = " ".join(rng.choices(WORDS, k=30_000))
    return [*out, (None, out[0][1]), (3, out[3][1]), (900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "two\twords"), (905, long), (906, long + " end")]


def test_against_all_pairs(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, set_id string, cluster int")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    wanted = sorted(plain(data), key=key)
    assert sorted((tuple(r) for r in neardup.jaccard_join(df).drop("text_hash").collect()), key=key) == wanted
    monkeypatch.setattr(neardup, "BLOCK_NODES", 2)  # all clusters in several blocks
    assert sorted((tuple(r) for r in neardup.jaccard_join(df).drop("text_hash").collect()), key=key) == wanted
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    full = {r[1] for r in wanted if r[3]}
    assert kept.count() == len(full) + 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.jaccard_join(df).collect() == [] and neardup.one_of_each(df).collect() == []


def test_depth_and_keys():
    depth = neardup.prefix_depth(0.8, 0.995)
    assert 1 - (1 - 0.8**depth) ** neardup.TREES >= 0.995 > 1 - (1 - 0.8 ** (depth + 1)) ** neardup.TREES
    rng, met = np.random.default_rng(0), 0
    for _ in range(300):
        both, one, two = (rng.integers(0, 2**63, n, np.uint64) for n in (160, 20, 20))
        a, b = np.concatenate([both, one]), np.concatenate([both, two])
        keys = neardup.prefix_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), neardup.TREES, depth)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 0.98 * 300


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        top[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(top)}
