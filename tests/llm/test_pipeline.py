import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from skarn.llm import queries, tokenstore

ROOT = Path(__file__).resolve().parents[2]
DATA = Path("/root/testdata/sf0.001")
here = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = queries.QUERIES[name](spark, str(DATA))
    wanted = con.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(wanted.columns)
    places = [wanted.columns.index(c) for c in order]
    assert sorted(str([r[c] for c in order]) for r in got.collect()) == sorted(str([r[i] for i in places]) for r in wanted.fetchall())


@here
def test_stages(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns, name
        assert all(seen[r.doc_id] == r.text for r in out.collect())
        docs = out
    ids = [r.doc_id for r in docs.collect()]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert [r.doc_id for r in last.orderBy("start").collect()] == sorted(ids)


def test_whole_run_against_brute_force(spark, tmp_path):
    """Every stage of one run, null ids, repeated rows and an extra column included, without labels, so that the base rules alone reject."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = {i: text(30) for i in range(4)}
    rows = [(i, text(rng.randint(60, 160)), "en", rng.choice(["a", "b", "b", None]), i % 7) for i in range(70)]
    rows += [(100 + k, rows[k][1], "en", "a", 0) for k in range(4)]  # exact copies
    rows += [(110 + k, rows[k][1] + " " + text(3), "en", "b", 0) for k in range(4)]  # near copies
    rows += [(120 + k, f"{text(40)} {items[k].upper()} {text(40)}", "de", "a", 0) for k in range(4)]  # leaks
    rows += [(130, "a b c " * 40, "en", "a", 0), (131, text(20), "en", "a", 0), (132, None, "en", "a", 0), (133, "", "en", None, 0)]  # rejected
    rows += [(None, text(80), "en", "b", 0), (None, text(90), None, "b", 1), rows[20], rows[20], (21, text(70), "en", "a", 9), (140, text(5000), "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _skarn_doc long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()

    def passes(t):
        w = (t or "").split()
        n = Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
        return len(w) >= 50 and 2 * len(again) <= len(w)

    left = [r for r in rows if passes(r[1])]
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].split() for r in left)]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    best = {}
    for r, g in zip(left, group, strict=True):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    left = list(best.values())
    assert len(left) < 85
    windows = lambda t: (lambda w: [tuple(w[k : k + 8]) for k in range(len(w) - 7)])(t.lower().split())
    known = [set(windows(t)) for t in items.values()]
    left = [r for r in left if not any(2 * len(k & set(windows(r[1]))) >= len(k) for k in known)]
    assert not any(r[0] in range(120, 124) for r in left)
    sizes = Counter()
    for r in left:
        sizes[r[3]] += len(r[1].split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target, total = {}, sum(sizes.values())
    while True:  # targets stop at three times a source's size
        free = [s for s in order if s not in target]
        rest, weight = total - sum(target.values()), {s: order.index(s) % 3 + 1 for s in free}
        over = [s for s in free if rest * weight[s] / sum(weight.values()) > 3 * sizes[s]]
        target |= {s: 3.0 * sizes[s] for s in over} if over else {s: rest * weight[s] / sum(weight.values()) for s in free}
        if not over:
            break
    mixed = []
    for s in order:
        at, key = 0, lambda r: "" if r[0] is None else hashlib.md5(str(r[0]).encode()).hexdigest()
        for r in sorted((r for r in left if r[3] == s), key=lambda r: (key(r), len(r[1].split()))):
            mixed += [r] * sum(k * sizes[s] + at < int(target[s]) for k in range(3))
            at += len(r[1].split())
    tokenizer = tokenstore.Encoder(queries.tokenizer_path()).tokenizer
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, queries.END_ID], "<u4").tobytes())
    named = lambda x: sorted((d is None, d or 0, c) for d, c in x)
    assert named((r.doc_id, r.ids_crc32) for r in got) == named((r[0], crc(r[1])) for r in mixed)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)


def test_empty_documents(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rest_imports_without_this_package(tmp_path):
    """A copy of the repository without the package and the pipeline still has its other queries."""
    import shutil

    shutil.copytree(ROOT / "skarn", tmp_path / "skarn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'drift_report' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
