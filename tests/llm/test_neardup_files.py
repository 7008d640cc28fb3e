"""Tables of short rows are a few files for each core, however many shuffle partitions there are."""

import random
from pathlib import Path

from skarn.llm import neardup, store


def test_narrow_tables_are_few_files(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=40)) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t + " q") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    held = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, known = {k: spark.conf.get(k) for k in held}, len(store._written)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        left = sorted(r.doc_id for r in neardup.one_of_each(docs).select("doc_id").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert left == list(range(600))
    most, files = 4 * spark.sparkContext.defaultParallelism, {}
    for _, path in store._written[known:]:
        name = Path(path).name.split("-")[1]
        files[name] = max(files.get(name, 0), len(list(Path(path.removeprefix("file://")).glob("part-*"))))
    narrow = ("prefixes", "edges", "labels", "hooked", "clusters", "placed", "known", "classes", "found", "kept")
    assert {k: files[k] for k in narrow if not 0 < files[k] <= most} == {}
