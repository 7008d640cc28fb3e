"""The cut of the isolation forest over all labelled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import rules


@pytest.mark.parametrize("n", [0, 1, 7, 99])
def test_nth_largest(spark, n):
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.random(60), np.full(30, 0.75), 0.75 + rng.random(10) * 1e-15]).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "rank long")
    assert rules.nth_largest(df, "rank", n) == np.sort(values)[::-1][n]


def test_cut_is_of_all_labelled_rows(spark):
    """More labelled rows than the 50,000 that once set the cut, most of them equal."""
    n = 60_000
    made = spark.range(n).withColumnRenamed("id", "doc_id")
    columns = {c: F.lit(0) for c in rules.BASE + rules.MORE} | {"n_words": F.lit(1000), "n_letters": F.lit(5000), "n_symbols": (F.xxhash64("doc_id") % 500 + 500), "n_marks": F.col("doc_id") % 97}
    stats = made.select("doc_id", *(v.cast("long").alias(c) for c, v in columns.items()))
    labels = made.select("doc_id", (F.col("doc_id") % 50 != 0).cast("int").alias("quality"))
    model = rules.fit_rules(stats, labels, trees=8)
    judged = rules.judge(stats, model).join(labels, "doc_id").select("anomaly", "quality").toPandas()
    assert model.cut == rules.calibrate(judged.anomaly.to_numpy(), judged.quality.to_numpy() > 0)
    assert model.cut < 1


def test_without_both_kinds_no_row_is_anomalous(spark):
    made = spark.range(60).withColumnRenamed("id", "doc_id")
    stats = made.select("doc_id", *((F.lit(1000) + F.col("doc_id")).alias(c) for c in rules.BASE[:1]), *(F.col("doc_id").alias(c) for c in rules.BASE[1:] + rules.MORE))
    for labels in (made.selectExpr("doc_id", "1 as quality"), made.selectExpr("doc_id", "0 as quality"), made.limit(0).selectExpr("doc_id", "1 as quality")):
        assert rules.fit_rules(stats, labels, trees=4).cut == 2.0
