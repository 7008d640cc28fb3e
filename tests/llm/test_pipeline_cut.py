"""The pipeline's first stage with more labelled rows than 50,000."""

import corpus_pipeline
from skarn.llm import rules


def test_first_stage_cuts_by_all_labelled_rows(spark, tmp_path):
    n = 56_000
    word = "concat(if(hash(x, id) % (2 + pmod(hash(id, 7), 61)) = 0, 'A', 'a'), char(97 + (id * 7 + x * 13) % 26), x, if(hash(id, x) % (2 + pmod(hash(id), 59)) = 0, '!#', ''))"
    text = f"array_join(transform(sequence(0, 55), x -> {word}), ' ')"
    docs = spark.range(n).selectExpr("id as doc_id", f"{text} as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 40 != 0 as int) as quality")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    judged = rules.quality_rules(docs, labels).join(labels, "doc_id").select("doc_id", "base_failed", "anomaly", "quality").toPandas()
    assert not judged.base_failed.any()
    cut = rules.calibrate(judged.anomaly.to_numpy(), judged.quality.to_numpy() > 0)
    got = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert cut < 1 and got == set(judged.doc_id[judged.anomaly < cut])
