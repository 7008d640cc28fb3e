import random

from skarn.llm import neardup


def test_repeated_and_null_ids_are_classes_of_their_own(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(rng.choices([f"w{i}" for i in range(400)], k=200)) for _ in range(4))
    rows = [(1, a), (1, b), (2, b + " end"), (3, a + " end"), (None, c), (None, c + " end"), (None, d), (None, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in neardup.one_of_each(df).collect()]
    assert {r for r in kept if r[0]} == {(1, a), (1, b)}
    nulls = [t for i, t in kept if i is None]
    assert len(nulls) == 2 and d in nulls and (c in nulls or c + " end" in nulls)
    assert neardup.jaccard_join(df).columns == ["doc_id", "text_hash", "class_id", "n_links", "n_shingles"]
