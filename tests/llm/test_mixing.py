import math

from pyspark.sql import functions as F

from skarn.llm import mixing

KIND = "doc_id long, text string, source string, size string"


def docs(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 3}", "x") for i in range(300)]
    return spark.createDataFrame([*rows, (None, "a b c", None, "x"), (None, "a b c", None, "x"), (7, None, "s1", "x"), (8, "", None, "x"), (9, "b " * 5000, "s2", "x")], KIND)


def plain_targets(sizes):
    """sizes: source to words. Weights in order of source, null last; capped at 3 times the size, the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_and_taken(spark):
    df = docs(spark)
    rows = mixing.taken_words(df).collect()
    assert len(rows) == df.count()
    by_source = {r.source: r.n for r in df.withColumn("n", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    target = plain_targets(by_source)
    got = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        got.setdefault(r.source_size, [0, r.target])[0] += r.taken
    for source, size in by_source.items():
        assert math.isclose(got[size][1], target[source])
        assert got[size][0] == math.floor(target[source])
    again = mixing.taken_words(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.taken)
    assert sorted(rows, key=key) == sorted(again, key=key)


def test_schedule_is_spread(spark):
    _, targets = mixing.stream_documents(docs(spark))
    slots = mixing.schedule(targets, 8).orderBy("slot").collect()
    assert len({r.slot for r in slots}) == len(slots)
    share = {}
    for half in (slots[: len(slots) // 2], slots[len(slots) // 2 :]):
        for r in half:
            share.setdefault(r.s, [0, 0])[half is not slots and half[0].slot > 0] += 1
    for first, second in share.values():
        assert abs(first - second) <= 12
    ranks = {}
    for r in slots:
        ranks.setdefault(r.s, set()).add(r["rank"])
    assert all(x == set(range(len(x))) for x in ranks.values())


def test_empty_and_wordless(spark):
    df = docs(spark)
    assert mixing.taken_words(df.limit(0)).collect() == []
    assert [r.taken for r in mixing.taken_words(df.where("doc_id = 7 and text is null")).collect()] == [0]


def test_whole_documents(spark):
    df = docs(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    counts = {r[0]: r[1] for r in out.where("doc_id is not null").groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 3 + 3  # ids 7, 8 and 9 are on two rows each


def test_copies_of_rows_that_differ_stay_apart(spark):
    """One id and text in two sources: each row is repeated by its own source's share, reruns agree, and slots are in order."""
    df = spark.createDataFrame([(1, "a b c d", "s0", "x"), (1, "a b c d", "s1", "y"), *[(i, "w " * 30, "s1", "z") for i in range(2, 12)], *[(50, "v " * 9, "s0", "r")] * 5], KIND)
    out = mixing.mixed_documents(df, slot="slot")
    assert out.columns == [*df.columns, "slot"]
    key = lambda r: str(r)
    assert sorted(out.collect(), key=key) == sorted(mixing.mixed_documents(df.repartition(5), slot="slot").collect(), key=key)
    rows, pieces = mixing.mix(df)
    heads = pieces.where("from_word = 0").join(rows, ["s", "bucket", "n"]).groupBy("doc_id", "row_hash").count().groupBy("doc_id").agg(F.sum("count")).collect()
    assert sorted((r.doc_id, r[1]) for r in out.groupBy("doc_id").count().collect()) == sorted(map(tuple, heads))
    assert {r["size"] for r in out.where("doc_id = 1").collect()} <= {"x", "y"} and out.where("source = 's0' and size = 'y'").count() == 0
