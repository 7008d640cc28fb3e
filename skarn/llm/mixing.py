"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of ``block_words`` words. Slot i takes the point frac(i * golden ratio); the source
whose share of the targets, laid end to end over [0, 1), holds that point gets the slot. The slots of one source are
ranked, and rank r takes words r * block_words onwards of the source's own stream: its documents in the order of a
hash of their id, laid end to end and repeated. So every source is spread evenly over the mix, and takes exactly
floor(target) words: a source's last slot is cut there, and the few slots that discrepancy leaves a source short of
follow at the end of the schedule.

Running sums over a source are taken in two levels (buckets, then rows of a bucket), so no source meets in one task.

Defined cases: null texts have no words; documents without words are returned with 0 taken words; null sources are one
source, the last in order; rows with a null or repeated doc_id are documents of their own; an empty table, or one
without any word, gives no slot; other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 1024
MOST_REPEATS = 3
GOLDEN = 0.6180339887498949


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """s (rank of the source), source, source_size, target, wanted (whole words), low, high (its share of [0, 1)).

    sizes: source, size. Weights repeat over the sources in code point order, null last. Targets share the sum of all
    sizes by weight; a target stops at most times its source's size, and what is over is shared again.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), "s")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("source_size")
    s = s.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left") / F.col("left_w")).withColumn("k", F.row_number().over(by_cap))
    fits = F.when(F.col("level") * F.col("w") <= cap, F.struct("k", "level"))
    s = s.withColumn("open", F.min(fits).over(everything))
    s = s.withColumn("target", F.when(F.col("k") < F.col("open.k"), cap.cast("double")).otherwise(F.col("open.level") * F.col("w")))
    s = s.withColumn("wanted", F.floor("target"))
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("high", F.try_divide(F.sum("wanted").over(upto).cast("double"), F.sum("wanted").over(everything)))
    s = s.withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("s")))
    return s.select("s", "source", "source_size", "target", "wanted", "low", "high")


def _before(df: DataFrame, group: str, bucket: str, value: Column, name: str) -> DataFrame:
    """For each group and bucket: the sum of value in the group's earlier buckets."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias(name))
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum(name).over(earlier), F.lit(0)))


def _root(n: int) -> int:
    return max(16, int(n**0.5))


def row_hash(documents: DataFrame) -> Column:
    """A hash of all columns but maps: rows alike in it may stand for each other."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString()))


def stream_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """Documents without their text, each with its place [start, start + size) in its source's stream; the targets.

    Columns: doc_id, row_hash, size, s, source_size, target, wanted, bucket, n (bucket and n name a row of a source).
    """
    order = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    sized = documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_hash(documents).alias("row_hash"), order.alias("order"))
    sized = store.cut(sized, "mix-sizes")
    targets = store.cut(source_targets(sized, weights).coalesce(1), "mix-targets")
    buckets = _root(sized.count())
    first = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    rows = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    rows = rows.withColumn("bucket", F.coalesce(F.floor(first * buckets / 2**32), F.lit(0)))
    base = _before(rows, "s", "bucket", F.col("size"), "base")
    within = Window.partitionBy("s", "bucket").orderBy("order", "doc_id", "size", "row_hash")
    rows = rows.join(base, ["s", "bucket"])
    rows = rows.withColumn("n", F.row_number().over(within)).withColumn("start", F.col("base") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return store.cut(rows.drop("base", "order", "low", "high"), "mix-rows"), targets


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, s, rank: which source's which block each slot of the mix takes."""
    spark = targets.sparkSession
    need = F.ceil(F.col("wanted") / block_words)
    slots, sources = targets.agg(F.coalesce(F.sum(need), F.lit(0)), F.count("*")).first()
    cells = max(1024, 4 * sources)
    turn = 2**20  # the point of slot i, without the rounding of a large product
    point = F.floor(F.col("id") / turn) * ((turn * GOLDEN) % 1) % 1 + (F.col("id") % turn) * GOLDEN
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    shares = targets.where("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    placed = points.join(shares.select("s", "low", "high", "cell"), "cell").where("u >= low and u < high").select("slot", "s")
    placed = store.cut(placed.withColumn("part", F.floor(F.col("slot") / _root(slots))), "mix-slots")
    ranked = placed.join(_before(placed, "s", "part", F.lit(1), "base"), ["s", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("s", "part").orderBy("slot")) - 1)
    got = placed.groupBy("s").agg(F.count("*").alias("got"))
    wanted = targets.select("s", need.alias("need"))
    short = wanted.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    extra = short.select("s", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    extra = extra.withColumn("slot", slots + F.row_number().over(Window.orderBy("rank", "s")) - 1)
    used = ranked.join(wanted, "s").where("rank < need")
    return used.select("slot", "s", "rank").unionByName(extra.select("slot", "s", "rank"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The documents of stream_documents, and the pieces of the mix: slot, s, bucket, n, repeat, from_word, words.

    A piece is what a slot takes of a document: so many words from from_word on (0 is its first), in repeat 0, 1, 2.
    """
    rows, targets = stream_documents(documents, weights)
    size, start = F.col("source_size"), F.col("start")
    parts = rows.where("size > 0").withColumn("repeat", F.explode(F.expr("sequence(0L, greatest(0L, (wanted - 1 - start) div source_size))")))
    parts = parts.withColumn("at", F.col("repeat") * size + start).withColumn("to", F.least(F.col("at") + F.col("size"), F.col("wanted"))).where("at < to")
    parts = parts.withColumn("rank", F.explode(F.expr(f"sequence(at div {block_words}, (to - 1) div {block_words})")))
    begin = F.greatest(F.col("at"), F.col("rank") * block_words)
    end = F.least(F.col("to"), (F.col("rank") + 1) * block_words)
    parts = parts.select("s", "rank", "bucket", "n", "repeat", (begin - F.col("at")).alias("from_word"), (end - begin).alias("words"))
    return rows, parts.join(schedule(targets, block_words), ["s", "rank"]).select("slot", "s", "bucket", "n", "repeat", "from_word", "words")


def taken_words(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of documents: the words of it that the mix takes."""
    rows, pieces = mix(documents, weights)
    taken = pieces.groupBy("s", "bucket", "n").agg(F.sum("words").alias("taken"))
    out = rows.join(taken, ["s", "bucket", "n"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), slot: str | None = None) -> DataFrame:
    """The rows of documents, whole, once for each repeat in which a slot takes their first word; null doc_ids too.

    slot: a column to add, the place in the mix of the slot that takes a copy's first word; the mix is read in its order.
    Documents without words are in no slot and stay once (null slot). Rows alike in every column are repeated together.
    """
    p = store.prefix(documents)
    rows, pieces = mix(documents, weights)
    copies = pieces.where("from_word = 0").groupBy("s", "bucket", "n").agg(F.collect_list("slot").alias("slots"))  # at most MOST_REPEATS + 1
    counted = rows.join(copies, ["s", "bucket", "n"], "left")
    counted = counted.withColumn("slots", F.when(F.col("size") == 0, F.array(F.lit(None).cast("long"))).otherwise(F.coalesce("slots", F.array().cast("array<long>"))))
    counted = store.cut(counted.select(F.col("doc_id").alias(f"{p}_doc"), F.col("row_hash").alias(f"{p}_hash"), "slots"), "mix-slots")
    keys = [f"{p}_doc", f"{p}_hash"]
    known = counted.groupBy(*keys).agg(F.count("*").alias(f"{p}_rows"), F.min("slots").alias(f"{p}_slots"))
    found = documents.join(known.hint("merge"), F.col("doc_id").eqNullSafe(F.col(f"{p}_doc")) & (row_hash(documents) == F.col(f"{p}_hash")))
    single = found.where(f"{p}_rows = 1").withColumn(f"{p}_slot", F.explode(f"{p}_slots"))
    several = found.where(f"{p}_rows > 1").dropDuplicates(keys)  # alike in all columns
    more = counted.select(F.col(f"{p}_doc").alias(f"{p}_doc2"), F.col(f"{p}_hash").alias(f"{p}_hash2"), F.explode("slots").alias(f"{p}_slot"))
    several = several.join(more.hint("merge"), F.col(f"{p}_doc").eqNullSafe(F.col(f"{p}_doc2")) & (F.col(f"{p}_hash") == F.col(f"{p}_hash2")))
    columns = [*(F.col(f"`{c}`") for c in documents.columns), *([F.col(f"{p}_slot").alias(slot)] if slot else [])]
    return single.select(*columns).unionByName(several.select(*columns))
