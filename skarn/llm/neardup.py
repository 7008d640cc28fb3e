"""N-gram Jaccard join: MinHash bands propose candidates, exact shingle sets decide.

A text's set holds its distinct windows of five words (texts of one to four words: one shingle of all of them). Rows
with equal sets are one node from then on, so copies are never paired. Each node has a MinHash signature for each of
several trees, cut at one depth for all data: the greatest at which a pair exactly at the threshold is met in some tree
with the target recall. This is LSH by bands and no forest of sorted prefixes. Nodes that share a whole prefix,
directly or through others, form a cluster; within it all exact Jaccard similarities are computed by blocks of
bounded size, as counts, without a row for each pair.

Texts are equal in a shingle if 64-bit hashes of its words are; nodes are told apart by a 128-bit hash of their set.

Defined cases: null texts and texts without words have no set, no link and a class of their own; rows with a null or
repeated doc_id are joined each by its own text; a class has the least doc_id of its rows (null if all are null);
an empty table gives no rows; other columns of the input are not looked at, whatever their names. Every link at or
above the threshold inside a cluster is counted; a link between clusters is missed with a chance of 1 - recall at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .components import components
from .textbatch import Texts, mix, pieces

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.995
TREES, LONGEST = 24, 12
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 20


def prefix_depth(threshold: float, recall: float, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix at which a pair of this similarity is met in some tree with this recall; 1 at least."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and where each text's begin (n + 1)."""
    words = texts.words()
    at, hashes = words.windows(width)
    doc = words.doc[at]
    counts = words.counts(len(texts))
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        first = (np.cumsum(counts) - counts)[few]
        whole = [mix(np.array([counts[d]], np.uint64) + _chain(words.hashes[f : f + counts[d]]))[0] for d, f in zip(few, first, strict=True)]
        doc, hashes = np.concatenate([doc, few]), np.concatenate([hashes, np.array(whole, np.uint64)])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def _chain(hashes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for x in hashes:
        h = mix(h + x)
    return h[0]


def prefix_keys(hashes: np.ndarray, ends: np.ndarray, trees: int, depth: int, seed: int = 5) -> np.ndarray:
    """For each non-empty set and tree: a hash of the first depth values of its signature there."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, (trees, depth), np.uint64) * np.uint64(2) + np.uint64(1)
    begin = ends[:-1][ends[1:] > ends[:-1]]
    out = np.zeros((len(begin), trees), np.uint64)
    for t in range(trees if len(begin) else 0):
        key = np.full(len(begin), t, np.uint64)
        for k in range(depth):
            key = mix(key + np.minimum.reduceat(hashes * factors[t, k], begin))
        out[:, t] = key
    return out


def _set_ids(hashes: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]


def signatures(documents: DataFrame, depth: int, trees: int = TREES) -> DataFrame:
    """doc_id, text_hash, set_id, shingles, keys (trees longs) of each row; null set_id and keys without words."""
    store.ship(documents.sparkSession)
    df = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("_text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                hashes, ends = shingle_sets(Texts.of(part.column(2)))
                keys = prefix_keys(hashes, ends, trees, depth).view(np.int64)
                sizes = np.diff(ends)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(sizes > 0, trees, 0)))), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_set_ids(hashes, ends), pa.binary()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "text_hash", "set_id", "shingles", "keys"])
        store.trim()

    return df.mapInArrow(sign, f"doc_id {kind}, text_hash long, set_id binary, shingles long, keys array<long>")


def candidate_clusters(nodes: DataFrame) -> DataFrame:
    """node, cluster for the nodes (node long, keys) that share a prefix with another."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").select(F.col("key").alias("_key"), "hub")
    edges = keyed.join(store.cut(store.gathered(shared), "prefixes"), F.col("key") == F.col("_key")).where("node != hub")
    found = components(edges.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    return found.withColumnRenamed("component", "cluster")


def _overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first split sets with the others (with each other if split is all)."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    kind, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = counts > 1
    number = np.cumsum(useful) - 1
    hit = useful[code]
    owner, code = owner[hit], number[code[hit]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    left, right = (split, len(sets) - split) if split < len(sets) else (split, split)
    total, step, width = np.zeros((left, right), np.int64), 4096, int(useful.sum())
    for low in range(0, width, step):
        a, b = np.searchsorted(code, [low, low + step])
        present = np.zeros((len(sets), min(step, width - low)), np.float32)
        present[owner[a:b], code[a:b] - low] = 1
        total += (present[:split] @ (present[split:] if split < len(sets) else present).T).astype(np.int64)
    return total


def _compare(ids: list[bytes], copies: np.ndarray, sets: list[np.ndarray], split: int, threshold: float) -> tuple[np.ndarray, list[bytes]]:
    """Links of each set (counting copies) with the other side, and the least id of those it is connected to here."""
    inside = split == len(sets)
    over = _overlaps(sets, split)
    size = np.array([len(x) for x in sets])
    left, right = np.arange(split), np.arange(len(sets)) if inside else np.arange(split, len(sets))
    union = size[left][:, None] + size[right][None, :] - over
    linked = over >= threshold * union - 1e-9
    if inside:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(sets), np.int64)
    links[left] += linked @ copies[right]
    if not inside:
        links[right] += copies[left] @ linked
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(*np.nonzero(linked), strict=True):
        p, q = root(int(left[x])), root(int(right[y]))
        if p != q:
            p, q = (p, q) if ids[p] < ids[q] else (q, p)
            parent[q] = p
    return links, [ids[root(x)] for x in range(len(sets))]


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """set_id, links, top from rows of low, high (block numbers), block, cluster, set_id, copies, text; one task holds two blocks."""
    names = ("cluster", "low", "high", "block", "set_id")
    df = rows.repartition("cluster", "low", "high").sortWithinPartitions(*names).select(*names, "copies", "set")

    def done(group: list[tuple], low: int) -> pa.RecordBatch:
        once = {(g[3], g[4]): g for g in group}
        group = [once[k] for k in sorted(once)]
        split = sum(g[3] == low for g in group)
        ids, copies = [g[4] for g in group], np.array([g[5] for g in group], np.int64)
        links, tops = _compare(ids, copies, [g[6] for g in group], split, threshold) if group[0][1] == group[0][2] or 0 < split < len(group) else (np.zeros(len(group), np.int64), ids)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(links), pa.array(tops, pa.binary())], names=["set_id", "links", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            sets = batch.column(6)
            for i, row in enumerate(zip(*columns, strict=True)):
                if row[:3] != key:
                    if group:
                        yield done(group, key[1])
                    key, group = row[:3], []
                group.append((*row, np.frombuffer(sets[i].as_buffer(), np.uint64)))
        if group:
            yield done(group, key[1])
        del group
        store.trim()

    return df.mapInArrow(run, "set_id binary, links long, top binary")


def jaccard_join(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, n_shingles for each row of documents."""
    return joined(documents, threshold, recall, trees).drop("class")


def joined(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """doc_id, text_hash, class, class_id, n_links, n_shingles for each row of documents.

    class: the class itself, by a set_id in it, null without words; classes of repeated or null ids may share a class_id.

    n_links: how many other rows have a similarity of threshold or more with it; class_id: the least doc_id of all rows
    that links lead to, one after the other.
    """
    rows = store.cut(signatures(documents, prefix_depth(threshold, recall, trees), trees), "signatures")
    first = F.min(F.struct("doc_id", "text_hash")).alias("row")
    nodes = rows.where("set_id is not null").groupBy("set_id").agg(first, F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("shingles").alias("shingles"), F.max("keys").alias("keys"))
    nodes = store.cut(nodes.withColumn("node", F.xxhash64("set_id")), "nodes")
    clusters = candidate_clusters(nodes)
    sizes = clusters.join(nodes.select("node", "shingles"), "node").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_SHINGLES)).alias("blocks")
    sizes = store.cut(store.gathered(sizes.select(F.col("cluster").alias("_cluster"), blocks)), "clusters")
    placed = clusters.join(nodes.select("node", "set_id", "copies", "row"), "node").join(sizes, F.col("cluster") == F.col("_cluster"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("blocks")))
    placed = placed.select("cluster", "blocks", "block", "set_id", "copies", F.col("row.doc_id").alias("_doc"), F.col("row.text_hash").alias("_hash"))
    placed = store.cut(store.gathered(placed), "placed")
    wanted = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("_text"))
    wanted = wanted.join(placed.hint("merge"), (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("cluster", "blocks", "block", "set_id", "copies", "_text")

    def reshingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                hashes, ends = shingle_sets(Texts.of(part.column(5)))
                sets = [hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(sets, pa.binary())], names=["cluster", "blocks", "block", "set_id", "copies", "set"])
        store.trim()

    sets = wanted.mapInArrow(reshingle, "cluster long, blocks long, block long, set_id binary, copies long, set binary")
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    checked = store.cut(_verify(paired, threshold), "links")
    links = checked.groupBy("set_id").agg(F.sum("links").alias("links"))
    classes = components(checked.where("set_id != top").select(F.col("set_id").alias("a"), F.col("top").alias("b")))
    known = nodes.select("set_id", "copies", "least").join(links, "set_id", "left").join(classes.withColumnsRenamed({"node": "set_id", "component": "class"}), "set_id", "left")
    known = store.cut(store.gathered(known.withColumn("class", F.coalesce("class", "set_id"))), "known")
    least = store.cut(store.gathered(known.groupBy("class").agg(F.min("least").alias("class_id")).withColumnRenamed("class", "_class")), "classes")
    found = known.join(least, F.col("class") == F.col("_class")).select(F.col("set_id").alias("_set"), "class", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = rows.join(store.cut(store.gathered(found), "found"), F.col("set_id") == F.col("_set"), "left")
    alone = F.col("set_id").isNull()
    return out.select("doc_id", "text_hash", "class", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.col("shingles").alias("n_shingles"))


def one_of_each(documents: DataFrame, **how) -> DataFrame:
    """The rows of documents without near copies: of each class the row with the least doc_id and text hash stays.

    Rows without words all stay. Rows alike in doc_id and text are one row afterwards, the one with the least hash of all columns; a class whose ids are
    all null keeps the row with the least text hash.
    """
    p = store.prefix(documents)
    found = joined(documents, **how)
    keep = found.where("n_shingles > 0").groupBy("class").agg(F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("row"), F.count("*").alias("n"))
    keep = store.cut(store.gathered(keep.select(F.col("row.doc_id").alias(f"{p}_doc"), F.col("row.text_hash").alias(f"{p}_hash"), F.col("n").alias(f"{p}_n"))), "kept")
    blank = documents.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    full = documents.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col(f"{p}_doc")) & (F.xxhash64("text") == F.col(f"{p}_hash")))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    first = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(f"{p}_row")
    several = full.where(f"{p}_n > 1").groupBy(f"{p}_doc", f"{p}_hash").agg(first).select(f"{p}_row.*")
    return full.where(f"{p}_n = 1").select(*columns).unionByName(store.gathered(several)).unionByName(store.gathered(blank.select(*columns)))
