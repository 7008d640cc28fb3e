"""Quality rules: an isolation forest over the rule statistics of whole texts.

``rule_statistics`` counts, for every text, what the rules look at. Two of them reject a text outright (too few
words; too many words in repeated three-word windows). For the rest an isolation forest decides: trees of random
splits, each grown on a subsample of its own that is drawn from the whole table (SUBSAMPLE rows, part of the method),
give each text its mean path length, and texts that are isolated early are anomalies. The cut between
anomalous and ordinary scores comes from all labelled rows: their scores stay in the cluster, and the one that is the
cut is found by counting them, some bits at a time.

Defined cases: a null text counts as empty; a text without words fails the base rules; rows with a null or repeated
doc_id are judged each on its own text; other columns of the input are not looked at, whatever their names. Without
labelled rows of both kinds no text is anomalous, so the base rules alone decide. Ties with the cut are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .textbatch import Texts, mix, pieces, run_hashes, running

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_marks", "n_bare_marks", "n_lower_starts")
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?|#*$%&<>=+~^_{}[]\\/@"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent of the words
TREES, SUBSAMPLE = 100, 256


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _MARK = _table(SYMBOLS), _table(MARKS)
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))


def _extra_repeats(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its text has it twice or more, and whether it is the first of its kind there."""
    key = mix(hashes + mix(doc.astype(np.uint64)))
    _, first, kind, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(key), bool)
    is_first[first] = True
    return counts[kind] > 1, is_first


def count_rules(texts: Texts) -> dict[str, np.ndarray]:
    """All statistics of BASE and MORE for each text."""
    n, data = len(texts), texts.data
    words = texts.words()
    out = {"n_words": words.counts(n)}
    lead = (data & 0xC0) != 0x80
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    out["word_chars"] = texts.total(lead & ~blank)
    out["n_symbols"] = texts.total(_SYMBOL[data])

    starts, ends = texts.runs(data == 10)
    in_word = running(~blank)
    hashes = run_hashes(data[data != 10], ends - starts)
    full = in_word[ends] > in_word[starts]
    doc = texts.owner(starts)
    _, first = _extra_repeats(doc[full], hashes[full])
    out["n_dup_lines"] = np.bincount(doc[full][~first], minlength=n)

    at, windows = words.windows(3)
    again, _ = _extra_repeats(words.doc[at], windows)
    covered = np.zeros(len(words.doc) + 2, bool)
    for k in range(3):
        covered[at[again] + k] = True
    out["n_repeat_words"] = np.bincount(words.doc[covered[: len(words.doc)]], minlength=n)

    out["n_upper"] = texts.total(_UPPER[data])
    out["n_letters"] = texts.total(_LETTER[data])
    out["n_marks"] = texts.total(_MARK[data])
    bare = _MARK[data[words.starts]] if len(words.starts) else np.zeros(0, bool)
    out["n_bare_marks"] = np.bincount(words.doc[bare], minlength=n)
    low = (data[words.starts] >= 97) & (data[words.starts] <= 122) if len(words.starts) else bare
    out["n_lower_starts"] = np.bincount(words.doc[low], minlength=n)
    return {k: out[k].astype(np.int64) for k in BASE + MORE}


def rule_statistics(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, then a long for each name in BASE and MORE, one row for each row of documents."""
    store.ship(documents.sparkSession)
    names = [f"_k{i}" for i in range(len(keep))]
    kept = documents.select(*(F.col(c).alias(k) for c, k in zip(keep, names, strict=True)), F.col("text").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                found = count_rules(Texts.of(part.column("_text")))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), *(pa.array(v) for v in found.values())], names=[*names, *found])
        store.trim()

    fields = [f"{k} {kept.schema[k].dataType.simpleString()}" for k in names]
    out = kept.mapInArrow(count, ", ".join([*fields, *(f"{c} long" for c in BASE + MORE)]))
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, names, strict=True)), *BASE, *MORE)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that don't depend on a text's length, float32, a row for each text."""
    n, letters = np.maximum(s["n_words"], 1), np.maximum(s["n_letters"], 1)
    per_word = [s[c] / n for c in ("n_symbols", "n_marks", "n_bare_marks", "n_lower_starts", "n_repeat_words")]
    return np.column_stack([*per_word, s["n_upper"] / letters]).astype(np.float32)


@dataclass
class Forest:
    """Trees in heap order: node k has the children 2k + 1 and 2k + 2. feature is -1 at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for texts that fewer random splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] >= cut[node]))
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _mean_path(n: int) -> float:
    """Mean depth at which a search in a random binary tree of n points ends."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow_forest(sample: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> Forest:
    """Each tree splits a subsample of its own at random features and values, to a depth of log2(subsample).

    The rows of sample, in random order, are dealt to the trees; if there are too few for that, each tree draws its own.
    """
    rng = np.random.default_rng(seed)
    enough = len(sample) >= trees * subsample
    subsample = max(2, min(subsample, len(sample)))
    depth = int(np.ceil(np.log2(subsample)))
    size = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, size), -1, np.int16), np.zeros((trees, size), np.float32), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, sample[t : trees * subsample : trees] if enough else sample[rng.permutation(len(sample))[:subsample]])]
        while todo:
            k, level, x = todo.pop()
            low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(0), np.zeros(0))
            open_ = np.flatnonzero(high > low)
            if level == depth or len(x) < 2 or not len(open_):
                length[t, k] = level + _mean_path(len(x))
                continue
            f = rng.choice(open_)
            c = np.float32(rng.uniform(low[f], high[f]))
            right = x[:, f] >= c
            feature[t, k], cut[t, k] = f, c
            todo += [(2 * k + 1, level + 1, x[~right]), (2 * k + 2, level + 1, x[right])]
    return Forest(feature, cut, length, _mean_path(subsample) or 1.0)


MOST_GOOD_LOST = 0.005


def calibrate(scores: np.ndarray, good: np.ndarray, most_good_lost: float = MOST_GOOD_LOST) -> float:
    """The cut that rejects most of the bad among those that reject at most that share of the good; above 1 if nothing helps."""
    if not good.any() or good.all():
        return 2.0
    allowed = np.sort(scores[good])[::-1]
    cut = allowed[min(len(allowed) - 1, int(most_good_lost * len(allowed)))]
    return float(np.nextafter(cut, 2.0))


def nth_largest(ranks: DataFrame, column: str, n: int) -> int:
    """The long, from 0, that n others come before in descending order; the driver gets at most 2^23 counts at once."""
    prefix = 0
    for shift in (40, 20, 0):
        inside = ranks.where(F.shiftright(column, shift + 20) == prefix) if shift < 40 else ranks
        counted = inside.groupBy(F.shiftright(column, shift).alias("_bin")).count().toArrow()
        bins, counts = (counted.column(i).to_numpy() for i in range(2))
        order = np.argsort(-bins)
        upto = np.cumsum(counts[order])
        at = int(np.searchsorted(upto, n, "right"))
        n -= int(upto[at - 1]) if at else 0
        prefix = int(bins[order[at]])
    return prefix


def calibrate_all(labelled: DataFrame, forest: Forest, most_good_lost: float = MOST_GOOD_LOST) -> float:
    """What calibrate gives for the scores of all rows of labelled (BASE, MORE and _good)."""
    held = labelled.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in BASE + MORE}
            ranks = held.value.scores(features(s)).view(np.int64)  # doubles from 0 are ordered as their bits are
            yield pa.RecordBatch.from_arrays([pa.array(ranks), batch.column(batch.schema.get_field_index("_good"))], names=["rank", "_good"])

    scored = store.cut(labelled.select(*BASE, *MORE, (F.col("_good") > 0).alias("_good")).mapInArrow(score, "rank long, _good boolean"), "labelled-scores")
    good, rows = scored.agg(F.coalesce(F.sum(F.col("_good").cast("long")), F.lit(0)), F.count("*")).first()
    if good in (0, rows):
        return 2.0
    rank = nth_largest(scored.where("_good"), "rank", min(good - 1, int(most_good_lost * good)))
    return float(np.nextafter(np.array([rank], np.int64).view(np.float64)[0], 2.0))


@dataclass
class RuleModel:
    forest: Forest
    cut: float


def fit_rules(statistics: DataFrame, labels: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> RuleModel:
    """Grow the forest, each tree on a subsample of its own from the whole table, and set its cut by all labelled rows.

    The trees' rows are those with the least hash of doc_id, so that reruns agree. labels: doc_id, quality (null: unlabelled).
    """
    marked = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("_good")).where("doc_id is not null and _good is not null")
    marked = marked.groupBy("doc_id").agg(F.max("_good").alias("_good"))
    eligible = statistics.where(~_base_failed()).select("doc_id", *BASE, *MORE)
    sample = store.least_hashes(eligible, "doc_id", trees * subsample, seed).toPandas()
    forest = grow_forest(features({c: sample[c].to_numpy() for c in BASE + MORE}), trees, subsample, seed)
    return RuleModel(forest, calibrate_all(eligible.join(marked, "doc_id"), forest))


def _base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(statistics: DataFrame, model: RuleModel) -> DataFrame:
    """statistics with base_failed, anomaly (the forest's score, double) and kept."""
    spark = statistics.sparkSession
    held = spark.sparkContext.broadcast(model)
    schema = statistics.schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            s = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in BASE + MORE}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.forest.scores(features(s)))], names=[*batch.schema.names, "anomaly"])

    out = statistics.mapInArrow(score, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, anomaly double")
    out = out.withColumn("base_failed", _base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(model.cut)))


def quality_rules(documents: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly and kept for each row of documents."""
    statistics = store.cut(rule_statistics(documents), "rules")
    return judge(statistics, fit_rules(statistics, labels, **fit))


def keep_good(documents: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The rows of documents that are kept, with all their columns.

    The texts are counted twice, once to fit and once to filter where they lie, so that none is shuffled.
    """
    model = fit_rules(store.cut(rule_statistics(documents), "rules"), labels, **fit)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in pieces(batch, "text"):
                s = count_rules(Texts.of(part.column(part.schema.get_field_index("text"))))
                failed = (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])
                yield part.filter(pa.array(~failed & (m.forest.scores(features(s)) < m.cut)))
        store.trim()

    return documents.mapInArrow(keep, documents.schema)
