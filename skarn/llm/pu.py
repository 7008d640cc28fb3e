"""Positive-unlabelled text classifiers: a linear model that minimises the non-negative unbiased risk.

Training sees trusted positives and unlabelled texts. With the class prior p, the risk of the unseen negatives is the
unlabelled texts' risk as negatives less p times the positives' risk as negatives; where that difference falls below
zero the step goes the other way, so the model can't profit from it. The unlabelled texts are all texts: every step sums
their risk and its slope over the whole table, task by task, and takes a limited-memory quasi-Newton step.

The prior is estimated from the unlabelled texts: a first model is fitted with half of the positives, and the least
ratio, over all thresholds, of the share of unlabelled texts above one to the share of the other positives above it is
the prior, after a margin for both samples' sizes has chosen the threshold. (The share of label 1 among labelled rows
starts the first model; it stands in where there are fewer than LEAST_POSITIVES.) The labelled rows, both labels, fit a scale and an
offset for the scores, so that 0.5 is the line.

Two kinds of features, both sets of column numbers for each text: ``word_features`` (hashed words and word
beginnings present) and ``shape_features`` (binned rates of the rule statistics). Of many columns those are kept whose
frequencies among the positives and in the whole table differ most.

Bounded sample: at most ``rows`` labelled rows, those with the least hash of doc_id. All else covers every text.

Defined cases: a null text counts as empty and gets a score like any text; rows with a null doc_id have no label and
are never held out; repeated rows get equal scores; a doc_id with several labels has the highest; without positives
in training every score is 0, and with positives only it is 1; an empty table gives no rows; other columns of the
input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .rules import count_rules
from .textbatch import Texts, pieces, run_hashes

WORD_DIMS = 1 << 18
BEGINNING = 5  # bytes
_APART = np.ones(256, bool)  # bytes between words: all but letters, digits and what isn't ASCII
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bin edges of the rates.
EDGES = np.array([1e-9, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0])
RATES = 8
SHAPE_DIMS = RATES * (len(EDGES) + 1)
MANY = 4096  # columns beyond which some are chosen
STEPS, MEMORY = 30, 8  # quasi-Newton steps of each of the two models, and how many of them form the next
DECAY = 1e-4
LEAST_POSITIVES = 40
BINS = 1024  # of scores, for the prior
_CHUNK = 4096
TASK_ROWS, FEW_TASKS = 20_000, 64

Features = tuple[np.ndarray, np.ndarray]  # text number and column, for each feature that is present


def word_features(texts: Texts, useful: np.ndarray | None = None) -> Features:
    """Each text's distinct words and beginnings of longer words, A-Z as a-z, hashed to WORD_DIMS columns; only the useful ones if given."""
    gap = _APART[texts.data]
    starts, ends = texts.runs(gap)
    kept, lengths = texts.data[~gap], ends - starts
    place = np.arange(len(kept)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    short = lengths <= BEGINNING
    whole = run_hashes(kept, lengths, fold=True)
    begun = ~run_hashes(kept[place < BEGINNING], np.minimum(lengths, BEGINNING), fold=True)[~short]
    column = (np.concatenate([whole, begun]) >> np.uint64(46)).astype(np.int64)
    doc = texts.owner(np.concatenate([starts, starts[~short]]))
    if useful is not None:
        hit = useful[column]
        column, doc = column[hit], doc[hit]
    both = np.unique(doc * WORD_DIMS + column)
    return both // WORD_DIMS, both % WORD_DIMS


def shape_features(texts: Texts, useful: np.ndarray | None = None) -> Features:
    """One column for each rate: the bin that holds it."""
    s = count_rules(texts)
    n, letters = np.maximum(s["n_words"], 1), np.maximum(s["n_letters"], 1)
    rates = np.column_stack([
        s["n_symbols"] / n, s["n_marks"] / n, s["n_bare_marks"] / n, s["n_lower_starts"] / n, s["n_repeat_words"] / n,
        s["n_upper"] / letters, s["word_chars"] / n / 4, np.log10(1 + s["n_words"]),
    ])
    column = np.searchsorted(EDGES, rates, "right") + np.arange(RATES) * (len(EDGES) + 1)
    return np.repeat(np.arange(len(texts)), RATES), column.ravel()


@dataclass
class Linear:
    weights: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    prior: float | None = None

    def scores(self, rows: Sample) -> np.ndarray:
        return _sigmoid(self.scale * (rows.apply(self.weights) + self.offset) + self.shift)


@dataclass
class Sample:
    """Rows of features; doc numbers run from 0 to n - 1 without the rows' order meaning anything."""

    doc: np.ndarray
    column: np.ndarray
    n: int

    def pick(self, wanted: np.ndarray) -> Sample:
        number = np.cumsum(wanted) - 1
        hit = wanted[self.doc]
        return Sample(number[self.doc[hit]], self.column[hit], int(wanted.sum()))

    def apply(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights[self.column], self.n)

    def frequency(self, dims: int) -> np.ndarray:
        return np.bincount(self.column, minlength=dims)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def select_columns(positives: np.ndarray, n_positive: int, everything: np.ndarray, n: int, most: int = MANY, least_rows: int = 4) -> np.ndarray:
    """The columns whose frequencies differ most between the positives and all texts, by a two-sample z score."""
    n_positive, n = max(1, n_positive), max(1, n)
    p, q, pooled = positives / n_positive, everything / n, (positives + everything + 1) / (n_positive + n + 2)
    z = np.abs(p - q) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.9999)) * (1 / n_positive + 1 / n))
    z[positives + everything < least_rows] = 0
    best = np.argsort(-z, kind="stable")[:most]
    keep = np.zeros(len(z), bool)
    keep[best[z[best] > 4]] = True
    return keep


def table_sums(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, rows: int | None = None) -> np.ndarray:
    """The sum over df's tasks of the vector that partial makes of a task's rows; zeros for no rows.

    The tasks' vectors are added in two levels, or by the driver alone if df has so few rows (given) that at most FEW_TASKS
    tasks of TASK_ROWS rows read them. Either way the order of the tasks is the order of the sum.
    """
    tasks = None if rows is None else max(1, -(-rows // TASK_ROWS))
    df = df if tasks is None else df.coalesce(tasks)
    kinds, names = "chunk long, part long, sums binary", ["chunk", "part", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part = partial(batches), TaskContext.get().partitionId()
        for c in range(0, size, _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([c // _CHUNK]), pa.array([part], pa.int64()), pa.array([sums[c : c + _CHUNK].astype(np.float64).tobytes()], pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for c, k, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(x, np.float64)
                held[c, k % 16] = held[c, k % 16] + x if (c, k % 16) in held else x
        for (c, k), x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=names)

    some = df.mapInArrow(run, kinds)
    if tasks is None or tasks > FEW_TASKS:
        some = some.repartition("chunk", F.pmod("part", F.lit(16))).sortWithinPartitions("chunk", "part").mapInArrow(add, kinds)  # 16 rows for each chunk
    some = some.collect()
    out = np.zeros(size)
    for r in sorted(some, key=lambda r: (r.chunk, r.part)):
        out[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] += np.frombuffer(r.sums, np.float64)
    return out


def column_counts(texts: DataFrame, features: Callable[..., Features], dims: int) -> np.ndarray:
    """How many of all texts (column _text) have each column."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros(dims)
        for batch in batches:
            for part in pieces(batch, "_text"):
                counts += np.bincount(features(Texts.of(part.column(0)))[1], minlength=dims)
        return counts

    return table_sums(texts.select("_text"), partial, dims)


def sample_of(columns: pa.Array, number: np.ndarray, dims: int) -> Sample:
    """Rows of lists of columns, renumbered by number (the place of a kept column, else -1)."""
    ends = columns.offsets.to_numpy()
    column = columns.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    doc = np.repeat(np.arange(len(columns)), np.diff(ends))
    column = number[column]
    return Sample(doc[column >= 0], column[column >= 0], len(columns))


def _slope(s: Sample, per_row: np.ndarray, dims: int) -> np.ndarray:
    return np.append(np.bincount(s.column, per_row[s.doc], dims), per_row.sum())


def unlabelled_sums(table: DataFrame, number: np.ndarray, w: np.ndarray, rows: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Over all rows of table (columns): the sum of their risk as negatives, its slope, and how many have each score bin."""
    dims = len(w) - 1
    held = table.sparkSession.sparkContext.broadcast((number, w))

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        (number, w), out = held.value, np.zeros(1 + dims + 1 + BINS)
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                s = sample_of(batch.column(0).slice(low, 2000), number, dims)
                z = s.apply(w[:-1]) + w[-1]
                out[0] += _exact(np.logaddexp(0, z)).sum()
                out[1 : dims + 2] += _slope(s, _exact(_sigmoid(z)), dims)
                out[dims + 2 :] += np.bincount(_bins(z), minlength=BINS)
        return out

    found = table_sums(table.select("columns"), partial, 1 + dims + 1 + BINS, rows)
    held.unpersist()
    return found[0], found[1 : dims + 2], found[dims + 2 :]


def _exact(x: np.ndarray) -> np.ndarray:
    """Rounded to 2^-30, so that sums of millions of rows are the same in any order."""
    return np.round(x * (1 << 30)) / (1 << 30)


def _bins(z: np.ndarray) -> np.ndarray:
    return np.minimum((_sigmoid(z) * BINS).astype(np.int64), BINS - 1)


def nn_pu(positive: Sample, unlabelled: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], n: int, prior: float, scale: np.ndarray, start: np.ndarray | None = None, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offset (the last) of the least non-negative unbiased logistic risk found, and their bins of unlabelled scores.

    unlabelled: the sums of unlabelled_sums for given weights, over n rows. scale: of each weight, so that the risk bends
    alike in all directions. A step that raises the risk is halved; one from where the negatives' risk is below zero
    goes up that risk's slope.
    """
    dims = len(scale) - 1
    at = np.append(np.zeros(dims), np.log(prior / (1 - prior))) / scale if start is None else start / scale
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    past: list[tuple[np.ndarray, np.ndarray]] = []
    here, slope, direction, length = np.inf, None, None, 1.0
    origin = at
    for _ in range(steps + 1):
        w = at * scale
        loss_u, slope_u, bins = unlabelled(w)
        zp = positive.apply(w[:-1]) + w[-1]
        negative = loss_u / n - prior * np.mean(np.logaddexp(0, zp))
        flat = np.append(np.full(dims, DECAY), 0.0) * w
        g_negative = slope_u / n - prior * _slope(positive, _sigmoid(zp), dims) / positive.n
        risk = prior * np.mean(np.logaddexp(0, -zp)) + max(0.0, negative) + 0.5 * float(flat @ w)
        if best is None or risk < best[0]:
            best = risk, w, bins
        if negative < 0:  # no model can have such a risk: undo what made it
            at, past, here, slope, length = at + scale * g_negative, [], np.inf, None, 1.0
            origin = at
            continue
        g = (prior * _slope(positive, _sigmoid(zp) - 1, dims) / positive.n + g_negative + flat) * scale
        if risk > here and length > 0.1:
            length /= 2
            at = origin + length * direction
            continue
        if slope is not None and (at - origin) @ (g - slope) > 1e-12:
            past = [*past[-MEMORY + 1 :], (at - origin, g - slope)]
        here, slope, origin, length = risk, g, at, 1.0
        direction, taken = -g, []
        for ds, dg in reversed(past):
            taken.append((ds @ direction) / (ds @ dg))
            direction = direction - taken[-1] * dg
        if past:
            direction = direction * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (ds, dg), a in zip(past, reversed(taken), strict=True):
            direction = direction + (a - (dg @ direction) / (ds @ dg)) * ds
        at = origin + direction
    return best[1], best[2]


def class_prior(bins: np.ndarray, others: np.ndarray, sure: float = 0.9) -> float:
    """The share of positives among unlabelled texts with so many in each score bin, by the scores (bins) of positives that the model hasn't seen."""
    up = lambda x: np.cumsum(x[::-1])[::-1]
    above_u, above_p = up(bins) / bins.sum(), up(np.bincount(others, minlength=BINS)) / len(others)
    margin = np.sqrt(np.log(4 / (1 - sure)) / 2 / bins.sum()) + np.sqrt(np.log(4 / (1 - sure)) / 2 / len(others))
    some = np.flatnonzero(above_p > 0)
    best = some[np.argmin((above_u[some] + margin) / above_p[some])]
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Scale and shift of z for the logistic that fits y, by damped Newton steps; smoothed targets keep it finite."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    size = max(float(np.abs(z).max(initial=0)), 1e-9)
    x, w = np.column_stack([z / size, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w += np.clip(np.linalg.solve(hess, x.T @ (target - p) - 1e-3 * w), -3, 3)
    return max(float(w[0]) / size, 1e-6), float(w[1])


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(folds))


def fit(documents: DataFrame, labels: DataFrame, label: str, features: Callable[..., Features], dims: int, rows: int = 12_000, seed: int = 11) -> tuple[Linear, DataFrame | None]:
    """Train on the labelled rows given (doc_id and label) and on all documents as unlabelled.

    Returns the model and the features of all documents (doc_id, columns; those columns alone that may have a weight), or None if none are needed.
    """
    spark = documents.sparkSession
    store.ship(spark)
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = store.cut(store.least_hashes(store.cut(marked, "labels"), "_id", rows, seed), "chosen-labels")
    df = documents.select("doc_id", F.col("text").alias("_text"))
    labelled = df.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_text", "_y")  # chosen: at most `rows` rows

    def extract(useful: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "_text"):
                    doc, column = features(Texts.of(part.column(1)), useful)
                    ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(column, pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(i) for i in range(2, part.num_columns)), lists], names=[*(x for x in part.schema.names if x != "_text"), "columns"])

        return run

    key = f"doc_id {df.schema['doc_id'].dataType.simpleString()}"
    got = labelled.mapInArrow(extract(None), f"{key}, _y int, columns array<int>").orderBy("doc_id", "_y", "columns").toArrow().combine_chunks()
    y = got.column("_y").to_numpy().astype(np.int64)
    if not len(y) or not (y > 0).any():
        return Linear(np.zeros(dims), 0.0, constant=0.0), None
    if (y > 0).all():
        return Linear(np.zeros(dims), 0.0, constant=1.0), None
    lists, useful = got.column("columns").combine_chunks(), None
    if dims > MANY:
        known = sample_of(lists, np.arange(dims), dims)
        useful = select_columns(known.pick(y > 0).frequency(dims), int((y > 0).sum()), column_counts(df, features, dims), df.count())
    table = store.cut(df.mapInArrow(extract(useful), f"{key}, columns array<int>"), "features")
    n, kept = table.count(), np.ones(dims, bool) if useful is None else useful
    number = np.where(kept, np.cumsum(kept) - 1, -1)
    width = int(kept.sum())
    known = sample_of(lists, number, width)
    unlabelled = lambda w: unlabelled_sums(table, number, w, n)
    share = float(np.clip((y > 0).mean(), 0.01, 0.99))
    every, half = known.pick(y > 0), np.cumsum(y > 0) % 2 > 0
    often = np.append(np.clip(every.frequency(width) / every.n, 1e-3, 1), 1.0)
    scale = 1 / np.sqrt(0.25 * share * often + DECAY)
    prior, w = share, None
    if (y > 0).sum() >= LEAST_POSITIVES:
        w, bins = nn_pu(known.pick((y > 0) & half), unlabelled, n, share, scale)
        others = known.pick((y > 0) & ~half)
        prior = class_prior(bins, _bins(others.apply(w[:-1]) + w[-1]))
    w, _ = nn_pu(every, unlabelled, n, prior, scale, w)
    slant, shift = platt(known.apply(w[:-1]) + w[-1], y.astype(float))
    weights = np.zeros(dims)
    weights[kept] = w[:-1]
    return Linear(weights, float(w[-1]), slant, shift, prior=prior), table


def score(documents: DataFrame, model: Linear, table: DataFrame | None) -> DataFrame:
    """doc_id and score of every row of documents; table: the features of fit."""
    if model.constant is not None:
        return documents.select("doc_id", F.lit(float(model.constant)).alias("score"))
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        number = np.arange(len(m.weights))
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.scores(sample_of(part.column(1), number, len(number))))], names=["doc_id", "score"])

    return table.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")


def classify(documents: DataFrame, labels: DataFrame, label: str, features: Callable[..., Features], dims: int, folds: int, held: int, rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out rows (fold == held of folds) are not used."""
    training = labels.where(fold("doc_id", folds) != held)
    out = score(documents, *fit(documents, training, label, features, dims, rows))
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def quality(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, rows: int = 12_000) -> DataFrame:
    """classify by the shapes of texts; labels: doc_id, quality."""
    return classify(documents, labels, "quality", shape_features, SHAPE_DIMS, folds, held, rows)


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = 12_000) -> DataFrame:
    """classify by the words of texts; labels: doc_id, toxic."""
    return classify(documents, labels, "toxic", word_features, WORD_DIMS, folds, held, rows)
