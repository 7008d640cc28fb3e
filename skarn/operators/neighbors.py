"""Nearest neighbours of a stated query set among all rows, in blocks.

Queries and rows are dealt to blocks by a hash of their id, and every block of queries meets every block of rows in one
group, whose size both block sizes bound. A group keeps the nearest rows of its own for each query, and a grouped
minimum joins these: no pair of a row and a query is ever a row of a table, and nothing is collected. The rows travel
once for each block of queries, the queries once for each block of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 4096, 16384


def _near(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of rows (id, vector, label) for each of asked (id, vector), less the row of the same id."""
    names = ["query", "neighbour", "label", "distance"]
    parts = []
    if len(asked) and len(rows):
        points, x = (np.stack(t["vector"].to_numpy()).astype(np.float64) for t in (asked, rows))
        ids, mine, labels = asked["id"].to_numpy(), rows["id"].to_numpy(), rows["label"].to_numpy()
        for low in range(0, len(ids), 64):
            q = points[low : low + 64]
            d = np.zeros((len(q), len(x)))
            for j in range(x.shape[1]):  # in order, as a plain sum of squares would
                d += (q[:, j, None] - x[None, :, j]) ** 2
            d[ids[low : low + 64, None] == mine[None, :]] = np.inf
            if k < len(x):  # all that are no farther than the k-th nearest, so that ties can be told by id
                within = d <= np.partition(d, k - 1, 1)[:, k - 1, None]
            else:
                within = np.ones(d.shape, bool)
            within &= np.isfinite(d)
            at, of = np.nonzero(within)
            order = np.lexsort((mine[of], d[at, of], at))
            at, of = at[order], of[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            at, of = at[place < k], of[place < k]
            parts.append(pd.DataFrame({"query": ids[low + at], "neighbour": mine[of], "label": labels[of], "distance": d[at, of]}))
    return pd.concat(parts) if parts else pd.DataFrame({n: [] for n in names})


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query, rank (from 1), neighbour, label, distance (squared): the k nearest other rows of each query; ties by id."""
    there = F.col(key).isNotNull() & F.col(vector).isNotNull()
    asked = queries.where(there).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    among = rows.where(there).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).cast("int").alias("label"))
    m, n = max(1, -(-asked.count() // query_block)), max(1, -(-among.count() // row_block))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(m))).withColumn("r", every(n))
    among = among.withColumn("r", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n))).withColumn("q", every(m))
    found = asked.groupBy("q", "r").cogroup(among.groupBy("q", "r")).applyInPandas(lambda a, b: _near(a, b, k), "query long, neighbour long, label int, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "neighbour", "label", "distance")


def vote(neighbours: DataFrame, k: int) -> DataFrame:
    """query, predicted: the most frequent label of the k nearest, the least of several."""
    counts = neighbours.where(F.col("rank") <= k).groupBy("query", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("predicted"))


def sweep(neighbours: DataFrame, truth: DataFrame, most: int) -> DataFrame:
    """k, accuracy for every k up to most, from one search; truth: query, actual."""
    each = neighbours.where(F.col("rank") <= most).withColumn("k", F.explode(F.sequence(F.col("rank"), F.lit(most))))
    counts = each.groupBy("k", "query", "label").agg(F.count("*").alias("n"))
    votes = counts.groupBy("k", "query").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("predicted"))
    return votes.join(truth, "query").groupBy("k").agg(F.avg((F.col("predicted") == F.col("actual")).cast("int")).alias("accuracy"))
