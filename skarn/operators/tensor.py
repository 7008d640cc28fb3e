"""Array arithmetic and the layers of a small convolutional network, on array columns and without a shuffle.

An image is one array, row by row, the channels of a place side by side. Convolution, pooling and dense layers are
matrix products over Arrow batches; their weights travel with the function and are no part of the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_AT_ONCE = 1 << 22  # values in a layer's largest matrix


def _layer(a: Column, run: Callable[[np.ndarray], np.ndarray], width: int) -> Column:
    """run over a batch of arrays as a matrix, some rows at once; width: values that a row takes in it. Null arrays stay null."""

    def go(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        some = np.flatnonzero(v.notna().to_numpy())
        step = max(1, _AT_ONCE // width)
        for low in range(0, len(some), step):
            at = some[low : low + step]
            for i, row in zip(at, run(np.stack(v.iloc[at].to_numpy()).astype(np.float64)), strict=True):
                out.iat[i] = row
        return out

    return F.pandas_udf(go, "array<double>")(a)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def add_nested(a: Column, b: Column) -> Column:
    """Sum of two matrices, as arrays of rows."""
    return F.zip_with(a, b, add)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def times(a: Column, scalar: float | Column) -> Column:
    return F.transform(a, lambda x: x * scalar)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def conv2d_same(image: Column, rows: int, columns: int, kernel: Sequence) -> Column:
    """The image with kernels of odd size over it, stride 1, zeros outside.

    kernel: rows by columns for one channel; or rows by columns by channels in by channels out.
    """
    k = np.asarray(kernel, np.float64)
    k = k[:, :, None, None] if k.ndim == 2 else k
    high, wide, inner, outer = k.shape

    def run(x: np.ndarray) -> np.ndarray:
        x = np.pad(x.reshape(len(x), rows, columns, inner), ((0, 0), (high // 2,) * 2, (wide // 2,) * 2, (0, 0)))
        patches = np.lib.stride_tricks.sliding_window_view(x, (high, wide), (1, 2))  # row, place, channel, then the patch
        product = patches.reshape(len(x) * rows * columns, -1) @ k.transpose(2, 0, 1, 3).reshape(-1, outer)
        return product.reshape(len(x), -1)

    return _layer(image, run, rows * columns * high * wide * inner)


def relu(a: Column, bias: float | Sequence[float] = 0.0) -> Column:
    """bias: one for all values, or one for each channel."""
    if isinstance(bias, (int, float)):
        return F.transform(a, lambda x: F.greatest(x + F.lit(float(bias)), F.lit(0.0)))
    each = F.array(*map(F.lit, map(float, bias)))
    return F.transform(a, lambda x, i: F.greatest(x + F.get(each, i % len(bias)), F.lit(0.0)))


def max_pool_2x2(image: Column, rows: int, columns: int, channels: int = 1) -> Column:
    """The greatest of each 2x2 tile, stride 2; tiles over the edge are smaller."""
    down, across = -(-rows // 2), -(-columns // 2)

    def run(x: np.ndarray) -> np.ndarray:
        x = np.pad(x.reshape(len(x), rows, columns, channels), ((0, 0), (0, rows % 2), (0, columns % 2), (0, 0)), constant_values=-np.inf)
        return x.reshape(len(x), down, 2, across, 2, channels).max((2, 4)).reshape(len(x), -1)

    return _layer(image, run, rows * columns * channels)


def dense(a: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """One output for each row of weights."""
    w, b = np.asarray(weights, np.float64).T.copy(), np.asarray(bias, np.float64)
    return _layer(a, lambda x: x @ w + b, max(w.shape))


def softmax_cross_entropy(logits: Column, label: Column) -> Column:
    most = F.array_max(logits)
    return F.ln(total(F.transform(logits, lambda x: F.exp(x - most)))) + most - F.get(logits, label)


def argmax(a: Column) -> Column:
    """Place of the greatest, the first of several, from 0."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def truncated_normal(count: int, deviation: float = 0.1, seed: int = 0) -> list[float]:
    """First weights of a layer: normal draws, drawn again beyond two deviations."""
    rng = np.random.default_rng(seed)
    out = rng.normal(0, deviation, count)
    while (far := np.abs(out) > 2 * deviation).any():
        out[far] = rng.normal(0, deviation, int(far.sum()))
    return out.tolist()


def dropout(a: Column, keep: float, seed: int = 0) -> Column:
    """All values at keep 1, as in evaluation; else each kept with that chance and scaled up."""
    if keep >= 1:
        return a
    return F.transform(a, lambda x, i: F.when(F.pmod(F.xxhash64(F.lit(seed), i, x), F.lit(1 << 20)) < int(keep * (1 << 20)), x / keep).otherwise(0.0))
