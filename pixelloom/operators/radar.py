"""Speckle filters and equivalent looks over 7 by 7 windows of radar images (x, y, bands).

Filters choose one half of each window, so they see a window as a whole: cells are dealt to
square tiles with a rim of three cells from the neighbours, and a tile is one Arrow group of
bounded size.  Cells whose window is not complete keep their values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cdf import digamma
from .change import LAYOUT
from .local import determinant, span
from .ranks import range_of

TILE, RIM = 256, 3
#: The edge masks over a window's corners, sides and middle.
EDGES = (((-1, 0, 1), (-1, 0, 1), (-1, 0, 1)), ((0, 1, 1), (-1, 0, 1), (-1, -1, 0)), ((1, 1, 1), (0, 0, 0), (-1, -1, -1)), ((1, 1, 0), (1, 0, -1), (0, -1, -1)))


def half_windows() -> np.ndarray:
    """Eight half windows of 21 cells: the three left columns and the triangle below the
    diagonal, each turned by quarters."""
    columns, triangle = np.zeros((7, 7), bool), np.zeros((7, 7), bool)
    columns[:, :3] = True
    for row in range(1, 7):
        triangle[row, :row] = True
    return np.array([np.rot90(base, turn) for turn in range(4) for base in (columns, triangle)])


def _chosen(window: np.ndarray) -> np.ndarray:
    """Which half window fits each 7 by 7 window (..., 7, 7): the edge's direction is that of
    the largest mask sum over a 3 by 3 thinning, the first of equal ones, its side the one
    nearer to the middle.  Sums are taken cell by cell, added ones first, each row by row: equal
    sums are equal only up to their order."""
    w = window[..., ::3, ::3]

    def strength(mask: np.ndarray) -> np.ndarray:
        total = 0.0
        for sign in (1, -1):
            for i, j in np.argwhere(mask == sign):
                total = total + sign * w[..., i, j]
        return total

    edge = np.argmax(np.stack([strength(np.array(m)) for m in EDGES], -1), -1)
    far = lambda i, j: np.abs(w[..., 1, 1] - w[..., i, j])
    one = [far(1, 0) < far(1, 2), far(2, 0) < far(0, 2), far(0, 1) < far(2, 1), far(0, 0) < far(2, 2)]
    pick = [(0, 4), (1, 5), (6, 2), (7, 3)]
    return np.select([edge == i for i in range(4)], [np.where(o, a, b) for o, (a, b) in zip(one, pick)])


def _tiled(grid: DataFrame, bands: list[str], f) -> DataFrame:
    """``f`` over dense tiles {band: 2-D array with NaN for missing cells}."""
    lo = lambda c, d: F.floor((F.col(c) + d) / TILE)
    sent = grid.select("x", "y", *[F.col(b).cast("double").alias(b) for b in bands])
    sent = sent.withColumn("tx", F.explode(F.array_distinct(F.array(lo("x", -RIM), lo("x", RIM))))).withColumn("ty", F.explode(F.array_distinct(F.array(lo("y", -RIM), lo("y", RIM)))))

    def tile(key, part: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = key[0] * TILE - RIM, key[1] * TILE - RIM
        x, y = (part["x"] - x0).to_numpy(), (part["y"] - y0).to_numpy()
        dense = {b: np.full((TILE + 2 * RIM, TILE + 2 * RIM), np.nan) for b in bands}
        for b in bands:
            dense[b][y, x] = part[b]
        done = f(dense)
        own = (x >= RIM) & (x < TILE + RIM) & (y >= RIM) & (y < TILE + RIM)
        out = {"x": part["x"][own], "y": part["y"][own]}
        for b in bands:
            v = done[b][y[own], x[own]]
            out[b] = np.where(np.isnan(v), dense[b][y[own], x[own]], v)
        return pd.DataFrame(out)

    return sent.groupBy("tx", "ty").applyInPandas(tile, "x long, y long, " + ", ".join(f"{b} double" for b in bands))


def _windows(a: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(a, (7, 7))


def _half(windows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance over the chosen half of each window, cell by cell, each row by
    row: their last digits hang on that order, and a tie of the rounding on the last digits.  Of
    equal values the variance is exactly 0."""
    flat, masks = windows.reshape(*windows.shape[:2], 49), half_windows().reshape(8, 49)
    mean, var = np.full(which.shape, np.nan), np.full(which.shape, np.nan)
    for i, m in enumerate(masks):
        at = which == i
        total = middle = squares = np.zeros(np.count_nonzero(at))
        for n, v in enumerate(flat[at][:, m].T, 1):
            off = v - middle
            total, middle = total + v, middle + off / n
            squares = squares + (v - middle) * off
        mean[at], var[at] = total / n, squares / n
    return mean, var


def gamma_map(grid: DataFrame, bands: list[str], looks: float) -> DataFrame:
    """The Gamma maximum a posteriori filter, band by band; windows without variance stay."""

    def one(a: np.ndarray) -> np.ndarray:
        out = np.full(a.shape, np.nan)
        w = _windows(a)
        whole = ~np.isnan(w).any((-1, -2))
        g = w[..., 3, 3]
        mu, var = _half(w, _chosen(np.where(np.isnan(w), 0, w)))
        with np.errstate(all="ignore"):
            alpha = np.abs((1 + 1 / looks) / (var / mu**2 - 1 / looks))
            b = mu * (alpha - looks - 1)
            x = (b + np.sqrt(4 * g * looks * alpha * mu + b * b)) / (2 * alpha)
        out[RIM:-RIM, RIM:-RIM] = np.where(whole & (var > 0) & np.isfinite(x), x, np.nan)
        return out

    return _tiled(grid, bands, lambda dense: {b: one(dense[b]) for b in bands})


def mmse(grid: DataFrame, bands: list[str], looks: float) -> DataFrame:
    """The minimum mean square error filter of a polarimetric matrix: half windows and weights
    from the span, the same for all bands."""
    diagonal = {9: (0, 5, 8), 4: (0, 3), 3: (0, 1, 2), 2: (0, 1), 1: (0,)}[len(bands)]

    def run(dense: dict) -> dict:
        total = sum(dense[bands[i]] for i in diagonal)
        w = _windows(total)
        whole = ~np.isnan(w).any((-1, -2))
        which = _chosen(np.where(np.isnan(w), 0, w))
        mean, var = _half(w, which)
        with np.errstate(all="ignore"):
            k = np.where(var > 0, np.maximum((1 - mean * mean / (var * looks)) / (1 + 1 / looks), 0), 0.0)
        out = {}
        for b in bands:
            v = _windows(dense[b])
            m, _ = _half(v, which)
            out[b] = np.full(total.shape, np.nan)
            out[b][RIM:-RIM, RIM:-RIM] = np.where(whole, m + k * (v[..., 3, 3] - m), np.nan)
        return out

    return _tiled(grid, bands, run)


# ------------------------------------------------------------- equivalent looks


def looks_table(p: int) -> list[float]:
    """p ln n - sum of digamma(n - i), i < p, for n = 0, 0.1 .. 79.9; infinite where it is not
    defined."""
    value = lambda n: p * math.log(n) - sum(digamma(n - i) for i in range(p)) if n > p - 1 else math.inf
    return [value(i / 10) for i in range(800)]


def looks_lookup(spark) -> DataFrame:
    """(n, p1, p2, p3): the table for matrices of each size, from the first n that all have."""
    t = [looks_table(p) for p in (1, 2, 3)]
    return spark.createDataFrame([(i / 10, t[0][i], t[1][i], t[2][i]) for i in range(21, 800)], "n double, p1 double, p2 double, p3 double")


def window_sums(grid: DataFrame, columns: list[str], radius: int = RIM) -> DataFrame:
    """Sums over the square window around each cell whose window is complete: along x, then
    along y, so a cell is sent to 2 (2 r + 1) places and not to (2 r + 1)^2."""
    out = grid.select("x", "y", *columns, F.lit(1).alias("n_"))
    for axis in ("x", "y"):
        at = F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius))
        moved = out.withColumn("at_", at).drop(axis).withColumnRenamed("at_", axis)
        out = moved.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in columns], F.sum("n_").alias("n_"))
    return out.filter(F.col("n_") == (2 * radius + 1) ** 2).drop("n_")


def equivalent_looks(grid: DataFrame, bands: list[str]) -> DataFrame:
    """The maximum likelihood estimate of the number of looks in each complete window whose
    determinants are all positive: the least n of the table from which its value falls below
    the window's; 0 if none does."""
    p = LAYOUT[len(bands)][0]
    det = determinant([F.col(b) for b in bands])
    logs = grid.withColumn("det_", det).withColumn("log_", F.when(F.col("det_") > 0, F.log("det_")))
    sums = window_sums(logs.withColumn("bad_", (F.col("log_").isNull()).cast("int")), [*bands, "log_", "bad_"]).filter("bad_ = 0")
    n = float((2 * RIM + 1) ** 2)
    whole = determinant([F.col(b) / n for b in bands])
    rows = sums.withColumn("a_", F.log(whole) - F.col("log_") / n)
    table = looks_table(p)
    first = next(i for i, v in enumerate(table) if math.isfinite(v))
    falling = [-v for v in table[first:]]  # rising, so that halving finds the first one beyond
    at = range_of(-F.col("a_"), falling) + first
    return rows.select("x", "y", F.when(at >= len(table), 0.0).otherwise(at / 10).alias("enl"))


def span_of(grid: DataFrame, bands: list[str]) -> DataFrame:
    return grid.withColumn("span", span([F.col(b) for b in bands]))
