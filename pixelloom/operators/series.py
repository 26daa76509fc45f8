"""Distances and transforms of series held as arrays: Arrow batches for dynamic programmes,
array functions for filters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

WARP = "cost double, path_x array<int>, path_y array<int>"
COMMON = "length int, path_x array<int>, path_y array<int>"


def _warp(x: np.ndarray, y: np.ndarray, squared: bool, free: bool) -> tuple[float, list[int], list[int]]:
    """Dynamic time warping, by anti-diagonals; ``free``: x may start and end anywhere in y."""
    n, m = len(x), len(y)
    if not n or not m:
        return math.nan, [], []
    d = np.abs(x[:, None] - y)
    d = d * d if squared else d
    c = np.full((n + 1, m + 1), np.inf)
    c[0, :] = 0.0 if free else np.inf
    c[0, 0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        c[i, j] = d[i - 1, j - 1] + np.minimum(np.minimum(c[i - 1, j - 1], c[i, j - 1]), c[i - 1, j])
    i, j = n, int(c[n, 1:].argmin()) + 1 if free else m
    cost, px, py = float(c[i, j]), [], []
    while i > 0 and j > 0:
        px.append(i - 1)
        py.append(j - 1)
        if i == 1 and (free or j == 1):
            break
        steps = ((c[i - 1, j - 1], i - 1, j - 1), (c[i, j - 1], i, j - 1), (c[i - 1, j], i - 1, j))
        low = min(v for v, _, _ in steps)
        i, j = next((a, b) for v, a, b in steps if v == low)
    return cost, px[::-1], py[::-1]


def _array(v) -> np.ndarray:
    return np.zeros(0) if v is None else np.asarray(v, float)


def warp(squared: bool = False, free: bool = False):
    """A function of two array columns: cost (square root taken of squared costs) and path."""

    @pandas_udf(WARP)
    def f(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = [_warp(_array(a), _array(b), squared, free) for a, b in zip(x, y)]
        return pd.DataFrame([(math.sqrt(c) if squared and c >= 0 else c, p, q) for c, p, q in out], columns=["cost", "path_x", "path_y"])

    return f


def _common(equal: np.ndarray) -> tuple[int, list[int], list[int]]:
    """The longest common subsequence under a matrix of equalities, row by row: within a row,
    lengths only rise, so the running maximum stands for the step from the left."""
    n, m = equal.shape
    c = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        c[i, 1:] = np.maximum.accumulate(np.where(equal[i - 1], c[i - 1, :-1] + 1, c[i - 1, 1:]))
    i, j, px, py = n, m, [], []
    while i and j:
        if equal[i - 1, j - 1]:
            i, j = i - 1, j - 1
            px.append(i)
            py.append(j)
        elif c[i - 1, j] > c[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return int(c[n, m]), px[::-1], py[::-1]


def common(eps: float | None = None, delta: int | None = None):
    """A function of two array columns: length and path of the longest common subsequence of
    equal values, or of values within ``eps`` whose places differ by ``delta`` at most."""

    @pandas_udf(COMMON)
    def f(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(x, y):
            a, b = _array(a), _array(b)
            equal = a[:, None] == b if eps is None else np.abs(a[:, None] - b) < eps
            if delta is not None:
                equal &= np.abs(np.arange(len(a))[:, None] - np.arange(len(b))) <= delta
            out.append(_common(equal))
        return pd.DataFrame(out, columns=["length", "path_x", "path_y"])

    return f


def pairs(series: DataFrame, key: str, value: str) -> DataFrame:
    """Each two different series once: (s1, v1, s2, v2).  All pairs are what is asked for."""
    a, b = (series.select(F.col(key).alias(f"s{i}"), F.col(value).alias(f"v{i}")) for i in (1, 2))
    return a.join(b, F.col("s1") < F.col("s2"))


# ------------------------------------------------------------- wavelets

_R3 = math.sqrt(3)
#: Scaling filters, from their closed forms.
HAAR = (1 / math.sqrt(2), 1 / math.sqrt(2))
D4 = tuple(c / (4 * math.sqrt(2)) for c in (1 + _R3, 3 + _R3, 3 - _R3, 1 - _R3))


def detail_filter(h: tuple[float, ...]) -> tuple[float, ...]:
    return tuple((-1) ** i * c for i, c in enumerate(reversed(h)))


def _tap(x: Column, h: tuple[float, ...], at) -> Column:
    """Sum of filter times the array at the places ``at(i)``, around the circle."""
    return sum((F.get(x, F.pmod(at(i), F.size(x)).cast("int")) * c for i, c in enumerate(h[1:], 1)), F.get(x, F.pmod(at(0), F.size(x)).cast("int")) * h[0])


def dwt_step(x: Column, h: tuple[float, ...]) -> tuple[Column, Column]:
    """Smooth and detail halves of an array of even length, periodic."""
    half = lambda f: F.transform(F.sequence(F.lit(0), (F.size(x) / 2 - 1).cast("int")), lambda k: _tap(x, f, lambda i: 2 * k + i))
    return half(h), half(detail_filter(h))


def idwt_step(s: Column, d: Column, h: tuple[float, ...]) -> Column:
    """The array whose halves are s and d."""
    g = detail_filter(h)

    def value(t: Column) -> Column:
        terms = []
        for i in range(len(h)):  # h[i] reaches t from k with 2 k + i = t
            k = F.pmod(F.floor((t - i) / 2), F.size(s)).cast("int")
            terms.append(F.when(F.pmod(t - i, F.lit(2)) == 0, F.get(s, k) * h[i] + F.get(d, k) * g[i]).otherwise(0.0))
        return sum(terms[1:], terms[0])

    return F.transform(F.sequence(F.lit(0), 2 * F.size(s) - 1), value)


def dwt(df: DataFrame, x: str, out: str, h: tuple[float, ...], levels: int) -> DataFrame:
    """All coefficients: the last smooth part, then details from coarse to fine.  The length
    must be a multiple of 2^levels."""
    t = df.withColumn("s_", F.col(x).cast("array<double>")).withColumn("w_", F.array().cast("array<double>"))
    for _ in range(levels):
        s, d = dwt_step(F.col("s_"), h)
        t = t.withColumn("d_", d).withColumn("s_", s).withColumn("w_", F.concat("d_", "w_"))
    return t.withColumn(out, F.concat("s_", "w_")).drop("s_", "d_", "w_")


def idwt(df: DataFrame, w: str, out: str, h: tuple[float, ...], levels: int) -> DataFrame:
    n = F.size(w)
    t = df.withColumn("s_", F.slice(w, F.lit(1), (n / 2**levels).cast("int")))
    for level in range(levels, 0, -1):
        half = (n / 2**level).cast("int")
        t = t.withColumn("s_", idwt_step(F.col("s_"), F.slice(w, half + 1, half), h))
    return t.withColumnRenamed("s_", out)


def uwt_step(x: Column, h: tuple[float, ...], level: int) -> tuple[Column, Column]:
    """Smooth and detail parts of the stationary transform at ``level`` (from 1), as long as
    the array itself."""
    step = 2 ** (level - 1)
    part = lambda f: F.transform(x, lambda _, t: _tap(x, tuple(c / math.sqrt(2) for c in f), lambda i: t - step * i))
    return part(h), part(detail_filter(h))


def iuwt_step(s: Column, d: Column, h: tuple[float, ...], level: int) -> Column:
    """The array whose stationary parts at ``level`` these are."""
    step, g = 2 ** (level - 1), detail_filter(h)
    half = lambda f: tuple(c / math.sqrt(2) for c in f)
    return F.transform(s, lambda _, t: _tap(s, half(h), lambda i: t + step * i) + _tap(d, half(g), lambda i: t + step * i))


def pad(x: Column, method: str) -> Column:
    """The array up to the next power of two, at its end: reflection, periodic or zeros."""
    n = F.size(x)
    p = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")
    place = {"reflection": lambda i: F.when(F.pmod(i, 2 * n) < n, F.pmod(i, 2 * n)).otherwise(2 * n - 1 - F.pmod(i, 2 * n)), "periodic": lambda i: F.pmod(i, n), "zeros": lambda i: i}[method]
    return F.transform(F.sequence(F.lit(0), p - 1), lambda i: F.coalesce(F.get(x, place(i).cast("int")), F.lit(0.0)))


def haar_truncated(df: DataFrame, x: str, out: str, levels: int, least: float) -> DataFrame:
    """Haar coefficients with those below ``least`` set to 0, and how many are left."""
    t = dwt(df, x, "c_", HAAR, levels)
    t = t.withColumn(out, F.transform("c_", lambda c: F.when(F.abs(c) < least, 0.0).otherwise(c)))
    return t.withColumn("n_left", F.size(F.filter(out, lambda c: c != 0))).drop("c_")


def power_spectrum(df: DataFrame, by: str, place: str, value: str, n: int) -> DataFrame:
    """(by, f, power): the squared modulus of the discrete Fourier transform of a series of n
    values at places 0..n-1, for frequencies 0..n/2; each value adds to each frequency."""
    a = -2 * math.pi / n * F.col("f") * F.col(place)
    sent = df.select(by, place, value, F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("f"))
    sums = sent.groupBy(by, "f").agg(F.sum(F.col(value) * F.cos(a)).alias("re"), F.sum(F.col(value) * F.sin(a)).alias("im"))
    return sums.select(by, "f", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def cwt(x: np.ndarray, dt: float, scales: np.ndarray, wavelet: str = "morlet", p: float = 6.0) -> np.ndarray:
    """The continuous wavelet transform (scales by places) through the Fourier domain."""
    w = 2 * np.pi * np.fft.fftfreq(len(x), dt)
    out = np.zeros((len(scales), len(x)), complex)
    f = np.fft.fft(x)
    for i, s in enumerate(scales):
        if wavelet == "morlet":
            h = np.where(w > 0, np.pi**-0.25 * np.exp(-((s * w - p) ** 2) / 2), 0)
        elif wavelet == "paul":
            h = np.where(w > 0, 2**p / np.sqrt(p * math.gamma(2 * p)) * np.abs(s * w) ** p * np.exp(-np.abs(s * w)), 0)
        elif wavelet == "dog":
            h = -(1j**p) / np.sqrt(math.gamma(p + 0.5)) * (s * w) ** p * np.exp(-((s * w) ** 2) / 2)
        else:
            raise ValueError(f"no wavelet {wavelet}")
        out[i] = np.fft.ifft(f * np.sqrt(2 * np.pi * s / dt) * np.conj(h))
    return out


def cwt_modulus(x: Column, dt: float, scales: list[float], wavelet: str = "morlet", p: float = 6.0) -> Column:
    """Moduli of the transform, scale by scale, as one array."""
    at = np.array(scales, float)

    @pandas_udf("array<double>")
    def f(v: pd.Series) -> pd.Series:
        return pd.Series([np.abs(cwt(_array(a), dt, at, wavelet, p)).ravel().tolist() for a in v])

    return f(x)
