"""Regressions and projections from one matrix of sums: the rows are read once (or once a
pass where noted), the rest is algebra of band size on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import matrices, moments
from .transforms import generalized_eigen


def sums(df: DataFrame, xs: list[str], y: str) -> tuple[int, np.ndarray, float, np.ndarray, np.ndarray, float]:
    """n, means of x and y, centred sums X'X, X'y and y'y."""
    row = moments(df, [*xs, y]).first()
    mean, cov = matrices(row, [*xs, y])
    s, k = np.nan_to_num(cov) * max(row["n"] - 1, 0), len(xs)
    return row["n"], mean[:k], float(mean[k]), s[:k, :k], s[:k, k], float(s[k, k])


def coefficients(spark, xs: list[str], beta: np.ndarray, intercept: float) -> DataFrame:
    """(name, beta), the intercept among them."""
    return spark.createDataFrame([*zip(xs, map(float, beta)), ("intercept", float(intercept))], "name string, beta double")


def least_squares(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0) -> DataFrame:
    """Ordinary or ridge regression on any number of bands (pseudo-inverse if they depend on
    one another)."""
    _, mx, my, xx, xy, _ = sums(df, xs, y)
    beta = np.linalg.pinv(xx + ridge * np.eye(len(xs)), hermitian=True) @ xy
    return coefficients(df.sparkSession, xs, beta, my - beta @ mx)


def elastic_net(df: DataFrame, xs: list[str], y: str, lasso: float, ridge: float, tol: float = 1e-10, rounds: int = 100_000) -> DataFrame:
    """Minimizes |y - Xb|^2 / n + 2 lasso |b|_1 + ridge |b|^2 over standardized x and centred y,
    by iterated soft thresholding of the matrix of sums; coefficients of the bands as they are."""
    n, mx, my, xx, xy, _ = sums(df, xs, y)
    sd = np.sqrt(np.diag(xx) / max(n - 1, 1))
    sd = np.where(sd > 0, sd, 1.0)
    a, b = xx / np.outer(sd, sd) / n, xy / sd / n
    step = 1 / (np.linalg.eigvalsh(a)[-1] + ridge or 1.0)
    beta = np.zeros(len(xs))
    for _ in range(rounds):
        z = beta + step * (b - a @ beta - ridge * beta)
        after = np.sign(z) * np.maximum(np.abs(z) - step * lasso, 0)
        moved = np.abs(after - beta).max(initial=0.0)
        beta = after
        if moved <= tol:
            break
    return coefficients(df.sparkSession, xs, beta / sd, my - (beta / sd) @ mx)


def least_angles(df: DataFrame, xs: list[str], y: str, steps: int | None = None) -> DataFrame:
    """The least-angle path over standardized x: (step, name, beta) on the standardized scale;
    step 0 is empty, the last one is least squares."""
    n, _, _, xx, xy, _ = sums(df, xs, y)
    length = np.sqrt(np.diag(xx))
    usable = np.flatnonzero(length > 0)
    a, b = xx / np.outer(np.where(length > 0, length, 1), np.where(length > 0, length, 1)), xy / np.where(length > 0, length, 1)
    beta, active, path = np.zeros(len(xs)), [], [np.zeros(len(xs))]
    for _ in range(min(steps or len(usable), len(usable))):
        c = b - a @ beta
        rest = [j for j in usable if j not in active]
        if not active:
            active.append(rest.pop(int(np.argmax(np.abs(c[rest])))))
        top, sign = np.abs(c[active]).max(), np.sign(c[active])
        if top < 1e-12:
            break
        w = np.linalg.pinv(a[np.ix_(active, active)], hermitian=True) @ sign
        scale = 1 / np.sqrt(sign @ w)
        move = np.zeros(len(xs))
        move[active] = scale * w
        along = a @ move
        found = [(g, j) for j in rest for g in ((top - c[j]) / (scale - along[j]) if scale != along[j] else np.inf, (top + c[j]) / (scale + along[j]) if scale != -along[j] else np.inf) if g > 1e-12]
        g, j = min(found, default=(top / scale, None))
        beta = beta + g * move
        path.append(beta)
        if j is not None:
            active.append(j)
    rows = [(i, name, float(v)) for i, p in enumerate(path) for name, v in zip(xs, p)]
    return df.sparkSession.createDataFrame(rows, "step int, name string, beta double")


def partial_least_squares(df: DataFrame, xs: list[str], y: str, components: int) -> DataFrame:
    """PLS with one response: directions of largest covariance, deflated in the matrix of sums."""
    _, mx, my, xx, xy, _ = sums(df, xs, y)
    w, p, q = [], [], []
    a, b = xx.copy(), xy.copy()
    for _ in range(min(components, len(xs))):
        if np.linalg.norm(b) < 1e-12 * max(np.linalg.norm(xy), 1e-300):
            break
        v = b / np.linalg.norm(b)
        tt = v @ a @ v
        load = a @ v / tt
        w.append(v)
        p.append(load)
        q.append(v @ b / tt)
        a, b = a - tt * np.outer(load, load), b - tt * q[-1] * load
    beta = np.zeros(len(xs))
    if w:
        ws, ps = np.array(w).T, np.array(p).T
        beta = ws @ np.linalg.solve(ps.T @ ws, np.array(q))
    return coefficients(df.sparkSession, xs, beta, my - beta @ mx)


def rigid_fit(points: DataFrame) -> DataFrame:
    """Rotation, scaling and translation (a, b, x0, y0) that takes warp to base points, and the
    root of the squared distances left per point: x = a u - b v + x0, y = b u + a v + y0."""
    m = points.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("base_x", "base_y", "warp_x", "warp_y")])
    d = points.join(F.broadcast(m.select("n", *[F.col(c).alias(f"m_{c}") for c in ("base_x", "base_y", "warp_x", "warp_y")])))
    x, y, u, v = (F.col(c) - F.col(f"m_{c}") for c in ("base_x", "base_y", "warp_x", "warp_y"))
    s = d.agg(*[F.max(c).alias(c) for c in ("n", "m_base_x", "m_base_y", "m_warp_x", "m_warp_y")], F.sum(u * u + v * v).alias("uu"), F.sum(u * x + v * y).alias("ux"), F.sum(u * y - v * x).alias("uy"), F.sum(x * x + y * y).alias("xx"))
    s = s.withColumn("a", F.try_divide("ux", "uu")).withColumn("b", F.try_divide("uy", "uu"))
    a, b = F.col("a"), F.col("b")
    left = F.greatest(F.col("xx") - (a * a + b * b) * F.col("uu"), F.lit(0.0))
    return s.select("a", "b", (F.col("m_base_x") - a * F.col("m_warp_x") + b * F.col("m_warp_y")).alias("x0"), (F.col("m_base_y") - b * F.col("m_warp_x") - a * F.col("m_warp_y")).alias("y0"), F.sqrt(left / F.col("n")).alias("rms"))


def scatters(df: DataFrame, bands: list[str], by: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, their means, scatter within classes and in all, from one row a class."""
    rows = sorted(moments(df, bands, [by]).collect(), key=lambda r: str(r[by]))
    both = [matrices(r, bands) for r in rows]
    n = np.array([r["n"] for r in rows], float)
    means = np.array([m for m, _ in both])
    within = sum(np.nan_to_num(c) * (k - 1) for (_, c), k in zip(both, n))
    mid = (n[:, None] * means).sum(0) / n.sum()
    total = within + ((means - mid).T * n) @ (means - mid)
    return [r[by] for r in rows], means, within, total


def discriminant_axes(df: DataFrame, bands: list[str], by: str) -> tuple[np.ndarray, np.ndarray]:
    """Fisher's axes (columns, by descending share between classes) with unit total scatter,
    and the shares."""
    classes, _, within, total = scatters(df, bands, by)
    values, vectors = generalized_eigen(total - within, total)
    n = min(len(classes) - 1, len(bands))
    return vectors[:, ::-1][:, :n], values[::-1][:n]


def gram_schmidt(x: np.ndarray) -> np.ndarray:
    """Orthogonal columns that span the same spaces, each less its projections on the earlier
    ones; columns that depend on earlier ones become 0."""
    out = np.array(x, float)
    for j in range(out.shape[1]):
        for i in range(j):
            k = out[:, i] @ out[:, i]
            out[:, j] -= out[:, i] * ((out[:, i] @ out[:, j]) / k if k > 0 else 0.0)
        if np.linalg.norm(out[:, j]) <= 1e-12 * max(np.linalg.norm(x[:, j]), 1e-300):
            out[:, j] = 0.0
    return out


def standardized(df: DataFrame, bands: list[str]) -> DataFrame:
    """(x - mean) / sd per band as z_ and its name; 0 for a constant band."""
    s = df.agg(*[f for b in bands for f in (F.avg(b).alias(f"m_{b}"), F.stddev_samp(b).alias(f"d_{b}"))])
    return df.join(F.broadcast(s)).select(*df.columns, *[F.coalesce(F.try_divide(F.col(b) - F.col(f"m_{b}"), F.col(f"d_{b}")), F.when(F.col(b).isNotNull(), 0.0)).alias(f"z_{b}") for b in bands])


def unit_length(df: DataFrame, bands: list[str]) -> DataFrame:
    """Each row divided by its length, as u_ and the band's name; 0 for a zero row."""
    norm = F.sqrt(sum((F.col(b) * F.col(b) for b in bands), F.lit(0.0)))
    t = df.withColumn("norm_", norm)
    return t.select(*df.columns, *[F.coalesce(F.try_divide(F.col(b), F.col("norm_")), F.when(F.col(b).isNotNull(), 0.0)).alias(f"u_{b}") for b in bands])
