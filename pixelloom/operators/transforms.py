"""Linear and kernel transforms whose model is a matrix of band or sample size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import project
from .moments import matrices, moments


def generalized_eigen(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (ascending) and vectors of a v = lambda b v for symmetric a and positive definite
    b, by Cholesky; vectors have unit b-norm, their largest component positive."""
    low = np.linalg.inv(np.linalg.cholesky(b))
    values, vectors = np.linalg.eigh(low @ a @ low.T)
    vectors = low.T @ vectors
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(len(a))])


def shift_noise(grid: DataFrame, bands: list[str], width: int, height: int) -> DataFrame:
    """Each cell minus the mean of its left and upper neighbours, wrapping around the image:
    cells are sent to those that need them and meet by position."""
    own = F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(1.0).alias("w"))
    right, down = (F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(-0.5).alias("w")) for dx, dy in ((1, 0), (0, 1)))
    sent = grid.select("x", "y", *bands, F.explode(F.array(own, right, down)).alias("o"))
    sent = sent.select(F.pmod(F.col("x") + F.col("o.dx"), F.lit(width)).alias("x"), F.pmod(F.col("y") + F.col("o.dy"), F.lit(height)).alias("y"), F.col("o.w").alias("w"), *bands)
    return sent.groupBy("x", "y").agg(F.sum(F.abs("w")).alias("n_"), *[F.sum(F.col("w") * F.col(b)).alias(b) for b in bands]).filter("n_ = 2").drop("n_")


def noise_fraction(grid: DataFrame, bands: list[str], width: int, height: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Minimum noise fractions mnf1.. by ascending noise, the noise shares (lambda) and the
    signal to noise ratios 1 / lambda - 1."""
    mean, cov = matrices(moments(grid, bands).first(), bands)
    noise = shift_noise(grid, bands, width, height)
    r = noise.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(bands) for b in bands[i:]]).first()
    s = np.array([[r[f"s_{min(a, b, key=bands.index)}_{max(a, b, key=bands.index)}"] for b in bands] for a in bands]) / (2 * (r["n"] - 1))
    values, vectors = generalized_eigen(s, cov)
    return project(grid, bands, vectors, mean, "mnf"), values, 1 / values - 1


# ------------------------------------------------------------- kernels


def kernel(x: np.ndarray, y: np.ndarray, name: str = "gaussian", **p: float) -> np.ndarray:
    """The kernel matrix of rows of x and y: linear, polynomial (gamma, b, degree), gaussian
    (sigma), exponential (sigma) or sigmoid (gamma, b)."""
    dot = x @ y.T
    if name == "linear":
        return dot
    if name == "polynomial":
        return (p.get("gamma", 1.0) * dot + p.get("b", 1.0)) ** p.get("degree", 2.0)
    if name == "sigmoid":
        return np.tanh(p.get("gamma", 1.0) * dot + p.get("b", 1.0))
    d2 = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * dot, 0)
    if name == "gaussian":
        return np.exp(-d2 / (2 * p.get("sigma", 1.0) ** 2))
    if name == "exponential":
        return np.exp(-np.sqrt(d2) / (2 * p.get("sigma", 1.0) ** 2))
    raise ValueError(f"no kernel {name}")


def centred(k: np.ndarray, train: np.ndarray) -> np.ndarray:
    """A kernel matrix (rows to judge by training rows) centred in the training set's feature
    space, whose own kernel matrix is ``train``."""
    return k - train.mean(0) - k.mean(1, keepdims=True) + train.mean()


def scale_of(x: np.ndarray, n_scale: float) -> float:
    """A Gaussian width: ``n_scale`` times the mean distance of the sample's points."""
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    m = len(x)
    return n_scale * float(d.sum()) / max(1, m * m - m)


def _scored(df: DataFrame, bands: list[str], names: list[str], score) -> DataFrame:
    """Double columns that ``score`` gives for blocks of band values."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` double" for n in names)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            y = score(f[bands].to_numpy(float))
            for i, n in enumerate(names):
                f[n] = y[:, i]
            yield f

    return df.mapInPandas(run, schema)


def kernel_pca(df: DataFrame, sample: DataFrame, bands: list[str], n: int, n_scale: float = 5.0) -> tuple[DataFrame, np.ndarray]:
    """Projections kpc1.. of all rows on the n leading components of a Gaussian kernel over a
    sample (a bounded table, which is collected), and all eigenvalues."""
    x = np.array([list(r) for r in sample.select(*bands).collect()], float)
    sigma = scale_of(x, n_scale)
    k = kernel(x, x, sigma=sigma)
    values, vectors = np.linalg.eigh(centred(k, k))
    values, vectors = values[::-1], vectors[:, ::-1]
    a = vectors[:, :n] / np.sqrt(np.maximum(values[:n], 1e-300))
    a = a * np.sign(a[np.abs(a).argmax(0), range(n)])
    return _scored(df, bands, [f"kpc{i + 1}" for i in range(n)], lambda y: centred(kernel(y, x, sigma=sigma), k) @ a), values


def kernel_rx(df: DataFrame, sample: DataFrame, bands: list[str], n_scale: float = 10.0) -> DataFrame:
    """``krx``: anomaly by the Mahalanobis distance in a Gaussian kernel's feature space, whose
    mean and covariance come from a sample (a bounded table, which is collected)."""
    x = np.array([list(r) for r in sample.select(*bands).collect()], float)
    sigma = scale_of(x, n_scale)
    k = kernel(x, x, sigma=sigma)
    c = centred(k, k)
    inverse = np.linalg.pinv(c @ c, hermitian=True)

    def score(y: np.ndarray) -> np.ndarray:
        z = centred(kernel(y, x, sigma=sigma), k)
        return ((z @ inverse) * z).sum(1, keepdims=True)

    return _scored(df, bands, ["krx"], score)


def kernel_kmeans(df: DataFrame, sample: DataFrame, bands: list[str], k: int, n_scale: float = 1.0, rounds: int = 100) -> DataFrame:
    """``cluster``: 1..k by kernel K-means over a sample (a bounded table, which is collected);
    all rows go to the nearest cluster in feature space.  Starts from the sample's order."""
    x = np.array([list(r) for r in sample.select(*bands).collect()], float)
    sigma = scale_of(x, n_scale)
    g = kernel(x, x, sigma=sigma)
    label = np.arange(len(x)) % k

    def distances(cross: np.ndarray, label: np.ndarray) -> np.ndarray:
        u = np.eye(k)[label]
        m = u / (u.sum(0) + 1)
        return (m * (g @ m)).sum(0) - 2 * cross @ m

    for _ in range(rounds):
        after = distances(g, label).argmin(1)
        if (after == label).all():
            break
        label = after
    out = _scored(df, bands, ["cluster"], lambda y: distances(kernel(y, x, sigma=sigma), label).argmin(1)[:, None] + 1.0)
    return out.withColumn("cluster", F.col("cluster").cast("int"))


def gram_matrix(df: DataFrame, key: str, vector: str, name: str = "gaussian", **p: float) -> DataFrame:
    """(i, j, k): the kernel of each two rows of a bounded table, in column expressions."""
    a = df.select(F.col(key).alias("i"), F.col(vector).alias("a"))
    b = df.select(F.col(key).alias("j"), F.col(vector).alias("b"))
    fold = lambda f: F.aggregate(F.zip_with("a", "b", f), F.lit(0.0), lambda s, v: s + v)
    dot = fold(lambda u, v: u.cast("double") * v.cast("double"))
    d2 = fold(lambda u, v: (u.cast("double") - v.cast("double")) * (u.cast("double") - v.cast("double")))
    width = 2 * p.get("sigma", 1.0) ** 2
    k = {
        "linear": dot, "polynomial": F.pow(p.get("gamma", 1.0) * dot + p.get("b", 1.0), F.lit(p.get("degree", 2.0))), "sigmoid": F.tanh(p.get("gamma", 1.0) * dot + p.get("b", 1.0)),
        "gaussian": F.exp(-d2 / width), "exponential": F.exp(-F.sqrt(d2) / width),
    }[name]
    return a.join(b).select("i", "j", k.alias("k"))


def centre_matrix(gram: DataFrame) -> DataFrame:
    """(i, j, k) with row and column means taken away and the mean of all added."""
    rows = gram.groupBy("i").agg(F.avg("k").alias("r_"))
    columns = gram.groupBy("j").agg(F.avg("k").alias("c_"))
    every = gram.agg(F.avg("k").alias("m_"))
    return gram.join(rows, "i").join(columns, "j").join(F.broadcast(every)).select("i", "j", (F.col("k") - F.col("r_") - F.col("c_") + F.col("m_")).alias("k"))
