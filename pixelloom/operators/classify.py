"""Clustering and classification on pixel tables: class moments and models of band size
come from one aggregation and return as literals or a broadcast table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .moments import matrices, moments


def _argmax(scores: dict[str, Column]) -> Column:
    """The class with the largest score; ties go to the first class."""
    names = sorted(scores)
    best = F.greatest(*[scores[k] for k in names]) if len(names) > 1 else scores[names[0]]
    out = F.lit(names[-1])
    for k in reversed(names[:-1]):
        out = F.when(scores[k] == best, F.lit(k)).otherwise(out)
    return out


def gaussian_ml(df: DataFrame, bands: list[str], by: str, rest: DataFrame | None = None) -> DataFrame:
    """Maximum likelihood with class priors; adds ``pred`` to the rows, or to ``rest``."""
    rows = moments(df, bands, [by]).collect()  # one row per class
    n = sum(r["n"] for r in rows)
    scores = {}
    for r in rows:
        mean, cov = matrices(r, bands)
        inv, det = np.linalg.pinv(cov, hermitian=True), np.linalg.det(cov)
        if not det > 0:
            raise ValueError(f"class {r[by]}: the covariance matrix of {', '.join(bands)} is not positive definite")
        d = [F.col(b) - float(m) for b, m in zip(bands, mean)]
        q = sum((float(inv[i, j]) * d[i] * d[j] for i in range(len(bands)) for j in range(len(bands))), F.lit(0.0))
        scores[r[by]] = F.lit(float(np.log(r["n"] / n) - 0.5 * np.log(det))) - q / 2
    return (df if rest is None else rest).withColumn("pred", _argmax(scores))


def lda(df: DataFrame, bands: list[str], by: str) -> DataFrame:
    """Linear discriminants with the pooled covariance over n - K."""
    rows = moments(df, bands, [by]).collect()
    n, k = sum(r["n"] for r in rows), len(rows)
    pooled = sum(matrices(r, bands)[1] * (r["n"] - 1) for r in rows) / (n - k)
    scores = {}
    for r in rows:
        mean = matrices(r, bands)[0]
        w = np.linalg.solve(pooled, mean)
        scores[r[by]] = sum((float(c) * F.col(b) for b, c in zip(bands, w)), F.lit(float(np.log(r["n"] / n) - mean @ w / 2)))
    return df.withColumn("pred", _argmax(scores))


def golub(df: DataFrame, bands: list[str], positive: Column) -> DataFrame:
    """Weights (m+ - m-) / (s+ + s-) per band."""
    aggs = [((F.avg(F.when(positive, F.col(b))) - F.avg(F.when(~positive, F.col(b)))) / (F.stddev_samp(F.when(positive, F.col(b))) + F.stddev_samp(F.when(~positive, F.col(b))))).alias(f"w_{b}") for b in bands]
    return df.agg(*aggs)


#: Rows of a training shard and of a test block that meet in one task.
SHARD_ROWS = 8192


def knn(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int) -> DataFrame:
    """Majority label among the k nearest by Euclidean distance (ties to the smaller key), the
    row's own key left out; 0 if the majority is not unique.

    Blocks of test rows meet shards of training rows, as matrix products; each pair of blocks
    gives k rows a test row at most, which are merged.  Nothing is broadcast."""
    shards, blocks = (max(1, -(-d.count() // SHARD_ROWS)) for d in (train, test))
    spread = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = train.select(spread(shards).alias("shard"), F.col(key).cast("long").alias("tk"), F.col(vector).cast("array<double>").alias("tv"), F.col(label).cast("int").alias("tl")).select("*", every(blocks).alias("block"))
    q = test.select(spread(blocks).alias("block"), F.col(key).cast("long").alias("qk"), F.col(vector).cast("array<double>").alias("qv")).select("*", every(shards).alias("shard"))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["qk", "tk", "tl", "d"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        x, y = np.stack(left["qv"].to_numpy()), np.stack(right["tv"].to_numpy())
        tk, tl = right["tk"].to_numpy(), right["tl"].to_numpy()
        out = []
        norms = (y * y).sum(1)
        for start in range(0, len(x), 512):
            part = x[start : start + 512]
            rough = norms - 2 * part @ y.T + (part * part).sum(1)[:, None]
            cut = np.partition(rough, min(k, len(y) - 1), axis=1)[:, min(k, len(y) - 1)]
            slack = 1e-9 * (norms.max() + (part * part).sum(1).max())
            for i, v in enumerate(part):
                qk = left["qk"].iat[start + i]
                at = np.flatnonzero(rough[i] <= cut[i] + slack)
                at = at[tk[at] != qk]
                d = ((y[at] - v) ** 2).sum(1)
                best = np.lexsort((tk[at], d))[:k]
                out += [(qk, tk[at[j]], tl[at[j]], d[j]) for j in best]
        return pd.DataFrame(out, columns=columns)

    found = q.groupBy("block", "shard").cogroup(t.groupBy("block", "shard")).applyInPandas(near, "qk long, tk long, tl int, d double")
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("qk").orderBy("d", "tk"))).filter(F.col("r") <= k)
    votes = first.groupBy("qk", "tl").agg(F.count("*").alias("n"))
    best = votes.groupBy("qk").agg(F.max_by("tl", "n").alias("tl"), F.max("n").alias("top"), F.collect_list("n").alias("ns"))
    return best.select(F.col("qk").alias(key), F.when(F.size(F.filter("ns", lambda n: n == F.col("top"))) == 1, F.col("tl")).otherwise(0).alias("pred"))


def rx_anomaly(df: DataFrame, bands: list[str]) -> DataFrame:
    """Squared Mahalanobis distance to the global mean; bands that are constant or depend on
    others add nothing (pseudo-inverse)."""
    row = moments(df, bands).first()
    if row["n"] < 2:
        return df.withColumn("rx", F.lit(0.0))
    mean, cov = matrices(row, bands)
    inv = np.linalg.pinv(cov, hermitian=True)
    d = [F.col(b) - float(m) for b, m in zip(bands, mean)]
    return df.withColumn("rx", sum((float(inv[i, j]) * d[i] * d[j] for i in range(len(bands)) for j in range(len(bands))), F.lit(0.0)))


def components(df: DataFrame, bands: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, eigenvalues (descending) and vectors of the covariance, each vector's largest
    component positive."""
    mean, cov = matrices(moments(df, bands).first(), bands)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    return mean, values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(len(bands))])


def project(df: DataFrame, bands: list[str], vectors: np.ndarray, mean: np.ndarray, prefix: str) -> DataFrame:
    """Centred bands times the vectors' columns, as ``prefix``1, ``prefix``2 and so on."""
    out = [sum(((F.col(b) - float(m)) * float(v) for b, m, v in zip(bands, mean, vectors[:, j])), F.lit(0.0)).alias(f"{prefix}{j + 1}") for j in range(vectors.shape[1])]
    return df.select("*", *out)


def pca(df: DataFrame, bands: list[str], whiten: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Centred principal components pc1.. by descending variance (divided by their standard
    deviations if ``whiten``); with eigenvalues and vectors."""
    mean, values, vectors = components(df, bands)
    scale = 1 / np.sqrt(np.maximum(values, 1e-300)) if whiten else np.ones(len(bands))
    return project(df, bands, vectors * scale, mean, "pc"), values, vectors


def pca_reconstruction(df: DataFrame, bands: list[str], r: int) -> DataFrame:
    """The centred bands rebuilt from the first r components, as rec_ and the band's name."""
    mean, _, vectors = components(df, bands)
    half = vectors[:, :r] @ vectors[:, :r].T
    out = project(df, bands, half, mean, "rec")
    return out.select(*df.columns, *[F.col(f"rec{i + 1}").alias(f"rec_{b}") for i, b in enumerate(bands)])
