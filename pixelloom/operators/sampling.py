"""Samples, intervals, resampling, simulated images.  Pseudo-random numbers come from keys by
plain arithmetic, so that any engine and any partitioning draws the same."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cdf import chi2_quantile, f_cdf, normal_quantile
from .classify import gaussian_ml
from .cluster import cut, hash_sample, linkage


def mean_interval(df: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """n, mean with its normal interval (low, high), variance with its chi-square interval."""
    r = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).first()
    n, half, tail = r["n"], normal_quantile((1 + level) / 2), (1 - level) / 2
    if n < 2:
        row = (n, r["mean"], None, None, None, None, None)
    else:
        e = half * math.sqrt(r["var"] / n)
        row = (n, r["mean"], r["mean"] - e, r["mean"] + e, r["var"], (n - 1) * r["var"] / chi2_quantile(1 - tail, n - 1), (n - 1) * r["var"] / chi2_quantile(tail, n - 1))
    return df.sparkSession.createDataFrame([row], "n long, mean double, low double, high double, var double, var_low double, var_high double")


def variance_test(df: DataFrame, value: str, first: Column) -> DataFrame:
    """The larger over the smaller population variance of two groups and its two-sided p."""
    r = df.agg(F.count(F.when(first, F.col(value))).alias("n0"), F.count(F.when(~first, F.col(value))).alias("n1"), F.var_pop(F.when(first, F.col(value))).alias("v0"), F.var_pop(F.when(~first, F.col(value))).alias("v1")).first()
    row = (None, None)
    if r["v0"] and r["v1"]:
        (v, n), (w, m) = sorted(((r["v0"], r["n0"]), (r["v1"], r["n1"])), reverse=True)
        p = 2 * (1 - f_cdf(v / w, n - 1, m - 1))
        row = (v / w, 2 - p if p > 1 else p)
    return df.sparkSession.createDataFrame([row], "f double, p double")


#: Terms of the Poisson distribution with mean 1 that a draw can reach.
TERMS = 8


def bootstrap_mean(df: DataFrame, key: str, value: str, replicates: int = 1000, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean: each row enters each replicate as often as a Poisson
    draw of mean 1 says, which its key and the replicate decide.  Rows are not shuffled, each
    task adds up its part of every replicate."""
    u = F.pmod(F.col(key) * 2654435761 + F.col("b") * (40503 * 65537), F.lit(1000003)) / 1000003.0
    cdf = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(TERMS)])
    k = sum((F.when(F.col("u") >= float(c), 1).otherwise(0) for c in cdf[1:]), F.when(F.col("u") >= float(cdf[0]), 1).otherwise(0))
    drawn = df.select(key, value, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("b")).withColumn("u", u).withColumn("k", k)
    means = drawn.groupBy("b").agg((F.sum(F.col("k") * F.col(value)) / F.sum("k")).alias("m"))
    s = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # one number a replicate
    return s.select(F.get("m", F.lit(int(replicates * alpha / 2))).alias("low"), F.get("m", F.lit(int(replicates * (1 - alpha / 2)))).alias("high"))


def region_mean(df: DataFrame, by: list[str], value: str, inside: Column) -> DataFrame:
    """The mean inside a region per group; without any, the group's; without that, of all."""
    every = df.agg(F.avg(value).alias("all_"))
    g = df.groupBy(*by).agg(F.avg(F.when(inside, F.col(value))).alias("in_"), F.avg(value).alias("own_"))
    return g.join(F.broadcast(every)).select(*by, F.coalesce("in_", "own_", "all_").alias("mean"))


def collection_arrays(df: DataFrame, by: list[str], key: str, order: str, prop: str, n: int) -> DataFrame:
    """Size of each collection, its first n keys in order, and its distinct properties: ranks
    bound what is gathered of a group."""
    from pyspark.sql import Window

    ranked = df.select(*by, key, prop, F.row_number().over(Window.partitionBy(*by).orderBy(order, key)).alias("r_"))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("r_") <= n, F.struct("r_", key)))), lambda x: x[key])
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), first.alias("first_keys"), F.array_sort(F.collect_set(prop)).alias("statuses"))


def random_column(key: Column, seed: int) -> Column:
    """Uniform numbers in [0, 1) by key."""
    return F.pmod(key * 2654435761 + seed, F.lit(1000003)) / 1000003.0


def remap(value: Column, names: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def binomial_pmf(spark: SparkSession, n: int, p: float) -> DataFrame:
    rows = [(k, math.comb(n, k) * p**k * (1 - p) ** (n - k)) for k in range(n + 1)]
    return spark.createDataFrame(rows, "k int, pmf double")


def normal(key: Column, k: int) -> Column:
    """Standard normal numbers by key and column (Box and Muller)."""
    u = (F.pmod(key * 2654435761 + k * 7919 * 104729, F.lit(1000003)) + 1) / 1000004.0
    v = F.pmod((key + 17) * 2654435761 + k * 15485863, F.lit(1000003)) / 1000003.0
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def wishart_dual(spark: SparkSession, n: int, looks: int) -> DataFrame:
    """Dual-polarization matrices (c1, c2 + i c3, c4) of ``looks`` looks at white noise."""
    rows = spark.range(n).select("id", *[normal(F.col("id"), k).alias(f"n{k}") for k in range(4 * looks)])
    z = lambda m, i: F.col(f"n{4 * m + i}")
    total = lambda f: sum((f(m) for m in range(1, looks)), f(0))
    return rows.select(
        "id", total(lambda m: z(m, 0) * z(m, 0) + z(m, 1) * z(m, 1)).alias("c1"), total(lambda m: z(m, 0) * z(m, 2) + z(m, 1) * z(m, 3)).alias("c2"),
        total(lambda m: z(m, 1) * z(m, 2) - z(m, 0) * z(m, 3)).alias("c3"), total(lambda m: z(m, 2) * z(m, 2) + z(m, 3) * z(m, 3)).alias("c4"),
    )


def toy_clusters(spark: SparkSession, n: int, k: int) -> DataFrame:
    """k Gaussian clouds along a diagonal, in two bands."""
    i = F.col("id") % k
    return spark.range(n).select("id", i.cast("int").alias("cluster"), (i * 2 + normal(F.col("id"), 20)).alias("b1"), (i * -2 + normal(F.col("id"), 21)).alias("b2"))


def ward_map(df: DataFrame, key: str, bands: list[str], k: int, n: int) -> DataFrame:
    """``cluster``: Gaussian maximum likelihood of all rows, by the k Ward clusters of a sample
    of n rows.  The fitted scores are carried over as expressions of the bands."""
    rows = [list(r) for r in hash_sample(df.select(key, *bands), key, n).select(*bands).collect()]
    x = np.array(rows, float)
    labels = cut(linkage(x, "ward"), k)
    train = df.sparkSession.createDataFrame([(*map(float, r), int(c)) for r, c in zip(rows, labels)], ", ".join(f"{b} double" for b in bands) + ", cluster int")
    return gaussian_ml(train, bands, "cluster", df).withColumnRenamed("pred", "cluster")
