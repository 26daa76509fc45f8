"""Clusterings.  Models are a few centres or moments on the driver; each round is one
aggregation over the rows, which stay where they are.  Rows that a loop reads again and again
are cached for the loop and released after it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import focal
from .metrics import hash_order


def _model(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """One row of numbers, as columns: generated code stays the same from round to round."""
    return df.sparkSession.range(1).select(*[F.lit(float(v)).alias(k) for k, v in values.items()])


def _nearest(df: DataFrame, bands: list[str], centres: list[list[float]]) -> DataFrame:
    """``cluster``: 1.. for the nearest centre, the first on ties; ``d2``: squared distance."""
    model = _model(df, {f"c_{i}_{b}": v for i, centre in enumerate(centres) for b, v in zip(bands, centre)})
    d = [sum(((F.col(b) - F.col(f"c_{i}_{b}")) * (F.col(b) - F.col(f"c_{i}_{b}")) for b in bands), F.lit(0.0)).alias(f"d_{i}") for i in range(len(centres))]
    rows = df.join(F.broadcast(model)).select(*df.columns, *d)
    best = F.least(*[F.col(f"d_{i}") for i in range(len(d))]) if len(d) > 1 else F.col("d_0")
    label = F.lit(len(d))
    for i in reversed(range(len(d) - 1)):
        label = F.when(F.col(f"d_{i}") == F.col("d2"), i + 1).otherwise(label)
    return rows.withColumn("d2", best).withColumn("cluster", label).select(*df.columns, "cluster", "d2")


def farthest_first(df: DataFrame, bands: list[str], k: int, key: str) -> list[list[float]]:
    """Starting centres: the row with the least hash, then the row farthest from those chosen
    (the smaller key on ties).  Fewer if there are fewer distinct rows."""
    point = F.struct(*[F.col(b).cast("double").alias(b) for b in bands])
    first = df.agg(F.min_by(point, F.struct(hash_order(F.col(key)), key, *bands))).first()[0]
    centres = [] if first is None else [list(first)]
    while centres and len(centres) < k:
        far = _nearest(df, bands, centres).agg(F.max_by(F.struct(F.col("d2"), point.alias("p")), F.struct(F.col("d2"), -F.col(key), *bands)).alias("m")).select("m.*").first()
        if not far["d2"] > 0:
            break
        centres.append(list(far["p"]))
    return centres


def kmeans(df: DataFrame, bands: list[str], centres: list[list[float]], rounds: int = 100) -> tuple[DataFrame, list[list[float]], int]:
    """Lloyd's rounds until no centre moves.  A cluster without rows gets the centre 0.  Gives
    the rows with ``cluster``, the centres and the number of rounds."""
    held = df.select(*bands).cache()
    turn = 0
    for turn in range(1, rounds + 1):
        means = {r["cluster"]: [r[b] for b in bands] for r in _nearest(held, bands, centres).groupBy("cluster").agg(*[F.avg(b).alias(b) for b in bands]).collect()}
        after = [means.get(i + 1, [0.0] * len(bands)) for i in range(len(centres))]
        moved = after != centres
        centres = after
        if not moved:
            break
    held.unpersist()
    return _nearest(df, bands, centres).drop("d2"), centres, turn


def extended_kmeans(df: DataFrame, band: str, noise: float, k0: int = 10, rounds: int = 100) -> tuple[DataFrame, list[tuple[float, float]]]:
    """K-means over one byte band whose cost holds the entropy of the clusters, so that their
    number falls: the start is every value there is; clusters with a share of 0.01 or less go.
    ``noise``: the variance.  The values' counts are all it needs, 256 rows at most."""
    counts = {int(r["v"]): r["c"] for r in df.groupBy(F.floor(band).alias("v")).agg(F.count("*").alias("c")).collect() if r["v"] is not None}
    n = sum(counts.values())
    if not n:
        return df.withColumn("cluster", F.lit(None).cast("int")), []
    values = np.array(sorted(counts), float)
    weight = np.array([counts[int(v)] for v in values], float)
    means, priors, alpha = values.copy(), weight / n, -1 / (2 * np.log(1 / k0))
    label = np.zeros(len(values), int)
    for _ in range(rounds):
        stay = priors > 0.01
        means, priors = means[stay], priors[stay]
        if not len(means):
            raise ValueError("no cluster holds more than a hundredth of the rows")
        cost = (values[:, None] - means) ** 2 / (2 * noise) - alpha * np.log(priors)
        label = cost.argmin(1)
        share = np.bincount(label, weight, len(means))
        after = np.divide(np.bincount(label, weight * values, len(means)), share, out=np.zeros(len(means)), where=share > 0)
        delta = np.abs(after - means).max()
        means, priors = after, share / n
        if delta <= 1:
            break
    lut = F.create_map(*[x for v, c in zip(values.astype(int).tolist(), label.tolist()) for x in (F.lit(v).cast("long"), F.lit(c + 1))])
    return df.withColumn("cluster", lut[F.floor(band)]), list(zip(means.tolist(), priors.tolist()))


# ------------------------------------------------------------- Gaussian mixtures

Model = list[tuple[float, np.ndarray, np.ndarray]]


def memberships(df: DataFrame, bands: list[str], model: Model, prefix: str = "u") -> DataFrame:
    """``prefix``1..K: the probability of each component of (weight, mean, covariance); 0 for
    all where every density vanishes."""
    values = {}
    for i, (w, mean, cov) in enumerate(model):
        det = np.linalg.det(cov)
        if not det > 0:
            raise ValueError(f"component {i + 1} has no positive definite covariance")
        inv = np.linalg.inv(cov)
        values |= {f"g_{i}": w / np.sqrt(det)} | {f"m_{i}_{a}": mean[a] for a in range(len(bands))} | {f"i_{i}_{a}_{b}": inv[a, b] for a in range(len(bands)) for b in range(len(bands))}
    d = lambda i, a: F.col(bands[a]) - F.col(f"m_{i}_{a}")
    n = range(len(bands))
    density = [(F.col(f"g_{i}") * F.exp(-sum((F.col(f"i_{i}_{a}_{b}") * d(i, a) * d(i, b) for a in n for b in n), F.lit(0.0)) / 2)).alias(f"f_{i}") for i in range(len(model))]
    rows = df.join(F.broadcast(_model(df, values))).select(*df.columns, *density)
    total = sum((F.col(f"f_{i}") for i in range(1, len(model))), F.col("f_0"))
    rows = rows.withColumn("f_", total)
    return rows.select(*df.columns, *[F.coalesce(F.try_divide(f"f_{i}", "f_"), F.lit(0.0)).alias(f"{prefix}{i + 1}") for i in range(len(model))])


def maximize(rows: DataFrame, bands: list[str], k: int, shift: list[float], prefix: str = "u") -> Model:
    """The weights, means and covariances that memberships imply: one aggregation."""
    n = range(len(bands))
    x = [F.col(b) - float(s) for b, s in zip(bands, shift)]
    aggs = [F.count("*").alias("n")]
    for i in range(1, k + 1):
        u = F.col(f"{prefix}{i}")
        aggs += [F.sum(u).alias(f"s{i}")] + [F.sum(u * x[a]).alias(f"s{i}_{a}") for a in n] + [F.sum(u * x[a] * x[b]).alias(f"s{i}_{a}_{b}") for a in n for b in n if a <= b]
    r = rows.agg(*aggs).first()
    out = []
    for i in range(1, k + 1):
        mean = np.array([r[f"s{i}_{a}"] / r[f"s{i}"] for a in n])
        cov = np.array([[r[f"s{i}_{min(a, b)}_{max(a, b)}"] / r[f"s{i}"] for b in n] for a in n]) - np.outer(mean, mean)
        out.append((r[f"s{i}"] / r["n"], mean + np.array(shift), cov))
    return out


def gaussian_mixture(df: DataFrame, bands: list[str], start: DataFrame, k: int, key: str | None = None, temperature: float = 0.0, beta: float = 0.0, tol: float = 1e-3, at_least: int = 10, rounds: int = 500) -> tuple[DataFrame, Model, int]:
    """Expectation maximization from memberships u1..uK beside the rows (``start``).

    ``temperature`` > 0: memberships are multiplied by 1 - r^(1/T) with r from a hash of
    ``key`` and the round, T falling by a fifth a round.  ``beta`` > 0: memberships are mixed
    with those of the four neighbours (columns x and y) as exp(-beta (1 - mean)).  Stops when
    no membership grows by more than ``tol``, after ``at_least`` rounds.  Gives the rows with
    u1..uK, the model (weight, mean, covariance) and the number of rounds."""
    us = [f"u{i + 1}" for i in range(k)]
    keep = [c for c in dict.fromkeys([*bands, *([key] if key else []), *(["x", "y"] if beta else [])])]
    shift = [start.agg(F.avg(b)).first()[0] or 0.0 for b in bands]
    held = start.select(*keep, *us).cache()
    old, turn, t = held, 0, temperature
    model = maximize(old, bands, k, shift)
    for turn in range(1, rounds + 1):
        new = memberships(held.select(*keep), bands, model)
        if t > 0:
            r = F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
            new = _normalized(new.withColumns({u: F.col(u) * (1 - F.pow(r, F.lit(1 / t))) for u in us}), us)
        if beta > 0:
            new = _mixed(new, us, beta)
        after = maximize(new, bands, k, shift)
        # How far memberships still move, from both models in one pass.
        both = memberships(memberships(held.select(*bands), bands, model, "p"), bands, after, "q")
        moved = both.agg(F.max(F.greatest(*[F.col(f"q{i}") - F.col(f"p{i}") for i in range(1, k + 1)])) if k > 1 else F.lit(0.0)).first()[0]
        model, t = after, 0.8 * t
        if turn >= at_least and not moved > tol:
            break
    held.unpersist()
    out = memberships(df, bands, model)
    return (_mixed(out, us, beta) if beta > 0 else out), model, turn


def _normalized(rows: DataFrame, us: list[str]) -> DataFrame:
    rows = rows.withColumn("sum_", sum((F.col(u) for u in us[1:]), F.col(us[0])))
    return rows.withColumns({u: F.coalesce(F.try_divide(u, "sum_"), F.lit(0.0)) for u in us}).drop("sum_")


def _mixed(rows: DataFrame, us: list[str], beta: float) -> DataFrame:
    """Memberships times exp(-beta (1 - mean of the four neighbours'))."""
    four = {(1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0}
    o = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in four])
    sent = rows.select("x", "y", *us, F.explode(o).alias("o")).select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), *us)
    near = sent.groupBy("x", "y").agg(*[F.avg(u).alias(f"n_{u}") for u in us])
    out = rows.join(near, ["x", "y"], "left").withColumns({u: F.col(u) * F.exp(-beta * (1 - F.coalesce(f"n_{u}", u))) for u in us})
    return _normalized(out, us).select(*rows.columns)


def hardened(rows: DataFrame, k: int) -> DataFrame:
    """``cluster`` (the largest membership, the first on ties) and bytes b1..bK of them."""
    us = [f"u{i + 1}" for i in range(k)]
    best = F.greatest(*us) if k > 1 else F.col("u1")
    label = F.lit(k)
    for i in reversed(range(k - 1)):
        label = F.when(F.col(us[i]) == best, i + 1).otherwise(label)
    return rows.withColumn("cluster", label).withColumns({f"b{i + 1}": F.floor(F.col(u) * 255).cast("int") for i, u in enumerate(us)})


# ------------------------------------------------------------- hierarchies, on a bounded sample


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the least hashes of their keys: the same in any partitioning."""
    return df.orderBy(hash_order(F.col(key)), key).limit(n)


def linkage(x: np.ndarray, method: str = "ward") -> np.ndarray:
    """Merges (a, b, height, size) of points, by Lance and Williams' recurrence; clusters are
    numbered as they arise.  Heights of ward, centroid and median are Euclidean distances."""
    n = len(x)
    squared = method in ("ward", "centroid", "median")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d = d if squared else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), np.arange(n), []
    for step in range(n - 1):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        h, ni, nj, nk = d[i, j], size[i], size[j], size
        di, dj = d[i], d[j]
        if method == "single":
            new = np.minimum(di, dj)
        elif method == "complete":
            new = np.maximum(di, dj)
        elif method == "average":
            new = (ni * di + nj * dj) / (ni + nj)
        elif method in ("weighted", "mcquitty"):
            new = (di + dj) / 2
        elif method == "centroid":
            new = (ni * di + nj * dj) / (ni + nj) - ni * nj * h / (ni + nj) ** 2
        elif method == "median":
            new = (di + dj) / 2 - h / 4
        elif method == "ward":
            new = ((ni + nk) * di + (nj + nk) * dj - nk * h) / (ni + nj + nk)
        else:
            raise ValueError(f"no method {method}")
        out.append((*sorted((name[i], name[j])), np.sqrt(max(h, 0.0)) if squared else h, ni + nj))
        new[[i, j]] = np.inf
        new[~np.isfinite(d[i]) & ~np.isfinite(d[j])] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i], name[i] = ni + nj, n + step
    return np.array(out).reshape(-1, 4)


def cut(merges: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k of the points, by order of their first member."""
    n = len(merges) + 1
    root = list(range(2 * n - 1))
    for step in range(n - max(1, k)):
        a, b = int(merges[step, 0]), int(merges[step, 1])
        root[a] = root[b] = n + step

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names) + 1) for i in range(n)])
