"""Classifiers whose training is a few aggregations, or a fit on a bounded sample, and whose
prediction is a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import _argmax
from .metrics import stratified_folds


def naive_bayes(df: DataFrame, bands: list[str], by: str) -> DataFrame:
    """Gaussian naive Bayes with population variances; adds ``pred``."""
    rows = df.groupBy(by).agg(F.count("*").alias("n"), *[f for b in bands for f in (F.avg(b).alias(f"m_{b}"), F.var_pop(b).alias(f"v_{b}"))]).collect()  # one row a class
    n = sum(r["n"] for r in rows)
    scores = {}
    for r in rows:
        var = [max(r[f"v_{b}"], 1e-300) for b in bands]
        at = F.lit(float(np.log(r["n"] / n) - 0.5 * np.log(var).sum()))
        scores[r[by]] = at - sum(((F.col(b) - r[f"m_{b}"]) * (F.col(b) - r[f"m_{b}"]) / (2 * v) for b, v in zip(bands, var)), F.lit(0.0))
    return df.withColumn("pred", _argmax(scores))


def shrunken_centroids(df: DataFrame, bands: list[str], by: str, delta: float) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Nearest shrunken centroids: class means move towards the overall mean by a soft threshold
    of their standardized differences.  Adds ``pred``; gives the differences left per class."""
    whole = df.agg(F.count("*").alias("n"), *[f for b in bands for f in (F.avg(b).alias(f"m_{b}"), F.stddev_samp(b).alias(f"s_{b}"))]).first()
    rows = df.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(b).alias(f"m_{b}") for b in bands]).collect()
    mean, sd = (np.array([whole[f"{c}_{b}"] for b in bands]) for c in "ms")
    spread = sd + np.median(sd)
    scores, left = {}, {}
    for r in rows:
        m = np.sqrt(1 / r["n"] - 1 / whole["n"])
        d = (np.array([r[f"m_{b}"] for b in bands]) - mean) / (m * spread) if m > 0 else np.zeros(len(bands))
        left[r[by]] = np.sign(d) * np.maximum(np.abs(d) - delta, 0)
        centre = mean + m * spread * left[r[by]]
        scores[r[by]] = F.lit(float(2 * np.log(r["n"] / whole["n"]))) - sum(((F.col(b) - float(c)) * (F.col(b) - float(c)) / float(s * s) for b, c, s in zip(bands, centre, sd) if s > 0), F.lit(0.0))
    return df.withColumn("pred", _argmax(scores)), left


def perceptron(df: DataFrame, bands: list[str], positive: Column, rate: float = 0.1, share: float = 0.0, rounds: int = 1000) -> tuple[DataFrame, np.ndarray, float, int]:
    """The batch rule: weights move by ``rate`` times the mean of (truth - prediction) x over
    all rows, one aggregation a round, until at most ``share`` of the rows is wrong.  Adds
    ``pred`` (true for positive); gives weights, bias and rounds."""
    held = df.select(*[F.col(b).cast("double").alias(b) for b in bands], positive.cast("double").alias("t_")).cache()
    w, bias, turn = np.zeros(len(bands)), 0.0, 0
    for turn in range(1, rounds + 1):
        p = (_linear(bands, w, bias) > 0).cast("double")
        e = F.col("t_") - p
        r = held.agg(F.avg(F.abs(e)).alias("wrong"), F.avg(e).alias("e"), *[F.avg(e * F.col(b)).alias(f"e_{b}") for b in bands]).first()
        if r["wrong"] is None or r["wrong"] <= share:
            break
        w, bias = w + rate * np.array([r[f"e_{b}"] for b in bands]), bias + rate * r["e"]
    held.unpersist()
    return df.withColumn("pred", _linear(bands, w, bias) > 0), w, bias, turn


def _linear(bands: list[str], w: np.ndarray, bias: float) -> Column:
    return sum((F.col(b) * float(v) for b, v in zip(bands, w)), F.lit(float(bias)))


def parzen(df: DataFrame, train: DataFrame, bands: list[str], positive: str, sigma: float) -> DataFrame:
    """Two classes by the mean Gaussian kernel to each class of a bounded training table, less
    half the classes' own mean kernels.  Adds ``pred`` (true for positive)."""
    from .transforms import _scored, kernel

    rows = train.select(*bands, F.col(positive).cast("int").alias("p_")).collect()
    x, t = np.array([list(r)[:-1] for r in rows], float), np.array([r["p_"] for r in rows]) == 1
    g = kernel(x, x, sigma=sigma)
    b = (g[np.ix_(~t, ~t)].mean() - g[np.ix_(t, t)].mean()) / 2

    def score(y: np.ndarray) -> np.ndarray:
        k = kernel(y, x, sigma=sigma)
        return (k[:, t].mean(1) - k[:, ~t].mean(1) + b)[:, None]

    return _scored(df, bands, ["score"], score).withColumn("pred", F.col("score") > 0)


def kernel_adatron(df: DataFrame, train: DataFrame, bands: list[str], positive: str, sigma: float, c: float = 1000.0, steps: int = 1000, eps: float = 0.01) -> DataFrame:
    """Two classes by the margin of a Gaussian kernel machine, whose weights rise by one minus
    their row's margin, within 0 and c, until the margin is within ``eps`` of one."""
    from .transforms import _scored, kernel

    rows = train.select(*bands, F.col(positive).cast("int").alias("p_")).collect()
    x, t = np.array([list(r)[:-1] for r in rows], float), np.where(np.array([r["p_"] for r in rows]) == 1, 1.0, -1.0)
    g, a = kernel(x, x, sigma=sigma), np.zeros(len(rows))
    for _ in range(steps):
        for i in range(len(a)):
            a[i] = min(max(a[i] + 1 - t[i] * (g[i] @ (a * t)), 0.0), c)
        z = g @ (a * t)
        margin = (z[t > 0].min(initial=np.inf) - z[t < 0].max(initial=-np.inf)) / 2
        if abs(1 - margin) < eps:
            break
    z = g @ (a * t)
    bias = (z[t > 0].min(initial=0.0) + z[t < 0].max(initial=0.0)) / 2
    out = _scored(df, bands, ["score"], lambda y: (kernel(y, x, sigma=sigma) @ (a * t) - bias)[:, None])
    return out.withColumn("pred", F.col("score") > 0)


# ------------------------------------------------------------- trees and boosting


class Tree:
    """A Gini tree over the counts of (band values, class): thresholds halfway between values.
    Splits stop at ``min_size`` rows or ``depth``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, n_classes: int, depth: int, min_size: float):
        counts = np.bincount(y, w, n_classes)
        self.label, self.band = int(counts.argmax()), -1
        if depth == 0 or w.sum() <= min_size or (counts > 0).sum() < 2:
            return
        gini = lambda c: c.sum(-1) - (c * c).sum(-1) / np.maximum(c.sum(-1), 1e-300)
        best = (gini(counts) - 1e-9 * w.sum(), -1, 0.0)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v = x[order, j]
            run = np.cumsum(np.eye(n_classes)[y[order]] * w[order, None], axis=0)
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                cost = gini(run[at]) + gini(run[-1] - run[at])
                i = int(cost.argmin())
                if cost[i] < best[0] - 1e-12 * w.sum():
                    best = (cost[i], j, float(v[at[i]] + v[at[i] + 1]) / 2)
        _, self.band, self.cut = best
        if self.band >= 0:
            go = x[:, self.band] <= self.cut
            self.left, self.right = (Tree(x[m], y[m], w[m], n_classes, depth - 1, min_size) for m in (go, ~go))

    def column(self, bands: list[str], labels: list) -> Column:
        if self.band < 0:
            return F.lit(labels[self.label])
        return F.when(F.col(bands[self.band]) <= F.lit(self.cut), self.left.column(bands, labels)).otherwise(self.right.column(bands, labels))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.band < 0:
            return np.full(len(x), self.label)
        return np.where(x[:, self.band] <= self.cut, self.left.predict(x), self.right.predict(x))


#: Distinct (values, class) rows that a tree is fitted on at most; more are binned by band.
MAX_CELLS, BINS = 200_000, 64


def _cells(df: DataFrame, bands: list[str], by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Counts of (band values, class) over all rows, as arrays on the driver."""
    rows = df.groupBy(*bands, by).agg(F.count("*").alias("c_"))
    if rows.count() > MAX_CELLS:
        lo_hi = df.agg(*[f for b in bands for f in (F.min(b).alias(f"lo_{b}"), F.max(b).alias(f"hi_{b}"))]).first()
        bins = max(2, min(BINS, int((MAX_CELLS / 16) ** (1 / len(bands)))))
        width = {b: ((lo_hi[f"hi_{b}"] - lo_hi[f"lo_{b}"]) / bins or 1.0) for b in bands}
        middle = [((F.floor((F.col(b) - lo_hi[f"lo_{b}"]) / width[b]) + 0.5) * width[b] + lo_hi[f"lo_{b}"]).alias(b) for b in bands]
        rows = df.select(*middle, by).groupBy(*bands, by).agg(F.count("*").alias("c_"))
    rows = rows.orderBy(*bands, by).collect()
    labels = sorted({r[by] for r in rows})
    at = {v: i for i, v in enumerate(labels)}
    return np.array([[r[b] for b in bands] for r in rows], float), np.array([at[r[by]] for r in rows]), np.array([r["c_"] for r in rows], float), labels


def class_tree(df: DataFrame, bands: list[str], by: str, stumps: bool = False, min_size: int = 1, depth: int = 16) -> DataFrame:
    """A classification tree (or a stump) fitted on the counts of band values; adds ``pred``."""
    x, y, w, labels = _cells(df, bands, by)
    return df.withColumn("pred", Tree(x, y, w, len(labels), 1 if stumps else depth, min_size).column(bands, labels))


def boosted_trees(df: DataFrame, bands: list[str], by: str, trees: int = 20, depth: int = 2) -> tuple[DataFrame, list[float]]:
    """AdaBoost.M1 over small trees: rows weigh less when classified well, trees vote with
    ln(1 / beta); stops at a tree that errs on half of the weight.  Adds ``pred``."""
    x, y, n, labels = _cells(df, bands, by)
    w, made, votes = n / n.sum(), [], []
    for _ in range(trees):
        tree = Tree(x, y, w, len(labels), depth, 0.0)
        right = tree.predict(x) == y
        error = w[~right].sum()
        if error >= 0.5:
            break
        beta = max(error, 1e-10) / (1 - min(error, 1 - 1e-10))
        made.append(tree)
        votes.append(float(np.log(1 / beta)))
        if error == 0:
            break
        w = np.where(right, w * beta, w)
        w /= w.sum()
    if not made:
        made, votes = [Tree(x, y, w, len(labels), depth, 0.0)], [1.0]
    picks = df.select("*", *[t.column(bands, labels).alias(f"t_{i}") for i, t in enumerate(made)])
    scores = {v: sum((F.when(F.col(f"t_{i}") == v, a).otherwise(0.0) for i, a in enumerate(votes)), F.lit(0.0)) for v in labels}
    return picks.withColumn("pred", _argmax(scores)).select(*df.columns, "pred"), votes


# ------------------------------------------------------------- a small network


class Network:
    """Sigmoid hidden units, softmax output, cross entropy; trained on a bounded sample by
    scaled conjugate gradients with exact curvature along each direction."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n_classes: int, hidden: int = 10, epochs: int = 200, seed: int = 1):
        self.shift, self.scale = x.min(0), np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1.0)
        self.shape = (x.shape[1] + 1, hidden, hidden + 1, n_classes)
        a, t = self._in(x), np.eye(n_classes)[y]
        rng = np.random.default_rng(seed)
        w = rng.uniform(-0.5, 0.5, self.shape[0] * self.shape[1] + self.shape[2] * self.shape[3])
        cost, g = self._cost(w, a, t)
        d, damp, sound = -g, 1e-6, True
        for k in range(epochs):
            slope = d @ g
            if slope >= 0 or np.linalg.norm(g) < 1e-7:
                break
            h = 1e-4 / np.linalg.norm(d)
            bend = d @ (self._cost(w + h * d, a, t)[1] - g) / h + damp * (d @ d)
            if bend <= 0:
                damp, bend = 2 * (damp - bend / (d @ d)), -bend + damp * (d @ d)
            step = -slope / bend
            after, g2 = self._cost(w + step * d, a, t)
            gain = 2 * bend * (cost - after) / slope**2
            sound = gain >= 0
            if sound:
                w, cost = w + step * d, after
                beta = 0.0 if (k + 1) % len(w) == 0 else max(0.0, (g2 @ g2 - g2 @ g) / (g @ g))
                g, d = g2, -g2 + beta * d
                damp = damp / 4 if gain > 0.75 else damp
            if gain < 0.25:
                damp = min(damp * 4 + 1e-12, 1e12)
            if d @ g >= 0:
                d = -g
        self.w = w

    def _in(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([2 * (x - self.shift) / self.scale - 1, np.ones(len(x))])

    def _parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, h, h1, o = self.shape
        return w[: i * h].reshape(i, h), w[i * h :].reshape(h1, o)

    def _forward(self, w, a):
        u, v = self._parts(w)
        z = np.column_stack([1 / (1 + np.exp(-np.clip(a @ u, -500, 500))), np.ones(len(a))])
        e = z @ v
        e = np.exp(e - e.max(1, keepdims=True))
        return z, e / e.sum(1, keepdims=True)

    def _cost(self, w, a, t):
        z, p = self._forward(w, a)
        e = (p - t) / len(a)
        back = (e @ self._parts(w)[1][:-1].T) * z[:, :-1] * (1 - z[:, :-1])
        return float(-(t * np.log(np.maximum(p, 1e-300))).sum() / len(a)), np.concatenate([(a.T @ back).ravel(), (z.T @ e).ravel()])

    def columns(self, bands: list[str]) -> tuple[list[Column], list]:
        """The hidden units, and each output before the softmax as a function of their names."""
        u, v = self._parts(self.w)
        a = [2 * (F.col(b) - float(m)) / float(s) - 1 for b, m, s in zip(bands, self.shift, self.scale)]
        z = [1 / (1 + F.exp(-sum((c * float(k) for c, k in zip(a, u[:-1, h])), F.lit(float(u[-1, h]))))) for h in range(u.shape[1])]
        return z, [lambda names, o=o: sum((F.col(n) * float(k) for n, k in zip(names, v[:-1, o])), F.lit(float(v[-1, o]))) for o in range(v.shape[1])]


def neural_network(df: DataFrame, train: DataFrame, bands: list[str], by: str, hidden: int = 10, epochs: int = 200) -> DataFrame:
    """A network trained on a bounded table; adds ``pred``.  Prediction is plain arithmetic."""
    rows = train.select(*bands, by).orderBy(*bands, by).collect()
    labels = sorted({r[by] for r in rows})
    at = {v: i for i, v in enumerate(labels)}
    net = Network(np.array([list(r)[:-1] for r in rows], float), np.array([at[r[by]] for r in rows]), len(labels), hidden, epochs)
    z, out = net.columns(bands)
    names = [f"z_{i}" for i in range(len(z))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(z, names)])
    rows = rows.select(*df.columns, *[f(names).alias(f"o_{i}") for i, f in enumerate(out)])
    return rows.withColumn("pred", _argmax({v: F.col(f"o_{i}") for i, v in enumerate(labels)})).select(*df.columns, "pred")


# ------------------------------------------------------------- validation

def cross_validate(df: DataFrame, key: str, bands: list[str], by: str, k: int = 10) -> DataFrame:
    """(fold, n, n_wrong) of Gaussian maximum likelihood, each fold judged by the others'
    moments: class moments of every fold come from one aggregation, and a fold's model is the
    whole less the fold."""
    folds = stratified_folds(df.select(key, by, *bands), key, by, k)
    n = range(len(bands))
    shift = [folds.agg(F.avg(b)).first()[0] or 0.0 for b in bands]
    x = [F.col(b) - float(s) for b, s in zip(bands, shift)]
    rows = folds.groupBy("fold", by).agg(F.count("*").alias("n"), *[F.sum(x[a]).alias(f"s_{a}") for a in n], *[F.sum(x[a] * x[b]).alias(f"s_{a}_{b}") for a in n for b in n if a <= b]).collect()
    total: dict = {}
    for r in rows:
        s = np.array([r["n"], *[r[f"s_{a}"] for a in n], *[r[f"s_{min(a, b)}_{max(a, b)}"] for a in n for b in n]], float)
        total.setdefault(r[by], {})[r["fold"]] = s
    pred = None
    for fold in sorted({r["fold"] for r in rows}):
        scores, models = {}, {}
        for c, parts in total.items():
            s = sum(v for f, v in parts.items() if f != fold)
            if np.ndim(s):
                mean = s[1 : 1 + len(bands)] / s[0]
                models[c] = (s[0], mean, (s[1 + len(bands) :].reshape(len(bands), -1) - s[0] * np.outer(mean, mean)) / (s[0] - 1))
        m = sum(v[0] for v in models.values())
        for c, (count, mean, cov) in models.items():
            inv = np.linalg.inv(cov)
            d = [x[a] - float(mean[a]) for a in n]
            scores[c] = F.lit(float(np.log(count / m) - 0.5 * np.log(np.linalg.det(cov)))) - sum((float(inv[a, b]) * d[a] * d[b] for a in n for b in n), F.lit(0.0)) / 2
        best = F.when(F.col("fold") == fold, _argmax(scores))
        pred = best if pred is None else F.coalesce(pred, best)
    return folds.withColumn("pred", pred).groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("pred") != F.col(by)).alias("n_wrong"))
