"""Neighbourhood operators on sparse rasters (x, y, band) and on one-dimensional series.

A cell is sent to each neighbour that needs it (``explode`` of offsets) and neighbours are
aggregated by position: one shuffle with partial sums, no halo bookkeeping, and it scales
with the cells and not with the image.  Borders: a missing neighbour is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOBEL_X = {(-1, -1): -1, (-1, 0): -2, (-1, 1): -1, (1, -1): 1, (1, 0): 2, (1, 1): 1}
LAPLACE = {(0, 0): -4, (1, 0): 1, (-1, 0): 1, (0, 1): 1, (0, -1): 1}


def neighbours(grid: DataFrame, offsets: dict[tuple[int, int], float], band: str) -> DataFrame:
    """(x, y, v, w): for each cell the values of its neighbours at the offsets, weighted w."""
    o = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in offsets.items()])
    sent = grid.select("x", "y", F.col(band).alias("v"), F.explode(o).alias("o"))
    return sent.select((F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), "v", "o.w", ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("own"))


def square(radius: int) -> dict[tuple[int, int], float]:
    return {(i, j): 1.0 for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)}


def convolve(grid: DataFrame, kernel: dict[tuple[int, int], float], band: str, out: str = "v") -> DataFrame:
    """Weighted sum over neighbours, for cells whose neighbours are all there."""
    n = neighbours(grid, kernel, band).groupBy("x", "y").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("w")).alias(out))
    return n.filter(F.col("n") == len(kernel)).select("x", "y", out)


def median_3x3(grid: DataFrame, band: str) -> DataFrame:
    """Median of the neighbours there are, for existing cells."""
    n = neighbours(grid, square(1), band).groupBy("x", "y").agg(F.median("v").alias("v"), F.max("own").alias("own"))
    return n.filter("own").select("x", "y", "v")


def neighbour_mean(grid: DataFrame, band: str) -> DataFrame:
    """Mean of the four neighbours there are; cells without any are left out."""
    four = {(1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0}
    n = neighbours(grid, four | {(0, 0): 0.0}, band).groupBy("x", "y").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("v"), F.max("own").alias("own"))
    return n.filter("own and v is not null").select("x", "y", "v")


def label_agreement(labels: DataFrame) -> DataFrame:
    """Counts of (label, label of the right or lower neighbour): the compatibility table of
    label relaxation.  labels: (x, y, label)."""
    b = labels.select((F.col("x") - 1).alias("x"), "y", F.col("label").alias("other")).unionByName(labels.select("x", (F.col("y") - 1).alias("y"), F.col("label").alias("other")))
    return labels.join(b, ["x", "y"]).groupBy("label", "other").agg(F.count("*").alias("n"))


# ------------------------------------------------------------- whole images, reflected borders


def reflected(grid: DataFrame, offsets: dict[tuple[int, int], float], columns: list[str], width: int, height: int) -> DataFrame:
    """Like ``neighbours`` for images of a known size, offsets of one step at most: beyond the
    border a cell meets its own row or column again.  Gives (x, y, w, own, columns)."""

    def targets(c: str, d: str, n: int) -> Column:
        again = F.when((F.col(c) == 0) & (F.col(d) == -1), F.lit(0)).when((F.col(c) == n - 1) & (F.col(d) == 1), F.lit(n - 1)).cast("long")
        return F.explode(F.filter(F.array((F.col(c) - F.col(d)).cast("long"), again), lambda t: t.isNotNull() & t.between(0, n - 1)))

    o = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in offsets.items()])
    sent = grid.select("x", "y", *columns, F.explode(o).alias("o")).select("x", "y", *columns, "o.*")
    sent = sent.withColumn("tx", targets("x", "dx", width)).withColumn("ty", targets("y", "dy", height))
    return sent.select(F.col("tx").alias("x"), F.col("ty").alias("y"), "w", ((F.col("dx") == 0) & (F.col("dy") == 0)).alias("own"), *columns)


FOUR = {(1, 0): 0.25, (-1, 0): 0.25, (0, 1): 0.25, (0, -1): 0.25}


def median_reflected(grid: DataFrame, band: str, width: int, height: int) -> DataFrame:
    n = reflected(grid, square(1), [band], width, height).groupBy("x", "y").agg(F.median(band).alias("v"), F.max("own").alias("own"))
    return n.filter("own").select("x", "y", "v")


def four_mean(grid: DataFrame, columns: list[str], width: int, height: int) -> DataFrame:
    """The mean of the four neighbours, of whole images; where cells are missing, they count 0
    and get no value."""
    n = reflected(grid, FOUR | {(0, 0): 0.0}, columns, width, height)
    return n.groupBy("x", "y").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns], F.max("own").alias("own_")).filter("own_").drop("own_")


def relax_labels(grid: DataFrame, probabilities: list[str], width: int, height: int, rounds: int = 1) -> DataFrame:
    """Probabilistic label relaxation: probabilities are multiplied by the support that the
    neighbours' mean gives through the compatibility of labels (shares of right and lower
    neighbours, from the first labels), and normalized.  One shuffle a round."""
    k = len(probabilities)
    best = F.greatest(*probabilities) if k > 1 else F.col(probabilities[0])
    label = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        label = F.when(F.col(probabilities[i]) == best, i).otherwise(label)
    counts = {(r["label"], r["other"]): r["n"] for r in label_agreement(grid.select("x", "y", label.alias("label"))).collect()}  # k by k
    share = [[counts.get((i, j), 0) / max(1, sum(counts.get((i, m), 0) for m in range(k))) for j in range(k)] for i in range(k)]
    for _ in range(rounds):
        near = four_mean(grid, probabilities, width, height).select("x", "y", *[F.col(p).alias(f"n_{p}") for p in probabilities])
        support = [sum((F.col(f"n_{q}") * share[i][j] for j, q in enumerate(probabilities)), F.lit(0.0)) for i in range(k)]
        both = grid.join(near, ["x", "y"]).withColumns({f"s_{p}": F.col(p) * s for p, s in zip(probabilities, support)})
        both = both.withColumn("t_", sum((F.col(f"s_{p}") for p in probabilities[1:]), F.col(f"s_{probabilities[0]}")))
        grid = both.select("x", "y", *[F.coalesce(F.try_divide(f"s_{p}", "t_"), F.col(p)).alias(p) for p in probabilities])
    return grid


SOBEL_Y = {(dy, dx): w for (dx, dy), w in SOBEL_X.items()}


def gradient(grid: DataFrame, band: str) -> DataFrame:
    """Sobel gx, gy, and their length, for cells whose neighbours are all there."""
    o = square(1)
    weigh = lambda k: sum((F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("v") * w).otherwise(0.0) for (dx, dy), w in k.items()), F.lit(0.0))
    sent = grid.select("x", "y", F.col(band).alias("v"), F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in o])).alias("o")).select("x", "y", "v", "o.*")
    sent = sent.select((F.col("x") - F.col("dx")).alias("x"), (F.col("y") - F.col("dy")).alias("y"), weigh(SOBEL_X).alias("gx"), weigh(SOBEL_Y).alias("gy"))
    g = sent.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("gx").alias("gx"), F.sum("gy").alias("gy")).filter("n = 9")
    return g.select("x", "y", "gx", "gy", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("length"))


def corners(grid: DataFrame, band: str, radius: int = 3) -> DataFrame:
    """The smaller eigenvalue of the gradients' structure tensor, summed over a square window
    (complete windows only)."""
    from .radar import window_sums

    g = gradient(grid, band).select("x", "y", (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gx") * F.col("gy")).alias("xy"), (F.col("gy") * F.col("gy")).alias("yy"))
    s = window_sums(g, ["xx", "xy", "yy"], radius)
    d = F.col("xx") - F.col("yy")
    return s.select("x", "y", ((F.col("xx") + F.col("yy") - F.sqrt(d * d + 4 * F.col("xy") * F.col("xy"))) / 2).alias("corner"))


def log_kernel(sigma: float, radius: int) -> dict[tuple[int, int], float]:
    """The Laplacian of a Gaussian, sampled, with a sum of zero."""
    raw = {(i, j): ((i * i + j * j) / sigma**4 - 2 / sigma**2) * math.exp(-(i * i + j * j) / (2 * sigma**2)) for i, j in square(radius)}
    mean = sum(raw.values()) / len(raw)
    return {at: v - mean for at, v in raw.items()}


def zero_crossings(grid: DataFrame, band: str, sigma: float = 1.0, radius: int = 3) -> DataFrame:
    """Cells where the Laplacian of Gaussian changes sign towards the right or lower cell."""
    v = convolve(grid, log_kernel(sigma, radius), band)
    sent = v.select("x", "y", "v", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (0, 1))])).alias("o"))
    sent = sent.select((F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), "v", ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("own"))
    t = sent.groupBy("x", "y").agg(F.max(F.when(F.col("own"), F.col("v"))).alias("v"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("v is not null")
    return t.select("x", "y", "v", ((F.signum("v") * F.col("lo") < 0) | (F.signum("v") * F.col("hi") < 0)).alias("crossing"))


def slope_aspect(grid: DataFrame, band: str, cell: float = 1.0) -> DataFrame:
    """Slope in degrees and aspect in degrees from north (0 where flat), by Horn's weights; y
    grows to the south."""
    g = gradient(grid, band)
    dx, dy = F.col("gx") / (8 * cell), F.col("gy") / (8 * cell)
    aspect = F.pmod(F.degrees(F.atan2(-dx, dy)), F.lit(360.0))
    return g.select("x", "y", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"), F.when((F.col("gx") == 0) & (F.col("gy") == 0), 0.0).otherwise(aspect).alias("aspect"))


def segment_boundaries(labels: DataFrame) -> DataFrame:
    """(x, y, boundary): whether the left or upper cell carries another label."""
    sent = labels.select("x", "y", "label", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (0, 1))])).alias("o"))
    sent = sent.select((F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "label", ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("own"))
    t = sent.groupBy("x", "y").agg(F.max("own").alias("own"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("own")
    return t.select("x", "y", (F.col("lo") != F.col("hi")).alias("boundary"))


def hu_moments(objects: DataFrame) -> DataFrame:
    """The first three invariant moments per object: objects are cells (label, x, y)."""
    m = objects.groupBy("label").agg(F.count("*").cast("double").alias("m00"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = objects.join(m, "label").withColumn("u", F.col("x") - F.col("cx")).withColumn("v", F.col("y") - F.col("cy"))
    power = lambda p, q: sum_of([F.col("u")] * p + [F.col("v")] * q)

    def sum_of(factors: list[Column]) -> Column:
        out = factors[0]
        for f in factors[1:]:
            out = out * f
        return F.sum(out)

    orders = ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2))
    s = d.groupBy("label").agg(F.max("m00").alias("n"), *[power(p, q).alias(f"m{p}{q}") for p, q in orders])
    e = {(p, q): F.col(f"m{p}{q}") / F.pow("n", F.lit(1 + (p + q) / 2)) for p, q in orders}
    h1 = e[2, 0] + e[0, 2]
    h2 = (e[2, 0] - e[0, 2]) ** 2 + 4 * e[1, 1] ** 2
    h3 = (e[3, 0] - 3 * e[1, 2]) ** 2 + (3 * e[2, 1] - e[0, 3]) ** 2
    return s.select("label", h1.alias("hu1"), h2.alias("hu2"), h3.alias("hu3"))


# ------------------------------------------------------------- wavelets of images


def dwt2(grid: DataFrame, h: tuple[float, ...], band: str, width: int, height: int) -> DataFrame:
    """One level of the separable wavelet transform around the torus: (x, y, ll, hl, lh, hh) of
    half the size.  A cell adds to the len(h) / 2 smooth cells per axis that reach it."""
    g = tuple((-1) ** i * c for i, c in enumerate(reversed(h)))
    taps = lambda c, n: F.explode(F.filter(F.array(*[F.struct((F.pmod(F.col(c) - i, F.lit(n)) / 2).cast("long").alias("at"), F.lit(h[i]).alias("h"), F.lit(g[i]).alias("g"), (F.pmod(F.col(c) - i, F.lit(2)) == 0).alias("ok")) for i in range(len(h))]), lambda t: t["ok"]))
    sent = grid.select("x", "y", F.col(band).alias("v")).withColumn("a", taps("x", width)).withColumn("b", taps("y", height))
    part = lambda p, q: F.sum(F.col("v") * F.col(f"a.{p}") * F.col(f"b.{q}"))
    return sent.groupBy(F.col("a.at").alias("x"), F.col("b.at").alias("y")).agg(part("h", "h").alias("ll"), part("g", "h").alias("hl"), part("h", "g").alias("lh"), part("g", "g").alias("hh"))


def idwt2(quadrants: DataFrame, h: tuple[float, ...], width: int, height: int) -> DataFrame:
    """The image (x, y, v) whose quadrants these are."""
    g = tuple((-1) ** i * c for i, c in enumerate(reversed(h)))
    taps = lambda c, n: F.explode(F.array(*[F.struct(F.pmod(2 * F.col(c) + i, F.lit(n)).alias("at"), F.lit(h[i]).alias("h"), F.lit(g[i]).alias("g")) for i in range(len(h))]))
    sent = quadrants.withColumn("a", taps("x", width)).withColumn("b", taps("y", height))
    v = sum((F.col(c) * F.col(f"a.{p}") * F.col(f"b.{q}") for c, p, q in (("hl", "g", "h"), ("lh", "h", "g"), ("hh", "g", "g"))), F.col("ll") * F.col("a.h") * F.col("b.h"))
    return sent.groupBy(F.col("a.at").alias("x"), F.col("b.at").alias("y")).agg(F.sum(v).alias("v"))


def atrous2(grid: DataFrame, band: str, level: int) -> DataFrame:
    """One level of the two-dimensional a-trous transform with the cubic spline, for cells whose
    neighbours are all there: (x, y, smooth, detail).  The filter goes along x, then y."""
    step = 2 ** (level - 1)
    taps = {-2: 1 / 16, -1: 4 / 16, 0: 6 / 16, 1: 4 / 16, 2: 1 / 16}
    out = grid.select("x", "y", F.col(band).alias("own"), F.col(band).alias("v"), F.lit(1).alias("n"))
    for axis in ("x", "y"):
        o = F.explode(F.array(*[F.struct(F.lit(i * step).alias("d"), F.lit(w).alias("w")) for i, w in taps.items()]))
        sent = out.withColumn("o", o).withColumn(axis, F.col(axis) - F.col("o.d"))
        out = sent.groupBy("x", "y").agg(F.max(F.when(F.col("o.d") == 0, F.col("own"))).alias("own"), F.sum(F.col("v") * F.col("o.w")).alias("v"), F.sum("n").alias("n"))
    return out.filter("n = 25").select("x", "y", F.col("v").alias("smooth"), (F.col("own") - F.col("v")).alias("detail"))


# ------------------------------------------------------------- series


def convolve_series(df: DataFrame, by: str, order: str, value: str, taps: list[float]) -> DataFrame:
    """Centred moving weighted sum; incomplete windows are left out."""
    h = len(taps) // 2
    w = Window.partitionBy(by).orderBy(order)
    terms = [(F.lag(value, h - i) if i < h else F.lead(value, i - h)).over(w) * t if i != h else F.col(value) * t for i, t in enumerate(taps)]
    return df.withColumn("smooth", sum(terms[1:], terms[0])).filter("smooth is not null")


def atrous(df: DataFrame, by: str, order: str, value: str, level: int = 1) -> DataFrame:
    """Cubic spline smoothing with holes 2^(level-1), and the detail it leaves."""
    step = 2 ** (level - 1)
    taps = {-2: 1 / 16, -1: 4 / 16, 0: 6 / 16, 1: 4 / 16, 2: 1 / 16}
    w = Window.partitionBy(by).orderBy(order)
    at = lambda i: F.col(value) if i == 0 else (F.lag(value, -i * step) if i < 0 else F.lead(value, i * step)).over(w)
    smooth = sum((at(i) * t for i, t in taps.items() if i > -2), at(-2) * taps[-2])
    return df.withColumn("smooth", smooth).withColumn("detail", F.col(value) - F.col("smooth")).filter("smooth is not null")


def peaks_window(df: DataFrame, by: str, order: str, value: str, span: int) -> DataFrame:
    """Strict maxima of the odd span around each value; borders use the part there is."""
    h = span // 2
    w = Window.partitionBy(by).orderBy(order)
    before, after = F.max(value).over(w.rowsBetween(-h, -1)), F.max(value).over(w.rowsBetween(1, h))
    low = F.lit(float("-inf"))
    return df.withColumn("is_peak", (F.col(value) > F.coalesce(before, low)) & (F.col(value) > F.coalesce(after, low)))


def peaks_distance(peaks: DataFrame, by: str, pos: str, value: str, distance: int) -> DataFrame:
    """Runs of peaks nearer than ``distance`` give their largest (the first on ties)."""
    w = Window.partitionBy(by).orderBy(pos)
    new = (F.coalesce(F.col(pos) - F.lag(pos).over(w) >= distance, F.lit(True))).cast("int")
    runs = peaks.withColumn("run", new).withColumn("run", F.sum("run").over(w))
    return runs.groupBy(by, "run").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(pos)).alias("p"))).alias("m")).select(by, (-F.col("m.p")).alias(pos), F.col("m.v").alias(value))
