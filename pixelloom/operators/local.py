"""Per-pixel operators: stretches, scalings, indices, determinants, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def _with(df: DataFrame, stats: DataFrame) -> DataFrame:
    """One row of statistics beside every row."""
    return df.join(F.broadcast(stats))


def _ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, and ``otherwise`` where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.when(a.isNotNull() & (b == 0), F.lit(otherwise)))


def _bytes(v: Column) -> Column:
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))).cast("int")


def byte_stretch(df: DataFrame, band: str, out: str = "byte") -> DataFrame:
    """(x - min) * 255 / (max - min), clipped and truncated; 0 for a constant band."""
    s = _with(df, df.agg(F.min(band).alias("lo_"), F.max(band).alias("hi_")))
    v = _ratio((F.col(band) - F.col("lo_")) * 255, F.col("hi_") - F.col("lo_"))
    return s.withColumn(out, _bytes(v)).drop("lo_", "hi_")


def histogram(df: DataFrame, byte: str = "byte") -> DataFrame:
    """Counts and running counts per byte value; 256 rows at most."""
    h = df.groupBy(F.col(byte).alias("b")).agg(F.count("*").alias("c"))
    w = Window.orderBy("b")
    return h.select("b", "c", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))


def hist_equalize(df: DataFrame, band: str) -> DataFrame:
    """Bytes through the cumulative histogram."""
    b = byte_stretch(df, band)
    lut = histogram(b).select(F.col("b").alias("byte"), F.floor(255 * F.col("cum") / F.col("total")).cast("int").alias("equalized"))
    return b.join(F.broadcast(lut), "byte")


def stretch_2pc(df: DataFrame, band: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Linear ramp between the 2 % and 98 % points of the byte histogram; 0 if they are one."""
    b = byte_stretch(df, band)
    h = histogram(b)
    share = F.col("cum") / F.col("total")
    cut = h.agg(F.min(F.when(share >= low, F.col("b"))).alias("lo_"), F.max(F.when(share <= high, F.col("b"))).alias("hi_"))
    s = _with(b, cut)
    v = _ratio((F.col("byte") - F.col("lo_")) * 255, F.col("hi_") - F.col("lo_"))
    return s.withColumn("stretched", F.coalesce(_bytes(v), F.when(F.col("byte").isNotNull(), 0))).drop("lo_", "hi_")


def log_enhance(df: DataFrame, band: str) -> DataFrame:
    """Shift to non-negative, zeros to the mean, ln, scale to 0..255; 0 for a constant band."""
    s = _with(df, df.agg(F.least(F.min(band), F.lit(0.0)).alias("lo_"), F.avg(band).alias("mean_")))
    v = F.col(band) - F.col("lo_")
    v = F.log(F.when(v == 0, F.col("mean_") - F.col("lo_")).otherwise(v))
    s = s.withColumn("log_", v)
    t = _with(s, s.agg(F.min("log_").alias("a_"), F.max("log_").alias("b_")))
    scaled = F.coalesce(_ratio((F.col("log_") - F.col("a_")) * 255, F.col("b_") - F.col("a_")), F.when(F.col(band).isNotNull(), 0.0))
    return t.withColumn("enhanced", scaled).drop("lo_", "mean_", "log_", "a_", "b_")


def log_stretch(df: DataFrame, band: str) -> DataFrame:
    """The logarithmic enhancement followed by the 2 % stretch."""
    out = stretch_2pc(log_enhance(df, band), "enhanced")
    return out.drop("byte", "enhanced")


def minmax_scale(df: DataFrame, bands: list[str]) -> DataFrame:
    """Each band to [-1, 1]; a constant band to -1."""
    s = _with(df, df.agg(*[x for b in bands for x in (F.min(b).alias(f"lo_{b}"), F.max(b).alias(f"hi_{b}"))]))
    return s.select(*df.columns, *[(_ratio(2 * (F.col(b) - F.col(f"lo_{b}")), F.col(f"hi_{b}") - F.col(f"lo_{b}")) - 1).alias(f"s_{b}") for b in bands])


def normalized_difference(a: Column, b: Column) -> Column:
    return F.when(a + b != 0, (a - b) / (a + b))


def db_to_linear(x: Column) -> Column:
    return F.exp(x * F.log(F.lit(10.0)) / 10)


def determinant(bands: list[Column]) -> Column:
    """Hermitian covariance matrix packed in 9, 4, 3, 2 or 1 real bands."""
    b = bands
    if len(b) == 9:
        k, a1, a2, r1, r2, xsi, b1, b2, zeta = b
        re = (a1 * b1 - a2 * b2) * r1 + (a1 * b2 + a2 * b1) * r2
        return k * xsi * zeta + 2 * re - xsi * (r1 * r1 + r2 * r2) - k * (b1 * b1 + b2 * b2) - zeta * (a1 * a1 + a2 * a2)
    if len(b) == 4:
        return b[0] * b[3] - (b[1] * b[1] + b[2] * b[2])
    out = b[0]
    for c in b[1:]:
        out = out * c
    return out


def span(bands: list[Column], log: bool = False) -> Column:
    diagonal = {9: (0, 5, 8), 4: (0, 3), 3: (0, 1, 2), 2: (0, 1), 1: (0,)}[len(bands)]
    total = sum((bands[i] for i in diagonal[1:]), bands[diagonal[0]])
    return F.log(total + 0.001) if log else total


def solar_incidence(zenith: Column, azimuth: Column, slope: Column, aspect: Column) -> Column:
    """Cosine of the local incidence angle, all in radians."""
    return F.cos(slope) * F.cos(zenith) + F.sin(slope) * F.sin(zenith) * F.cos(azimuth - aspect)


def subset(df: DataFrame, window: tuple[int, int, int, int], bands: list[str]) -> DataFrame:
    """[x, y, width, height] and the named bands; both reach the scan."""
    x, y, w, h = window
    return df.filter((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)).select("x", "y", *bands)


def block_mean(df: DataFrame, f: int, bands: list[str]) -> DataFrame:
    """Rebin by whole blocks."""
    return df.groupBy(F.floor(F.col("x") / f).alias("x"), F.floor(F.col("y") / f).alias("y")).agg(*[F.avg(b).alias(b) for b in bands])


def block_repeat(df: DataFrame, f: int, bands: list[str]) -> DataFrame:
    """Rebin upwards: each cell becomes f by f cells of its value."""
    steps = F.sequence(F.lit(0), F.lit(f - 1))
    out = df.select((F.col("x") * f).alias("x"), (F.col("y") * f).alias("y"), *bands).withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    return out.select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), *bands)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (of one turn), saturation and value."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    h = F.when(d == 0, 0.0).when(v == r, ((g - b) / d + 6) % 6).when(v == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return h, F.when(v == 0, 0.0).otherwise(d / v), v


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """The inverse: each colour falls off from v by its distance on the hue circle."""

    def part(n: int) -> Column:
        k = (n + h * 6) % 6
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return part(5), part(3), part(1)


def pansharpen_hsv(df: DataFrame, r: str, g: str, b: str, pan: str) -> DataFrame:
    """The colour bands with their value replaced by the panchromatic band."""
    h, s, _ = rgb_to_hsv(F.col(r), F.col(g), F.col(b))
    t = df.withColumns({"h_": h, "s_": s})
    out = hsv_to_rgb(F.col("h_"), F.col("s_"), F.col(pan))
    return t.withColumns({c: x for c, x in zip((f"sharp_{r}", f"sharp_{g}", f"sharp_{b}"), out)}).drop("h_", "s_")


def nan_to_zero(c: Column) -> Column:
    return F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def valid_pixels(df: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Pixels whose bands do not sum to zero in either image (nulls and NaN count as 0)."""
    total = lambda bands: sum((nan_to_zero(F.col(b)) for b in bands[1:]), nan_to_zero(F.col(bands[0])))
    return df.filter((total(first) != 0) & (total(second) != 0))


def checkerboard(x: Column, y: Column) -> Column:
    """(-1)^(x + y)."""
    return F.when(F.pmod(x + y, F.lit(2)) == 0, 1).otherwise(-1)


def where(value: Column, mask: Column, replacement: Column) -> Column:
    """``replacement`` where the mask is not zero."""
    return F.when(mask != 0, replacement).otherwise(value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def resample_nearest(grid: DataFrame, width: int, height: int, new_width: int, new_height: int, bands: list[str]) -> DataFrame:
    """Resampling to a new shape, each cell from the source cell that holds its corner.  Source
    cells tell which new ones they make, so nothing is joined."""
    lo = lambda c, n, m: F.ceil(F.col(c) * m / n)
    span = lambda c, n, m: F.sequence(lo(c, n, m), F.ceil((F.col(c) + 1) * m / n) - 1)
    some = lambda c, n, m: F.ceil((F.col(c) + 1) * m / n) > lo(c, n, m)
    inside = grid.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & some("x", width, new_width) & some("y", height, new_height))
    return inside.withColumn("nx", F.explode(span("x", width, new_width))).withColumn("ny", F.explode(span("y", height, new_height))).select(F.col("nx").alias("x"), F.col("ny").alias("y"), *bands)


def resample_linear(grid: DataFrame, width: int, height: int, new_width: int, new_height: int, band: str) -> DataFrame:
    """Bilinear resampling that maps corner to corner; every source cell adds its share to the
    new cells within one step of it."""
    fx, fy = (width - 1) / (new_width - 1), (height - 1) / (new_height - 1)
    reach = lambda c, f, n: F.sequence(F.greatest(F.ceil((F.col(c) - 1) / f), F.lit(0)), F.least(F.floor((F.col(c) + 1) / f), F.lit(n - 1)))
    inside = grid.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    sent = inside.withColumn("nx", F.explode(reach("x", fx, new_width))).withColumn("ny", F.explode(reach("y", fy, new_height)))
    share = (1 - F.abs(F.col("nx") * fx - F.col("x"))) * (1 - F.abs(F.col("ny") * fy - F.col("y")))
    parts = sent.select(F.col("nx").alias("x"), F.col("ny").alias("y"), band, share.alias("w")).filter("w > 0")
    return parts.groupBy("x", "y").agg(F.sum(F.col(band) * F.col("w")).alias(band), F.sum("w").alias("w")).filter("w > 1 - 1e-9").drop("w")


def percentiles(df: DataFrame, band: str, at: tuple[float, ...] = (0.02, 0.98)) -> DataFrame:
    """Exact quantiles with linear interpolation, as columns p2, p98 and so on; null if there
    are no values."""
    values = ranks.quantiles(df.select(F.col(band).cast("double").alias("v")), "v", at)
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(f"p{round(100 * p)} double" for p in at))


def affine(x: Column, y: Column, gt: tuple[float, ...]) -> tuple[Column, Column]:
    """Map coordinates of a pixel, by the six numbers (x0, xx, xy, y0, yx, yy)."""
    return gt[0] + x * gt[1] + y * gt[2], gt[3] + x * gt[4] + y * gt[5]


def affine_inverse(px: Column, py: Column, gt: tuple[float, ...]) -> tuple[Column, Column]:
    """The pixel of map coordinates, for rotated grids as well."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    dx, dy = px - gt[0], py - gt[3]
    return (dx * gt[5] - dy * gt[2]) / det, (dy * gt[1] - dx * gt[4]) / det


def log_span(*diagonal: Column) -> Column:
    """Logarithm of the trace of a polarimetric matrix."""
    return F.log(sum(diagonal[1:], diagonal[0]) + 0.001)
