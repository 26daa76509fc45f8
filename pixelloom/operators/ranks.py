"""Orders over whole tables without a task that holds them: running sums, ranks, quantiles.

Values fall into ranges by bounds from a mergeable sketch.  The bounds only balance the
ranges; results do not depend on them.  Ranges are counted in one aggregation, their offsets
(one row a range) are summed up, and the rest happens within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
#: Values that one task orders at most when a quantile is read off.
FEW = 200_000


def bounds(df: DataFrame, value: Column, ranges: int = RANGES) -> list[float]:
    found = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    return sorted(set(found))


def range_of(value: Column, cuts: list[float]) -> Column:
    """The number of bounds below ``value``, by halving: plain code and no array."""

    def find(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(cuts[mid]), find(mid + 1, hi)).otherwise(find(lo, mid))

    return find(0, len(cuts))


def before(df: DataFrame, value: str, sums: dict[str, str], by: list[str] = ()) -> DataFrame:
    """For each row of ``df`` (one per value, and ``by`` if given) the sums over all rows with
    a smaller value: ``sums`` names the new columns and what they add up."""
    by = list(by)
    ranged = df.withColumn("range_", range_of(F.col(value), bounds(df, F.col(value))))
    totals = ranged.groupBy(*by, "range_").agg(*[F.sum(c).alias(f"t_{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "range_", *[F.coalesce(F.sum(f"t_{n}").over(ahead), F.lit(0)).alias(f"o_{n}") for n in sums])  # one row a range
    own = Window.partitionBy(*by, "range_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    out = inside.join(offsets, [*by, "range_"])
    return out.withColumns({n: F.col(n) + F.col(f"o_{n}") for n in sums}).select(*df.columns, *sums)


def quantiles(df: DataFrame, value: str, at: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles by linear interpolation at (n - 1) p.  Bounds around each wanted rank
    narrow the rows until one task can order them; values that repeat count as they are."""
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    n = rows.count()
    if not n:
        return [None for _ in at]
    out = []
    for p in at:
        rank = (n - 1) * p
        low = _at_rank(rows, int(rank), n)
        high = low if rank == int(rank) else _at_rank(rows, int(rank) + 1, n)
        out.append(low + (rank - int(rank)) * (high - low))
    return out


def _at_rank(rows: DataFrame, rank: int, n: int) -> float:
    while n > FEW:
        p, off = (rank + 0.5) / n, 2 / RANGES**2
        cuts = rows.agg(F.percentile_approx("v", [max(p - off, 0.0), min(p + off, 1.0)], RANGES**2)).first()[0]
        low, high = cuts
        below, equal, inside = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") == low), F.count_if((F.col("v") > low) & (F.col("v") <= high))).first()
        if below <= rank < below + equal:
            return low
        if rank < below:
            rows, n = rows.filter(F.col("v") < low), below
        elif rank < below + equal + inside:
            rows, rank, n = rows.filter((F.col("v") > low) & (F.col("v") <= high)), rank - below - equal, inside
        else:
            rows, rank, n = rows.filter(F.col("v") > high), rank - below - equal - inside, n - below - equal - inside
        least, most = rows.agg(F.min("v"), F.max("v")).first()
        if least == most:
            return least
    return rows.orderBy("v").limit(rank + 1).agg(F.max("v")).first()[0]
