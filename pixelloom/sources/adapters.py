"""Pixel tables made from the generic tables, as DataFrames and as SQL text.

pixels: one row per line item, bands b1..b4, class cls.  grid: a raster of supplier by
ship month with mean bands.  pair: two dates per part.  series: radar-like intensities
per user and six-day bucket.  signal: daily means per event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_quantity").alias("b1"), F.col("l_extendedprice").alias("b2"), F.col("l_discount").alias("b3"), F.col("l_tax").alias("b4"), F.col("l_returnflag").alias("cls")
    )


PIXELS = "pixels AS (SELECT l_partkey AS id, l_quantity AS b1, l_extendedprice AS b2, l_discount AS b3, l_tax AS b4, l_returnflag AS cls FROM lineitem)"


def grid(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """``in_order``: for queries that cut means or ask whether they are equal.  A mean's last
    digits depend on the order of its sum, so rows are added as the files hold them, whatever
    the partitions: all rows of a cell are sorted in one task, and spilled if they are many."""
    month = (12 * (F.year("l_shipdate") - 1995) + F.month("l_shipdate") - 1).cast("long")
    bands = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    means = [F.avg(b) for b in bands]
    rows = table(spark, sf_dir, "lineitem")
    if not in_order:
        return rows.groupBy(F.col("l_suppkey").alias("x"), month.alias("y")).agg(*[m.alias(f"b{i + 1}") for i, m in enumerate(means)])
    rows = rows.select(F.col("l_suppkey").alias("x"), month.alias("y"), *bands, F.col("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    cell = Window.partitionBy("x", "y").orderBy("file_", "row_")
    whole = cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.select("x", "y", *[m.over(whole).alias(f"b{i + 1}") for i, m in enumerate(means)], F.row_number().over(cell).alias("n_"))
    return out.filter("n_ = 1").drop("n_")


GRID = "grid AS (SELECT l_suppkey AS x, (12 * (year(l_shipdate) - 1995) + month(l_shipdate) - 1)::BIGINT AS y, avg(l_quantity) AS b1, avg(l_extendedprice) AS b2, avg(l_discount) AS b3, avg(l_tax) AS b4 FROM lineitem GROUP BY 1, 2)"


def pair(spark: SparkSession, sf_dir: str, cut: str = "1998-06-01") -> DataFrame:
    """id, a1..a4 (before ``cut``), c1..c4 (from then on): one pass, no join of scans."""
    li = table(spark, sf_dir, "lineitem")
    late = F.col("l_shipdate") >= F.lit(cut).cast("timestamp_ntz")
    bands = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    aggs = [F.avg(F.when(~late, F.col(b))).alias(f"a{i + 1}") for i, b in enumerate(bands)] + [F.avg(F.when(late, F.col(b))).alias(f"c{i + 1}") for i, b in enumerate(bands)]
    return li.groupBy(F.col("l_partkey").alias("id")).agg(*aggs).filter("a1 is not null and c1 is not null")


PAIR = "pair AS (SELECT * FROM (SELECT l_partkey AS id, " + ", ".join(
    f"avg({b}) FILTER (WHERE l_shipdate {op} TIMESTAMP '1998-06-01') AS {n}{i + 1}" for n, op in (("a", "<"), ("c", ">=")) for i, b in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
) + " FROM lineitem GROUP BY 1) WHERE a1 IS NOT NULL AND c1 IS NOT NULL)"

START = "2024-01-01"


def series(spark: SparkSession, sf_dir: str, k: int = 5, days: int = 6) -> DataFrame:
    """pix, t (1..k), v: mean value per user and bucket of ``days`` from the first event."""
    ev = table(spark, sf_dir, "events")
    first = ev.agg(F.min(F.to_date("ts")).alias("first"))
    day = F.datediff(F.to_date("ts"), F.col("first"))
    rows = ev.join(F.broadcast(first)).withColumn("t", (F.floor(day / days) + 1).cast("int")).filter(F.col("t") <= k)
    return rows.groupBy(F.col("user_id").alias("pix"), "t").agg(F.avg("value").alias("v"))


SERIES = "series AS (SELECT user_id AS pix, (floor(date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) / 6) + 1)::INTEGER AS t, avg(value) AS v FROM events GROUP BY 1, 2 HAVING t <= 5)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("s"), F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))


SIGNAL = "signal AS (SELECT event_type AS s, ts::DATE AS d, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)"
