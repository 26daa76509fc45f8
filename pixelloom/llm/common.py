"""Helpers shared by the corpus operators.

Rules that every operator of this subpackage keeps:

* intermediate tables go to the folder named by ``spark.checkpoint.dir``; one is
  set only where none is and everything runs in one process, as in tests;
* words are maximal runs of anything but space and ``\\t``..``\\r``;
* a null text counts as an empty one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python regular expression for the characters between words.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pixelloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pixelloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: this cuts the
    lineage, and a lost executor costs no more than a re-read.  The shuffles below it are
    done with; Spark deletes their files when the driver collects its garbage, which is
    asked for here, as a small heap may not need to for long."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of ``text`` as an array."""
    parts = F.split(text, WS, -1)
    return F.filter(parts, lambda w: w != "")
