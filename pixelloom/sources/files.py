"""Readers and writers of the file formats that come with images: headers, raw rasters,
polygons, control points, prediction lists.

Raw rasters are read by ranges of rows with Hadoop's file system through Spark's binary reader,
one row of the table per pixel; small text files are parsed on the driver."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of the header's data types.
DATA_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4"}


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return rows[0][0] if rows else ""


def parse_header(text: str) -> dict[str, str | list[str]]:
    """``key = value`` lines, where a value in braces may go on over lines and is a list; keys
    in lower case.  ``sigma`` counts as ``fwhm``."""
    out: dict[str, str | list[str]] = {}
    for m in re.finditer(r"^[ \t]*([^=\n;]+?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)", text, re.M):
        key, value = m[1].strip().lower(), m[2].strip()
        out["fwhm" if key == "sigma" else key] = [x.strip() for x in value[1:-1].split(",")] if value.startswith("{") else value
    return out


def header_text(header: dict[str, str | list[str]]) -> str:
    lines = [f"{k} = {{{', '.join(map(str, v))}}}" if isinstance(v, list) else f"{k} = {v}" for k, v in header.items()]
    return "\n".join(["ENVI", *lines]) + "\n"


def read_raster(spark: SparkSession, path: str, header: dict) -> DataFrame:
    """(x, y, b1..bN) of a raw raster, band interleaved in any of the three ways."""
    w, h, n = (int(header[k]) for k in ("samples", "lines", "bands"))
    kind = np.dtype((">" if str(header.get("byte order", "0")) == "1" else "<") + DATA_TYPES[int(header["data type"])])
    skip, order = int(header.get("header offset", 0)), str(header.get("interleave", "bsq")).lower()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                data = np.frombuffer(content, kind, w * h * n, skip)
                cube = {"bsq": lambda: data.reshape(n, h, w).transpose(1, 2, 0), "bil": lambda: data.reshape(h, n, w).transpose(0, 2, 1), "bip": lambda: data.reshape(h, w, n)}[order]()
                step = max(1, 200_000 // w)
                for y in range(0, h, step):
                    part = cube[y : y + step].reshape(-1, n).astype(float)
                    at = np.arange(len(part))
                    yield pd.DataFrame({"x": at % w, "y": y + at // w, **{f"b{i + 1}": part[:, i] for i in range(n)}})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "x long, y long, " + ", ".join(f"b{i + 1} double" for i in range(n)))


def write_raster(df: DataFrame, path: str, bands: list[str], width: int, height: int, data_type: int = 4, rows: int = 64) -> dict:
    """Write (x, y, bands) as raw strips of ``rows`` image rows, band interleaved by pixel, and
    give the header.  ``path`` becomes a Parquet table (strip, content) that ``read_strips``
    reads; strips are written where they arise and never meet in one task."""
    kind = np.dtype("<" + DATA_TYPES[data_type])

    def strip(key, part: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((min(rows, height - key[0] * rows), width, len(bands)), kind)
        dense[part["y"].to_numpy() - key[0] * rows, part["x"].to_numpy()] = part[bands].to_numpy()
        return pd.DataFrame({"strip": [key[0]], "content": [dense.tobytes()]})

    inside = df.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    inside.withColumn("strip", F.floor(F.col("y") / rows)).groupBy("strip").applyInPandas(strip, "strip long, content binary").write.mode("errorifexists").parquet(path)
    return {"samples": str(width), "lines": str(height), "bands": str(len(bands)), "data type": str(data_type), "interleave": "bip", "byte order": "0", "band names": list(bands)}


def read_strips(spark: SparkSession, path: str, header: dict, rows: int = 64) -> DataFrame:
    w, n = int(header["samples"]), int(header["bands"])
    kind = np.dtype("<" + DATA_TYPES[int(header["data type"])])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s, content in zip(f["strip"], f["content"]):
                data = np.frombuffer(content, kind).reshape(-1, n).astype(float)
                at = np.arange(len(data))
                yield pd.DataFrame({"x": at % w, "y": s * rows + at // w, **{f"b{i + 1}": data[:, i] for i in range(n)}})

    return spark.read.parquet(path).mapInPandas(run, "x long, y long, " + ", ".join(f"b{i + 1} double" for i in range(n)))


# ------------------------------------------------------------- points and polygons


def read_control_points(spark: SparkSession, path: str) -> DataFrame:
    """(base_x, base_y, warp_x, warp_y) of the lines that are no comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, ';')")
    parts = F.split("v", r"\s+")
    return lines.select(*[F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(("base_x", "base_y", "warp_x", "warp_y"))])


def parse_shapes(content: bytes) -> list[list[list[tuple[float, float]]]]:
    """The rings of each polygon of a main shape file; other shapes have none."""
    out, at = [], 100
    while at + 8 <= len(content):
        length = 2 * struct.unpack_from(">i", content, at + 4)[0]
        body = content[at + 8 : at + 8 + length]
        rings = []
        if len(body) >= 44 and struct.unpack_from("<i", body)[0] in (5, 15, 25):
            n_parts, n_points = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n_points]
            xy = struct.unpack_from(f"<{2 * n_points}d", body, 44 + 4 * n_parts)
            rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        out.append(rings)
        at += 8 + length
    return out


def parse_attributes(content: bytes) -> list[dict[str, str]]:
    """Records of a dBASE table as text; deleted ones are kept, as shapes go by place."""
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at, offset = [], 32, 1
    while at < head - 1 and content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), offset, content[at + 16]))
        offset += content[at + 16]
        at += 32
    rows = [content[head + i * size : head + (i + 1) * size] for i in range(n)]
    return [{k: r[o : o + w].decode("latin-1").strip() for k, o, w in fields} for r in rows]


def read_polygons(spark: SparkSession, shapes: str, attributes: str) -> DataFrame:
    """(class_id, class_name, rings) of a shape file and its table."""
    content = lambda p: bytes(spark.read.format("binaryFile").load(p).select("content").first()[0])
    rows = [(int(float(a["CLASS_ID"])), a.get("CLASS_NAME"), [[{"x": x, "y": y} for x, y in ring] for ring in s]) for s, a in zip(parse_shapes(content(shapes)), parse_attributes(content(attributes)))]
    return spark.createDataFrame(rows, "class_id int, class_name string, rings array<array<struct<x:double,y:double>>>")


def pixels_in_polygons(pixels: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", cell: float = 64.0) -> DataFrame:
    """Pixels inside a polygon or on its left and upper sides, with class_id and class_name:
    the bounding boxes' cells of a coarse lattice meet the pixels' cells by equality, then rays
    are cast over the rings' sides."""
    every = F.flatten("rings")
    box = polygons.select("*", *[f(every.getField(c)).alias(f"{n}_{c}") for n, f in (("lo", F.array_min), ("hi", F.array_max)) for c in ("x", "y")])
    steps = lambda c: F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / cell), F.floor(F.col(f"hi_{c}") / cell)))
    laid = box.withColumn("cx_", steps("x")).withColumn("cy_", steps("y"))
    at = pixels.withColumn("cx_", F.floor(F.col(x) / cell)).withColumn("cy_", F.floor(F.col(y) / cell))
    # Sides of all rings: crossings of a ray to the right, counted.
    sides = F.flatten(F.transform("rings", lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))))
    px, py = F.col(x), F.col(y)
    hit = lambda s: ((s["p"]["y"] > py) != (s["q"]["y"] > py)) & (px < F.coalesce(F.try_divide((s["q"]["x"] - s["p"]["x"]) * (py - s["p"]["y"]), s["q"]["y"] - s["p"]["y"]), F.lit(0.0)) + s["p"]["x"])
    both = at.join(laid.withColumn("sides", sides).select("cx_", "cy_", "class_id", "class_name", "sides"), ["cx_", "cy_"])
    return both.filter(F.size(F.filter("sides", hit)) % 2 == 1).select(*pixels.columns, "class_id", "class_name")


# ------------------------------------------------------------- predictions


def prediction_text(rows: DataFrame, title: str, classes: int) -> DataFrame:
    """The lines of a prediction list: four of heading, counts, then ``pred label``."""
    n = rows.count()
    head = [title, "", "Classification image: -", "Class probabilities image: -", f"{n} {classes}"]
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "i long, value string")
    body = rows.select(F.lit(len(head)).cast("long").alias("i"), F.concat_ws(" ", "pred", "label").alias("value"))
    return top.union(body)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(pred, label): the lines of two integers, without the counts of the heading."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("l"))
    rows = lines.select(F.explode(F.slice("l", F.lit(6), F.greatest(F.size("l") - 5, F.lit(0)))).alias("v")).filter(F.col("v").rlike(r"^\s*\d+\s+\d+\s*$"))
    parts = F.split(F.trim("v"), r"\s+")
    return rows.select(F.get(parts, F.lit(0)).cast("int").alias("pred"), F.get(parts, F.lit(1)).cast("int").alias("label"))
