"""Raster relations: one row per raster with an array of values, or one row per pixel, aggregated in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import cells, meeting


def pixels(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """key, row, col, v of every pixel of row-major arrays."""
    return df.select(key, F.posexplode(values).alias("i", "v")).select(key, F.floor(F.col("i") / width).cast("int").alias("row"), (F.col("i") % width).cast("int").alias("col"), F.col("v").cast("double").alias("v"))


def block_mean(px: DataFrame, key: str, k: int) -> DataFrame:
    """Area average of k x k blocks; repeated, the levels of a pyramid."""
    return px.groupBy(key, F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")).agg(F.avg("v").alias("mean"))


def dft_power(df: DataFrame, key: str, values: str, n: int, frequencies: tuple[int, ...]) -> DataFrame:
    """Power at a few frequencies, inside each row's array: nothing is exploded but the frequencies."""
    d = df.select(key, F.col(values).alias("v"), F.explode(F.array(*[F.lit(k) for k in frequencies])).alias("k"))
    part = lambda f: F.aggregate(F.transform("v", lambda v, i: v.cast("double") * f(F.lit(2.0) * F.pi() * F.col("k") * i / n)), F.lit(0.0), lambda s, x: s + x)
    return d.select(key, "k", (F.pow(part(F.cos), 2) + F.pow(part(F.sin), 2)).alias("power"))


def phasor(px: DataFrame, key: str, at: str, value: str, spacing: float) -> DataFrame:
    """Amplitude and phase (in turns) of a profile at one spacing."""
    a = F.lit(2.0) * F.pi() * F.col(at) / spacing
    c = px.groupBy(key).agg(F.avg(F.col(value) * F.cos(a)).alias("re"), F.avg(F.col(value) * F.sin(a)).alias("im"))
    return c.select(key, (2 * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("amplitude"), (F.atan2("im", "re") / (2 * F.pi())).alias("turns"))


def bilinear(values: Column, width: int, row: Column, col: Column) -> Column:
    """Value of a row-major array at a fractional position; null outside."""
    r, c = F.floor(row), F.floor(col)
    at = lambda i, j: F.get(values, (i * width + j).cast("int")).cast("double")
    fr, fc = row - r, col - c
    return (1 - fr) * (1 - fc) * at(r, c) + (1 - fr) * fc * at(r, c + 1) + fr * (1 - fc) * at(r + 1, c) + fr * fc * at(r + 1, c + 1)


def box_union_area(boxes: DataFrame, key: str, cx: float, cy: float) -> DataFrame:
    """Area of the union of each key's boxes (x0, y0, x1, y1): clipped to cells, cut into slabs at every x, intervals united in each slab."""
    b = boxes.select(key, "x0", "y0", "x1", "y1", F.explode(cells("x0", "y0", "x1", "y1", cx, cy)).alias("cell"))
    b = b.select(
        key,
        "cell",
        F.greatest("x0", F.col("cell.i") * cx).alias("x0"),
        F.greatest("y0", F.col("cell.j") * cy).alias("y0"),
        F.least("x1", (F.col("cell.i") + 1) * cx).alias("x1"),
        F.least("y1", (F.col("cell.j") + 1) * cy).alias("y1"),
    ).where("x1 > x0 AND y1 > y0").distinct()
    xs = b.select(key, "cell", F.explode(F.array("x0", "x1")).alias("x")).distinct()
    xs = xs.withColumn("nx", F.lead("x").over(W.partitionBy(key, "cell").orderBy("x"))).where("nx IS NOT NULL")
    s = meeting(xs, b, [key, "cell"]).where("x0 <= x AND x1 >= nx").select(key, "cell", "x", "nx", "y0", "y1").distinct()
    w = W.partitionBy(key, "cell", "x").orderBy("y0", "y1").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("reach", F.max("y1").over(w))
    return s.groupBy(key).agg(F.sum((F.col("nx") - F.col("x")) * F.greatest(F.lit(0.0), F.col("y1") - F.greatest("y0", F.coalesce("reach", "y0")))).alias("area"))
