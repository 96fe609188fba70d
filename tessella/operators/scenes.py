"""Scene-level operators: verdict tables, label precedence, samples along lines, route choice, parcels, tile addresses."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..scratch import Scratch
from .joins import meeting


def upsert(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key: what a log of replacements amounts to."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def by_precedence(sources: list[DataFrame], reach: float) -> DataFrame:
    """Union of labelled points (id, x, y, verdict), earlier sources first: a later point within ``reach`` of an earlier source's is dropped."""
    out = sources[0].select("id", "x", "y", "verdict").withColumn("rank", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        kept = out.select(F.lit(0).alias("node"), "x", "y", F.lit(0).alias("part"))
        hit = _candidates(s.select("id", "x", "y"), kept, reach, 1).select("id").distinct()
        out = out.unionByName(s.select("id", "x", "y", "verdict").join(hit, "id", "left_anti").withColumn("rank", F.lit(k)))
    return out


def along(segments: DataFrame, step: float) -> DataFrame:
    """Points every ``step`` along segments (id, x0, y0, x1, y1): id, i, x, y and the unit tangent."""
    n = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    d = segments.withColumn("n", n).where("n > 0").withColumn("tx", (F.col("x1") - F.col("x0")) / F.col("n")).withColumn("ty", (F.col("y1") - F.col("y0")) / F.col("n"))
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / step).cast("int"))))
    return d.select("id", "i", (F.col("x0") + F.col("tx") * F.col("i") * step).alias("x"), (F.col("y0") + F.col("ty") * F.col("i") * step).alias("y"), "tx", "ty")


def sampled(points: DataFrame, pixels: DataFrame, px: float, offsets: tuple[float, ...]) -> DataFrame:
    """OR over offsets across the tangent of a raster flag: points (id, i, x, y, tx, ty), pixels (row, col, flag, valid) in a grid from (0, 0)."""
    p = points.withColumn("o", F.explode(F.array(*[F.lit(o) for o in offsets])))
    p = p.select("id", "i", F.floor((F.col("x") - F.col("ty") * F.col("o")) / px).alias("col"), F.floor((F.col("y") + F.col("tx") * F.col("o")) / px).alias("row"))
    j = p.join(pixels, ["row", "col"], "left")
    return j.groupBy("id", "i").agg(F.coalesce(F.bool_or("flag"), F.lit(False)).alias("flag"), F.coalesce(F.bool_or("valid"), F.lit(False)).alias("seen"))


def split_stretches(stretches: DataFrame, least: float, spacing: float) -> DataFrame:
    """Stretches (id, start, end) of at least ``least`` cut in round(length / spacing) equal parts: id, k, centre."""
    size = F.col("end") - F.col("start")
    n = F.greatest(F.lit(1), F.round(size / spacing, 0)).cast("int")
    d = stretches.where(size >= least).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return d.select("id", "k", (F.col("start") + (F.col("k") - 0.5) * (F.col("end") - F.col("start")) / F.col("n")).alias("centre"))


def best_route(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Per scope: the legal route that fits the budget, visits most and is shortest."""
    return routes.where("legal").groupBy(*keys).agg(F.max_by("id", F.struct("fits", "visited", -F.col("length_m"), -F.col("id"))).alias("id"))


def angle_patterns(rows: DataFrame, degrees: float = 5.0, least_step: float = 0.5) -> DataFrame:
    """Rows (field, row_id, angle, length, v) grouped by angle, greedily from the longest: field, row_id, pattern; and the pattern's median step.

    One field's rows are bounded, so each field is one group.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_id"], ascending=[False, True]).reset_index(drop=True)
        pattern, heads = np.zeros(len(pdf), int), []
        for n, a in enumerate(pdf["angle"]):
            k = next((k for k, h in enumerate(heads) if abs((a - h + 90) % 180 - 90) <= degrees), len(heads))
            if k == len(heads):
                heads.append(a)
            pattern[n] = k
        pdf["pattern"] = pattern
        step = {}
        for k, g in pdf.groupby("pattern"):
            d = np.diff(np.sort(g["v"].to_numpy()))
            step[k] = float(np.median(d[d > least_step])) if (d > least_step).any() else math.nan
        pdf["step_m"] = pdf["pattern"].map(step)
        return pdf[["field", "row_id", "pattern", "step_m"]]

    return rows.select("field", "row_id", "angle", "length", "v").groupBy("field").applyInPandas(group, "field string, row_id string, pattern int, step_m double")


def header(features: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: totals of the scored features, the official route's length, targets, and the routes by cutoff."""
    from .rollup import scored

    s = scored(features).agg(F.count_distinct(F.nullif("vineyard_id", F.lit(""))).alias("blocks"), F.count_distinct(F.when(F.col("label") == "row", F.col("row_id"))).alias("rows"), F.sum(F.when(F.col("label") == "row", F.col("length_m"))).alias("row_m"), F.count_if(F.col("label").isin("inspection", "waste")).alias("targets"))
    r = routes.agg(F.max(F.when(F.col("scope") == "site", F.col("length_m"))).alias("route_m"), F.sort_array(F.collect_list(F.struct("min_confidence", "scope", "length_m"))).alias("routes"))
    return s.crossJoin(r)  # one row each


def blocks(patterns: DataFrame) -> DataFrame:
    """Patterns (block_id, pattern_id, area_m2, row_count) as one record a block: rows added, the main pattern (largest area, then larger id), patterns by area. A block's own patterns give the same record again."""
    by_area = F.sort_array(F.collect_list(F.struct((-F.col("area_m2")).alias("less"), "pattern_id", "area_m2", "row_count")))
    out = patterns.groupBy("block_id").agg(F.sum("row_count").alias("row_count"), F.max_by("pattern_id", F.struct("area_m2", "pattern_id")).alias("main_pattern"), by_area.alias("p"))
    return out.withColumn("patterns", F.transform("p", lambda x: x.dropFields("less"))).drop("p")


def row_records(pieces: DataFrame, keys: list[str], least: float = 0.05) -> DataFrame:
    """Pieces (keys, piece, start, end) as one record a row: axis (the longest piece), extent, and its pieces longer than ``least`` in order."""
    size = F.col("end") - F.col("start")
    kept = F.sort_array(F.collect_list(F.when(size > least, F.struct("start", "end", "piece"))))
    return pieces.groupBy(*keys).agg(F.max_by("piece", F.struct(size.alias("size"), "piece")).alias("axis"), F.min("start").alias("lo"), F.max("end").alias("hi"), kept.alias("pieces"))


def svg_parcels(svg: DataFrame, least_area: float = 1.0) -> DataFrame:
    """Unfilled paths of SVG text (one column, svg) as rings in pixels: id, points, area."""
    paths = F.regexp_extract_all("svg", F.lit(r'(<path[^>]*>)'), F.lit(1))
    p = svg.select(F.posexplode(paths).alias("id", "tag")).where(F.col("tag").contains('fill="none"'))
    d = F.regexp_extract("tag", r'\sd="([^"]*)"', 1)
    numbers = F.transform(F.regexp_extract_all(d, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda v: v.cast("double"))
    p = p.withColumn("v", numbers).withColumn("points", F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1), lambda i: F.struct(F.get("v", 2 * i).alias("x"), F.get("v", 2 * i + 1).alias("y"))))
    from ..functions.columns import shoelace

    return p.withColumn("area", shoelace(F.col("points"))).where(F.col("area") > least_area).select("id", "points", "area")


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """Web Mercator bounds of an XYZ tile."""
    world = 2 * math.pi * G.SEMI_MAJOR
    size = world / 2**z
    left, top = -world / 2 + x * size, world / 2 - y * size
    return left, top - size, left + size, top


def tile_ok(z: Column, x: Column, y: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return z.between(0, 24) & (x >= 0) & (y >= 0) & (x < n) & (y < n)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = F.lit(G.SEMI_MAJOR)
    return r * F.radians(lon), r * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))


def snapped(points: DataFrame, nodes: DataFrame, reach: float = 25.0) -> DataFrame:
    """Nearest passable node of each point no farther than ``reach`` (ties: the smaller node): id, node, distance; null where there is none."""
    near = _candidates(points, nodes.select("node", "x", "y", F.lit(0).alias("part")), reach, 1)
    best = near.groupBy("id").agg(F.min(F.struct("d", "node")).alias("m"))
    return points.select("id").join(best, "id", "left").select("id", F.col("m.node").alias("node"), F.col("m.d").alias("distance"))


def candidates(points: DataFrame, nodes: DataFrame, reach: float, k: int) -> DataFrame:
    """Up to ``k`` nodes of each point within ``reach``, the nearest of each local component: id, node, rank. ``nodes``: node, x, y, part."""
    return _candidates(points, nodes, reach, k).select("id", "node", "rank")


def _candidates(points: DataFrame, nodes: DataFrame, reach: float, k: int) -> DataFrame:
    """``candidates``, with their distance d.

    Places are met once. The search starts with the radius in which a crowd has some nodes and widens by three: a
    place that has k components within a radius has its nearest, and only the others look on.
    """
    scratch = Scratch(points.sparkSession, "candidates")
    n = nodes.groupBy("part", F.col("x").alias("nx"), F.col("y").alias("ny")).agg(F.min("node").alias("node"))
    n = scratch.write(n, "nodes")
    left = scratch.write(points.select("x", "y").distinct(), "places")
    # how many others a node has in its cell, on average over the nodes: crowds count by their nodes, not by their cells
    small = reach / 16
    own = n.groupBy(F.floor(F.col("nx") / small), F.floor(F.col("ny") / small)).agg(F.count("*").alias("n"))
    crowd = own.agg((F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n")).alias("n")).first()["n"] or 0.0
    radii, r = [], small * math.sqrt(2 * k / (math.pi * max(crowd, 1e-6)))
    while r < reach / 2:
        radii.append(r)
        r *= 3
    found = None
    for r in [*radii, reach]:
        cell = lambda c, r=r: F.floor(F.col(c) / r)
        around = F.explode(F.array(*[F.struct((cell("x") + i).alias("i"), (cell("y") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("cell")
        d = F.sqrt(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2))
        near = meeting(left.select("x", "y", around), n.withColumn("cell", F.struct(cell("nx").alias("i"), cell("ny").alias("j"))), ["cell"])
        per = near.where(d <= r).groupBy("x", "y", "part").agg(F.min(F.struct(d.alias("d"), "node")).alias("m"))
        w = W.partitionBy("x", "y")
        per = per.withColumn("rank", F.row_number().over(w.orderBy("m")).cast("long")).withColumn("parts", F.count("*").over(w))
        per = scratch.write(per.where((F.col("rank") <= k) & ((F.col("parts") >= k) | F.lit(r == reach))).select("x", "y", F.col("m.node").alias("node"), F.col("m.d").alias("d"), "rank"), "found")
        found = per if found is None else found.unionByName(per)
        if r < reach:
            left = scratch.write(left.join(per.where("rank = 1"), ["x", "y"], "left_anti"), "left")
    return scratch.settle(points.select("id", "x", "y").join(found, ["x", "y"]).select("id", "node", "d", "rank"))


def answered(requests: DataFrame, known: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Status requests (id, status, ...) with ``code``: 404 for a point that isn't known, 422 for a status that isn't one, 200."""
    j = requests.join(known.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    return j.withColumn("code", F.when(F.col("_known").isNull(), 404).when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), 422).otherwise(200)).drop("_known")
