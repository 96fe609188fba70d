"""Rows moved onto what stands on them: shared slopes, offsets by row, support, and moves taken back where neighbours get too near or far.

Positions are whole units of 0.1 mm and weights whole thousandths, so sums are exact and no result hangs on the order
in which tasks add up; what is divided is rounded (slopes to 12 digits, offsets to a thousandth of a unit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch

UNIT, WEIGHT = 10_000, 1000


def units(c: Column, unit: int = UNIT) -> Column:
    return F.round(c * F.lit(float(unit))).cast("long")


def _whole(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,0)")).cast("double")


def moments(near: DataFrame, keys: list[str]) -> DataFrame:
    """Per row of vines: n, and weighted sums of u and v (whole units from the row's cu and cv): mean positions, and second sums about them as whole numbers."""
    du, dv = F.col("u") - F.col("cu"), F.col("v") - F.col("cv")
    wide = lambda a, b: F.col("w").cast("decimal(18,0)") * (a * b).cast("decimal(19,0)")
    s = near.groupBy(*keys, "cu", "cv").agg(F.count("*").alias("n"), F.sum("w").cast("double").alias("sw"), _whole(F.col("w") * du).alias("su"), _whole(F.col("w") * dv).alias("sv"), _whole(wide(du, du)).alias("suu"), _whole(wide(du, dv)).alias("suv"))
    mean = lambda c: F.col(f"s{c}") / F.col("sw")
    second = lambda a, b: F.round(F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("sw")).cast("decimal(38,0)")
    return s.select(*keys, "n", (F.col("cu") + mean("u")).alias("mu"), (F.col("cv") + mean("v")).alias("mv"), second("u", "u").alias("suu"), second("u", "v").alias("suv"))


def pattern_slopes(rows: DataFrame) -> DataFrame:
    """(p, new): one slope for all rows of a pattern, from the rows' second sums."""
    s = rows.groupBy("p").agg(F.sum("suu").cast("double").alias("suu"), F.sum("suv").cast("double").alias("suv"))
    return s.select("p", F.when(F.col("suu") > 0, F.round(F.col("suv") / F.col("suu"), 12)).otherwise(0.0).alias("new"))


def shared_fit(df: DataFrame, pattern: str, row: str, u: str, v: str, w: str, limits: tuple[float, ...] = (0.8, 0.3, 0.15, 0.15)) -> DataFrame:
    """(pattern, row, slope, offset, n): one slope for all rows of a pattern and an offset for each row, by weighted least squares.

    Each round leaves out what lies farther from the round before than its limit (the first from the row's plain
    mean); a round is two grouped sums, of rows and of patterns. Rows of which nothing is left keep their last offset.
    Points without a place or a weight above zero don't count.
    """
    d = df.select(F.col(pattern).alias("p"), F.col(row).alias("r"), units(F.col(u)).alias("u"), units(F.col(v)).alias("v"), units(F.col(w), WEIGHT).alias("w")).where("u IS NOT NULL AND v IS NOT NULL AND w > 0")
    scratch = Scratch(df.sparkSession, "fit")
    mean = lambda c: F.round(_whole(F.col("w") * F.col(c)) / F.sum("w").cast("double"), 3)
    fit = d.groupBy("p", "r").agg(F.lit(0.0).alias("slope"), mean("v").alias("offset"), F.round(mean("u")).cast("long").alias("cu"), F.round(mean("v")).cast("long").alias("cv"))
    fit = scratch.write(fit, "start")
    for limit in limits:
        fit = fit.drop("n")
        near = d.join(fit, ["p", "r"]).where(F.abs(F.col("v").cast("double") - F.col("offset") - F.col("slope") * F.col("u").cast("double")) <= limit * UNIT)
        rows = moments(near, ["p", "r"])
        fit = fit.join(rows.select("p", "r", "n", "mu", "mv"), ["p", "r"], "left").join(pattern_slopes(rows), "p", "left")
        offset = F.when(F.col("n").isNotNull(), F.round(F.col("mv") - F.col("new") * F.col("mu"), 3)).otherwise(F.col("offset"))
        # a row for each row of vines; at rest, since a round reads the one before several times
        fit = scratch.write(fit.select("p", "r", F.coalesce("new", "slope").alias("slope"), offset.alias("offset"), "cu", "cv", F.coalesce("n", F.lit(0)).alias("n")), "round")
    return scratch.settle(fit.select(F.col("p").alias(pattern), F.col("r").alias(row), "slope", (F.col("offset") / float(UNIT)).alias("offset"), "n"))


def assigned(rows: DataFrame, points: DataFrame, reach: float, bin_m: float) -> DataFrame:
    """Points (p, u, v, w in whole units) with their nearest row (smaller r on a tie) of the pattern within reach across and a bin beyond its ends."""
    far = units(F.lit(reach))
    cell = lambda c: F.floor(F.col(c) / far)
    r = rows.select("p", "r", "v_row", "start", "end", F.explode(F.array(cell("v_row") - 1, cell("v_row"), cell("v_row") + 1)).alias("cell"))
    pts = points.withColumn("id", F.monotonically_increasing_id()).withColumn("cell", cell("v"))
    near = pts.join(r, ["p", "cell"]).where((F.abs(F.col("v") - F.col("v_row")) <= far) & F.col("u").between(F.col("start") - units(F.lit(bin_m)), F.col("end") + units(F.lit(bin_m))))
    best = near.groupBy("id").agg(F.min(F.struct(F.abs(F.col("v") - F.col("v_row")).alias("d"), "r", (F.col("v") - F.col("v_row")).alias("v"), "p", "u", "w")).alias("m"))
    return best.select("m.p", "m.r", "m.u", "m.v", "m.w")


def refit(rows: DataFrame, points: DataFrame, reach: float = 0.8, bin_m: float = 0.5, min_cover: float = 3.0, min_share: float = 0.2, limits: tuple[float, ...] = (0.8, 0.3, 0.15, 0.15), gap_share: float = 0.4) -> DataFrame:
    """Lattice rows (p, r, v_row, start, end: metres) moved onto points (p, u, v, w): p, r, cover, supported, moved, reverted, slope, shift_start, shift_end (metres).

    A pattern gets one turn, each supported row an offset of its own. A row whose bins with points cover less than
    ``min_cover`` metres or ``min_share`` of its length is not supported and keeps its place, turned with the pattern.
    A move that leaves less than 1 - ``gap_share`` or more than 1 + ``gap_share`` of the lattice distance to a
    neighbour that runs beside it is taken back, of two the larger one (on a tie the first); see ``taken_back``.
    """
    scratch = Scratch(rows.sparkSession, "refit")
    r = scratch.write(rows.select("p", "r", *[units(F.col(c)).alias(c) for c in ("v_row", "start", "end")]), "rows")
    d = points.select("p", units(F.col("u")).alias("u"), units(F.col("v")).alias("v"), units(F.col("w"), WEIGHT).alias("w")).where("u IS NOT NULL AND v IS NOT NULL AND w > 0")
    d = scratch.write(assigned(r, scratch.write(d, "points"), reach, bin_m), "assigned")
    size = units(F.lit(bin_m))
    cover = d.groupBy("p", "r").agg((F.count_distinct(F.floor(F.col("u") / size)) * size).alias("cover"))
    least = F.greatest(units(F.lit(min_cover)).cast("double"), min_share * (F.col("end") - F.col("start")).cast("double"))
    # the middle of a row, rounded down: centre is where its offset is measured, and cu where sums are
    centre = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    fit = r.join(cover, ["p", "r"], "left").fillna(0, ["cover"]).withColumn("supported", F.col("cover") >= least)
    fit = fit.select("p", "r", "v_row", "start", "end", "cover", "supported", centre.alias("cu"), F.lit(0).cast("long").alias("cv"), centre.cast("double").alias("centre"), F.lit(0.0).alias("slope"), F.lit(0.0).alias("offset"), F.lit(0).cast("long").alias("n"))
    fit = scratch.write(fit, "start")
    for limit in limits:
        off = F.abs(F.col("v").cast("double") - F.col("offset") - F.col("slope") * (F.col("u").cast("double") - F.col("centre")))
        near = d.join(fit.where("supported").select("p", "r", "cu", "cv", "centre", "slope", "offset"), ["p", "r"]).where(off <= limit * UNIT)
        sums = moments(near, ["p", "r"])
        new = fit.drop("n").join(sums.select("p", "r", "n", "mu", "mv"), ["p", "r"], "left").join(pattern_slopes(sums), "p", "left")
        ok = F.col("n").isNotNull()
        fit = scratch.write(new.select("p", "r", "v_row", "start", "end", "cover", "supported", "cu", "cv", F.when(ok, F.round("mu", 3)).otherwise(F.col("centre")).alias("centre"), F.coalesce("new", F.lit(0.0)).alias("slope"), F.when(ok, F.round("mv", 3)).otherwise(0.0).alias("offset"), F.coalesce("n", F.lit(0)).alias("n")), "round")
    kept = taken_back(fit.withColumn("moved", F.col("supported") & (F.col("n") > 0)), gap_share, scratch)
    shift = lambda at: (F.when(F.col("moved"), F.col("offset")).otherwise(0.0) + F.col("slope") * (F.col(at).cast("double") - F.col("centre"))) / float(UNIT)
    out = kept.select("p", "r", (F.col("cover") / float(UNIT)).alias("cover"), "supported", "moved", "reverted", "slope", shift("start").alias("shift_start"), shift("end").alias("shift_end"))
    return scratch.settle(out)


def taken_back(fit: DataFrame, gap_share: float, scratch: Scratch) -> DataFrame:
    """fit (p, r, v_row, start, end, centre, slope, offset, moved) with moves taken back until no two neighbours of a pattern are too near or far; and reverted.

    One at a time the largest move goes first. Of a pair the larger move is at fault, and only larger or equal moves
    go before it, so it stays at fault until it goes: all that are at fault may go in one round, with the same end.
    A row's neighbours don't change, so they are found once; a round is two joins on rows, and as many rounds follow
    as moves hang on each other.
    """
    order = W.partitionBy("p").orderBy("v_row", "r")
    links = scratch.write(fit.withColumn("next", F.lead("r").over(order)).where("next IS NOT NULL").select("p", "r", "next"), "links")
    still = scratch.write(fit.select("p", "r", "moved"), "moved")
    base = fit.select("p", "r", "v_row", "start", "end", "centre", "slope", "offset")
    while True:
        now = base.join(still, ["p", "r"])
        side = lambda s, now=now: now.select("p", *[F.col(c).alias(f"{s}_{c}") for c in ("r", "v_row", "start", "end", "centre", "slope", "offset", "moved")])
        pairs = links.withColumnsRenamed({"r": "a_r", "next": "b_r"}).join(side("a"), ["p", "a_r"]).join(side("b"), ["p", "b_r"])
        lattice = (F.col("b_v_row") - F.col("a_v_row")).cast("double")
        shift = lambda s, at: F.when(F.col(f"{s}_moved"), F.col(f"{s}_offset")).otherwise(0.0) + F.col(f"{s}_slope") * (at.cast("double") - F.col(f"{s}_centre"))
        ends = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
        gaps = [lattice + shift("b", at) - shift("a", at) for at in ends]
        wrong = (ends[1] > ends[0]) & (lattice > 0) & ((F.least(*gaps) < (1 - gap_share) * lattice) | (F.greatest(*gaps) > (1 + gap_share) * lattice))
        size = lambda s: F.when(F.col(f"{s}_moved"), F.abs(F.col(f"{s}_offset"))).otherwise(-1.0)
        fault = pairs.where(wrong & (F.col("a_moved") | F.col("b_moved"))).select("p", F.when(size("a") >= size("b"), F.col("a_r")).otherwise(F.col("b_r")).alias("r")).distinct()
        fault = scratch.write(fault, "fault")
        if fault.isEmpty():
            break
        still = scratch.write(still.join(fault.withColumn("at_fault", F.lit(True)), ["p", "r"], "left").select("p", "r", (F.col("moved") & F.col("at_fault").isNull()).alias("moved")), "moved")
    return fit.withColumnRenamed("moved", "first").join(still, ["p", "r"]).withColumn("reverted", F.col("first") & ~F.col("moved")).drop("first")
