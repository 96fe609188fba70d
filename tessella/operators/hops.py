"""Hops over rows: steps between walkable cells on either side of a row, where nothing grown stands in the way.

A gap is looked for every ``step`` metres along a row. A hop must cross exactly as many rows as it says, its corridor
no mature canopy and no forbidden place; small canopies make it one of the second tier. Hops whose gaps line up over
rows side by side chain into one straight crossing, which must have a corridor without any canopy.

Rows, canopies and places are dealt to cells, so a hop meets those near it only; hops are as long as the rows are
apart. Between the same two cells only the cheapest hop stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .joins import meeting


@dataclass(frozen=True)
class HopParams:
    grid: float = 0.5
    step: float = 0.5
    reach: float = 0.9
    width: float = 0.8
    align: float = 0.3
    penalty: float = 50.0
    #: None: no hop over small canopies.
    young_penalty: float | None = None
    young_m2: float = 0.25
    rows_max: int = 1
    #: How far apart two gaps of one crossing may have their common cell, and the least way between their rows.
    near: float = 1.6
    apart: float = 1.0
    #: Cosine up to which two directions count as the same.
    parallel: float = 0.995
    outside_weight: float = 60.0
    cell: float = 4.0


def line_cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Array of the cells that a line passes, and perhaps some beside it."""
    slope = (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0))
    lo, hi = F.least(x0, x1), F.greatest(x0, x1)

    def column(i: Column) -> Column:
        a, b = (y0 + (F.greatest(F.least(x, hi), lo) - x0) * slope for x in (i * size, (i + 1) * size))
        low, high = F.when(slope.isNull(), F.least(y0, y1)).otherwise(F.least(a, b)), F.when(slope.isNull(), F.greatest(y0, y1)).otherwise(F.greatest(a, b))
        return F.transform(F.sequence(F.floor((low - 1e-6) / size), F.floor((high + 1e-6) / size)), lambda j: F.struct(i.alias("i"), j.alias("j")))

    return F.flatten(F.transform(F.sequence(F.floor(lo / size), F.floor(hi / size)), column))


def _box_cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    side = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(side(x0, x1), lambda i: F.transform(side(y0, y1), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def segments_meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two segments (x0, y0, x1, y1) share a point."""
    turn = lambda s, x, y: F.signum((s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0]))
    over = lambda k: (F.least(a[k], a[k + 2]) <= F.greatest(b[k], b[k + 2])) & (F.least(b[k], b[k + 2]) <= F.greatest(a[k], a[k + 2]))
    return over(0) & over(1) & (turn(a, b[0], b[1]) * turn(a, b[2], b[3]) <= 0) & (turn(b, a[0], a[1]) * turn(b, a[2], a[3]) <= 0)


def corridor_meets(s: list[Column], box: list[Column], width: float) -> Column:
    """Whether the corridor of a segment with flat ends and a box share a point: no side of either parts them."""
    length = F.sqrt(F.pow(s[2] - s[0], 2) + F.pow(s[3] - s[1], 2))
    dx, dy = (s[2] - s[0]) / length, (s[3] - s[1]) / length
    cx, cy = (box[0] + box[2]) / 2 - (s[0] + s[2]) / 2, (box[1] + box[3]) / 2 - (s[1] + s[3]) / 2
    ex, ey, half, h = (box[2] - box[0]) / 2, (box[3] - box[1]) / 2, length / 2, width / 2
    adx, ady = F.abs(dx), F.abs(dy)
    upright = (F.abs(cx) <= ex + half * adx + h * ady) & (F.abs(cy) <= ey + half * ady + h * adx)
    return upright & (F.abs(cx * dx + cy * dy) <= half + ex * adx + ey * ady) & (F.abs(cx * dy - cy * dx) <= h + ex * ady + ey * adx)


def gaps(rows: DataFrame, nodes: DataFrame, p: HopParams) -> DataFrame:
    """Places along rows (row_id, x0, y0, x1, y1) with two different walkable cells at ``reach`` on either side: a, b, px, py, tx, ty (along the row)."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    n = F.floor(F.col("m") / p.step)
    r = rows.withColumn("m", length).where(F.col("m") > p.step).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    t = (F.col("k") + 0.5) / F.col("n")
    r = r.select(*[(F.col(f"{c}0") + t * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(f"p{c}") for c in "xy"], *[((F.col(f"{c}1") - F.col(f"{c}0")) / F.col("m")).alias(f"t{c}") for c in "xy"])
    for name, side in (("a", p.reach), ("b", -p.reach)):
        at = nodes.select(F.col("node").alias(name), F.col("i").alias("_i"), F.col("j").alias("_j"))
        r = r.withColumns({"_i": F.floor((F.col("px") - side * F.col("ty")) / p.grid), "_j": F.floor((F.col("py") + side * F.col("tx")) / p.grid)})
        r = meeting(r, at, ["_i", "_j"]).drop("_i", "_j")
    return r.where("a != b")


def clear(hops: DataFrame, rows: DataFrame, canopies: DataFrame, forbidden: DataFrame, nodes: DataFrame, crossings: int, p: HopParams) -> DataFrame:
    """Pairs (a, b) that cross exactly so many rows through a free corridor: a, b, tier, metres."""
    at = lambda s: nodes.select(F.col("node").alias(s), *[((F.col(c) + 0.5) * p.grid).alias(f"{s}{x}") for c, x in (("i", "x"), ("j", "y"))], F.col("outside").alias(f"{s}_out"))
    h = meeting(meeting(hops.select("a", "b").distinct(), at("a"), ["a"]), at("b"), ["b"])
    s, wide = [F.col(c) for c in ("ax", "ay", "bx", "by")], p.width
    dealt = h.withColumn("cell", F.explode(_box_cells(F.least("ax", "bx") - wide, F.least("ay", "by") - wide, F.greatest("ax", "bx") + wide, F.greatest("ay", "by") + wide, p.cell)))
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    line = rows.select("row_id", *ends, F.explode(line_cells(*ends, p.cell)).alias("cell"))
    crossed = meeting(dealt, line, ["cell"]).where(segments_meet(s, ends)).groupBy("a", "b").agg(F.count_distinct("row_id").alias("crossed"))
    h = h.join(crossed.where(F.col("crossed") == crossings).select("a", "b").hint("merge"), ["a", "b"])
    dealt = dealt.join(crossed.where(F.col("crossed") == crossings).select("a", "b").hint("merge"), ["a", "b"], "left_semi")
    small = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < p.young_m2
    boxes = canopies.select(*ends, F.when(small, 1).otherwise(2).alias("kind")).unionByName(forbidden.select(*ends, F.lit(3).alias("kind")))
    boxes = boxes.withColumn("cell", F.explode(_box_cells(*ends, p.cell)))
    hit = meeting(dealt, boxes, ["cell"]).where(corridor_meets(s, ends, wide)).groupBy("a", "b").agg(F.max("kind").alias("hit"))
    tier = F.when(F.col("hit").isNull(), 1).when(F.col("hit") == 1, 2)
    share = (F.col("a_out") + F.col("b_out")) / 2
    metres = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)) * ((1 - share) + share * p.outside_weight)
    out = h.join(hit.hint("merge"), ["a", "b"], "left").withColumn("tier", tier)
    most = 2 if p.young_penalty is not None and crossings == 1 else 1
    return out.where(F.col("tier") <= most).select("a", "b", "tier", metres.alias("metres"))


def hop_edges(rows: DataFrame, canopies: DataFrame, forbidden: DataFrame, nodes: DataFrame, p: HopParams = HopParams()) -> DataFrame:
    """low, high, cost, tier, crossed: the cheapest hop between two cells. Rows: row_id, x0, y0, x1, y1; canopies and
    forbidden: boxes; nodes: node, i, j (walkable cells of ``grid`` metres), outside (share of a cell off limits)."""
    scratch = Scratch(rows.sparkSession, "hops")
    g = scratch.write(gaps(rows, nodes, p), "gaps")
    free = scratch.write(clear(g, rows, canopies, forbidden, nodes, 1, p), "clear")
    price = F.col("metres") + F.when(F.col("tier") == 1, p.penalty).otherwise(p.young_penalty or 0.0)
    found = [free.select("a", "b", price.alias("cost"), "tier", F.lit(1).alias("crossed"))]
    if p.rows_max > 1:
        g = g.join(free.select("a", "b").hint("merge"), ["a", "b"])
        way = lambda sign: g.select(F.col("a" if sign < 0 else "b").alias("start"), F.col("b" if sign < 0 else "a").alias("end"), "px", "py", "tx", "ty", (sign * -F.col("ty")).alias("dx"), (sign * F.col("tx")).alias("dy"))
        xy = lambda s: nodes.select(F.col("node").alias(s), *[((F.col(c) + 0.5) * p.grid).alias(f"{s}_{x}") for c, x in (("i", "x"), ("j", "y"))])
        cell = lambda c: F.floor(F.col(c) / p.near)
        pieces = way(-1).unionByName(way(1))
        second = scratch.write(meeting(pieces, xy("start"), ["start"]).select(F.col("start").alias("near"), F.col("end").alias("far"), *[F.col(c).alias(f"q{c}") for c in ("px", "py", "tx", "ty", "dx", "dy")], "start_x", "start_y", F.struct(cell("start_x").alias("i"), cell("start_y").alias("j")).alias("cell")), "pieces")
        level = pieces
        for crossings in range(2, p.rows_max + 1):
            ends = meeting(level, xy("end"), ["end"])
            around = F.explode(F.array(*[F.struct((cell("end_x") + i).alias("i"), (cell("end_y") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("cell")
            j = meeting(ends.select("*", around), second, ["cell"])
            ox, oy = F.col("qpx") - F.col("px"), F.col("qpy") - F.col("py")
            close = F.sqrt(F.pow(F.col("end_x") - F.col("start_x"), 2) + F.pow(F.col("end_y") - F.col("start_y"), 2)) <= p.near
            lined = (F.abs(ox * F.col("tx") + oy * F.col("ty")) <= p.align) & (ox * F.col("dx") + oy * F.col("dy") > p.apart) & (F.col("qdx") * F.col("dx") + F.col("qdy") * F.col("dy") > p.parallel)
            chained = j.where(close & lined).select("start", F.col("far").alias("end"), *[F.col(f"q{c}").alias(c) for c in ("px", "py", "tx", "ty", "dx", "dy")])
            chained = scratch.write(chained.where("start != end").distinct(), "chained")
            free = scratch.write(clear(chained.select(F.col("start").alias("a"), F.col("end").alias("b")), rows, canopies, forbidden, nodes, crossings, p), "clear")
            found.append(free.select("a", "b", (F.col("metres") + crossings * p.penalty).alias("cost"), "tier", F.lit(crossings).alias("crossed")))
            level = chained.join(free.select(F.col("a").alias("start"), F.col("b").alias("end")).hint("merge"), ["start", "end"])
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    best = out.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min(F.struct("cost", "crossed", "tier")).alias("m"))
    return scratch.settle(best.select("low", "high", "m.cost", "m.tier", "m.crossed"))
