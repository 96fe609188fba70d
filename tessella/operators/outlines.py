"""Repair of crossing rings and outlines of unions, on a whole-number grid.

Edges are directed pieces (k, x0, y0, x1, y1) between grid points; k is a ring for repair, a group for unions.

* ``noded`` splits edges where they cross, touch or run over each other's ends. Edges meet in the cells they pass, and
  a crossing is moved to the nearest grid point, which may make new ones, so it repeats until nothing is cut.
* ``boundary`` cancels what runs both ways and finds on which side of every edge left over the area lies. What covers
  a point is the sum over the edges left of it; the part up to the corner of the point's cell is a running sum over
  the edges that pass the corner's line, and only edges of the point's own cell are looked at one by one. All tests are
  signs of whole numbers, lines between cells lie half a unit off the grid, and rays run just above points.
* ``rings`` turns at every point into the next edge clockwise, which bounds the same stretch of area; pointers are
  doubled until each ring has one name, and once more for the places along it. A ring passes no point twice.

Coordinates stay below 2**28 and edges after noding below 2**26, so that products fit 64 bits and directions are
told apart. A crowded cell costs the product of its edges, as a join on the cell that any number of tasks can share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import noding
from ..scratch import Scratch
from .joins import dealt, meeting

ENDS = ("x0", "y0", "x1", "y1")
MAX_ROUNDS = 64
#: Edges of small groups taken at a time.
SOME = 2048


def ring_edges(points: DataFrame, key: str, grid: float) -> DataFrame:
    """Edges of closed rings. ``points``: key, at, x, y in the order of ``at``; points that fall together and rings of one point have none."""
    p = points.select(F.col(key).alias("k"), "at", *[F.round(F.col(c) / grid).cast("long").alias(c) for c in ("x", "y")])
    w, all_ = W.partitionBy("k").orderBy("at"), W.partitionBy("k").orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(all_))
    return p.select("k", F.col("x").alias("x0"), F.col("y").alias("y0"), nxt("x").alias("x1"), nxt("y").alias("y1")).where("x0 != x1 OR y0 != y1")


def box_edges(boxes: DataFrame, key: str) -> DataFrame:
    """Edges of boxes (key, x0, y0, x1, y1 on the grid), the area on their left."""
    a, b, c, d = (F.struct(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))
    e = F.explode(F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in ((a, b), (b, c), (c, d), (d, a))])).alias("e")
    return boxes.where("x0 < x1 AND y0 < y1").select(F.col(key).alias("k"), e).select("k", F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"))


def merged(edges: DataFrame) -> DataFrame:
    """Edges by their ends, the smaller end first: n, how many there are, and net, how many more run forward than back."""
    forward = (F.col("x0") < F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") < F.col("y1")))
    n, net = (F.col(c) if c in edges.columns else F.lit(1).cast("long") for c in ("n", "net"))
    e = edges.select("k", *[F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))], n.alias("n"), F.when(forward, net).otherwise(-net).alias("net"))
    return e.groupBy("k", *ENDS).agg(F.sum("n").alias("n"), F.sum("net").alias("net"))


def usual_cell(edges: DataFrame) -> int:
    """A cell's side: about the mean edge's longer extent."""
    mean = edges.agg(F.avg(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))).first()[0]
    return max(2, int(mean or 0) + 1)


def _column(x: Column, c: int) -> Column:
    """Cell of a whole coordinate; its left side lies half a unit beside the grid, at c times the cell plus a half."""
    return F.floor((x - 1) / F.lit(c)).cast("long")


def passed(edges: DataFrame, c: int) -> DataFrame:
    """Edges by the cells (i, j) that they pass; an edge's neighbour cells may come too."""
    e = edges.withColumn("i", F.explode(F.sequence(_column(F.least("x0", "x1"), c), _column(F.greatest("x0", "x1"), c))))
    slope = (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0).cast("long"))
    at = lambda x: F.col("y0") + (x - F.col("x0")) * slope
    a, b = F.greatest(F.col("i") * c, F.least("x0", "x1")), F.least((F.col("i") + 1) * c + 1, F.greatest("x0", "x1"))
    lo, hi = (F.when(slope.isNull(), f("y0", "y1")).otherwise(g(f("y0", "y1"), h(f(at(a), at(b))))) for f, g, h in ((F.least, F.greatest, F.floor), (F.greatest, F.least, F.ceil)))
    return e.withColumn("j", F.explode(F.sequence(_column(lo, c), _column(hi, c))))


def by_cell(df: DataFrame) -> DataFrame:
    """Dealt by cell to a set number of tasks: small rows are much work here, and would be put together by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "i", "j")


def _turn(ax, ay, bx, by, px, py) -> Column:
    """Sign of p beside the line from a to b: 1 to the left, -1 to the right, 0 on it."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax)).cast("int")


def _cuts(edges: DataFrame, c: int) -> DataFrame:
    """(id, x, y): points inside edges at which another edge crosses or ends."""
    near = by_cell(passed(edges.select("id", "k", *ENDS), c))
    a = near.select("k", "i", "j", F.col("id").alias("a"), *[F.col(n).alias(f"a_{n}") for n in ENDS])
    b = near.select("k", "i", "j", F.col("id").alias("b"), *[F.col(n).alias(f"b_{n}") for n in ENDS])
    box = " AND ".join(f"least(a_{z}0, a_{z}1) <= greatest(b_{z}0, b_{z}1) AND least(b_{z}0, b_{z}1) <= greatest(a_{z}0, a_{z}1)" for z in "xy")
    p = {s: [F.col(f"{s}_{n}") for n in ENDS] for s in "ab"}
    j = a.join(b, ["k", "i", "j"]).where(f"a < b AND {box}")
    for s, o in (("a", "b"), ("b", "a")):
        for end in (0, 1):
            j = j.withColumn(f"{s}{end}", _turn(*p[o], p[s][2 * end], p[s][2 * end + 1]))
    cross = (F.col("a0") * F.col("a1") == -1) & (F.col("b0") * F.col("b1") == -1)
    # where the lines meet; only read where they cross, so never parallel
    ax, ay, bx, by = p["a"][2] - p["a"][0], p["a"][3] - p["a"][1], p["b"][2] - p["b"][0], p["b"][3] - p["b"][1]
    t = ((p["b"][0] - p["a"][0]) * by - (p["b"][1] - p["a"][1]) * bx).cast("double") / F.nullif((ax * by - ay * bx).cast("double"), F.lit(0.0))
    point = F.struct(F.round(p["a"][0] + t * ax).cast("long").alias("x"), F.round(p["a"][1] + t * ay).cast("long").alias("y"))
    found = [F.when(cross, F.array(F.struct(F.col(s).alias("id"), point["x"].alias("x"), point["y"].alias("y")))) for s in "ab"]
    for s, o in (("a", "b"), ("b", "a")):
        for end in (0, 1):
            x, y = p[s][2 * end], p[s][2 * end + 1]
            inside = (F.col(f"{s}{end}") == 0) & x.between(F.least(p[o][0], p[o][2]), F.greatest(p[o][0], p[o][2])) & y.between(F.least(p[o][1], p[o][3]), F.greatest(p[o][1], p[o][3]))
            found.append(F.when(inside, F.array(F.struct(F.col(o).alias("id"), x.alias("x"), y.alias("y")))))
    none = F.array().cast("array<struct<id:bigint,x:bigint,y:bigint>>")
    cut = j.select(F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("c")).select("c.*").distinct()
    # an edge is not cut at its own ends
    return cut.join(edges.select("id", *ENDS), "id").where("NOT (x = x0 AND y = y0) AND NOT (x = x1 AND y = y1)").select("id", "x", "y")


def noded(edges: DataFrame, scratch: Scratch, cell: int | None = None) -> DataFrame:
    """``merged`` edges of which no two cross or touch but at their ends."""
    e = scratch.write(merged(edges), "edges")
    for _ in range(MAX_ROUNDS):
        c = cell or usual_cell(e)  # pieces become shorter
        named = scratch.write(e.withColumn("id", F.monotonically_increasing_id()), "named")
        cuts = scratch.write(_cuts(named, c), "cuts")
        if cuts.isEmpty():
            return named.drop("id")
        cut = named.join(cuts.select("id").distinct(), "id", "left_semi")
        ends = cut.select("id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("id", "p.x", "p.y")
        # a crossing that was moved may lie beside its edge: the order along the edge is that of its projection
        stops = cuts.unionByName(ends).join(cut, "id")
        along = (F.col("x") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y1") - F.col("y0"))
        w = W.partitionBy("id").orderBy(along, "x", "y")
        pieces = stops.select("k", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), "n", "net").where("x1 IS NOT NULL")
        e = scratch.write(merged(pieces.unionByName(named.join(cuts.select("id").distinct(), "id", "left_anti").drop("id"))), "edges")
    raise RuntimeError(f"edges still cross after {MAX_ROUNDS} rounds")


def boundary(edges: DataFrame, scratch: Scratch, even_odd: bool, cell: int | None = None) -> DataFrame:
    """The edges that bound area, directed so that it lies on their left: k, x0, y0, x1, y1. ``edges``: noded.

    Area is where an odd number of rings' edges lies to the left, or else where at least one member of the group is.
    """
    weight = F.col("n") % 2 if even_odd else F.col("net")
    e = scratch.write(edges.select("k", *ENDS, weight.alias("v")).where("v != 0").withColumn("id", F.monotonically_increasing_id()), "left over")
    c = cell or usual_cell(e)
    up = F.col("y1") > F.col("y0")
    sign = F.when(up, -F.col("v")).otherwise(F.col("v"))  # of crossing the edge from left to right
    # running sums: what lies left of each cell's lower left corner, over the lines that an edge passes
    line = F.explode(F.sequence(_column(F.least("y0", "y1"), c) + 1, _column(F.greatest("y0", "y1"), c))).alias("j")
    lines = e.where(F.abs(_column(F.col("y1"), c) - _column(F.col("y0"), c)) > 0).select("k", *ENDS, sign.alias("s"), line)
    x, y = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def left_of(i: Column, j: Column) -> Column:
        """Whether the edge meets the line below cells j left of the corner of (i, j); on the corner counts as right of it."""
        side = F.signum(x * (2 * c * j + 1 - 2 * F.col("y0")) - y * (2 * c * i + 1 - 2 * F.col("x0"))).cast("int")  # of the corner beside the edge
        return F.when(up, side < 0).otherwise(side > 0)

    guess = F.floor((F.col("x0") + (c * F.col("j") + 0.5 - F.col("y0")) * x / y - 0.5) / c).cast("long")
    lines = lines.withColumn("i", guess).withColumn("i", F.when(left_of(F.col("i"), F.col("j")), F.col("i") - 1).when(~left_of(F.col("i") + 1, F.col("j")), F.col("i") + 1).otherwise(F.col("i")))
    sums = lines.groupBy("k", "j", "i").agg(F.sum("s").alias("s"))
    # a point of each edge: its middle, in half units, and the cell that it lies in
    px, py = F.col("x0") + F.col("x1"), F.col("y0") + F.col("y1")
    point = e.select("k", "id", px.alias("px"), py.alias("py"), F.floor((px - 1) / F.lit(2 * c)).cast("long").alias("i"), F.floor((py - 1) / F.lit(2 * c)).cast("long").alias("j"))
    corners = sums.unionByName(point.select("k", "j", "i").distinct().withColumn("s", F.lit(0).cast("long"))).groupBy("k", "j", "i").agg(F.sum("s").alias("s"))
    corners = corners.withColumn("before", F.coalesce(F.sum("s").over(W.partitionBy("k", "j").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # from the corner up the cell's left side to the height of the point, then right
    local = passed(e, c).withColumn("s", sign).select("k", "i", "j", *ENDS, "s", F.col("id").alias("other"))
    near = by_cell(point).join(by_cell(local), ["k", "i", "j"])
    at = lambda hx, hy: F.signum(x * (hy - 2 * F.col("y0")) - y * (hx - 2 * F.col("x0"))).cast("int")
    side_x, low_y = 2 * c * F.col("i") + 1, 2 * c * F.col("j") + 1
    spans = (2 * F.col("x0") < side_x) != (2 * F.col("x1") < side_x)
    corner, mid = at(side_x, low_y), at(side_x, F.col("py"))
    # edges run from smaller to larger x here, so a point left of one lies above it
    above_low = (corner < 0) | ((corner == 0) & ~up)
    above_mid = mid < 0
    # the point's own falling edge is never below the side, but may meet it in the point
    own = (F.col("id") == F.col("other")) & (F.col("y1") < F.col("y0"))
    climbed = F.when(spans & above_low & ~above_mid & ~own, F.when(up, -F.col("s")).otherwise(F.col("s")))
    reached = (2 * F.col("y0") > F.col("py")) != (2 * F.col("y1") > F.col("py"))
    right = F.when(up, at(F.col("px"), F.col("py")) < 0).otherwise(at(F.col("px"), F.col("py")) > 0)
    beyond_side = F.when(up, mid >= 0).otherwise(mid < 0)
    walked = F.when(reached & right & beyond_side, F.col("s"))
    zero = F.lit(0).cast("long")
    inner = near.groupBy("id").agg(F.sum(F.coalesce(climbed, zero) + F.coalesce(walked, zero)).alias("inner"))
    cover = point.join(corners.select("k", "j", "i", "before"), ["k", "j", "i"]).join(inner, "id", "left").select("id", (F.col("before") + F.coalesce("inner", zero)).alias("cover"))
    # the point just left of the edge's middle, or just above a level edge
    d = e.join(cover, "id")
    left = F.when(up | (F.col("y0") == F.col("y1")), F.col("cover")).otherwise(F.col("cover") + F.col("v"))
    d = d.select("k", *ENDS, left.alias("l"), (left - F.col("v")).alias("r"))
    full = lambda v: F.pmod(F.col(v), F.lit(2)) == 1 if even_odd else F.col(v) > 0
    d = d.where(full("l") != full("r")).withColumn("keep", full("l"))
    return d.select("k", *[F.when(F.col("keep"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))])


def direction(dx: Column, dy: Column) -> Column:
    """Rises with the angle of a direction, exactly so where both parts are below 2**26: the eighth of a turn, and a ratio of at most 1 in it."""
    a, b = F.abs(dx).cast("double"), F.abs(dy).cast("double")
    quarter = F.when((dx >= 0) & (dy >= 0), 0).when((dx < 0) & (dy >= 0), 1).when(dx < 0, 2).otherwise(3)
    odd = (a >= b) == (quarter % 2 == 1)
    r = F.least(a, b) / F.greatest(a, b)
    return F.struct((2 * quarter + odd.cast("int")).alias("eighth"), F.when(odd, -r).otherwise(r).alias("ratio"))


def turns(edges: DataFrame, clockwise: bool = True) -> DataFrame:
    """(k, id, next) for directed edges (id, k, x0, y0, x1, y1) with area on their left: the next edge, clockwise or not, at each end."""
    none = F.lit(None).cast("long")
    out = edges.select("k", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("id").alias("out"), none.alias("in"), direction(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("d"))
    into = edges.select("k", F.col("x1").alias("x"), F.col("y1").alias("y"), none.alias("out"), F.col("id").alias("in"), direction(F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1")).alias("d"))
    w = W.partitionBy("k", "x", "y").orderBy("d")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    beside, end = (F.lag("out"), F.last("out")) if clockwise else (F.lead("out"), F.first("out"))
    # ends in and out alternate, so only the first (or last) has none beside it
    e = out.unionByName(into).withColumn("next", F.coalesce(beside.over(w), end.over(whole)))
    return e.where("in IS NOT NULL").select("k", F.col("in").alias("id"), "next")


def named(ids: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ring, at) of links held in memory, by doubled pointers."""
    order = np.argsort(ids)
    me = np.arange(len(ids))
    to = np.searchsorted(ids[order], following[order])
    ring, skip = np.minimum(me, to), to
    while True:
        step, skip = np.minimum(ring, ring[skip]), skip[skip]
        if (step == ring).all():
            break
        ring = step
    to = np.where(me == ring, me, to)
    left = (me != ring).astype(np.int64)
    while (to != ring).any():
        left, to = left + left[to], to[to]
    most = np.zeros(len(ids), np.int64)
    np.maximum.at(most, ring, left)
    back = np.argsort(order)
    return ids[order][ring][back], np.where(left == 0, 0, most[ring] + 1 - left)[back]


def cycles(links: DataFrame, scratch: Scratch, most: int = 1 << 17) -> DataFrame:
    """(id, ring, at) for (k, id, next), permutations within each k: ring is the least id of the cycle, at counts from it.

    Links of a k that has no more than ``most`` are followed in memory, those of larger ones by joins.
    """
    large = scratch.write(links.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > most).select("k"), "large")
    small = links if large.isEmpty() else links.join(large, "k", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def close() -> pa.RecordBatch:
            ids, following = (np.concatenate(c) for c in list(zip(*parts, strict=True))[:2])
            ring, at = named(ids, following)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ring), pa.array(at)], ["id", "ring", "at"])

        for b in batches:
            cols = tuple(b.column(c).to_numpy() for c in ("id", "next", "g"))
            if parts and sum(len(p[0]) for p in parts) + b.num_rows > most:
                # a group may go on in the next batch; groups are told apart by a digest, or stay together
                ends = np.flatnonzero(np.diff(np.append(parts[-1][2][-1:], cols[2])))
                if len(ends):
                    parts.append(tuple(c[: ends[-1]] for c in cols))
                    yield close()
                    parts, cols = [], tuple(c[ends[-1] :] for c in cols)
            parts.append(cols)
        if parts:
            yield close()

    dealt = small.select("id", "next", F.xxhash64("k").alias("g")).repartition("g").sortWithinPartitions("g")
    out = dealt.mapInArrow(run, "id long, ring long, at long")
    return out if large.isEmpty() else out.unionByName(long_cycles(links.join(large, "k", "left_semi"), scratch))


def long_cycles(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, ring, at) for (id, next), a permutation. After r rounds a pointer skips 2**r links, so a cycle of n takes about 2 log2 n rounds."""
    now = scratch.write(links.select("id", F.col("next").alias("to"), F.least("id", "next").alias("least")), "links")
    while True:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        step = scratch.write(now.join(ahead, "to").select("id", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("changed")), "links")
        stable = step.where("changed").isEmpty()
        now = step.drop("changed")
        if stable:
            break
    ring = now.select("id", F.col("least").alias("ring"))
    now = scratch.write(links.join(ring, "id").select("id", "ring", F.when(F.col("id") == F.col("ring"), F.col("id")).otherwise(F.col("next")).alias("to"), F.when(F.col("id") == F.col("ring"), 0).otherwise(1).cast("long").alias("left")), "ranks")
    while not now.where("to != ring").isEmpty():
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        open_ = now.where("to != ring").join(ahead, "to").select("id", "ring", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left"))
        now = scratch.write(open_.unionByName(now.where("to = ring")), "ranks")
    size = now.groupBy("ring").agg(F.max("left").alias("most"))
    return now.join(size, "ring").select("id", "ring", F.when(F.col("left") == 0, 0).otherwise(F.col("most") + 1 - F.col("left")).cast("long").alias("at"))


def rings(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """k, ring, at, x, y, x1, y1: the corners of each ring in order and their successors; area lies on the left, so a hole's ring runs clockwise. ``edges``: ``boundary``.

    Clockwise turns part area that meets in a point. A hole that meets its shell in a point is still one ring with
    it, which passes the point more than once; turning the other way among such a ring's own edges parts them.
    """
    e = scratch.write(edges.withColumn("id", F.monotonically_increasing_id()), "bounds")
    found = scratch.write(e.join(cycles(scratch.write(turns(e), "turns"), scratch), "id"), "rings")
    again = scratch.write(found.groupBy("ring", "x0", "y0").agg(F.count("*").alias("n")).where("n > 1").select("ring").distinct(), "again")
    if not again.isEmpty():
        pinched = found.join(again, "ring", "left_semi")
        parted = scratch.write(turns(pinched.drop("k").withColumnRenamed("ring", "k"), clockwise=False), "turns")
        parted = pinched.drop("ring", "at").join(cycles(parted, scratch), "id")
        found = found.join(again, "ring", "left_anti").unionByName(parted)
    return found.select("k", "ring", "at", F.col("x0").alias("x"), F.col("y0").alias("y"), "x1", "y1")


def ring_areas(corners: DataFrame) -> DataFrame:
    """k, ring, corners, twice its area in units of the grid (below zero for a hole) and perimeter."""
    twice = F.sum(F.col("x") * F.col("y1") - F.col("x1") * F.col("y"))
    return corners.groupBy("k", "ring").agg(F.count("*").alias("corners"), twice.alias("twice"), F.sum(F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))).alias("perimeter"))


def small_rings(edges: DataFrame) -> DataFrame:
    """``rings`` of the even-odd area of small groups: edges, all of a group in one task and side by side, become rings in memory, some groups at a time."""

    def ringed(t: pa.Table) -> pa.RecordBatch:
        keys = t["k"].combine_chunks()
        g = _numbers(keys)
        g, e = noding.boundary(*noding.noded(g, np.stack([t[c].to_numpy() for c in ENDS]), MAX_ROUNDS)[:3])
        ids = np.arange(len(g))
        ring, at = named(ids, noding.turns(g, e))
        order, new = noding.distinct(ring, e[0], e[1])
        again = np.flatnonzero(np.isin(ring, ring[order][~new]))
        if len(again):
            ring[again], at[again] = named(again, again[noding.turns(ring[again], e[:, again], clockwise=False)])
        first = np.searchsorted(_numbers(keys), g)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(first)), *[pa.array(c) for c in (ring, at, *e)]], ["k", "ring", "at", "x", "y", "x1", "y1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                piece, b = b.slice(0, SOME), b.slice(SOME)
                t = pa.Table.from_batches([*held, piece])
                # the last group may go on
                g = _numbers(t["k"].combine_chunks())
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield ringed(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield ringed(pa.Table.from_batches(held))

    kind = edges.select("k").schema[0].dataType.simpleString()
    return edges.select("k", *ENDS).sortWithinPartitions("k").mapInArrow(run, f"k {kind}, ring long, at long, x long, y long, x1 long, y1 long")


def _numbers(keys: pa.Array) -> np.ndarray:
    """Numbers of groups that lie side by side."""
    codes = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.cumsum(np.diff(codes, prepend=codes[:1]) != 0).astype(np.int64)


def repaired(points: DataFrame, key: str, grid: float, scratch: Scratch, cell: int | None = None, most: int = 256) -> DataFrame:
    """Rings of the even-odd area of each ring of points (key, at, x, y), moved to the grid: what ``rings`` returns, k being the key.

    Rings of no more than ``most`` points are repaired in memory, so that only their points are shuffled; larger ones by joins.
    """
    large = scratch.write(points.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key), "large")
    if large.isEmpty():
        return small_rings(ring_edges(dealt(points, [key]), key, grid))
    e = noded(ring_edges(points.join(large, key, "left_semi"), key, grid), scratch, cell)
    crowded = rings(boundary(e, scratch, even_odd=True, cell=cell), scratch)
    return small_rings(ring_edges(dealt(points.join(large, key, "left_anti"), [key]), key, grid)).unionByName(crowded)


def union_outlines(edges: DataFrame, scratch: Scratch, cell: int | None = None) -> DataFrame:
    """Rings of the union of each group's members, given by their edges with area on the left: what ``rings`` returns."""
    return rings(boundary(noded(edges, scratch, cell), scratch, even_odd=False, cell=cell), scratch)


def box_outlines(boxes: DataFrame, key: str, scratch: Scratch, cell: int | None = None) -> DataFrame:
    """``union_outlines`` of boxes (key, x0, y0, x1, y1 on the grid), however crowded: no pairs of edges are made.

    In each cell the union is cut into slabs at every x, and intervals are united in a slab. Of the sides of what that
    leaves, those of neighbours cancel along each line, and the rest is the boundary; lines part where it turns.
    """
    b = scratch.write(boxes.where("x0 < x1 AND y0 < y1").select(F.col(key).alias("k"), *[F.col(c).cast("long").alias(c) for c in ENDS]).distinct(), "boxes")
    c = cell or 2 * usual_cell(b)
    own = ["k", "i", "j"]
    for n, z in (("i", "x"), ("j", "y")):
        b = b.withColumn(n, F.explode(F.sequence(F.floor(F.col(f"{z}0") / c), F.floor((F.col(f"{z}1") - 1) / c))))
    low = [F.greatest(z, F.col(n) * c).alias(z) for n, z in (("i", "x0"), ("j", "y0"))]
    high = [F.least(z, (F.col(n) + 1) * c).alias(z) for n, z in (("i", "x1"), ("j", "y1"))]
    b = b.select(*own, *low, *high).distinct()
    xs = b.select(*own, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    xs = xs.withColumn("nx", F.lead("x").over(W.partitionBy(*own).orderBy("x"))).where("nx IS NOT NULL")
    s = meeting(xs, b, own).where("x0 <= x AND x1 >= nx").select(*own, "x", "nx", "y0", "y1").distinct()
    w = W.partitionBy(*own, "x").orderBy("y0", "y1")
    s = s.withColumn("reach", F.max("y1").over(w.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("n", F.count_if(F.col("reach").isNull() | (F.col("y0") > F.col("reach"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    united = scratch.write(s.groupBy(*own, "x", "nx", "n").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")), "united")

    def lines(band: str, forward: str, back: str, lo: str, hi: str) -> DataFrame:
        """k, at, a, b: the stretches of lines that bound area, from a to b; sides of cells that share a line meet in their band."""
        ends = F.array(*[F.struct(F.col(at).alias("at"), F.col(z).alias("a"), F.lit(v).alias("v")) for at, sign in ((forward, 1), (back, -1)) for z, v in ((lo, sign), (hi, -sign))])
        e = united.select("k", band, F.explode(ends).alias("e")).groupBy("k", band, "e.at", "e.a").agg(F.sum("e.v").alias("v")).where("v != 0")
        w = W.partitionBy("k", band, "at").orderBy("a")
        e = e.select("k", "at", "a", F.lead("a").over(w).alias("b"), F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("v")).where("v != 0")
        return e.select("k", "at", F.when(F.col("v") > 0, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("v") > 0, F.col("b")).otherwise(F.col("a")).alias("b"))

    level = lines("i", "y0", "y1", "x", "nx").select("k", F.col("a").alias("x0"), F.col("at").alias("y0"), F.col("b").alias("x1"), F.col("at").alias("y1"))
    upright = lines("j", "nx", "x", "y0", "y1").select("k", F.col("at").alias("x0"), F.col("a").alias("y0"), F.col("at").alias("x1"), F.col("b").alias("y1"))
    return rings(level.unionByName(upright), scratch)


def largest_filled(corners: DataFrame, least: float = 0.0) -> DataFrame:
    """k, ring, twice, parts: each group's largest part without its holes, and how many parts have more than ``least`` (twice the area)."""
    shells = ring_areas(corners).where(F.col("twice") > F.greatest(F.lit(least), F.lit(0.0)))
    return shells.groupBy("k").agg(F.max_by(F.struct("ring", "twice"), F.struct("twice", -F.col("ring"))).alias("m"), F.count("*").alias("parts")).select("k", "m.ring", "m.twice", "parts")
