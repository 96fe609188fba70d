"""Ring repair and union outlines against even-odd areas, unit cells and flood fills."""

import math
import threading
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import outlines as O
from tessella.plans import catalog
from tessella.scratch import Scratch


def rows_of(spark, rings):
    rows = [(k, i, float(x), float(y)) for k, r in rings.items() for i, (x, y) in enumerate(r)]
    return spark.createDataFrame(rows, "k int, at int, x double, y double").repartition(3)


def collected(corners):
    """{k: [ring as array]} and a check that rings are closed, without repeated points, and in order."""
    out = {}
    for r in corners.collect():
        out.setdefault((r.k, r.ring), []).append(r)
    rings = {}
    for (k, _), part in out.items():
        part.sort(key=lambda r: r.at)
        assert [r.at for r in part] == list(range(len(part)))
        assert all((a.x1, a.y1) == (b.x, b.y) for a, b in zip(part, part[1:] + part[:1], strict=True))
        assert len({(r.x, r.y) for r in part}) == len(part) >= 3
        rings.setdefault(k, []).append(np.array([(r.x, r.y) for r in part], float))
    return rings


def signed(ring):
    x, y = ring[:, 0], ring[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2


def crossing(rings):
    """Whether any two edges of the rings cross or touch but at shared ends, in exact arithmetic."""
    edges = [(tuple(map(int, a)), tuple(map(int, b))) for r in rings for a, b in zip(r, np.roll(r, -1, 0), strict=True)]

    def turn(a, b, p):
        v = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        return (v > 0) - (v < 0)

    def on(a, b, p):
        return turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]) and p not in (a, b)

    return any((turn(a, b, c) * turn(a, b, d) == -1 and turn(c, d, a) * turn(c, d, b) == -1) or any(on(a, b, p) for p in (c, d)) or any(on(c, d, p) for p in (a, b)) for i, (a, b) in enumerate(edges) for c, d in edges[:i])


BOW = [(0, 0), (4, 4), (4, 0), (0, 4)]
PENTAGRAM = [(math.cos(a) * 50, math.sin(a) * 50) for a in (2 * math.pi * 2 * k / 5 for k in range(5))]
CASES = {
    1: [(0, 0), (4, 0), (4, 4), (0, 4)],
    2: BOW,
    3: PENTAGRAM,
    4: [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0), (2, 2), (2, 5), (5, 5), (5, 2), (2, 2)],  # a hole on a thread that runs both ways
    5: [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0), (4, 4), (0, 4)],  # twice round: nothing, even-odd
    6: [(0, 0), (4, 0)],  # no area
    7: [(3, 3)],
    8: [(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)],  # touches its own side
    9: [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (3, 2), (3, 5), (6, 3)],  # a hole that meets its shell in a point
    10: [(0, 0), (4, 0), (4, 4), (8, 4), (8, 8), (4, 8), (4, 4), (0, 4)],  # two squares that meet in a point
    11: [(0, 0), (0, 0), (6, 0), (6, 0), (6, 6), (2, 6), (4, 6), (0, 6)],  # repeated points, a spike along a side
}


def test_repair_of_known_rings(spark):
    scratch = Scratch(spark, "repair")
    got = collected(O.repaired(rows_of(spark, CASES), "k", 0.25, scratch, cell=7))
    areas = {k: sorted(round(signed(r) / 16, 3) for r in rings) for k, rings in got.items()}
    assert areas[1] == [16] and areas[2] == [4, 4] and 5 not in areas and 6 not in areas and 7 not in areas
    assert len(areas[3]) == 5 and sum(areas[3]) == pytest.approx(G.sweep_area([[np.round(np.array(PENTAGRAM) * 4) / 4]], 1), rel=0.01)
    assert areas[4] == [-9, 64] and areas[8] == [25, 25] and areas[10] == [16, 16] and areas[11] == [36]
    assert areas[9] == [-6, 100]
    assert not any(crossing(r) for r in got.values())


def test_repair_of_random_rings(spark):
    rng = np.random.default_rng(8)
    # coarse grids make crossings move far, touch and fall together
    rings = {k: rng.integers(-30, 30, (int(rng.integers(3, 14)), 2)) if k % 2 else rng.normal(size=(12, 2)) * 10 for k in range(60)}
    for grid, cell in ((1.0, 3), (2.0**-12, None)):
        scratch = Scratch(spark, "repair")
        got = collected(O.repaired(rows_of(spark, rings), "k", grid, scratch, cell))
        for k, r in rings.items():
            found, snapped = got.get(k, []), np.round(np.asarray(r, float) / grid)
            assert not crossing(found)
            # every turning of a crossing by at most its rounding moves no more area than its edges are long
            slack = 0.75 * sum(G.length(np.vstack((x, x[:1]))) for x in found) + 1e-6
            assert abs(sum(signed(x) for x in found) - G.sweep_area([[snapped]], 1)) <= slack
            for x in found:
                assert G.union_area([x]) == pytest.approx(abs(signed(x)), rel=1e-9)


def test_small_rings_are_those_of_the_joins(spark):
    """The same rings in memory, in batches that cut them, as by joins; keys of two kinds, one null."""
    rng = np.random.default_rng(21)
    # a fine grid, since which way a crossing halfway between points goes hangs on the order of its edges
    rings = {k: rng.integers(-2_000_000, 2_000_000, (int(rng.integers(3, 30)), 2)) for k in range(40)} | {100 + k: r for k, r in CASES.items() if k != 3}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = lambda points, most: {(k, frozenset(c)) for (k, _), c in _rings(O.repaired(points, "k", 1.0, Scratch(spark, "small"), most=most).collect()).items()}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        p = rows_of(spark, rings)
        small = found(p, 256)
        assert len(small) > 500 and small == found(p, 12) == found(p, 0)
        assert found(p.withColumn("k", F.when(F.col("k") != 3, F.concat(F.lit("r"), "k"))), 256) == {(None if k == 3 else f"r{k}", c) for k, c in small}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def _rings(rows):
    out = {}
    for r in rows:
        out.setdefault((r.k, r.ring), []).append((r.x, r.y, r.x1, r.y1))
    return out


def test_small_rings_shuffle_their_points_only(spark):
    """200 rings of 32 points that cross some 150 times each: what is shuffled and written is as the points."""

    def moved():
        store = spark._jsparkSession.sparkContext().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))

    k = F.col("id")
    p = spark.range(6400).select(F.floor(k / 32).alias("k"), (k % 32).alias("at"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    before = moved()
    n = O.ring_areas(O.repaired(p, "k", 2.0**-20, Scratch(spark, "small"))).agg(F.sum("corners")).first()[0]
    assert n > 40_000 and moved() - before < 2_000_000


def test_area_is_where_crossings_are_odd(spark):
    rng = np.random.default_rng(3)
    rings = {k: rng.integers(0, 12, (9, 2)) * 1000 for k in range(20)}
    got = collected(O.repaired(rows_of(spark, rings), "k", 1.0, Scratch(spark, "odd")))
    for k, r in rings.items():
        points = rng.integers(-500, 12_500, (300, 2)) + 0.37
        want = G.contains(r.astype(float), points)
        have = sum((G.contains(x, points).astype(int) for x in got.get(k, [])), np.zeros(300, int)) % 2 == 1
        far = np.array([min(G.line_distance(p[None], np.vstack((r, r[:1])).astype(float))[0] for _ in (0,)) > 2 for p in points])
        assert (want == have)[far].all()


def boxes(n, seed, side=40):
    rng = np.random.default_rng(seed)
    lo = rng.integers(0, side, (n, 2))
    return np.hstack((lo, lo + rng.integers(0, 12, (n, 2))))


def cells_of(group, side=60):
    grid = np.zeros((side, side), bool)
    for x0, y0, x1, y1 in group:
        grid[x0:x1, y0:y1] = True
    return grid


def labels(grid, eight):
    """Connected parts by repeated spreading."""
    out = np.where(grid, np.arange(grid.size).reshape(grid.shape) + 1, 0)
    while True:
        new, pad = out.copy(), np.pad(out, 1)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                if eight or dx == 0 or dy == 0:
                    new = np.maximum(new, pad[1 + dx : pad.shape[0] - 1 + dx, 1 + dy : pad.shape[1] - 1 + dy])
        new[~grid] = 0
        if (new == out).all():
            return out
        out = new


def test_union_outlines_are_the_cells(spark):
    groups = {k: boxes(n, k) for k, n in enumerate((1, 2, 5, 20, 60, 200, 60, 20))}
    rows = [(k, *map(int, b)) for k, g in groups.items() for b in [*g, g[0]]]  # one member twice
    df = spark.createDataFrame(rows, "k int, x0 long, y0 long, x1 long, y1 long").repartition(3)
    for cell in (None, 4):
        corners = O.union_outlines(O.box_edges(df, "k"), Scratch(spark, "union"), cell).cache()
        got = collected(corners)
        most = {r.k: r for r in O.largest_filled(corners).collect()}
        for k, g in groups.items():
            grid = cells_of(g)
            rings = got.get(k, [])
            shells = [signed(r) for r in rings if signed(r) > 0]
            assert sum(map(signed, rings)) == grid.sum() and not crossing(rings)
            solid, open_ = labels(grid, False), labels(~np.pad(grid, 1), True)
            assert len(shells) == len(set(solid.ravel()) - {0})
            assert len(rings) - len(shells) == len(set(open_.ravel()) - {0}) - 1
            if not shells:
                assert k not in most
                continue
            filled = [int((labels(~np.pad(solid == s, 1), True) != labels(~np.pad(solid == s, 1), True)[0, 0]).sum()) for s in set(solid.ravel()) - {0}]
            assert most[k].twice == 2 * max(filled) and most[k].parts == len(filled)


def test_box_outlines_are_those_of_the_edges(spark):
    """Boxes by slabs as by their edges: areas and perimeters of rings, which pass no point twice."""
    groups = {k: boxes(n, k) - 9 for k, n in enumerate((1, 2, 5, 20, 60, 200, 60, 20))} | {99: np.array([(0, 0, 4, 4), (4, 4, 8, 8), (0, 8, 4, 12), (8, 0, 12, 4), (8, 8, 12, 12)])}
    df = spark.createDataFrame([(k, *map(int, b)) for k, g in groups.items() for b in [*g, g[0]]], "k int, x0 long, y0 long, x1 long, y1 long").repartition(3)
    found = lambda corners: sorted((r.k, r.twice, r.perimeter) for r in O.ring_areas(corners).collect())
    want = found(O.union_outlines(O.box_edges(df, "k"), Scratch(spark, "union")))
    for cell in (None, 4, 7):
        corners = O.box_outlines(df, "k", Scratch(spark, "boxes"), cell).cache()
        assert found(corners) == want and len(want) > 30
        assert not any(crossing(r) for r in collected(corners).values())
    assert O.box_outlines(df.limit(0), "k", Scratch(spark, "none")).count() == 0


def test_union_of_a_crowd(spark, tmp_path):
    """120,000 boxes of one brand, nearly all of them different, in the query's own 500 by 500: no pairs of edges are made."""
    k = F.col("id")
    spark.range(120_000).select(k.alias("p_partkey"), F.lit("b").alias("p_brand"), (k * 7919 % 10_007 % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        got = catalog.queries()["q151_union_outlines"](spark, str(tmp_path)).collect()
    finally:
        timer.cancel()
    grid = np.zeros((540, 540), bool)
    for i in range(120_000):
        x, y = (i * 7919 % 10_007 % 50 + 1) * 10, i * 37 % 500
        grid[x : x + 5 + i % 20, y : y + 10 + i % 30] = True
    pad = np.pad(grid, 1)
    assert [(r.area, r.perimeter) for r in got] == [(grid.sum(), (np.diff(pad, axis=0) != 0).sum() + (np.diff(pad, axis=1) != 0).sum())]


def test_crowded_and_empty(spark):
    scratch = Scratch(spark, "crowd")
    # all in one group; long edges that each cross many
    rows = [(1, 0, 3 * i, 1000 + i % 7, 3 * i + 2) for i in range(60)] + [(1, i, 0, i + 1, 190) for i in range(0, 90, 3)]
    df = spark.createDataFrame(rows, "k int, x0 long, y0 long, x1 long, y1 long")
    corners = O.union_outlines(O.box_edges(df, "k"), scratch)
    grid = np.zeros((1200, 200), bool)
    for _, x0, y0, x1, y1 in rows:
        grid[x0:x1, y0:y1] = True
    assert sum(signed(r) for r in collected(corners)[1]) == grid.sum()
    none = df.where("k < 0")
    assert O.union_outlines(O.box_edges(none, "k"), scratch).count() == 0
    assert O.repaired(spark.createDataFrame([], "k int, at int, x double, y double"), "k", 1.0, scratch).count() == 0


def test_long_ring_is_named_and_numbered(spark):
    n = 1000
    links = [("long", 7 * i % n, 7 * (i + 1) % n) for i in range(n)] + [("b", n, n + 1), ("b", n + 1, n), (None, n + 2, n + 2)]
    links += [(f"k{k}", 2000 + 10 * k + i, 2000 + 10 * k + (i + 1) % 5) for k in range(100) for i in range(5)]
    df = spark.createDataFrame(links, "k string, id long, next long")
    want = {7 * i % n: (0, i) for i in range(n)} | {n: (n, 0), n + 1: (n, 1), n + 2: (n + 2, 0)} | {2000 + 10 * k + i: (2000 + 10 * k, i) for k in range(100) for i in range(5)}
    # all in memory, in several closings, and the long one by joins
    for most in (10_000, 40):
        assert {r.id: (r.ring, r.at) for r in O.cycles(df, Scratch(spark, "cycles"), most).collect()} == want


def test_directions_rise_with_the_angle(spark):
    rng = np.random.default_rng(0)
    d = {tuple(map(int, v)) for v in rng.integers(-4, 5, (200, 2)) if v.any()} | {(2**26 - 1, 1), (2**26 - 2, 1), (2**26 - 1, 2**26 - 2), (2**26 - 2, 2**26 - 3), (-(2**26) + 1, 1), (-(2**26) + 2, 1)}
    df = spark.createDataFrame(sorted(d), "x long, y long")
    got = [(r.x, r.y) for r in df.orderBy(O.direction(F.col("x"), F.col("y")), F.abs("x") + F.abs("y")).collect()]

    def half(v):
        return 0 if v[1] > 0 or (v[1] == 0 and v[0] > 0) else 1

    for a, b in zip(got, got[1:], strict=False):
        assert half(a) <= half(b)
        if half(a) == half(b):
            assert a[0] * b[1] - a[1] * b[0] >= 0
    assert Fraction(1, 2**26 - 2) > Fraction(1, 2**26 - 1)
