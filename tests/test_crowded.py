"""Many rows in one neighbourhood: work that grows with all their pairs is cut off here."""

import threading
from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import batch as B
from tessella.operators import joins as J
from tessella.operators import measures as M
from tessella.operators import scenes as S
from tessella.scratch import Scratch


@contextmanager
def within(spark, seconds):
    """Cancels what still runs after so many seconds, which fails the test."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_edges(spark):
    """100,000 points at four places and 100,000 edges of two kinds; a diagonal passes cells of its envelope that it isn't near."""
    k = F.col("id")
    p = spark.range(100_000).select("id", (k % 4 * 5).cast("double").alias("x"), F.lit(40.0).alias("y"))
    e = spark.range(100_000).select(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(k % 2 == 0, 300.0).otherwise(0.0).alias("x1"), F.when(k % 2 == 0, 300.0).otherwise(30.0).alias("y1"))
    with within(spark, 40):
        got = {(r["place"], r["distance"], r["n"]) for r in M.edge_distance(p, e, 12.0).groupBy((k % 4).alias("place"), F.round("distance", 6).alias("distance")).agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 10.0, 25_000), (1, 11.18034, 25_000), (2, None, 25_000), (3, None, 25_000)}


def test_candidates(spark):
    """Two crowds, of nodes at one place and of nodes side by side, and lone nodes far off, against all pairs of what can matter."""
    rng = np.random.default_rng(3)
    lone = [(9_000_000 + i, float(x), float(y), f"p{i % 4}") for i, (x, y) in enumerate(rng.uniform(1000, 3000, (400, 2)))]
    k = F.col("id")
    one = spark.range(60_000).select(k.alias("node"), F.lit(5.0).alias("x"), F.lit(5.0).alias("y"), F.concat(F.lit("p"), k % 4).alias("part"))
    many = spark.range(1_000_000, 1_040_000).select(k.alias("node"), (k % 200 / 4).alias("x"), (F.floor(k / 200) % 200 / 4 + 100).alias("y"), F.concat(F.lit("p"), (k * 7919 % 1009 % 4)).alias("part"))
    nodes = one.unionByName(many).unionByName(spark.createDataFrame(lone, one.schema))
    at = [(6.0, 5.0)] * 30_000 + [(x / 2 + 0.1, y / 2 + 100.2) for x in range(100) for y in range(100)] + [(float(x), float(y)) for x, y in rng.uniform(1000, 3000, (50, 2))] + [(-900.0, -900.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "id long, x double, y double").cache()
    with within(spark, 60):
        out = S.candidates(points, nodes, 120.0, 3).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["node"])
    table = nodes.where("node < 4 OR node >= 1000000").toPandas()
    nx, ny, part, node = (table[c].to_numpy() for c in ("x", "y", "part", "node"))
    assert all(got[i] == [0, 1, 2] for i in range(0, 30_000, 997))
    for i in [*range(30_000, 40_000, 397), *range(40_000, 40_051)]:
        d = np.sqrt((at[i][0] - nx) ** 2 + (at[i][1] - ny) ** 2)
        best = sorted(min(zip(d[on], node[on], strict=True)) for p in ("p0", "p1", "p2", "p3") if (on := (part == p) & (d <= 120)).any())
        assert got.get(i, []) == [v for _, v in best[:3]], at[i]


def test_review_items(spark):
    """100,000 points and 100,000 canopies, each at two places."""
    k = F.col("id")
    p = spark.range(100_000).select("id", (k % 5).alias("field"), F.when(k % 2 == 0, 10.0).otherwise(500.0).alias("x"), F.lit(0.0).alias("y"), (-k).cast("double").alias("gap_m"))
    c = spark.range(100_000).select(F.when(k % 4 == 0, 10.0).otherwise(15.0).alias("x"), F.when(k % 4 == 0, 8.0).otherwise(6.5).alias("y"))
    with within(spark, 40):
        got = M.review_items(p, c, 8.0).groupBy("x", "canopies").agg(F.count("*").alias("n"), F.max("place").alias("last")).collect()
    assert {(r["x"], r["canopies"], r["n"], r["last"]) for r in got} == {(10.0, 25_000, 50_000, 20_000), (500.0, 0, 50_000, 20_000)}


def test_meetings(spark):
    """The components of all touching pairs, of boxes of all sizes that share corners, sides, or nothing, in batches that cut cells."""
    rng = np.random.default_rng(11)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        for most, grid in ((3, 60), (9, 90), (2, 30)):
            lo, size = rng.integers(0, grid, (300, 2)) - 5, rng.integers(0, most + 1, (300, 2))
            rows = [(1000 - i, *map(float, (x, y, x + w, y + h))) for i, ((x, y), (w, h)) in enumerate(zip(lo, size, strict=True))]
            b = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
            nodes = b.select(F.col("id").alias("node"))
            want, got = ({tuple(r) for r in J.components(nodes, e).collect()} for e in (J.touching(b, 8.0), J.meetings(b, 8.0)))
            assert got == want and 1 < len({r for _, r in want}) < 300
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_reach_windows(spark):
    """60,000 boxes in one cell and two boxes apart."""
    k = F.col("id")
    b = spark.range(60_002).select("id", (k % 20 + F.when(k < 60_000, 0.0).otherwise(500.0)).alias("x0"), (k % 7).cast("double").alias("y0"))
    b = b.withColumn("x1", F.col("x0") + 1 + k % 3).withColumn("y1", F.col("y0") + 1 + k % 2)
    with within(spark, 40):
        got = sorted(tuple(r) for r in B.reach_windows(b, Scratch(spark, "windows"), 6.0, 30.0).collect())
    assert [(r[0], r[-1]) for r in got] == [(0, 60_000), (60_000, 2)]


def _sequential(rows, reach):
    """Kept rows of (part, id, x, y, score), best first."""
    kept, by = [], {}
    for r in sorted(rows, key=lambda r: (-np.inf if r[4] is None else -r[4], r[1]) if r[4] is not None else (np.inf, r[1])):
        mine = by.setdefault(r[0], [])
        if r[2] is None or r[3] is None:
            kept.append(r)
        elif all((r[2] - k[2]) ** 2 + (r[3] - k[3]) ** 2 > reach * reach for k in mine):
            mine.append(r)
            kept.append(r)
    return sorted(kept, key=str)


def test_suppression_in_lots_and_rounds(spark):
    rng = np.random.default_rng(7)
    rows = [("a" if i % 3 else "b", i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(*rng.integers(0, 40, (2, 300)), rng.integers(0, 9, 300), strict=True))]
    rows += [("a", 1000 + i, 3.0, 4.0, None) for i in range(5)] + [("b", 2000, None, 1.0, 3.0), ("c", 2001, 1e6, -1e6, 1.0), ("c", 2002, 1e6, -1e6, 1.0), ("b", 7, 7.5, 7.5, 9.0), ("b", 7, 7.5, 7.5, 9.0)]
    rows += [("line", 3000 + i, float(i), 0.0, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "part string, id long, x double, y double, score double").repartition(3)
    want = _sequential(rows, 3.0)
    for large in (200_000, 0, 40):
        assert sorted(map(tuple, J.suppressed(df, 3.0, large).collect()), key=str) == want


def test_suppression_of_a_crowd(spark):
    """40,000 points within reach of each other, and as many beside them: no pairs are made."""
    k = F.col("id")
    df = spark.range(80_000).select(F.lit("p").alias("part"), "id", (k % 100 / 1000 + F.when(k < 40_000, 0.0).otherwise(1.2)).alias("x"), (F.floor(k / 100) % 100 / 1000).alias("y"), (k * 7919 % 10_007).cast("double").alias("score"))
    with within(spark, 100):
        got = {r["id"] for r in J.suppressed(df, 1.0, 1000).collect()}
    assert len(got) == 2 and {i < 40_000 for i in got} == {True, False}


def test_matching_in_lots_and_rounds(spark):
    rng = np.random.default_rng(9)
    rows = [("p", int(i), int(j), float(s)) for i, j, s in zip(rng.integers(0, 30, 300), rng.integers(0, 40, 300), rng.integers(0, 6, 300), strict=True)]
    rows += [("q", 1, j, 1.0) for j in range(50)] + [("r", i, i + d, float(i)) for i in range(20) for d in (0, 1)]
    rows = list({r[:3]: r for r in rows}.values())
    used, want = set(), []
    for r in sorted(rows, key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if (r[0], 0, r[1]) not in used and (r[0], 1, r[2]) not in used:
            used |= {(r[0], 0, r[1]), (r[0], 1, r[2])}
            want.append(r)
    df = spark.createDataFrame(rows, "part string, i long, j long, score double").repartition(3)
    for large in (200_000, 0):
        assert sorted(map(tuple, J.greedy_match(df, large).collect())) == sorted(want)


def _matched(rows, least):
    """(part, i, j, score) of boxes (part, side, id, x0, y0, x1, y1), all pairs one after the other."""
    pairs, used, want = [], set(), set()
    for p, _, i, ax0, ay0, ax1, ay1 in (r for r in rows if r[1] == 0):
        for q, _, j, bx0, by0, bx1, by1 in (r for r in rows if r[1] == 1):
            w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
            if p == q and w > 0 and h > 0 and (s := w * h / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - w * h)) >= least:
                pairs.append((round(s, 6), i, j, p))
    for s, i, j, p in sorted(pairs, reverse=True):
        if (p, 0, i) not in used and (p, 1, j) not in used:
            used |= {(p, 0, i), (p, 1, j)}
            want.add((p, i, j, s))
    return want


def test_matching_of_boxes(spark):
    """As all pairs one by one: places with several boxes, tied scores, bands of scores, components in rounds, an id at two places."""
    rng = np.random.default_rng(5)
    rows = list({(f"p{i % 2}", i // 2 % 2, i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.integers((0, 0, 1, 1), (12, 12, 5, 5), (400, 4)))})
    kind = "part string, side int, id long, x0 double, y0 double, x1 double, y1 double"
    for extra in ([], [("p0", 0, 4, 3.0, 3.0, 6.0, 6.0)]):
        df = spark.createDataFrame(rows + extra, kind)
        want = _matched(rows + extra, 0.1)
        for large, most in ((200_000, 1 << 20), (10, 1 << 20), (10, 1)):
            got = J.greedy_match_boxes(df.where("side = 0"), df.where("side = 1"), "part", 5.0, 5.0, 0.1, large=large, most=most)
            assert {tuple(r) for r in got.collect()} == want
    assert J.greedy_match_boxes(df.limit(0), df.where("side = 1"), "part", 5.0, 5.0, 0.1).count() == 0


def test_matching_of_a_crowd(spark):
    """40,000 boxes at two places that overlap, and one box apart: no pairs of boxes are made."""
    k = F.col("id")
    b = spark.range(40_001).select("id", F.lit("p").alias("part"), F.when(k < 40_000, k % 2 * 1.0).otherwise(90.0).alias("x0"), F.lit(0.0).alias("y0"))
    b = b.withColumn("x1", F.col("x0") + 4).withColumn("y1", F.col("y0") + 4)
    with within(spark, 60):
        got = sorted((r["i"], r["j"]) for r in J.greedy_match_boxes(b.where("id % 2 = 0"), b.where("id % 2 = 1"), "part", 40.0, 60.0, 0.1).collect())
    assert got == [(i, i + 1) for i in range(0, 40_000, 2)]


def test_batch_of_rows_at_one_place(spark):
    """100,000 rows along one line through four tiles, and as many areas at one place: sampled once."""
    k = F.col("id")
    rows = spark.range(100_000).select(F.concat(F.lit("R"), k).alias("row_id"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 7.0), ("x1", 400.0), ("y1", 7.0))])
    areas = spark.range(100_000).select("id", *[F.lit(v).alias(c) for c, v in (("x0", 90.0), ("y0", 0.0), ("x1", 250.0), ("y1", 100.0))])
    tiles = spark.createDataFrame([(f"t{n}", n * 100.0, 0.0, n * 100.0 + 100, 100.0) for n in range(4)], "tile string, left double, low double, right double, high double")
    # green but for half of the third tile, and nothing in the last one
    px = spark.range(20 * 60).select(F.floor(k / 60).alias("row"), (k % 60).alias("col"), (k % 60 < 50).alias("green"))
    none = spark.createDataFrame([], "label string, tile string, id string, length_m double, area_m2 double")
    with within(spark, 60):
        got = B.batch(rows, areas, none, tiles, px, 5.0, 0.05, 100.0).groupBy("label", "tile", "attribute").agg(F.count("*").alias("n"), F.min("length_m").alias("m"), F.max("area_m2").alias("a")).collect()
    n = 100_000
    want = {("row", f"t{i}", s, n, 100.0, None) for i, s in enumerate(("regular", "regular", "disrupted", "unassessable"))}
    want |= {("interrow_area", f"t{i}", "vegetation", n, None, a) for i, a in enumerate((1000.0, 10_000.0, 5000.0))}
    assert {tuple(r) for r in got} == want
