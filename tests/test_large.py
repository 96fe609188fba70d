"""Joins on cells: dealt to tasks by their cells, whatever Spark thinks of their size, and nothing that grows is broadcast."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mix
from tessella.operators import details as D
from tessella.operators import hops as H
from tessella.operators import inspection as I
from tessella.operators import joins as J
from tessella.operators import measures as M
from tessella.operators import rasters as A
from tessella.operators import scenes as S
from tessella.plans import measures, rules


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_locations(spark):
    """boxes spread over cells were broadcast, and met in the few tasks that read the points; points and boxes alike are met once."""
    k = F.col("id")
    p = spark.range(100_000).select("id", (k % 2 * 5).cast("double").alias("x"), F.lit(5.0).alias("y"))
    b = spark.range(100_000).select(*[(k % 2 * 0 + v).alias(c) for c, v in (("x0", 4.0), ("y0", 4.0), ("x1", 6.0), ("y1", 6.0))])
    out = I.located(p, b, b.where("x0 < 0"), 10.0)
    assert "BroadcastHashJoin" not in plan_of(out) and "REPARTITION_BY_NUM" in plan_of(out)
    assert {r["location"]: r["n"] for r in out.groupBy("location").agg(F.count("*").alias("n")).collect()} == {"interrow": 50_000, "outside": 50_000}


def test_nearest(spark):
    """60,000 rows on either side in one cell; every row met every other one."""
    k = F.col("id")
    l = spark.range(60_000).select("id", F.lit(1).alias("p"), (k % 30_000 / 1000).alias("x"))
    r = spark.range(60_000).select(F.concat(F.lit("r"), k % 20_000).alias("o"), F.lit(1).alias("p"), (k % 20_000 / 1000 + 0.0004).alias("y"))
    out = J.nearest(l, r, "id", "o", "x", "y", 100.0, ["p"])
    assert "SortMergeJoin [p" not in plan_of(out) and "Window" in plan_of(out)
    got = {x["id"]: (x["nearest"], round(x["distance"], 6)) for x in out.where("id IN (0, 7, 20001)").collect()}
    assert got == {0: ("r0", 0.0004), 7: ("r7", 0.0004), 20001: ("r19999", 0.0016)}


def test_nearest_ties_and_bounds(spark):
    """Equally far on both sides: the smaller id; exactly at reach counts; beyond it and null have none."""
    l = spark.createDataFrame([(1, 1, 10.0), (2, 1, 113.0), (3, 1, None), (4, 2, 10.0), (5, 1, -92.0)], "id long, p long, x double")
    r = spark.createDataFrame([("b", 1, 8.0), ("a", 1, 12.0), ("c", 1, 13.0), ("n", 1, None), ("z", 1, float("nan"))], "o string, p long, y double")
    got = {x["id"]: (x["nearest"], x["distance"]) for x in J.nearest(l, r, "id", "o", "x", "y", 100.0, ["p"]).collect()}
    assert got == {1: ("a", 2.0), 2: ("c", 100.0), 3: ("", None), 4: ("", None), 5: ("b", 100.0)}


def test_merged_boxes_query(spark):
    """the query links each box a few times, not with all that it touches."""
    boxes = spark.range(3000).select(F.col("id"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 3.0), ("y1", 3.0))])
    assert J.meetings(boxes, 20.0).count() < 6000
    assert "touching" not in rules.q94_merged_boxes.__code__.co_names


def test_links(spark):
    """20,000 rows within reach of each other gave 200 million pairs."""
    d = spark.range(20_000).select("id", (F.col("id") % 5000 / 1000).alias("x"))
    e = J.links(d, "id", "x", 60.0)
    assert e.count() < 40_000
    assert J.components(d.select(F.col("id").alias("node")), e).select("root").distinct().count() == 1
    few = spark.createDataFrame([(1, 0.0), (2, 59.9), (3, 120.0), (4, 179.0), (5, None), (6, 300.0)], "id long, x double")
    assert sorted(map(tuple, J.links(few, "id", "x", 60.0).collect())) == [(1, 2), (3, 4)]


def test_gap_points(spark):
    """stretches at the same place meet obstacles at the same place once, in as many tasks as shuffles have."""
    g = spark.range(20_000).select(F.lit("v").alias("vineyard_id"), F.col("id").cast("string").alias("row_id"), F.lit("gap").alias("kind"), *[F.lit(v).alias(c) for c, v in (("gap_m", 3.0), ("green", 0.0), ("hidden", 0.0), ("row_planted", 1.0), ("x0", 0.0), ("y0", 0.0), ("x1", 3.0), ("y1", 0.0))])
    o = spark.range(20_000).select(F.col("id").alias("obstacle_id"), F.when(F.col("id") == 0, "tree").otherwise("bush").alias("kind"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("in_block"))
    out = I.gap_points(g, o)
    assert "REPARTITION_BY_NUM" in plan_of(out)
    assert out.where("obstacle_type = 'tree'").count() == 20_000


def test_snapped_and_precedence(spark):
    """20,000 points in one cell with 20,000 nodes; a widening search has no pairs of all."""
    k = F.col("id")
    p = spark.range(20_000).select("id", (k % 141).cast("double").alias("x"), F.floor(k / 141).cast("double").alias("y"), F.lit("a").alias("verdict"))
    out = S.snapped(p, p.select(F.col("id").alias("node"), "x", (F.col("y") + 0.25).alias("y")), 1000.0)
    assert out.where("id = node AND distance = 0.25").count() == 20_000
    far = p.select((k + 20_000).alias("id"), (F.col("x") + F.when(k % 2 == 0, 0.0).otherwise(5000.0)).alias("x"), "y", "verdict")
    assert S.by_precedence([p, far], 1000.0).count() == 30_000


def test_nearest_row(spark):
    """F8: 60,000 pieces and rows of one extent in one cell met in pairs; of rows alike the smallest, beyond the extent none."""
    k = F.col("id")
    pieces = spark.range(60_000).select(k.alias("piece"), F.lit(1).alias("pattern"), (k % 100).alias("u"), (k / 1000).alias("v"))
    rows = spark.range(60_000).select((k + 5).alias("row"), F.lit(1).alias("pattern"), F.lit(10).alias("u0"), F.lit(80).alias("u1"), (k % 30_000 / 1000).alias("rv"))
    out = D.nearest_row(pieces, rows, reach=150.0)
    assert "Window" in plan_of(out)
    got = {r["piece"]: r["row"] for r in out.where("piece IN (5, 9, 50, 40, 50040)").collect()}
    assert got == {5: -1, 9: 14, 50: 55, 40: 45, 50040: 30_004}


def test_max_overlap_of(spark):
    """20,000 boxes at one place on either side met in pairs; each gets the largest id of the other side."""
    b = spark.range(40_000).select("id", F.lit("b").alias("brand"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 3.0), ("y1", 3.0))])
    out = J.max_overlap_of(b.where("id % 2 = 0"), b.where("id % 2 = 1"), ["brand"], 40.0, 60.0, 0.1)
    assert [tuple(r) for r in out.groupBy("b", "overlap").count().collect()] == [(39_999, 9.0, 20_000)]


def test_metres_inside(spark):
    """a stretch walked 20,000 times meets a parcel once, and counts 20,000 times."""
    s = spark.range(20_000).select(F.lit(1).alias("id"), F.col("id").alias("k"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 1.0), ("x1", 30.0), ("y1", 1.0))])
    b = spark.range(300).select("id", (F.col("id") % 10 * 3.0).alias("x0"), F.floor(F.col("id") / 10).cast("double").alias("y0"), (F.col("id") % 10 * 3.0 + 1).alias("x1"), (F.floor(F.col("id") / 10) + 0.5).alias("y1"))
    out = M.metres_inside(s, b, 40.0)
    assert "REPARTITION_BY_NUM" in plan_of(out)
    assert [(r["id"], round(r["inside"], 6)) for r in out.collect()] == [(1, 200_000.0)]


def test_overlaps(spark):
    """boxes are dealt by number, not broadcast to the tasks that read a small file."""
    b = spark.range(100).select("id", F.lit("b").alias("brand"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 3.0), ("y1", 3.0))])
    for out in J.overlaps(b, b, ["brand"], 40.0, 60.0), A.box_union_area(b, "brand", 40.0, 60.0):
        assert "REPARTITION_BY_NUM" in plan_of(out) and "BroadcastHashJoin" not in plan_of(out)
    assert [tuple(r) for r in A.box_union_area(b, "brand", 40.0, 60.0).collect()] == [("b", 9.0)]


def test_mix_slots(spark):
    """where no slot is left to the closing shards, Spark takes the slots for a few rows and broadcast them."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), F.lit(200)).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    p = mix.MixParams(tolerance=1.0)
    out = mix.taken(mix.plan(docs, p))
    assert not [x for x in plan_of(out).split("\n") if "BroadcastHashJoin" in x and "index" in x]


def test_gaps(spark):
    """cells, several for each row of a small table, were broadcast."""
    nodes = spark.range(10).select(F.col("id").alias("node"), F.col("id").alias("i"), F.lit(0).cast("long").alias("j"))
    rows = spark.range(1).select(F.col("id").alias("row_id"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 5.0), ("y1", 0.0))])
    assert "BroadcastHashJoin" not in plan_of(H.gaps(rows, nodes, H.HopParams()))


def test_rings(spark):
    """Rings of a small file were one task's work."""
    b = spark.range(100).coalesce(1).select("id", *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 3.0), ("y1", 3.0))])
    out = measures.rings(b, lambda r: [(r.id, 1.0)], "id long, area double")
    assert "REPARTITION_BY_NUM" in plan_of(out) and out.count() == 100


def test_merged_lines_shuffle(spark):
    """segments were shuffled many times over, on their way to components and back: some 350 bytes each."""
    k = F.col("id")
    s = spark.range(200_000).select((k * 7919 % 50_021).alias("line"), (k * 104_729 % 1_000_003).alias("k"), (k % 12).alias("a"), (k * 31 % 12 + 12 * (k % 2)).alias("b"))
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return [found.apply(i) for i in range(found.size())]

    before = {x.stageId() for x in stages()}
    assert J.merged_parts(s).agg(F.sum("pieces")).first()[0] == 200_000
    assert sum(x.shuffleWriteBytes() + x.outputBytes() for x in stages() if x.stageId() not in before) < 50 * 200_000


def chained(rows):
    """The same by hand: (line, k) and the smallest k of its chain."""
    ends, top = {}, {(r[0], r[1]): r[1] for r in rows}
    for line, k, a, b in rows:
        for end in (a, b):
            ends.setdefault((line, end), []).append(k)
    links = [(line, *ks) for (line, end), ks in ends.items() if line is not None and end is not None and len(ks) == 2 and None not in ks]
    for _ in rows:
        for line, p, q in links:
            top[line, p] = top[line, q] = min(top[line, p], top[line, q])
    return top


@pytest.mark.parametrize("large", [1, 6, 1000])
def test_merged_lines(spark, large):
    """chains, rings, forks, repeated k and odd nulls, in tasks, by joins and both, against all links by hand; lines that go on in the next batch."""
    rng = np.random.default_rng(5)
    rows = [(line, int(rng.integers(1, 20)), f"n{rng.integers(0, 9)}", f"n{rng.integers(0, 9)}") for line in range(60) for _ in range(rng.integers(1, 12))]
    rows += [(100, 40 - i, f"n{i}", f"n{i + 1}") for i in range(30)] + [(101, i, f"n{i}", f"n{(i + 1) % 9}") for i in range(9)]
    rows += [(102, 1, None, "a"), (102, 2, None, "b"), (103, None, "a", "b"), (103, None, "b", "c"), (103, 5, "c", "d"), (103, 4, "d", "e"), (None, 7, "a", "b"), (None, 8, "b", "c"), (None, 8, "b", "c"), (None, None, "c", "d")]
    rng.shuffle(at := np.arange(len(rows)))
    rows = [rows[i] for i in at]
    top = chained(rows)
    counts = {}
    for (line, _), root in top.items():
        counts[line, root] = counts.get((line, root), 0) + 1
    s = spark.createDataFrame(rows, "line long, k long, a string, b string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = J.merged_lines(s, large).collect()
        parts = J.merged_parts(s, large).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(map(tuple, got)) == Counter((*r, top[r[0], r[1]]) for r in rows)
    assert Counter(map(tuple, parts)) == Counter((*c, n) for c, n in counts.items())
