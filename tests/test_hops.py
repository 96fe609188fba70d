"""Hops over rows: a small world, and controls that must not be hopped."""

import pytest

from tessella.operators import hops as H
from tessella.operators.hops import HopParams, hop_edges

BOX = "x0 double, y0 double, x1 double, y1 double"


def world(spark, rows=((1, 0.0, 5.0, 10.0, 5.0),), canopies=(), forbidden=(), skip=()):
    """Cells of half a metre over 10 m by 10 m, and rows at y = 5 unless given."""
    nodes = [(1000 * i + j, i, j, 0.0) for i in range(20) for j in range(20) if (i, j) not in skip]
    of = lambda data, schema: spark.createDataFrame(list(data), schema)
    return of(rows, f"row_id int, {BOX}"), of(canopies, BOX), of(forbidden, BOX), of(nodes, "node int, i int, j int, outside double")


def edges(spark, p=HopParams(), **kw):
    return {(r.low, r.high): r for r in hop_edges(*world(spark, **kw), p).collect()}


def test_one_row(spark):
    got = edges(spark)
    # cells on either side at every half metre: 0.9 m up and down from y = 5
    assert set(got) == {(1000 * i + 8, 1000 * i + 11) for i in range(20)}
    assert all(r.cost == pytest.approx(1.5 + 50) and r.tier == 1 and r.crossed == 1 for r in got.values())
    assert len(edges(spark, skip={(3, 8), (4, 11)})) == 18


def test_controls_are_not_hopped(spark):
    mature, small, beside = (4.8, 4.7, 5.8, 5.3), (4.9, 4.9, 5.1, 5.1), (4.8, 8.0, 5.8, 9.0)
    free = edges(spark)
    blocked = edges(spark, canopies=[mature, beside])
    # corridors are 0.8 m wide: those around 4.25 to 6.25
    assert set(free) - set(blocked) == {(1000 * i + 8, 1000 * i + 11) for i in range(20) if 4.8 - 0.4 <= i / 2 + 0.25 <= 5.8 + 0.4}
    assert set(edges(spark, forbidden=[mature])) == set(blocked)
    few = edges(spark, canopies=[small])
    assert len(few) == 20 - sum(4.9 - 0.4 <= i / 2 + 0.25 <= 5.1 + 0.4 for i in range(20)) < 20
    second = edges(spark, HopParams(young_penalty=70.0), canopies=[small])
    assert set(second) == set(free) and {r.tier for k, r in second.items() if k not in few} == {2}
    assert all(r.cost == pytest.approx(71.5) for k, r in second.items() if k not in few)
    # two rows between the cells are no single hop
    two = [(1, 0.0, 5.0, 10.0, 5.0), (2, 0.0, 5.4, 10.0, 5.4)]
    assert all(r.crossed == 1 for r in edges(spark, rows=two).values()) and (8, 11) not in edges(spark, rows=two)
    # a row not longer than a step, and a world without rows
    assert not edges(spark, rows=[(1, 1.0, 5.0, 1.4, 5.0)]) and not edges(spark, rows=[])


def test_chains_cross_rows_that_line_up(spark):
    rows = [(k, 0.0, y, 10.0, y) for k, y in enumerate((2.5, 5.0, 7.5))]
    got = edges(spark, HopParams(rows_max=3), rows=rows)
    assert {r.crossed for r in got.values()} == {1, 2, 3}
    assert all(r.cost == pytest.approx((r.high % 1000 - r.low % 1000) / 2 + 50 * r.crossed) for r in got.values() if r.low // 1000 == r.high // 1000)
    assert max(edges(spark, HopParams(rows_max=1), rows=rows).values(), key=lambda r: r.crossed).crossed == 1
    # any canopy in the corridor, however small, stops a crossing of several rows
    small = edges(spark, HopParams(rows_max=3, young_penalty=70.0), rows=rows, canopies=[(4.9, 4.9, 5.1, 5.1)])
    assert all(abs((r.low // 1000 + r.high // 1000) / 4 + 0.25 - 5.0) > 0.5 for r in small.values() if r.crossed > 1 and r.low // 1000 == r.high // 1000 and r.low % 1000 < 10 <= r.high % 1000)
    # gaps that don't line up: the middle row is walkable only 2 m further on
    side = {(i, j) for i in range(20) for j in (8, 11) if i < 14} | {(i, j) for i in range(20) for j in (3, 6) if i > 8}
    apart = edges(spark, HopParams(rows_max=2), rows=rows[:2], skip=side)
    assert apart and {r.crossed for r in apart.values()} == {1}


def test_lines_pass_their_cells(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    lines = [tuple(map(float, v)) for v in rng.uniform(-9, 9, (60, 4))] + [(1.0, -5.0, 1.0, 5.0), (-3.0, 2.0, 6.0, 2.0), (0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(lines, BOX)
    for r in df.withColumn("c", H.line_cells(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], 2.0)).collect():
        cells = {(c.i, c.j) for c in r.c}
        for t in np.linspace(0, 1, 301):
            x, y = r.x0 + t * (r.x1 - r.x0), r.y0 + t * (r.y1 - r.y0)
            assert (int(np.floor(x / 2)), int(np.floor(y / 2))) in cells
        assert len(cells) <= 14 + 12
