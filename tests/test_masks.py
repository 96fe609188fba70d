"""Cell sets in tiles against sets of cells in Python, over tile sides, corners and keys."""

import numpy as np
import pytest

from tessella.operators import masks as M

BOX = "k string, x0 long, y0 long, x1 long, y1 long"


def boxes(seed, n=14):
    rng = np.random.default_rng(seed)
    lo = rng.integers(-80, 140, (n, 2))
    rows = [("ab"[i % 2], *map(int, (x, y, x + w, y + h))) for i, ((x, y), (w, h)) in enumerate(zip(lo, rng.integers(0, 40, (n, 2)), strict=True))]
    # sides of tiles, one cell, a gap that closing bridges across a side, a copy, nothing, no key
    return [*rows, ("a", 60, 60, 64, 68), ("a", 66, 60, 70, 68), ("b", 127, 127, 128, 128), rows[0], ("a", 5, 5, 5, 9), (None, 0, 0, 3, 3)]


def filled(rows):
    return {(k, i, j) for k, x0, y0, x1, y1 in rows if k is not None for i in range(x0, x1) for j in range(y0, y1)}


def around(reach, round_):
    return [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if not round_ or a * a + b * b <= reach * reach]


def dilated(s, reach, round_=True):
    return {(k, i + a, j + b) for k, i, j in s for a, b in around(reach, round_)}


def eroded(s, reach, round_=True):
    return {(k, i, j) for k, i, j in s if all((k, i + a, j + b) in s for a, b in around(reach, round_))}


def got(tiles):
    rows = [tuple(r) for r in M.cells(tiles).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("reach,round_", [(0, True), (1, False), (3, True), (9, False)])
def test_growing_and_shrinking(spark, reach, round_):
    rows = boxes(reach)
    tiles = M.from_boxes(spark.createDataFrame(rows, BOX).repartition(3), "k").cache()
    s = filled(rows)
    assert got(tiles) == s
    assert got(M.grown(tiles, reach, round_)) == dilated(s, reach, round_)
    assert got(M.shrunk(tiles, reach, round_)) == eroded(s, reach, round_)
    assert got(M.closed(tiles, reach, round_)) == eroded(dilated(s, reach, round_), reach, round_) >= s


def test_a_tiles_whole_reach(spark):
    tiles = M.from_boxes(spark.createDataFrame([("a", 63, 63, 64, 64)], BOX), "k")
    assert got(M.grown(tiles, 64)) == dilated({("a", 63, 63)}, 64)
    with pytest.raises(ValueError, match="more than a tile"):
        M.grown(tiles, 65)


def test_sets_and_spaces(spark):
    one, two, three = (boxes(s) for s in (5, 6, 7))
    df = lambda rows: spark.createDataFrame(rows, BOX).repartition(2)
    a, b, c = filled(one), filled(two), filled(three)
    assert got(M.combined([M.from_boxes(df(one), "k"), M.from_boxes(df(two), "k")], M.from_boxes(df(three), "k"))) == (a | b) - c
    assert got(M.robust_space(df(one), df(two), df(three), "k", 1, 2)) == (eroded(dilated(a, 1, False), 3) | b) - c
    # b has blocks of its own, a only inter-rows; a block without area is none
    blocks = [r for r in two if r[0] == "b"] + [("a", 4, 4, 4, 9)]
    want = filled(blocks) | {x for x in eroded(dilated(a, 2), 2) if x[0] == "a"}
    assert got(M.field_masks(df(blocks), df(one), "k", 2)) == want
    none = df(one).where("false")
    assert got(M.field_masks(none, none, "k", 2)) == set() and got(M.closed(M.from_boxes(none, "k"), 3)) == set()


def test_one_crowded_tile(spark):
    """60,000 boxes in one tile, of which a few are different."""
    df = spark.range(60_000).selectExpr("'a' AS k", "id % 7 AS x0", "id % 5 AS y0", "id % 7 + 2 AS x1", "id % 5 + 3 AS y1")
    assert got(M.closed(M.from_boxes(df, "k"), 4)) == eroded(dilated({("a", i, j) for i in range(8) for j in range(7)}, 4), 4)
