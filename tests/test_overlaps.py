"""Overlap removal against the same done plot by plot in Python."""

import numpy as np
import pytest

from tessella.operators import masks as M
from tessella.operators import overlaps as V
from tessella.scratch import Scratch

BOX = "k string, x0 long, y0 long, x1 long, y1 long"


def parts(s):
    out, left = [], set(s)
    while left:
        todo, part = [left.pop()], set()
        while todo:
            i, j = todo.pop()
            part.add((i, j))
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(part)
    return out


def sequential(plots, field, least, whole):
    """({k: cells kept}, {k: covered})"""
    kept, covered, taken = {}, {}, {}
    for k in sorted(plots, key=lambda k: (-len(plots[k]), k)):
        ground = taken.setdefault(field[k], set())
        rest = plots[k] - ground
        covered[k] = len(plots[k]) - len(rest)
        if 2 * covered[k] > len(plots[k]):
            continue
        if whole and rest and covered[k]:
            best = sorted(parts(rest), key=len)
            assert len(best) == 1 or len(best[-1]) > len(best[-2])  # equal parts are told apart by a hash only
            rest = best[-1]
        if len(rest) >= least:
            kept[k] = rest
            ground |= rest
    return kept, covered


@pytest.mark.parametrize("whole", [True, False])
def test_bigger_plots_keep_their_ground(spark, whole):
    rng = np.random.default_rng(4)
    rows, field = [], {}
    for n in range(36):
        k = f"p{n:02d}"
        field[k] = n % 3
        # plots of two boxes, some across tiles; some are the same size
        for _ in range(2):
            x, y, w, h = (int(v) for v in (*rng.integers(30, 100, 2), *rng.integers(3, 40, 2)))
            rows.append((k, x, y, x + w, y + h))
    # a cross: the long bar parts the wide one unequally; a copy, one inside another, and one that stands alone
    rows += [("bar", 500, 0, 510, 300), ("wide", 460, 100, 560, 120), ("wide2", 460, 100, 560, 120), ("in", 501, 5, 504, 9), ("alone", 900, 900, 905, 905), ("tiny", 700, 700, 701, 702)]
    field |= dict.fromkeys(("bar", "wide", "wide2", "in", "alone", "tiny"), 7)
    plots = {}
    for k, x0, y0, x1, y1 in rows:
        plots.setdefault(k, set()).update((i, j) for i in range(x0, x1) for j in range(y0, y1))
    want, covered = sequential(plots, field, 5, whole)
    scratch = Scratch(spark, "plots")
    tiles, verdicts = V.without_overlaps(M.from_boxes(spark.createDataFrame(rows, BOX).repartition(3), "k"), spark.createDataFrame(list(field.items()), "k string, field int"), 5, scratch, whole)
    got = {}
    for k, i, j in M.cells(tiles).collect():
        got.setdefault(k, set()).add((i, j))
    assert got == want and {"wide2", "in", "tiny"}.isdisjoint(want) and (len(want["wide"]) == 1000) == whole
    v = {r.k: r for r in verdicts.collect()}
    assert {k: r.covered for k, r in v.items()} == covered and {k: r.cells for k, r in v.items()} == {k: len(s) for k, s in plots.items()}
    assert {k: r.left for k, r in v.items() if r.kept} == {k: len(s) for k, s in want.items()}


def test_largest_parts_over_tiles(spark):
    """Spirals and combs that leave and enter tiles, and parts of one tile that hang together in another."""
    rows = [("comb", 0, 0, 200, 2), *[("comb", 4 * n, 0, 4 * n + 2, 150) for n in range(20)], ("comb", 300, 300, 340, 390)]
    rows += [("u", 10, 10, 14, 100), ("u", 50, 10, 54, 100), ("u", 10, 96, 54, 100), ("u", 20, 10, 44, 30), ("dots", 63, 63, 64, 64), ("dots", 64, 64, 66, 66)]
    cells = {}
    for k, x0, y0, x1, y1 in rows:
        cells.setdefault(k, set()).update((i, j) for i in range(x0, x1) for j in range(y0, y1))
    scratch = Scratch(spark, "parts")
    got = {}
    for k, i, j in M.cells(V.largest_parts(M.from_boxes(spark.createDataFrame(rows, BOX), "k"), scratch)).collect():
        got.setdefault(k, set()).add((i, j))
    assert got == {k: max(parts(s), key=len) for k, s in cells.items()}
    rng = np.random.default_rng(0)
    for _ in range(50):
        grid = rng.random((64, 64)) < rng.random()
        marks, n = V.labelled(grid)
        assert n == len(parts({tuple(x) for x in np.argwhere(grid)})) and (marks > 0).tolist() == grid.tolist()


def test_no_plots(spark):
    none = spark.createDataFrame([], BOX)
    tiles, verdicts = V.without_overlaps(M.from_boxes(none, "k"), spark.createDataFrame([], "k string, field int"), 5, Scratch(spark, "none"))
    assert tiles.count() == 0 and verdicts.count() == 0
