"""Geometry, raster and graph kernels: closed forms, brute force, invariants, and controls that must fail."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import geometry as G
from tessella.functions import rasters as R
from tessella.operators import graph

SQUARE = np.array([[0, 0], [2, 0], [2, 2], [0, 2.0]])


def star(seed, n=9):
    """A ring that doesn't cross itself: no gap between its angles reaches half a turn."""
    rng = np.random.default_rng(seed)
    a = (np.arange(n) + 0.9 * rng.random(n)) * 2 * math.pi / n
    r = 1 + 3 * rng.random(n)
    return np.column_stack((r * np.cos(a), r * np.sin(a)))


def test_areas():
    assert G.area(SQUARE) == 4 and G.union_area([SQUARE, SQUARE + 1]) == pytest.approx(7) and G.intersection_area(SQUARE, SQUARE + 1) == pytest.approx(1)
    assert G.iou(SQUARE, SQUARE) == pytest.approx(1) and G.iou(SQUARE, SQUARE + 5) == 0


def test_crossing_rings_have_even_odd_areas():
    bow = np.array([[0, 0], [4, 4], [4, 0], [0, 4.0]])
    assert G.area(bow) == 0 and G.union_area([bow]) == pytest.approx(8)
    assert G.iou(bow, bow) == pytest.approx(1) and G.iou(bow, SQUARE * 2) == pytest.approx(0.5)


@settings(max_examples=25, deadline=None, derandomize=True)
@given(st.integers(0, 10_000), st.integers(0, 10_000), st.floats(-3, 3))
def test_overlay_invariants(a, b, shift):
    p, q = star(a), star(b) + shift
    both, either = G.intersection_area(p, q), G.union_area([p, q])
    assert both + either == pytest.approx(G.area(p) + G.area(q), rel=1e-6)
    assert G.iou(p, q) == pytest.approx(G.iou(p + 100, q + 100), abs=1e-6)
    assert either <= G.area(p) + G.area(q) + 1e-9


def test_clip():
    box = (0.0, 0.0, 2.0, 2.0)
    assert G.area(G.clip_polygon(SQUARE + 1, box)) == pytest.approx(1)
    assert len(G.clip_polygon(SQUARE + 9, box)) == 0
    a, b = G.clip_line(np.array([-1.0, 1]), np.array([3.0, 1]), box)
    assert a.tolist() == [0, 1] and b.tolist() == [2, 1]
    assert G.clip_line(np.array([-1.0, 3]), np.array([3.0, 3]), box) is None


def test_retraced_metres_count_twice():
    assert G.length_in(np.array([[-1, 1], [3, 1], [-1, 1.0]]), SQUARE) == pytest.approx(4)
    assert G.length_in(np.array([[-1, 3], [3, 3.0]]), SQUARE) == 0


def test_axis_share():
    line = np.array([[0, 0], [10, 0.0]])
    assert G.axis_share(line, line + [0, 0.35]) == pytest.approx(1) and G.axis_share(line, line + [0, 0.6]) == 0
    assert G.axis_share(line, np.array([[5, 0], [15, 0.0]]), 0.4) == pytest.approx(0.54, abs=0.01)


def test_rectangle_hull_simplify():
    c, s = math.cos(0.4), math.sin(0.4)
    pts = np.array([[0, 0], [6, 0], [6, 2], [0, 2], [3, 1.0]]) @ np.array([[c, s], [-s, c]])
    assert G.min_rectangle(pts) == pytest.approx((6, 2))
    assert len(G.hull(pts)) == 4
    assert len(G.simplify(np.array([[0, 0], [1, 0.01], [2, 0], [3, 1.0]]), 0.02)) == 3


def test_projection_round_trip():
    lon, lat = np.meshgrid(np.linspace(25, 29.5, 9), np.linspace(45, 49, 9))
    x, y = G.to_utm(lon, lat)
    a, b = G.from_utm(x, y)
    assert np.abs(a - lon).max() * 111_320 < 1e-3 and np.abs(b - lat).max() * 111_320 < 1e-3
    assert G.to_utm(np.array([27.0]), np.array([47.0]))[0][0] == pytest.approx(500_000)
    assert abs(G.to_utm(np.array([28.7]), np.array([47.1]), 36)[0][0] - G.to_utm(np.array([28.7]), np.array([47.1]), 35)[0][0]) > 100_000


def test_labels_and_outlines():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.2, 0.5, 1.0):
        m = rng.random((20, 31)) < share
        lab, n = R.labels(m)
        seen, k = np.zeros(m.shape, int), 0
        for i, j in zip(*np.nonzero(m), strict=True):
            if seen[i, j]:
                continue
            k += 1
            stack = [(i, j)]
            seen[i, j] = k
            while stack:
                a, b = stack.pop()
                for x, y in itertools.product(range(max(0, a - 1), min(20, a + 2)), range(max(0, b - 1), min(31, b + 2))):
                    if m[x, y] and not seen[x, y]:
                        seen[x, y] = k
                        stack.append((x, y))
        assert n == k and (lab == seen).all()
        signed = sum((np.dot(q[:, 0], np.roll(q[:, 1], -1)) - np.dot(np.roll(q[:, 0], -1), q[:, 1])) / 2 for q in R.outlines(m))
        assert abs(signed) == pytest.approx(m.sum())


def test_morphology_and_distance():
    rng = np.random.default_rng(1)
    m = rng.random((24, 24)) < 0.5
    d = R.disk(2.2)
    assert (R.opened(m, d) <= m).all() and (m <= R.closed(m, d)).all()
    assert (R.opened(R.opened(m, d), d) == R.opened(m, d)).all()
    ring = np.ones((7, 7), bool)
    ring[3, 3] = False
    assert R.without_holes(ring).all() and not R.without_holes(np.pad(ring, 1))[0, 0]
    pts = np.argwhere(m)
    brute = np.sqrt(((np.argwhere(np.ones_like(m))[:, None] - pts[None]) ** 2).sum(2).min(1)).reshape(m.shape)
    assert np.allclose(R.distances(m), brute)
    assert np.isinf(R.distances(np.zeros((3, 3), bool))).all() or R.distances(np.zeros((3, 3), bool)).min() > 3
    seed = np.zeros_like(m)
    seed[tuple(pts[0])] = True
    assert (R.reconstructed(seed, m) == (R.labels(m)[0] == R.labels(m)[0][tuple(pts[0])])).all()


def test_blur_and_sampling():
    a = np.zeros((21, 21))
    a[10, 10] = 1
    b = R.blur(a, 1.5)
    assert b[10, 10] == b.max() and b.sum() == pytest.approx(1, rel=1e-3)
    half = np.ones((21, 21), bool)
    half[:, :10] = False
    assert np.allclose(R.blur(np.ones((21, 21)), 1.5, half)[:, 10:], 1)
    g = np.arange(12.0).reshape(3, 4)
    assert R.sample(g, np.array([0.5, 1.0, 9.0]), np.array([0.5, 2.0, 9.0]), -1.0).tolist() == [2.5, 6.0, -1.0]
    assert R.block_mean(np.arange(16.0).reshape(4, 4), 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]


def test_spectra():
    x = np.arange(200) * 0.1
    assert R.profile_spacing(np.sin(2 * np.pi * x / 2.5), 0.1, 2.0, 3.6)[0] == pytest.approx(2.5, abs=0.02)
    rows = np.sin(2 * np.pi * np.arange(128)[None, :] * 0.2 / 2.5) * np.ones((128, 1))
    wide = np.sin(2 * np.pi * np.arange(128)[None, :] * 0.2 / 5.0) * np.ones((128, 1))
    inside, outside = (R.row_energy(a, 0.2, 2.0, 3.6)[0][64, 64] for a in (rows, wide))
    assert inside > 5 * outside and R.row_energy(wide, 0.2, 3.8, 7.0)[0][64, 64] > outside
    assert R.row_energy(rows, 0.2, 2.0, 3.6)[1][64, 64] == 0 and R.row_energy(rows.T.copy(), 0.2, 2.0, 3.6)[1][64, 64] == 6


def test_blobs_and_pictures():
    m = np.zeros((20, 30), bool)
    m[2:6, 3:15] = True
    m[10:14, 20:24] = True
    lab, n = R.labels(m)
    f = R.blob_features(lab, n, m.astype(float), 0.5)
    assert f["area_m2"].tolist() == [12.0, 4.0] and f["length_m"].tolist() == pytest.approx([6, 2]) and f["width_m"].tolist() == pytest.approx([2, 2])
    assert R.rasterise(np.array([[2, 2], [10, 2], [10, 8], [2, 8.0]]), 12, 12).sum() == 48
    assert R.png(R.colour_ramp(np.array([[0.0, np.nan], [0.5, 1.0]]), [(0, "#000000"), (1, "#ff0000")])).startswith(b"\x89PNG")


def test_tiles_kernel(spark):
    a = np.arange(16, dtype=np.float32).reshape(4, 4)
    df = spark.createDataFrame([("t", 4, 4, bytearray(a.tobytes()))], "name string, height int, width int, data binary")
    r = R.on_tiles(df, lambda x: R.block_mean(x, 2)).first()
    assert np.frombuffer(r["data"], np.float32).tolist() == [2.5, 4.5, 10.5, 12.5]


def grid(spark, wall):
    cells = [(r, c, 1.0) for r in range(20) for c in range(20) if not (c == 10 and wall and r != 15)]
    return spark.createDataFrame(cells, "r int, c int, cost double")


def test_shortest_paths(spark):
    node = lambda r, c: r * (1 << 20) + c
    targets = spark.createDataFrame([(node(0, 0),), (node(0, 19),)], "node long")
    free, walled = ({(r["src"], r["dst"]): r["cost"] for r in graph.shortest_paths(graph.grid_edges(grid(spark, w)), targets, targets).collect()} for w in (False, True))
    k = (node(0, 0), node(0, 19))
    assert free[k] == pytest.approx(19) and free[k[::-1]] == free[k]
    # through the only gap: up to its column's neighbour, straight through the corner-blocked wall, and back
    assert walled[k] == pytest.approx(2 * (6 * 1 + 9 * math.sqrt(2)) + 7 - 0, abs=8) and walled[k] > 2 * 15
    closed = graph.grid_edges(grid(spark, True).where("NOT (r = 15 AND c = 10)"))
    assert k not in {(r["src"], r["dst"]) for r in graph.shortest_paths(closed, targets, targets).collect()}


def test_tours():
    rng = np.random.default_rng(3)
    p = rng.random((7, 2))
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    best = min(graph.tour_length(d, [0, *x]) for x in itertools.permutations(range(1, 7)))
    t = graph.tour(d)
    assert sorted(t) == list(range(7)) and graph.tour_length(d, t) <= 1.05 * best
    groups = [[0], [1, 2], [3, 4], [5]]
    path = graph.cheapest_choice(d, groups)
    cost = lambda q: sum(d[a, b] for a, b in itertools.pairwise(q))
    assert cost(path) == pytest.approx(min(cost(q) for q in itertools.product(*groups)))


def test_budget():
    d = np.ones((5, 5)) * 10
    out = np.zeros((5, 5))
    out[3, :] = out[:, 3] = 5
    keep, gone = graph.fit_budget(d, out, [0, 1, 2, 3, 4])
    assert gone == [3] and sorted(keep) == [0, 1, 2, 4]


def test_route_check():
    walk = np.array([[0, 0], [50, 0], [0, 0.0]])
    ok = graph.check_route(walk, np.array([[10, 1], [40, 3.0]]), 1.0, 0.0, 0.0, walk[0], walk[-1])
    far = graph.check_route(walk, np.empty((0, 2)), 1.0, 0.5, 0.0, walk[0] + 9, walk[-1])
    assert far["scores"] and not far["legal"] and not far["closed"]  # the score asks for the share outside alone
    still = graph.check_route(walk[:1], np.empty((0, 2)), 0.0, 0.0, 0.0, walk[0], walk[0])
    assert still["outside_share"] == 1.0 and not still["scores"]
    assert ok["visited"] == 1 and ok["legal"] and ok["closed"] and ok["scores"]
    assert not graph.check_route(walk, np.empty((0, 2)), 3.0, 0.0, 0.0, walk[0], walk[-1])["legal"]
    assert not graph.check_route(walk, np.empty((0, 2)), 0.0, 0.0, 0.0, walk[0] + 9, walk[-1])["closed"]
    assert graph.first_pass(walk, np.array([20.0, 0]), 2.0) == pytest.approx(18) and math.isnan(graph.first_pass(walk, np.array([20.0, 9]), 2.0))


def field_picture():
    """256 x 256 at 0.1 m: green rows 2.5 m apart, a tree, a white blob, a dark margin."""
    rgb = np.full((256, 256, 3), (120, 110, 100), np.uint8)
    y, x = np.mgrid[:256, :256]
    rgb[(x % 25 < 6) & (y < 200)] = (60, 130, 50)
    rgb[(x - 60) ** 2 + (y - 228) ** 2 < 24**2] = (50, 120, 45)
    rgb[100:104, 65:71] = (250, 250, 250)
    rgb[:, 246:] = 0
    return rgb


def test_detectors():
    from tessella.functions import imagery as I

    rgb = field_picture()
    assert not I.visible(rgb)[:, 246:].any() and I.visible(rgb)[:, :240].all()
    deg, spacing = I.row_angle(I.excess_green(rgb)[:200, :200], 0.1, 2.0, 3.6)
    assert abs(deg - 90) <= 1 and spacing == pytest.approx(2.5, abs=0.05)
    blobs = I.bright_blobs(rgb, 0.1)
    assert len(blobs) == 1 and blobs["area_m2"][0] == pytest.approx(0.24) and abs(blobs["row"][0] - 101.5) < 0.1
    t = I.trees(rgb, 0.1)
    assert len(t) == 1 and abs(t["col"][0] - 60) < 1 and t["width_m"][0] > 4
    tube = (np.mgrid[:256, :256][1] % 25 < 10) & (np.mgrid[:256, :256][0] < 200)
    mask = I.canopy_mask(rgb, tube, 0.1, lively=0.0)
    assert (mask == ((I.excess_green(rgb) > 0.1) & tube)).mean() > 0.99
    pale = rgb.copy()
    pale[(np.mgrid[:256, :256][1] < 6) & (np.mgrid[:256, :256][0] < 200)] = (118, 124, 60)
    assert not I.canopy_mask(pale, tube, 0.1, lively=20.0)[:200, :6].any() and I.canopy_mask(pale, tube, 0.1, lively=20.0)[:200, 25:31].all()


def test_planted_regions():
    from tessella.functions import imagery as I

    orientation = np.zeros((60, 80), int)
    orientation[:, 40:] = 6
    near = np.zeros((60, 80))
    near[5:55, 5:75] = 1.0
    found = I.planted_regions(near, np.zeros((60, 80)), orientation, 1.0, 0.5)
    assert sorted(m for _, m in found) == [0, 6] and all(mask.sum() > 1500 for mask, _ in found)
    assert I.planted_regions(near, near * 2, orientation, 1.0, 0.5) == []  # an orchard's spacing


def test_scoped_routes(spark):
    rng = np.random.default_rng(5)
    ids = ["start", *"abcdef"]
    xy = dict(zip(ids, rng.random((7, 2)) * 100, strict=True))
    pairs = [(p, q, float(np.hypot(*(xy[p] - xy[q]))), 30.0 if "f" in (p, q) else 0.0) for p in ids for q in ids if p != q]
    targets = [("site", x, c) for x, c in zip("abcdef", (0.9, 0.6, None, 0.4, 0.8, 0.95), strict=True)] + [("A", x, 0.9) for x in "ab"]
    out = graph.scoped_routes(spark.createDataFrame(pairs, "a string, b string, cost double, outside double"), spark.createDataFrame(targets, "scope string, id string, confidence double")).toPandas()
    one = lambda s, c: out[(out["scope"] == s) & (out["min_confidence"].isna() if c is None else out["min_confidence"] == c)]
    assert set(one("site", 0.7)["id"]) == {"start", "a", "c", "e", "f"} and set(one("A", None)["id"]) == {"start", "a", "b"}
    assert one("site", None).set_index("id")["place"].isna()["f"] and one("site", None)["place"].notna().sum() == 6
    assert one("site", 0.7)["length_m"].iloc[0] <= one("site", None)["length_m"].iloc[0] + 1e-9


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 10_000))
def test_pieces(a, b):
    p, q = star(a), star(b) + 1.0
    left, both = G.difference(p, [q]), G.intersection(p, q)
    assert sum(map(G.area, left)) == pytest.approx(G.area(p) - G.intersection_area(p, q), abs=1e-6)
    assert sum(map(G.area, both)) == pytest.approx(G.intersection_area(p, q), abs=1e-6)
    assert all(not G.contains(q, r.mean(0)[None])[0] and G.contains(p, r.mean(0)[None])[0] for r in left if G.area(r) > 1e-6)


def test_hole_and_slices():
    hole = SQUARE / 2 + 0.5
    parts = G.difference(SQUARE, [hole])
    assert len(parts) == 4 and sum(map(G.area, parts)) == pytest.approx(3)
    assert G.difference(SQUARE, [hole], least=1.5) == []
    cut = G.slices(SQUARE, np.array([1.0, 0.0]), 0.8)
    assert [k for k, _, _ in cut] == [0, 1, 2] and sum(a for _, a, _ in cut) == pytest.approx(4) and cut[0][2].tolist() == pytest.approx([0.4, 1.0])
    turned = G.slices(SQUARE, np.array([1.0, 1.0]), 1.0)
    assert sum(a for _, a, _ in turned) == pytest.approx(4)


def test_row_kernels():
    from tessella.functions import rows as K

    assert K.without_close(np.array([0, 2.5, 3.2, 5.0]), np.array([1, 1, 0.2, 1]), 2.5).tolist() == [0, 1, 3]
    rng = np.random.default_rng(3)
    for _ in range(40):
        at, green = rng.choice(np.arange(60) / 4, 25, replace=False), rng.random(25)
        kept = sorted(range(25), key=lambda i: at[i])
        while True:  # the rule, literally
            pairs = [(at[b] - at[a], k) for k, (a, b) in enumerate(zip(kept[:-1], kept[1:], strict=True))]
            size, k = min(pairs, default=(9.0, 0))
            if size >= 0.7:
                break
            kept.pop(k if green[kept[k]] < green[kept[k + 1]] else k + 1)
        assert K.without_close(at, green, 1.0).tolist() == sorted(kept)
    assert K.without_close(np.empty(0), np.empty(0), 1.0).tolist() == []
    e = np.array([1, 0, 0, 1, 1, 1, 0, 1, 0, 0, 0, 0, 1.0])
    assert K.grown(e, (4, 5), 0.5, 2) == (0, 8) and K.grown(e, (4, 5), 0.5, 0) == (3, 6)
    assert K.grown_rows(np.array([[1, 1], [0, 0], [1, 1], [1, 0.9], [1, 1.0]]), 3, 0.5) == [2, 3, 4]
    w = np.array([1, 3, 5, 3, 0.5, 3, 5, 3, 1.0])
    assert K.split_at_necks(w, 0.3, 2) == [(0, 4), (4, 9)] and K.split_at_necks(w, 0.05, 2) == [(0, 9)]


def test_open_tour_and_outside(spark):
    x = np.array([0.0, 3, 1, 2, 4])
    d = np.abs(x[:, None] - x[None])
    assert graph.open_tour(d, 0, 4) == [0, 2, 3, 1, 4]
    steps = spark.createDataFrame([("a", 0.0, 0.5, 8.0, 0.5), ("b", 0.0, 0.5, 4.0, 0.5)], "id string, x0 double, y0 double, x1 double, y1 double")
    ok = spark.createDataFrame([(0, c) for c in range(4)], "row int, col int")
    assert {r["id"]: r["outside"] for r in graph.outside_share(steps, ok, 1.0).collect()} == {"a": 0.5, "b": 0.0}


def test_shortest_paths_in_waves():
    """Against relaxing every edge again and again; predecessors carry the distances; nodes out of reach stay so."""
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (30, 40), (60, 400)):
        edges = pd.DataFrame({"src": rng.integers(0, n, m), "dst": rng.integers(0, n, m), "cost": rng.integers(0, 6, m) / 2})
        edges = pd.concat([edges, pd.DataFrame({"src": [0], "dst": [n - 1], "cost": [50.0]})])
        ids, start, near, cost = graph.compressed(edges)
        best, pred = graph.dijkstra(start, near, cost, 0)
        want = np.full(len(ids), np.inf)
        want[0] = 0
        src = np.repeat(np.arange(len(ids)), np.diff(start))
        for _ in ids:
            np.minimum.at(want, near, want[src] + cost)
        assert np.allclose(best, want)
        for v in np.flatnonzero(pred >= 0):
            assert any(src[e] == pred[v] and near[e] == v and np.isclose(best[pred[v]] + cost[e], best[v]) for e in range(len(cost)))
            assert graph.trace(pred, v)[0] == 0


def test_moved_edges_and_shortest_line():
    from tessella.functions import geometry as g

    tri = np.array([[0, 0], [4, 0], [0, 3.0]])
    out = g.moved_edges(tri, np.array([1.0, 1.0, 1.0]))
    r = 1.0  # the inner circle's radius grows by the move: areas go with its square
    assert g.area(out) == pytest.approx(6 * ((1 + r) / 1) ** 2)
    assert g.area(g.moved_edges(tri[::-1], np.array([0.0, 0.0, 2.0]))) > 6 and len(g.moved_edges(tri, np.full(3, -1.1))) == 0
    one = g.moved_edges(np.array([[0, 0], [4, 0], [4, 2], [0, 2.0]]), np.array([0.0, 1.5, 0, 0]))
    assert g.area(one) == pytest.approx(11)
    a, b = np.array([[0, 0], [2, 0], [2, 2], [0, 2.0]]), np.array([[5, 1], [7, 0], [7, 3.0]])
    p, q = g.shortest_line(a, b)
    assert np.hypot(*(p - q)) == pytest.approx(3) and p.tolist() == [2, 1] and q.tolist() == [5, 1]
    assert np.hypot(*np.subtract(*g.shortest_line(a, a + 1))) == 0


def test_solved_by_measured_legs():
    """Legs that the estimate overrates come back once they are measured; what is really outside goes, a run at a time."""
    rng = np.random.default_rng(7)
    xy = rng.random((9, 2)) * 100
    cost = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    true = np.zeros((9, 9))
    true[[7, 8], :] = true[:, [7, 8]] = 40.0
    estimate = np.where(true > 0, true, 0.4)  # far too careful everywhere
    asked = []
    keep, gone, metres, fits = graph.solved(cost, estimate, lambda a, b: asked.append((a, b)) or true[a, b])
    assert fits and metres == 0 and set(gone) >= {7, 8} and len(set(asked)) == len(asked) and set(keep) | set(gone) == set(range(9))
    keep, gone, metres, fits = graph.solved(cost, true / 2, lambda a, b: true[a, b])
    assert fits and sorted(gone) == [7, 8] and sorted(keep) == list(range(7))
