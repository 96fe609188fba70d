"""Row inspection, scores, roll-up and sources on small synthetic fields, with controls that must fail."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import inspection as I
from tessella.operators import joins as J
from tessella.operators import rollup, sequences, stats
from tessella.sources import features as S


def samples(spark, rows):
    """rows: {row_id: [(start, end) of holes in samples]} of 400 samples (20 m)."""
    out = []
    for k, (row, holes) in enumerate(rows.items()):
        for i in range(400):
            bare = any(a <= i < b for a, b in holes)
            out.append(("V1", row, i, i * 0.05, 2.5 * k, not bare, not bare, True, False))
    return spark.createDataFrame(out, "vineyard_id string, row_id string, i int, x double, y double, canopy boolean, green boolean, seen boolean, dark boolean")


def test_gaps(spark):
    s = samples(spark, {"V1a-R001": [(100, 220)], "V1a-R002": [(100, 198)], "V1a-R003": [(260, 400)], "V1a-R004": [], "V1a-R005": [], "V1b-R001": [(0, 399)]})
    none = spark.createDataFrame([], "vineyard_id string, threshold double")
    gaps = {(r["row_id"], r["kind"], r["gap_m"]) for r in I.row_gaps(s, none).collect()}
    assert gaps == {("V1a-R001", "interior", 6.0), ("V1a-R003", "end", 7.0)}  # 4.9 m is no gap; a row planted under 1 m is left out
    tight = spark.createDataFrame([("V1", 3.5)], "vineyard_id string, threshold double")
    assert ("V1a-R002", "interior", 4.9) in {(r["row_id"], r["kind"], r["gap_m"]) for r in I.row_gaps(s, tight).collect()}
    shared = samples(spark, {f"V1a-R00{i}": [(260, 400)] for i in range(1, 6)})
    assert I.row_gaps(shared, none).count() == 0  # an end that all rows share is no gap
    points = I.gap_points(I.gap_measures(I.row_gaps(s, none), s)).toPandas().set_index("row_id")
    assert points.loc["V1a-R001", "confidence"] == 1.0 and points.loc["V1a-R003", "confidence"] == 0.5  # a row's end is in doubt
    assert points["reason"].to_dict() == {"V1a-R001": "gap", "V1a-R003": "planting"} and points["challenge"].all()
    hidden = s.withColumn("seen", F.col("i") % 2 == 0)
    assert I.gap_points(I.gap_measures(I.row_gaps(s, none), hidden)).count() == 0
    y = {r["row_id"]: r["y"] for r in s.select("row_id", "y").distinct().collect()}
    tree = spark.createDataFrame([("t", 8.0, y["V1a-R001"] - 1.5, "tree", 0.9), ("b", 16.0, y["V1a-R003"] + 3.0, "building", 0.2)], "obstacle_id string, x double, y double, kind string, in_block double")
    near = I.gap_points(I.gap_measures(I.row_gaps(s, none), s), tree).toPandas().set_index("row_id")
    assert near.loc["V1a-R001", ["reason", "obstacle_type", "challenge"]].tolist() == ["obstacle", "tree", False] and near.loc["V1a-R003", "reason"] == "planting"  # a building off the block reaches as far as a tree


def test_structure(spark):
    s = samples(spark, {"A": [(100, 220)], "B": [(100, 150), (155, 230)], "C": [], "D": [(0, 400)], "E": [(100, 190)]})
    got = {r["row_id"]: r["row_structure"] for r in I.row_structure(s).collect()}
    assert got == {"A": "disrupted", "B": "disrupted", "C": "regular", "D": "unassessable", "E": "regular"}


def test_pieces(spark):
    p = spark.createDataFrame([("t", "r", 0.0, 4.0, "regular"), ("t", "r", 9.5, 12.0, "regular"), ("t", "q", 0.0, 4.0, "regular"), ("t", "q", 8.0, 9.0, "regular")], "tile string, row_id string, start double, end double, row_structure string")
    got = {(r["row_id"], r["start"]): r["row_structure"] for r in I.disrupted_pieces(p).collect()}
    assert got == {("r", 0.0): "disrupted", ("r", 9.5): "disrupted", ("q", 0.0): "regular", ("q", 8.0): "regular"}


def test_pieces_of_one_start(spark):
    """Of pieces that start together the longest is the next one's neighbour, in whatever order they come."""
    same = [(0.0, 10.0), (0.0, 2.0), (12.0, 13.0)]
    rows = [("t", name, a, b, "regular") for name, ps in (("down", same), ("up", same[1::-1] + same[2:])) for a, b in ps]
    p = spark.createDataFrame(rows, "tile string, row_id string, start double, end double, row_structure string").coalesce(1)
    assert {(r["row_id"], r["row_structure"]) for r in I.disrupted_pieces(p).collect()} == {("down", "regular"), ("up", "regular")}


def test_outer_and_stray_rows(spark):
    rows = spark.createDataFrame([("p", f"r{i}", float(i), c) for i, c in enumerate((0.05, 0.1, 0.6, 0.02, 0.7, 0.6, 0.6, 0.6, 0.1))], "pattern_id string, row_id string, v double, cover double")
    assert {r["row_id"] for r in I.bare_outer_rows(rows).collect()} == {"r0", "r1", "r8"}  # a bare row between good ones stays
    f = spark.createDataFrame([("p", f"r{i}", v, 2.5) for i, v in enumerate((0.0, 2.5, 3.6, 5.0, 7.5))], "pattern_id string, row_id string, v double, step double")
    assert sorted(r["row_id"] for r in I.stray_rows(f).collect()) == ["r0", "r1", "r3", "r4"]
    back = f.withColumn("v", -F.col("v")).unionByName(f.where("row_id < 'r2'").withColumn("pattern_id", F.lit("q")))
    assert sorted((r["pattern_id"], r["row_id"]) for r in I.stray_rows(back).collect()) == [("p", "r0"), ("p", "r1"), ("p", "r3"), ("p", "r4"), ("q", "r0"), ("q", "r1")]


def test_stray_rows_of_long_patterns(spark):
    """Patterns of more rows than a batch or a list takes, against the plain scan; rows without a place stay."""
    rng = np.random.default_rng(5)
    v = np.cumsum(rng.choice([0.3, 0.8, 1.1, 1.3, 2.5], 60_000))
    rows = [(f"p{i // 50_000}", f"r{i:06}", None if i % 997 == 5 else float(x), 2.5) for i, x in enumerate(v)]
    want, last = [], None
    for i, (pattern, row, x, step) in enumerate(rows):
        after = rows[i + 1][2] if i + 1 < len(rows) and rows[i + 1][0] == pattern else None
        if i and rows[i - 1][0] == pattern and None not in (x, last, after):
            a, b = abs(x - last), abs(after - x)
            if max(a, b) < 0.7 * step and 0.7 * step <= a + b <= 1.4 * step:
                continue
        want.append((pattern, row))
        last = x
    f = spark.createDataFrame(rows, "pattern_id string, row_id string, v double, step double").repartition(5)
    assert 40_000 < len(want) < 59_000
    assert sorted((r["pattern_id"], r["row_id"]) for r in I.stray_rows(f).collect()) == want
    assert "collect_list" not in I.stray_rows(f)._jdf.queryExecution().toString()


def test_scores(spark):
    points = spark.createDataFrame([("w1", "A", "waste", 0.0), ("g1", "A", "gap", 6.0), ("g2", "A", "gap", 6.0), ("w2", "B", "waste", 0.0)], "id string, vineyard_id string, kind string, gap_m double")
    log = spark.createDataFrame([(1, "w1", "farmer", "done"), (2, "w1", "inspector", "open"), (3, "g1", "farmer", "planted"), (4, "w1", "farmer", "done")], "seq long, id string, role string, status string")
    records = sequences.fold_events(log, "id", ["seq"], "status", "role").join(log.groupBy("id").agg(F.max_by("role", "seq").alias("role")), "id")
    fields = spark.createDataFrame([("A", 1000.0, 400.0), ("B", 1000.0, 0.0), ("C", 1.0, 1.0)], "vineyard_id string, area_m2 double, row_m double")
    got = {r["vineyard_id"]: r for r in I.scores(points, records, fields).collect()}
    assert (got["A"]["score"], got["A"]["model_score"], got["A"]["waste_open"], got["A"]["missing_open"], got["A"]["to_review"]) == (94, 78, 0, 1, 2)
    assert got["B"]["score"] == 90 and got["C"]["score"] == 100
    assert records.where("id = 'w1'").first()["events"] == 3 and not records.where("id = 'w1'").first()["approved"]


def test_score_limits(spark):
    v = spark.range(1).select(stats.field_score(F.lit(1.0), F.lit(0.0), F.lit(0), F.lit(0.0)).alias("a"), stats.field_score(F.lit(1.0), F.lit(100.0), F.lit(9), F.lit(15.0)).alias("b")).first()
    assert (v["a"], v["b"]) == (100, 0)


def test_zones_and_scenes(spark):
    px = [("P", d, i // 5, i % 5, 0.2 if i in (3, 4) or (d == "2" and i == 9) else 0.6 + 0.01 * (i % 3)) for d in "123" for i in range(25)]
    low = I.low_zones(spark.createDataFrame(px, "plot string, date string, row int, col int, value double")).collect()
    assert {(r["row"], r["col"]) for r in low} == {(0, 3), (0, 4)}
    items = spark.createDataFrame([("s", f"2026-05-{d:02d}", c) for d, c in ((1, 1.0), (9, 1.0), (12, 0.5), (14, 1.0), (16, 1.0), (20, 0.99))], "site string, date string, clear double").withColumn("date", F.col("date").cast("date"))
    assert [str(r["day"]) for r in I.choose_scenes(items).orderBy("rank").collect()] == ["2026-05-20", "2026-05-16", "2026-05-09"]


def test_waste(spark):
    from tessella.operators.rules import waste_tier

    blob = {"kind": "white", "location": None, "area_m2": 0.1, "length_m": 0.3, "width_m": 0.2, "w_m": 0.4, "h_m": 0.2, "lum": 230.0, "lum_std": 12.0, "chroma": 10.0, "dev": 160.0, "hue": 30.0, "fill": 0.5, "ring_green": 0.8, "density": 0.01, "structure": 0.0, "clipped": 0.2, "row_m": 1.0, "forbidden_m": 50.0}
    cases = {
        "strict": {}, "small_bright": {"dev": 120.0}, "pile": {"area_m2": 0.5, "lum": 210.0, "dev": 115.0}, "colour": {"kind": "colour", "chroma": 90.0}, "scrap": {"location": "block", "ring_green": 0.0},
        "white": {"location": "headland", "chroma": 22.0}, "blue": {"location": "outside", "kind": "colour", "hue": 200.0, "lum_std": 25.0},
    }
    none = [{"length_m": 0.7}, {"area_m2": 2.0}, {"kind": "black"}, {"row_m": 0.3}, {"location": "outside", "density": 0.2}, {"location": "outside", "lum": 222.0}, {"location": "block", "structure": 1.0}, {"location": "headland", "forbidden_m": 5.0}]
    rows = [(name, *(blob | c).values()) for name, c in [*cases.items(), *((f"none{i}", c) for i, c in enumerate(none))]]
    types = ", ".join(f"{k} {'string' if k in ('kind', 'location') else 'double'}" for k in blob)
    got = {r["name"]: r["tier"] for r in spark.createDataFrame(rows, f"name string, {types}").select("name", waste_tier().alias("tier")).collect()}
    assert got == {k: k for k in cases} | {f"none{i}": None for i in range(len(none))}
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0, "outside", 1.0, "t2"), (2, 1.0, 1.0, 3.0, 3.0, "block", 2.0, "t1"), (3, 9.0, 9.0, 10.0, 10.0, "outside", 1.0, "t1")], "id long, x0 double, y0 double, x1 double, y1 double, location string, area_m2 double, tile string")
    pairs = J.overlaps(boxes, boxes, [], 4.0, 4.0).select("a", "b")
    members = J.components(boxes.select(F.col("id").alias("node")), pairs).withColumnRenamed("node", "id")
    got = sorted(tuple(r) for r in I.merged_boxes(boxes, members).drop("root").collect())
    assert got == [(0.0, 0.0, 3.0, 3.0, "block", 3.0, ["t1", "t2"]), (9.0, 9.0, 10.0, 10.0, "outside", 1.0, ["t1"])]


def test_verdicts_and_plot_scores(spark):
    v = spark.createDataFrame([("1", "wrong"), ("2", "wrong"), ("3", "right")], "id string, verdict string")
    p = spark.createDataFrame([("1",), ("3",), ("3",)], "verdict_id string")
    assert {tuple(r) for r in I.regressions(p, v).collect()} == {("wrong_still_there", 1), ("wrong_gone", 1), ("right_still_there", 1)}
    b = spark.createDataFrame([("n", x, 4, 4) for x in (0.2, 0.6, 0.8, 0.9)], "half string, iou double, predicted int, reference int")
    assert tuple(I.plot_scores(b).first()) == ("n", 0.75, 0.5, 0.8)  # the upper median


def scene(tmp_path, crs="EPSG:32635"):
    f = lambda label, source, props, geometry: {"type": "Feature", "geometry": geometry, "properties": {"label": label, **({"source": source} if source else {}), **props}}
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": crs}}, "features": [f("row", None, {"row_id": "a"}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}), f("row", "prediction", {"row_id": "b"}, {"type": "Point", "coordinates": [1, 2]})]}
    path = tmp_path / f"scene{len(crs)}.json"
    path.write_text(json.dumps(doc))
    return str(path)


def test_scene_round_trip(spark, tmp_path):
    s = S.read_scene(spark, scene(tmp_path))
    assert [(r["shape"], r["source"]) for r in s.orderBy("shape").collect()] == [("LineString", None), ("Point", "prediction")]
    assert rollup.scored(s).count() == 1  # no source is scored
    S.write_scene(s, f"{tmp_path}/out", ["label", "shape"])
    back = S.read_scene(spark, f"{tmp_path}/out/*.txt")
    key = lambda df: sorted((r["geometry"], sorted(r["properties"].items())) for r in df.collect())
    assert key(back) == key(s)
    with pytest.raises(Exception, match="not a feature collection"):
        S.read_scene(spark, scene(tmp_path, "EPSG:4326")).collect()
    assert S.read_verdicts(spark, f"{tmp_path}/none.json").count() == 0


def test_annotations_round_trip(spark, tmp_path):
    tiles = spark.createDataFrame([("t1.tif", 100.0, 200.0, 0.025)], "name string, left double, top double, px double")
    shapes = [("t1.tif", "polyline", "row", [(101.0, 199.0), (110.0, 190.5)], {"vineyard_id": "V", "pattern_id": "V", "row_id": "V-R1", "row_structure": "regular"}), ("t1.tif", "box", "waste", [(101.0, 199.0), (102.0, 199.0), (102.0, 198.0), (101.0, 198.0)], {"vineyard_id": "", "location": "<block> & more"})]
    df = spark.createDataFrame(shapes, "tile string, tag string, label string, points array<struct<x:double,y:double>>, properties map<string,string>")
    S.write_annotations(df, tiles, f"{tmp_path}/xml")
    back = S.read_annotations(spark, f"{tmp_path}/xml/*.txt", tiles)
    rows = lambda d: sorted((r["tile"], r["tag"], r["label"], [(round(p["x"], 3), round(p["y"], 3)) for p in r["points"]], sorted(r["properties"].items())) for r in d.collect())
    assert rows(back) == rows(df)
    assert S.annotation_problems(df, tiles).count() == 0
    bad = df.withColumn("label", F.when(F.col("tag") == "box", "vineyard").otherwise(F.col("label"))).withColumn("properties", F.when(F.col("tag") == "polyline", F.map_concat(F.map_filter("properties", lambda k, v: k != "row_structure"), F.create_map(F.lit("row_structure"), F.lit("odd")))).otherwise(F.col("properties")))
    assert {r["rule"] for r in S.annotation_problems(bad, tiles).collect()} == {"wrong shape", "attribute set", "domain of row_structure"}
    with pytest.raises(Exception, match="unknown image"):
        S.read_annotations(spark, f"{tmp_path}/xml/*.txt", tiles.withColumn("name", F.lit("other.tif"))).collect()
    numbered = spark.read.text(f"{tmp_path}/xml").select(F.regexp_replace("value", 'name="t1.tif"', 'name="42_t1.tif"').alias("value"))
    numbered.coalesce(1).write.text(f"{tmp_path}/xml2")
    assert rows(S.read_annotations(spark, f"{tmp_path}/xml2/*.txt", tiles)) == rows(df)


def test_inventory(spark, tmp_path):
    for part, names in (("p1.zip", ("a.tif", "b.tif", "note.txt")), ("p2.zip", ("b.tif",))):
        with zipfile.ZipFile(tmp_path / part, "w") as z:
            for n in names:
                z.writestr(n, n * 10)
    got = S.tile_inventory(spark, str(tmp_path))
    assert sorted(r["name"] for r in got.collect()) == ["a.tif", "b.tif", "b.tif"]
    expected = got.where("part = 'p1.zip'").select("name", "size", F.when(F.col("name") == "a.tif", 0).otherwise(F.col("crc")).alias("crc")).union(spark.createDataFrame([("c.tif", 1, 1)], "name string, size long, crc long"))
    assert {tuple(r) for r in S.inventory_problems(got, expected).collect()} == {("a.tif", "changed"), ("b.tif", "duplicate"), ("c.tif", "missing")}


def test_measurements_csv(spark, tmp_path):
    f = spark.createDataFrame([("row", None, "A", "r1", 3.5, None), ("row", None, "A", "r1", 1.5, None), ("row", "prediction", "B", "r2", 9.0, None), ("vineyard", None, "A", None, None, 20000.0)], "label string, source string, vineyard_id string, row_id string, length_m double, area_m2 double")
    S.write_measurements(rollup.measurement_rows(f), f"{tmp_path}/csv")
    lines = [p.read_text().splitlines() for p in (tmp_path / "csv").glob("*.csv")][0]
    assert lines[0].startswith("level,vineyard_id,row_id,block_count") and [x.split(",")[0] for x in lines[1:]] == ["total", "block", "row"]
    assert lines[3].split(",")[2:6] == ["r1", "", "", "5.0"] and lines[1].split(",")[6:8] == ["20000.0", "2.0"]


def test_world_choice(spark):
    f = lambda n, p: spark.createDataFrame([("interrow_area", None)] * n + [("interrow_area", "prediction")] * p + [("start", "organizer"), ("tile", "organizer")], "label string, source string")
    few, many = (rollup.planning_world(f(*x)).groupBy("source").count().collect() for x in ((1, 8), (2, 8)))
    assert {tuple(r) for r in few} == {("dev", 8), ("organizer", 1)} and {tuple(r) for r in many} == {(None, 2), ("organizer", 1)}


def test_scene_operators(spark):
    from tessella.operators import scenes as N

    rows = [("f", f"r{i}", a, 10.0 - i, v) for i, (a, v) in enumerate(((10.0, 0.0), (12.0, 2.5), (178.0, 0.0), (11.0, 5.0), (3.0, 7.0)))]
    got = {r["row_id"]: (r["pattern"], r["step_m"]) for r in N.angle_patterns(spark.createDataFrame(rows, "field string, row_id string, angle double, length double, v double"), 5.0).collect()}
    assert {k: v[0] for k, v in got.items()} == {"r0": 0, "r1": 0, "r3": 0, "r2": 1, "r4": 1} and got["r0"][1] == 2.5
    svg = '<svg><path fill="none" d="M 0 0 L 4 0 L 4 3 L 0 3 Z"/><path fill="red" d="M 0 0 L 9 0 L 9 9 Z"/><path fill="none" d="M 0 0 L 1 0 L 1 1 Z"/></svg>'
    assert [r["area"] for r in N.svg_parcels(spark.createDataFrame([(svg,)], "svg string")).collect()] == [12.0]
    line = N.along(spark.createDataFrame([("a", 0.0, 0.05, 1.0, 0.05)], "id string, x0 double, y0 double, x1 double, y1 double"), 0.25)
    px = spark.createDataFrame([(0, c, c == 5, True) for c in range(10)], "row int, col int, flag boolean, valid boolean")
    hit = {r["i"]: (r["flag"], r["seen"]) for r in N.sampled(line, px, 0.1, (-0.2, 0.0)).collect()}
    assert hit == {0: (False, True), 1: (False, True), 2: (True, True), 3: (False, True), 4: (False, False)}
    b = N.tile_bounds(1, 1, 0)
    assert b[0] == pytest.approx(0) and b[1] == pytest.approx(0) and b[2] == b[3]
    f = spark.createDataFrame([("row", None, "A", "r1", 3.0), ("waste", None, "A", None, None), ("row", "prediction", "B", "r9", 9.0)], "label string, source string, vineyard_id string, row_id string, length_m double")
    h = N.header(f, spark.createDataFrame([("site", 0.5, 70.0), ("A", None, 9.0)], "scope string, min_confidence double, length_m double")).first()
    assert (h["blocks"], h["rows"], h["row_m"], h["targets"], h["route_m"], len(h["routes"])) == (1, 1, 3.0, 1, 70.0, 2)


def test_obstacles_peers_owners(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0), ("b", 5.0, 0.0), ("c", 50.0, 0.0)], "id string, x double, y double")
    o = spark.createDataFrame([("tree", 1.5, 0.0, "tree", 0.0), ("house", 10.5, 0.0, "building", 0.8), ("inner", 50.2, 0.0, "tree", 0.9), ("far", 51.0, 0.0, "tree", 0.9)], "obstacle_id string, x double, y double, kind string, in_block double")
    assert {r["id"]: r["obstacle_id"] for r in I.near_obstacles(p, o).collect()} == {"a": "tree", "b": "house", "c": "inner"}
    plots = spark.createDataFrame([(i, "v" if i < 6 else "s", float(i)) for i in range(8)], "plot int, cover string, value double")
    z = {r["plot"]: r["z"] for r in I.peer_z(plots).collect()}
    assert z[2] == pytest.approx((2 - 2.5) / (1.4826 * 1.5)) and z[7] == pytest.approx((7 - 3.5) / (1.4826 * 2))
    assert I.jittered(p, [(0.0, 0.0), (1.0, -1.0)]).count() == 6
    blobs = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 2), (2, 0, 0), (2, 0, 1)], "id int, row int, col int")
    px = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (0, 2, 7)], "row int, col int, owner int")
    assert {r["id"]: r["owner"] for r in I.owner_of(blobs, px).collect()} == {1: 7, 2: 5}
