"""Feature collections: GeoJSON scenes, annotation XML, verdict lists and the CSV and XML sinks.

Readers return DataFrames with explicit schemas; geometry stays JSON text until a kernel needs it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CRS = "EPSG:32635"
SCENE = "type string, crs struct<type:string,properties:struct<name:string>>, source string, features array<struct<type:string,geometry:string,properties:map<string,string>>>"
VERDICT = "id string, created string, kind string, verdict string, label string, source string, tile string, reason string, note string, reviewer string, replaces string, properties map<string,string>, geometry string"
#: The attributes that each annotated label has, and the domains of the closed ones.
ATTRIBUTES = {"row": ("vineyard_id", "pattern_id", "row_id", "row_structure"), "vineyard": ("vineyard_id",), "interrow_area": ("vineyard_id", "pattern_id", "interrow_cover"), "waste": ("vineyard_id", "location")}
DOMAINS = {"row_structure": ("regular", "disrupted", "unassessable"), "interrow_cover": ("bare_soil", "vegetation", "mixed", "unassessable")}
SHAPES = {"row": "polyline", "vineyard": "polygon", "interrow_area": "polygon", "waste": "box"}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_scene(spark: SparkSession, path: str, crs: str = CRS) -> DataFrame:
    """Features of one or many collections; a collection in another CRS, or none, fails the read."""
    raw = spark.read.schema(SCENE).json(path, multiLine=True)
    ok = (F.col("type") == "FeatureCollection") & F.coalesce(F.col("crs.properties.name").endswith(crs.rpartition(":")[2]), F.lit(False))
    checked = raw.select(F.when(ok, F.col("features")).otherwise(F.raise_error(F.lit(f"not a feature collection in {crs}"))).alias("features"))
    f = checked.select(F.explode("features").alias("f")).select("f.geometry", "f.properties")
    p = F.col("properties")
    return f.select(F.try_element_at(p, F.lit("label")).alias("label"), F.try_element_at(p, F.lit("source")).alias("source"), F.get_json_object("geometry", "$.type").alias("shape"), "geometry", "properties")


def read_constraints(spark: SparkSession, folder: str, files: dict[str, str]) -> DataFrame:
    """Named files as labels: {label: file name}."""
    out = None
    for label, name in files.items():
        part = read_scene(spark, f"{folder}/{name}").withColumn("label", F.lit(label)).withColumn("source", F.lit("organizer"))
        out = part if out is None else out.unionByName(part)
    return out


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """A verdict list, or no rows where there is no file yet."""
    return spark.read.schema(VERDICT).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], VERDICT)


def route_targets(points: DataFrame, scene: DataFrame, confidence_over: float | None = None) -> DataFrame:
    """Challenge points above a confidence (strictly), and the scene's inspections and waste."""
    p = points.where("challenge")
    if confidence_over is not None:
        p = p.where(F.col("confidence") > confidence_over)
    return p.unionByName(scene.where(F.col("label").isin("inspection", "waste")), allowMissingColumns=True)


def read_annotations(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Annotation XML (1.1) as world features: one row a shape. ``known``: name, left, top, px of each image.

    A numeric export prefix of an image name is dropped where the rest is a known name; an unknown image fails.
    """
    attr = "array<struct<_name:string,_VALUE:string>>"
    shape = f"array<struct<_label:string,_points:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:{attr}>>"
    raw = spark.read.format("xml").option("rowTag", "image").schema(f"_name string, _width int, _height int, box {shape}, polygon {shape}, polyline {shape}").load(path)
    empty = F.expr(f"cast(array() as {shape})")
    every = F.concat(*[F.transform(F.coalesce(F.col(k), empty), _tagged(k)) for k in ("box", "polygon", "polyline")])
    s = raw.select("_name", F.explode(every).alias("s")).select("_name", "s.*")
    tiles = known.select(F.col("name").alias("image"), "left", "top", "px")
    names = s.select("_name").distinct()
    names = names.join(tiles.select("image"), F.col("_name") == F.col("image"), "left").withColumn("image", F.coalesce("image", F.regexp_replace("_name", r"^[0-9]+_", "")))
    s = s.join(names, "_name").join(tiles, "image", "left")
    left = F.when(F.col("left").isNull(), F.raise_error(F.concat(F.lit("unknown image "), F.col("_name"))).cast("double")).otherwise(F.col("left"))
    world = F.transform("px_points", lambda p: F.struct((left + p["x"] * F.col("px")).alias("x"), (F.col("top") - p["y"] * F.col("px")).alias("y")))
    return s.select(F.col("image").alias("tile"), "tag", "label", world.alias("points"), "properties")


def _tagged(tag: str):
    def one(s: Column) -> Column:
        corners = F.array(*[F.struct(s[x].alias("x"), s[y].alias("y")) for x, y in (("_xtl", "_ytl"), ("_xbr", "_ytl"), ("_xbr", "_ybr"), ("_xtl", "_ybr"))])
        pairs = F.transform(F.split(s["_points"], ";"), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))
        props = F.map_from_entries(F.transform(F.coalesce(s["attribute"], F.expr("cast(array() as array<struct<_name:string,_VALUE:string>>)")), lambda a: F.struct(a["_name"], F.coalesce(a["_VALUE"], F.lit("")))))
        return F.struct(F.lit(tag).alias("tag"), s["_label"].alias("label"), (corners if tag == "box" else pairs).alias("px_points"), props.alias("properties"))

    return one


def annotation_xml(features: DataFrame, tiles: DataFrame) -> DataFrame:
    """One XML fragment an image: features (tile, tag, label, points, properties) in pixels, snapped to a hundredth."""
    f = features.join(tiles.select(F.col("name").alias("tile"), "left", "top", "px"), "tile")
    num = lambda v: F.format_string("%.2f", v)
    px = lambda p: F.concat(num((p["x"] - F.col("left")) / F.col("px")), F.lit(","), num((F.col("top") - p["y"]) / F.col("px")))
    text = F.array_join(F.transform("points", px), ";")
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda a: F.concat(F.lit('<attribute name="'), esc(a["key"]), F.lit('">'), esc(a["value"]), F.lit("</attribute>"))), "")
    side = lambda k, fn: F.format_string("%.2f", fn(F.transform("points", lambda p: (p["x"] - F.col("left")) / F.col("px") if k == "x" else (F.col("top") - p["y"]) / F.col("px"))))
    bounds = F.format_string(' xtl="%s" ytl="%s" xbr="%s" ybr="%s"', side("x", F.array_min), side("y", F.array_min), side("x", F.array_max), side("y", F.array_max))
    place = F.when(F.col("tag") == "box", bounds).otherwise(F.concat(F.lit(' points="'), text, F.lit('"')))
    element = F.concat(F.lit("<"), F.col("tag"), F.lit(' label="'), esc(F.col("label")), F.lit('"'), place, F.lit(">"), attrs, F.lit("</"), F.col("tag"), F.lit(">"))
    grouped = f.groupBy("tile").agg(F.array_join(F.array_sort(F.collect_list(element)), "\n").alias("body"))
    return grouped.select("tile", F.concat(F.lit('<image name="'), esc(F.col("tile")), F.lit('">\n'), F.col("body"), F.lit("\n</image>")).alias("xml"))


def write_annotations(features: DataFrame, tiles: DataFrame, path: str) -> None:
    """A complete XML document in one file, images in name order."""
    body = annotation_xml(features, tiles).select(F.lit(1).alias("k"), "tile", "xml")
    spark = features.sparkSession
    ends = spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="utf-8"?>\n<annotations>\n<version>1.1</version>'), (2, "", "</annotations>")], "k int, tile string, xml string")
    body.unionByName(ends).repartition(1).sortWithinPartitions("k", "tile").select("xml").write.mode("overwrite").text(path)


def annotation_problems(shapes: DataFrame, known: DataFrame, width: int = 2048, height: int = 2048, px: float = 0.025) -> DataFrame:
    """(tile, rule) of every broken rule: labels, shapes, attribute sets, domains, empty ids, unknown or missing images, points off the image.

    ``shapes``: tile, tag, label, points, properties; ``known``: name, left, top.
    """
    s = shapes.join(known.select(F.col("name").alias("tile"), "left", "top"), "tile", "left")
    label, props = F.col("label"), F.col("properties")
    want = F.create_map(*[x for k, v in ATTRIBUTES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in sorted(v)]))])
    tag = F.create_map(*[x for k, v in SHAPES.items() for x in (F.lit(k), F.lit(v))])
    inside = F.forall("points", lambda p: p["x"].between(F.col("left") - 1e-6, F.col("left") + width * px + 1e-6) & p["y"].between(F.col("top") - height * px - 1e-6, F.col("top") + 1e-6))
    rules = [
        ("unknown image", F.col("left").isNull()),
        ("unknown label", ~label.isin(*ATTRIBUTES)),
        ("wrong shape", F.try_element_at(tag, label) != F.col("tag")),
        ("attribute set", F.try_element_at(want, label) != F.array_sort(F.map_keys(props))),
        *[(f"domain of {k}", F.try_element_at(props, F.lit(k)).isNotNull() & ~F.try_element_at(props, F.lit(k)).isin(*v)) for k, v in DOMAINS.items()],
        ("empty id", F.exists(F.map_keys(props), lambda k: k.isin("row_id", "pattern_id") & (F.element_at(props, k) == ""))),
        ("off the image", ~inside),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())
    return s.select("tile", F.explode(found).alias("rule"))


def geojson_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature a line, properties in key order: features with geometry (JSON text) and properties (map)."""
    return features.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce("geometry", F.lit("null")), F.lit(',"properties":'), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties")))), F.lit("}")).alias("value"))


def write_scene(features: DataFrame, path: str, order: list[str], crs: str = CRS) -> None:
    """A feature collection in one file, features in the given order."""
    head = json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": crs}}})[:-1] + ', "features": ['
    f = features.select(F.struct(*order).alias("o"), "geometry", "properties")
    lines = f.select("o", F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce("geometry", F.lit("null")), F.lit(',"properties":'), F.to_json("properties"), F.lit("}")).alias("value"))
    numbered = lines.withColumn("n", F.row_number().over(W.orderBy("o", "value")))  # a scene is one document, written by one task
    body = numbered.select(F.lit(1).alias("k"), "n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), F.col("value")).alias("value"))
    ends = features.sparkSession.createDataFrame([(0, 0, head), (2, 0, "]}")], "k int, n int, value string")
    body.unionByName(ends).repartition(1).sortWithinPartitions("k", "n").select("value").write.mode("overwrite").text(path)


def write_measurements(report: DataFrame, path: str) -> None:
    """measurements.csv: fixed columns, empty cells for nulls, in the report's order."""
    from ..operators.rollup import report_order

    report_order(report).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def tile_inventory(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """name, part, size, crc of every .tif in the ZIP parts (each of bounded size)."""
    import io
    import zipfile

    import pandas as pd

    def entries(it):
        for pdf in it:
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(i.filename.rpartition("/")[2], at.rpartition("/")[2], i.file_size, i.CRC) for i in z.infolist() if i.filename.lower().endswith(".tif")]
                    bad = z.testzip()
                if bad:
                    raise ValueError(f"{at}: {bad} is damaged")
                yield pd.DataFrame(rows, columns=["name", "part", "size", "crc"])

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(entries, "name string, part string, size long, crc long")


def inventory_problems(got: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, rule): duplicates, missing, unexpected and changed tiles (name, size, crc)."""
    rule = lambda df, text: df.select("name", F.lit(text).alias("rule"))
    twice = got.groupBy("name").count().where("count > 1")
    e = expected.select("name", F.col("size").alias("size0"), F.col("crc").alias("crc0"))
    changed = got.join(e, "name").where("size <> size0 OR crc <> crc0").select("name").distinct()
    return rule(twice, "duplicate").unionByName(rule(expected.join(got, "name", "left_anti"), "missing")).unionByName(rule(got.join(expected, "name", "left_anti").select("name").distinct(), "unexpected")).unionByName(rule(changed, "changed"))
