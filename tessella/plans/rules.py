"""Rule classifiers, point and route checks, stray rows, halves and texts over the tables at hand.

Stand-in columns are SQL expressions that both engines read, so each relation is written down once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph as G
from ..operators import inspection as I
from ..operators import joins as J
from ..operators import rules as R
from ..operators import scenes as S
from ..operators import sequences as Q
from .reports import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def derived_sql(name: str, columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {name}"


# --- waste tiers, ranks and flags

BLOB = {
    "id": "l_orderkey * 10 + l_linenumber", "kind": "CASE l_orderkey % 4 WHEN 0 THEN 'white' WHEN 1 THEN 'white' WHEN 2 THEN 'colour' ELSE 'black' END",
    "location": "CASE l_partkey % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'headland' WHEN 2 THEN 'outside' WHEN 3 THEN 'interrow' END",
    "area_m2": "CAST(1 + l_suppkey % 40 AS DOUBLE) / 99", "length_m": "CAST(1 + l_partkey % 9 AS DOUBLE) / 8", "width_m": "CAST(1 + l_linenumber % 7 AS DOUBLE) / 16",
    "w_m": "CAST(4 + l_partkey % 7 AS DOUBLE) / 16", "h_m": "CAST(4 + l_suppkey % 5 AS DOUBLE) / 16",
    "lum": "CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE CAST(200 + l_orderkey % 45 AS DOUBLE) END", "lum_std": "CAST(l_partkey % 31 AS DOUBLE)",
    "chroma": "CASE WHEN l_orderkey % 4 = 2 THEN CAST(50 + l_suppkey % 60 AS DOUBLE) ELSE CAST(l_suppkey % 35 AS DOUBLE) END", "dev": "CAST(90 + l_partkey % 101 AS DOUBLE)", "hue": "CAST(l_orderkey % 300 AS DOUBLE)",
    "fill": "CAST(l_partkey % 9 AS DOUBLE) / 8", "ring_green": "CAST(2 + l_suppkey % 7 AS DOUBLE) / 8", "density": "CAST(l_linenumber % 8 AS DOUBLE) / 64",
    "structure": "CAST(l_suppkey % 3 AS DOUBLE)", "clipped": "CAST(l_orderkey % 16 AS DOUBLE) / 128", "row_m": "CAST(1 + l_partkey % 15 AS DOUBLE) / 8", "forbidden_m": "CAST(4 + l_suppkey % 37 AS DOUBLE)",
}


def _tier_sql() -> str:
    w = R.WasteRules()
    meets = lambda t: f"area_m2 BETWEEN {t.least_m2} AND {t.most_m2} AND width_m >= {t.width_m} AND lum >= {t.lum} AND chroma <= {t.chroma} AND dev >= {t.dev} AND row_m >= {t.row_m}" + (f" AND hue <= {t.hue}" if t.hue else "")
    return f"""b0 AS ({derived_sql("lineitem", BLOB)}),
b AS (SELECT *, coalesce(location, 'interrow') AS place, coalesce(location IN ('block', 'headland'), false) AS near, structure = 0 AND forbidden_m >= {w.building_m} AS apart FROM b0),
a AS (SELECT *, apart AND density - area_m2 / 9 <= CASE WHEN near THEN {w.near_density} ELSE {w.far_density} END AND fill >= {w.fill} AND ring_green >= {w.ring_green} AND row_m >= {w.row_m} AS alone,
 fill >= {w.disc_fill} AND greatest(w_m, h_m) < {w.disc_side}::DOUBLE * least(w_m, h_m) AND lum_std < {w.disc_texture} AS disc FROM b),
t AS (SELECT *, CASE WHEN area_m2 > {w.most_m2} OR length_m > {w.elongation} * greatest(width_m, 1e-3) THEN NULL
 WHEN place = 'interrow' THEN CASE WHEN kind = 'white' AND {meets(w.strict)} THEN 'strict' WHEN kind = 'white' AND {meets(w.small)} THEN 'small_bright' WHEN kind = 'white' AND {meets(w.pile)} THEN 'pile'
  WHEN kind = 'colour' AND area_m2 >= {w.colour_m2} AND chroma >= {w.colour_chroma} AND dev >= {w.colour_dev} THEN 'colour' END
 WHEN place = 'block' AND kind = 'white' AND apart AND (({meets(w.strict)}) OR ({meets(w.small)})) THEN 'scrap'
 WHEN alone AND kind = 'white' AND NOT disc AND area_m2 BETWEEN {w.rest_m2[0]} AND {w.rest_m2[1]} AND clipped >= {w.clipped} AND lum >= CASE WHEN near THEN {w.near_lum} ELSE {w.far_lum} END AND chroma <= {w.rest_chroma} AND lum_std >= {w.texture} THEN 'white'
 WHEN alone AND kind = 'colour' AND hue BETWEEN {w.blue_hue[0]} AND {w.blue_hue[1]} AND area_m2 BETWEEN {w.blue_m2[0]} AND {w.blue_m2[1]} AND lum_std >= {w.blue_texture} THEN 'blue' END AS tier FROM a)"""


def blobs(spark, sf) -> DataFrame:
    return derived(table(spark, sf, "lineitem"), BLOB)


@query(f"WITH {_tier_sql()} SELECT id, tier FROM t")
def q86_waste_tiers(spark, sf):
    return blobs(spark, sf).select("id", R.waste_tier().alias("tier"))


@query(
    f"""WITH {_tier_sql()} SELECT id, round(least(3, sqrt(area_m2 / 0.04)) * CASE WHEN length_m <= 3 * greatest(width_m, 1e-3) THEN 1 ELSE 0.35 END * least(1.2, greatest(0.25, row_m / 0.8)) *
CASE kind WHEN 'white' THEN CASE WHEN lum IS NOT NULL THEN least(1.5, greatest(0.05, (lum - 185) / 35)) END * least(1.2, greatest(0.15, (35 - chroma) / 20)) WHEN 'colour' THEN least(1.5, greatest(0.1, (chroma - 45) / 40)) * least(1.3, dev / 100) ELSE 0.15 * least(1, area_m2 / 0.08) END
* CASE WHEN tier IS NULL THEN 1 ELSE 2 END, 10) AS rank FROM t"""
)
def q87_review_rank(spark, sf):
    return blobs(spark, sf).withColumn("tier", R.waste_tier()).select("id", R.review_rank(F.col("tier").isNotNull(), 10).alias("rank"))


@query(
    f"""WITH {_tier_sql()} SELECT id, CASE WHEN lum IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN area_m2 < 0.02 THEN 'tiny' END,
CASE WHEN kind = 'black' THEN 'dark' WHEN area_m2 >= 0.15 AND (lum < 215 OR chroma > 22) AND dev < 170 THEN 'dull' WHEN kind = 'white' AND lum < 212 AND dev < 170 THEN 'not bright' END, CASE WHEN dev < 105 THEN 'low contrast' END,
CASE WHEN row_m < 0.5 AND location IN ('interrow', 'block') THEN 'on a row' END, CASE WHEN length_m > 3.5 * greatest(width_m, 1e-3) THEN 'long' END], lambda x: x IS NOT NULL), ',') END AS flags FROM t"""
)
def q88_rule_flags(spark, sf):
    return blobs(spark, sf).select("id", F.array_join(R.rule_flags(), ",").alias("flags"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN cover < 0.25 THEN 'cover' WHEN contrast < 0.015 THEN 'contrast' WHEN len_med > 4 AND cover < 0.5 THEN 'patchy' END AS reason, CASE WHEN contrast < 0.009 THEN 'contrast' END AS overgrown
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 64 AS cover, l_discount / 4 AS contrast, l_tax * 100 AS len_med FROM lineitem)"""
)
def q89_plot_reason(spark, sf):
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 64).alias("cover"), (F.col("l_discount") / 4).alias("contrast"), (F.col("l_tax") * 100).alias("len_med"))
    return e.select("l_orderkey", "l_linenumber", R.plot_reason().alias("reason"), R.plot_reason(R.PlotRules(cover=0, contrast=0.009, vine_m=0)).alias("overgrown"))


# --- gaps as points, with obstacles

GAP = {
    "vineyard_id": "c_mktsegment", "row_id": "concat(c_mktsegment, '-R', CAST(c_custkey AS STRING))", "kind": "CASE WHEN c_custkey % 3 = 0 THEN 'planting' ELSE 'gap' END", "gap_m": "CAST(c_custkey % 97 AS DOUBLE) / 4",
    "green": "CAST(c_custkey % 41 AS DOUBLE) / 40", "hidden": "CAST(c_custkey % 11 AS DOUBLE) / 32", "row_planted": "CAST(c_custkey % 16 AS DOUBLE) / 16",
    "x0": "CAST(c_custkey % 200 AS DOUBLE)", "y0": "CAST(c_nationkey * 12 AS DOUBLE)", "x1": "CAST(c_custkey % 200 AS DOUBLE) + CAST(c_custkey % 97 AS DOUBLE) / 4", "y1": "CAST(c_nationkey * 12 + c_custkey % 2 AS DOUBLE)",
}
OBSTACLE = {"obstacle_id": "s_suppkey", "kind": "CASE WHEN s_suppkey % 4 = 0 THEN 'building' ELSE 'tree' END", "x": "CAST(s_suppkey * 37 % 230 AS DOUBLE)", "y": "CAST(s_suppkey * 53 % 300 AS DOUBLE)", "in_block": "CAST(s_suppkey % 4 AS DOUBLE) / 4"}


def _segment_sql(px, py, x0, y0, x1, y1) -> str:
    t = f"CASE WHEN ({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0}) > 0 THEN greatest(0, least(1, (({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / (({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0})))) ELSE 0 END"
    return f"sqrt(pow({px} - {x0} - {t} * ({x1} - {x0}), 2) + pow({py} - {y0} - {t} * ({y1} - {y0}), 2))"


@query(
    f"""WITH g AS ({derived_sql("customer", GAP)}), o AS (SELECT *, CASE WHEN in_block >= 0.5 AND kind = 'building' THEN 6 ELSE 2 END AS reach FROM ({derived_sql("supplier", OBSTACLE)})),
n AS (SELECT g.row_id, arg_min(o.kind, ({_segment_sql("o.x", "o.y", "x0", "y0", "x1", "y1")}, obstacle_id)) AS obstacle_type FROM g, o WHERE {_segment_sql("o.x", "o.y", "x0", "y0", "x1", "y1")} <= reach GROUP BY 1),
j AS (SELECT g.*, obstacle_type, coalesce(CASE WHEN obstacle_type IS NOT NULL THEN 'obstacle' END, kind) AS reason, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM g LEFT JOIN n USING (row_id) WHERE hidden <= 0.2)
SELECT upper(reason) || '-' || row_id || '-' || lpad((round_even(x, 0)::BIGINT % 10000)::VARCHAR, 4, '0') || '-' || lpad((round_even(y, 0)::BIGINT % 10000)::VARCHAR, 4, '0') AS id, reason, obstacle_type,
 obstacle_type IS NULL AND CASE WHEN kind = 'gap' THEN green < CASE WHEN gap_m >= 5 THEN 0.75 ELSE 0.1 END ELSE green < 0.1 AND gap_m <= 15 END AS challenge, CASE WHEN kind = 'gap' THEN 'deviation' ELSE 'fixed' END AS gap_rule,
 round((1 - hidden) / pow(2, (green >= 0.375)::INT + (row_planted < 0.25)::INT + (kind <> 'gap')::INT), 2) AS confidence, x, y FROM j"""
)
def q90_gap_points(spark, sf):
    out = I.gap_points(derived(table(spark, sf, "customer"), GAP), derived(table(spark, sf, "supplier"), OBSTACLE))
    return out.select("id", "reason", "obstacle_type", "challenge", "gap_rule", "confidence", "x", "y")


# --- route checks

ROUTE = {
    "route": "o_orderkey", "length_m": "CASE WHEN o_orderkey % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice / 100 END", "outside_m": "CAST(o_custkey % 40 AS DOUBLE)", "forbidden_m": "CAST(o_orderkey % 9 AS DOUBLE) / 100",
    "canopy_m": "CAST(o_custkey % 8 AS DOUBLE) / 100", "young_canopy_m": "CAST(o_custkey % 5 AS DOUBLE)", "start_gap_m": "CAST(o_orderkey % 7 AS DOUBLE)", "end_gap_m": "CAST(o_custkey % 6 AS DOUBLE)",
}


@query(
    f"""WITH r AS ({derived_sql("orders", ROUTE)}), v AS (SELECT l_orderkey AS route, count(*) AS targets, count(*) FILTER (l_quantity / 10 <= 2) AS visited FROM lineitem GROUP BY 1),
c AS (SELECT r.*, coalesce(targets, 0) AS targets, coalesce(visited, 0) AS visited, CASE WHEN length_m > 0 THEN outside_m / length_m ELSE 1 END AS outside_share, start_gap_m <= 5 AND end_gap_m <= 5 AS closed FROM r LEFT JOIN v USING (route))
SELECT route, targets, visited, round(outside_share, 6) AS outside_share, young_canopy_m, closed, outside_share <= 0.02 AS scores, outside_share <= 0.02 AND forbidden_m <= 0.05 AND canopy_m <= 0.05 AS legal FROM c"""
)
def q91_route_checks(spark, sf):
    near = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), (F.col("l_quantity") / 10).alias("distance"))
    out = G.checked_routes(derived(table(spark, sf, "orders"), ROUTE), near)
    return out.select("route", "targets", "visited", F.round("outside_share", 6).alias("outside_share"), "young_canopy_m", "closed", "scores", "legal")


# --- rows

STRAY = {"pattern_id": "concat(c_mktsegment, '-', CAST(c_nationkey AS STRING))", "row_id": "concat('R', lpad(CAST(c_custkey AS STRING), 7, '0'))", "v": "c_acctbal", "step": "CAST(2500 AS DOUBLE)"}


@query(
    f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY pattern_id) AS n, lead(v) OVER w AS after FROM ({derived_sql("customer", STRAY)}) WINDOW w AS (PARTITION BY pattern_id ORDER BY row_id)),
s AS (SELECT pattern_id, row_id, v, i, true AS kept, v AS last FROM f WHERE i = 1
 UNION ALL SELECT f.pattern_id, f.row_id, f.v, f.i, f.i = f.n OR NOT (greatest(abs(f.v - s.last), abs(f.after - f.v)) < 0.7::DOUBLE * step AND abs(f.v - s.last) + abs(f.after - f.v) BETWEEN 0.7::DOUBLE * step AND 1.4::DOUBLE * step),
  CASE WHEN f.i = f.n OR NOT (greatest(abs(f.v - s.last), abs(f.after - f.v)) < 0.7::DOUBLE * step AND abs(f.v - s.last) + abs(f.after - f.v) BETWEEN 0.7::DOUBLE * step AND 1.4::DOUBLE * step) THEN f.v ELSE s.last END
 FROM s JOIN f ON f.pattern_id = s.pattern_id AND f.i = s.i + 1)
SELECT pattern_id, row_id, v FROM s WHERE kept"""
)
def q92_stray_rows(spark, sf):
    return I.stray_rows(derived(table(spark, sf, "customer"), STRAY))


PIECE = {"tile": "l_suppkey", "row_id": "concat('R', CAST(l_partkey % 50 AS STRING))", "start": "CAST(l_orderkey % 1000 AS DOUBLE) / 4", "end_": "CAST(l_orderkey % 1000 AS DOUBLE) / 4 + l_quantity / 2", "structure": "CASE l_returnflag WHEN 'R' THEN 'unassessable' ELSE 'regular' END"}


@query(
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, {", ".join(f"{e} AS {n}" for n, e in PIECE.items())} FROM lineitem), g AS (SELECT *, lead(start) OVER (PARTITION BY tile, row_id ORDER BY start, end_) - end_ AS gap FROM p),
h AS (SELECT *, max(gap) OVER (PARTITION BY tile, row_id) AS most FROM g) SELECT l_orderkey, l_linenumber, tile, row_id, CASE WHEN most >= 5 THEN 'disrupted' ELSE structure END AS row_structure FROM h"""
)
def q93_disrupted_pieces(spark, sf):
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).alias(n) for n, e in PIECE.items()]).withColumnsRenamed({"end_": "end", "structure": "row_structure"})
    return I.disrupted_pieces(p).select("l_orderkey", "l_linenumber", "tile", "row_id", "row_structure")


# --- boxes, halves, places

BOX = {"id": "p_partkey", "x0": "CAST(p_partkey * 131 % 1500 AS DOUBLE)", "y0": "CAST(p_partkey * 37 % 900 AS DOUBLE)", "x1": "CAST(p_partkey * 131 % 1500 + 3 + p_size % 12 AS DOUBLE)", "y1": "CAST(p_partkey * 37 % 900 + 2 + p_size % 9 AS DOUBLE)",
       "location": "CASE p_partkey % 4 WHEN 0 THEN 'interrow' WHEN 1 THEN 'block' WHEN 2 THEN 'headland' ELSE 'outside' END", "area_m2": "CAST(p_size AS DOUBLE)", "tile": "concat('t', CAST(p_partkey % 13 AS STRING))"}


@query(
    f"""WITH RECURSIVE b AS ({derived_sql("part", BOX)}), e AS (SELECT l.id AS a, r.id AS b FROM b l JOIN b r ON l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1),
r AS (SELECT id AS node, id AS root FROM b UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT root, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(location, CASE location WHEN 'interrow' THEN 0 WHEN 'block' THEN 1 WHEN 'headland' THEN 2 ELSE 3 END) AS location, round(sum(area_m2), 2) AS area_m2,
 string_agg(DISTINCT tile, ',' ORDER BY tile) AS tiles FROM b JOIN c ON node = id GROUP BY 1"""
)
def q94_merged_boxes(spark, sf):
    b = derived(table(spark, sf, "part"), BOX)
    members = J.components(b.select(F.col("id").alias("node")), J.meetings(b, 20.0)).withColumnRenamed("node", "id")
    return I.merged_boxes(b, members).withColumn("tiles", F.array_join("tiles", ","))


@query(
    f"""WITH b AS ({derived_sql("part", BOX)}), h AS (SELECT id % 2 = 0 AS ref, CASE WHEN (y0 + y1) / 2 >= 450 THEN 'north' ELSE 'south' END AS half, * FROM b), r AS (SELECT * FROM h WHERE ref), p AS (SELECT * FROM h WHERE NOT ref),
i AS (SELECT r.id, max((least(r.x1, p.x1) - greatest(r.x0, p.x0)) * (least(r.y1, p.y1) - greatest(r.y0, p.y0)) / ((r.x1 - r.x0) * (r.y1 - r.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) - (least(r.x1, p.x1) - greatest(r.x0, p.x0)) * (least(r.y1, p.y1) - greatest(r.y0, p.y0)))) AS iou
 FROM r JOIN p ON r.half = p.half AND least(r.x1, p.x1) > greatest(r.x0, p.x0) AND least(r.y1, p.y1) > greatest(r.y0, p.y0) GROUP BY 1),
b2 AS (SELECT r.half, coalesce(iou, 0) AS iou FROM r LEFT JOIN i USING (id)), n AS (SELECT half, count(*) AS pred FROM p GROUP BY 1), l AS (SELECT half, list_sort(list(iou)) AS v, count(*) AS refs, count(*) FILTER (iou >= 0.5) AS m50, count(*) FILTER (iou >= 0.75) AS m75 FROM b2 GROUP BY 1)
SELECT half, round(2.0 * m50 / (pred + refs), 6) AS f1_50, round(2.0 * m75 / (pred + refs), 6) AS f1_75, round(v[refs // 2 + 1], 6) AS median_iou FROM l JOIN n USING (half)"""
)
def q95_plot_scores(spark, sf):
    b = derived(table(spark, sf, "part"), BOX).withColumn("half", F.when((F.col("y0") + F.col("y1")) / 2 >= 450, "north").otherwise("south"))
    ref, pred = b.where("id % 2 = 0"), b.where("id % 2 = 1")
    pairs = J.overlaps(ref, pred, ["half"], 20.0, 20.0)
    best = pairs.groupBy(F.col("a").alias("id")).agg(F.max(F.col("overlap") / (F.col("area_a") + F.col("area_b") - F.col("overlap"))).alias("iou"))
    counts = ref.groupBy("half").agg(F.count("*").alias("reference")).join(pred.groupBy("half").agg(F.count("*").alias("predicted")), "half")
    scored = ref.join(best, "id", "left").withColumn("iou", F.coalesce("iou", F.lit(0.0))).join(F.broadcast(counts), "half")
    return I.plot_scores(scored).select("half", *[F.round(c, 6).alias(c) for c in ("f1_50", "f1_75", "median_iou")])


@query(
    f"""WITH b AS ({derived_sql("part", BOX)}), c AS (SELECT c_custkey AS id, (c_custkey * 71 % 1500)::DOUBLE AS x, (c_custkey * 29 % 900)::DOUBLE AS y FROM customer),
d AS (SELECT c.id, coalesce(bool_or(b.id % 2 = 0 AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), false) AS in_row, coalesce(bool_or(b.id % 2 = 1 AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), false) AS in_block,
 min(sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2))) FILTER (b.id % 2 = 1) AS block_m FROM c, b GROUP BY 1)
SELECT id, CASE WHEN in_row THEN 'interrow' WHEN in_block THEN 'block' WHEN block_m <= 10 THEN 'headland' ELSE 'outside' END AS location FROM d"""
)
def q96_locations(spark, sf):
    b = derived(table(spark, sf, "part"), BOX)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 71 % 1500).cast("double").alias("x"), (F.col("c_custkey") * 29 % 900).cast("double").alias("y"))
    return I.located(c, b.where("id % 2 = 0"), b.where("id % 2 = 1"), 10.0)


@query(
    """WITH p AS (SELECT l_suppkey AS blob, l_partkey % 7 AS owner FROM lineitem), n AS (SELECT blob, owner, count(*) AS n FROM p GROUP BY ALL)
SELECT blob, arg_max(owner, (n, -owner)) AS owner, sum(n)::BIGINT AS pixels FROM n GROUP BY 1"""
)
def q97_owner_majority(spark, sf):
    px = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("blob"), (F.col("l_partkey") % 7).alias("owner"))
    return I.owner_majority(px)


# --- scalars

@query(
    """SELECT event_id, round((90 + event_id % 360 - floor((90 + event_id % 360) / 180) * 180)::DOUBLE, 4) AS folded, round(least((event_id % 12 - user_id % 12 + 12) % 12, 12 - (event_id % 12 - user_id % 12 + 12) % 12), 4)::DOUBLE AS bins FROM events"""
)
def q98_angles(spark, sf):
    turn = F.radians((F.lit(90) + F.col("event_id") % 360).cast("double"))
    folded = F.round(C.undirected_angle(F.cos(turn), F.sin(turn)), 4)
    gap = C.circular_gap(F.col("event_id") % 12, F.col("user_id") % 12, 12)
    return table(spark, sf, "events").select("event_id", F.when(folded == 180, 0.0).otherwise(folded).alias("folded"), F.round(gap.cast("double"), 4).alias("bins"))


@query(
    """SELECT user_id AS item, round(1 - avg(CASE WHEN event_id % 12 IN (3, 8, 9, 10, 11) THEN 1.0 ELSE 0 END), 6) AS clear, round(sum(value * 100 * coalesce(CASE WHEN event_id % 5 > 0 THEN (event_id % 5) / 10000.0 END, 1e-4) + coalesce(CASE WHEN event_id % 7 > 0 THEN -(event_id % 7) / 100.0 END, -0.1)), 4) AS total FROM events GROUP BY 1"""
)
def q99_reflectance(spark, sf):
    k = F.col("event_id")
    r = R.reflectance(F.col("value") * 100, F.when(k % 5 > 0, (k % 5) / 10000.0), F.when(k % 7 > 0, -(k % 7) / 100.0))
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("item")).agg(F.round(R.clear_share(k % 12), 6).alias("clear"), F.round(F.sum(r), 4).alias("total"))


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 4 <> 0 THEN l_tax + (l_discount - l_tax) * (l_quantity - 5) / ((5 + l_linenumber % 4) - 5) ELSE l_tax END, 6) AS across FROM lineitem"""
)
def q100_across(spark, sf):
    five, end = F.lit(5.0), (5 + F.col("l_linenumber") % 4).cast("double")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(R.across_at(F.col("l_quantity"), five, F.col("l_tax"), end, F.col("l_discount")), 6).alias("across"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-06-15' - 45 AND DATE '1995-06-15' AND o_custkey % 100 < 50 AND contains(o_orderpriority, 'E')"""
)
def q101_search_window(spark, sf):
    o = table(spark, sf, "orders")
    hit = R.in_search(F.to_date("o_orderdate"), F.col("o_custkey") % 100, F.col("o_orderpriority"), F.lit("1995-06-15").cast("date"), "E")
    return o.where(hit).select("o_orderkey", R.utc_seconds(F.col("o_orderdate")).alias("at"))


@query(
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_acctbal::VARCHAR || ',' || c_custkey::VARCHAR WHEN 1 THEN 'x,1' WHEN 2 THEN '1' WHEN 3 THEN '1,2,3' ELSE NULL END AS s, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey / 8.0 END AS v FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN split_part(s, ',', 1)::DOUBLE END AS e, CASE WHEN c_custkey % 5 = 0 THEN split_part(s, ',', 2)::DOUBLE END AS n, CASE WHEN v IS NULL THEN 'n/a' ELSE format('{:.3f}', v::DOUBLE) END AS text FROM t"""
)
def q102_numbers_in_text(spark, sf):
    k = F.col("c_custkey")
    s = F.when(k % 5 == 0, F.concat(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit(","), k.cast("string"))).when(k % 5 == 1, "x,1").when(k % 5 == 2, "1").when(k % 5 == 3, "1,2,3")
    t = table(spark, sf, "customer").select("c_custkey", R.easting_northing(s).alias("p"), R.fixed_or_none(F.when(k % 3 != 0, k / 8)).alias("text"))
    return t.select("c_custkey", "p.e", "p.n", "text")


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'over_budget' WHEN 1 THEN 'unreachable' ELSE 'skipped' END AS s, CASE WHEN event_id % 2 = 0 THEN value END AS needs, CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END AS why, CASE WHEN event_id % 7 > 0 THEN value - 50 END AS rest FROM events)
SELECT event_id, CASE s WHEN 'over_budget' THEN 'Not on this route: it needs ' || coalesce('~' || floor(needs + 0.5)::BIGINT::VARCHAR || ' m', 'more') || ' outside the lanes' || CASE WHEN rest IS NULL THEN '' ELSE '; ' || floor(greatest(rest, 0) + 0.5)::BIGINT::VARCHAR || ' m are left' END || '.'
WHEN 'unreachable' THEN 'Not on this route: no legal path' || CASE WHEN why <> '' THEN ' (' || why || ')' ELSE '' END || '.' ELSE 'Not on this route: it passes more than 2 m away.' END AS text FROM t"""
)
def q103_off_route_text(spark, sf):
    k = F.col("event_id")
    status = F.when(k % 3 == 0, "over_budget").when(k % 3 == 1, "unreachable").otherwise("skipped")
    text = R.off_route_text(status, F.when(k % 2 == 0, F.col("value")), F.when(k % 5 == 0, F.col("event_type")).otherwise(""), F.when(k % 7 > 0, F.col("value") - 50))
    return table(spark, sf, "events").select("event_id", text.alias("text"))


@query(
    """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 2500 AS n, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 400 - 200)::DOUBLE END AS lon, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 95)::DOUBLE END AS lat,
CASE o_orderkey % 5 WHEN 0 THEN 'site' WHEN 1 THEN 'V-1_a' WHEN 2 THEN 'a b' WHEN 3 THEN '' ELSE 'a_name_that_is_too_long' END AS scope, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.5 ELSE 0.6 END AS cut FROM orders)
SELECT id, CASE WHEN n > 2048 THEN 413 WHEN ((lon IS NULL AND lat IS NULL) OR (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)) AND regexp_full_match(scope, '[A-Za-z0-9_-]{1,16}') AND (cut IS NULL OR cut IN (0.5, 0.7)) AND (lon IS NULL OR lon >= 0) THEN 200 ELSE 422 END AS status FROM t"""
)
def q104_requests(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    scope = F.when(k % 5 == 0, "site").when(k % 5 == 1, "V-1_a").when(k % 5 == 2, "a b").when(k % 5 == 3, "").otherwise("a_name_that_is_too_long")
    lon, lat = F.when(k % 4 > 0, (c % 400 - 200).cast("double")), F.when(k % 4 > 0, (c % 95).cast("double"))
    cut = F.when(k % 3 == 1, 0.5).when(k % 3 == 2, 0.6)
    return table(spark, sf, "orders").select(k.alias("id"), R.request_error(k % 2500, lon, lat, scope, cut, lon >= 0).alias("status"))


# --- orders of lists: the place of every row, so that the order itself is compared

@query(
    """WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal, c_custkey % 3 = 0 AS dropped, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 7 % 100 END AS stop FROM customer)
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY stop IS NULL, stop, c_custkey) AS by_stop, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS longest, row_number() OVER (PARTITION BY c_nationkey ORDER BY dropped, c_acctbal DESC, c_custkey) AS dropped_last FROM c"""
)
def q105_list_orders(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", (F.col("c_custkey") % 3 == 0).alias("dropped"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") * 7 % 100).alias("stop"))
    out = Q.placed(c, ["c_nationkey"], [F.col("stop").asc_nulls_last(), F.asc("c_custkey")], "by_stop")
    out = Q.placed(out, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], "longest")
    return Q.placed(out, ["c_nationkey"], [F.asc("dropped"), F.desc("c_acctbal"), F.asc("c_custkey")], "dropped_last").select("c_custkey", "by_stop", "longest", "dropped_last")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS newest FROM orders")
def q106_newest_first(spark, sf):
    return Q.placed(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], "newest").select("o_orderkey", "newest")


# --- scene headers, blocks, rows

@query(
    """WITH f AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'row' WHEN 1 THEN 'inspection' WHEN 2 THEN 'waste' ELSE 'block' END AS label, CASE WHEN o_orderstatus = 'P' THEN 'prediction' END AS source, CASE WHEN o_custkey % 10 = 0 THEN '' ELSE (o_custkey % 30)::VARCHAR END AS v, (o_custkey % 90)::VARCHAR AS r, o_totalprice AS m FROM orders),
s AS (SELECT count(DISTINCT nullif(v, '')) AS blocks, count(DISTINCT r) FILTER (label = 'row') AS "rows", round(sum(m) FILTER (label = 'row'), 2) AS row_m, count(*) FILTER (label IN ('inspection', 'waste')) AS targets FROM f WHERE source IS NULL),
t AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'site' ELSE 'f' || n_nationkey::VARCHAR END AS scope, (n_nationkey * 10)::DOUBLE AS m FROM nation) SELECT s.*, (SELECT max(m) FROM t WHERE scope = 'site') AS route_m, (SELECT count(*) FROM t) AS routes FROM s"""
)
def q107_header(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    label = F.when(k % 4 == 0, "row").when(k % 4 == 1, "inspection").when(k % 4 == 2, "waste").otherwise("block")
    f = table(spark, sf, "orders").select(label.alias("label"), F.when(F.col("o_orderstatus") == "P", "prediction").alias("source"), F.when(c % 10 == 0, "").otherwise((c % 30).cast("string")).alias("vineyard_id"), (c % 90).cast("string").alias("row_id"), F.col("o_totalprice").alias("length_m"))
    n = F.col("n_nationkey")
    routes = table(spark, sf, "nation").select(F.when(n % 5 == 0, "site").otherwise(F.concat(F.lit("f"), n.cast("string"))).alias("scope"), F.lit(None).cast("double").alias("min_confidence"), (n * 10).cast("double").alias("length_m"))
    return S.header(f, routes).withColumn("routes", F.size("routes")).withColumn("row_m", F.round("row_m", 2))


@query(
    """WITH p AS (SELECT c_custkey, n_name AS block, c_mktsegment AS pattern, c_acctbal AS area, c_custkey % 9 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey), g AS (SELECT block, pattern, round(sum(area), 2) AS area, sum(n) AS n FROM p GROUP BY ALL)
SELECT block, sum(n)::BIGINT AS row_count, arg_max(pattern, (area, pattern)) AS main, string_agg(pattern || ':' || n::VARCHAR, ',' ORDER BY area DESC, pattern) AS patterns FROM g GROUP BY 1"""
)
def q108_blocks(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("block_id"))
    p = table(spark, sf, "customer").join(F.broadcast(n), "c_nationkey").groupBy("block_id", F.col("c_mktsegment").alias("pattern_id")).agg(F.round(F.sum("c_acctbal"), 2).alias("area_m2"), F.sum(F.col("c_custkey") % 9).alias("row_count"))
    out = S.blocks(p)
    text = F.array_join(F.transform("patterns", lambda x: F.concat(x["pattern_id"], F.lit(":"), x["row_count"].cast("string"))), ",")
    return out.select(F.col("block_id").alias("block"), "row_count", F.col("main_pattern").alias("main"), text.alias("patterns"))


@query(
    f"""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, {", ".join(f"{e} AS {n}" for n, e in PIECE.items())} FROM lineitem) SELECT tile, row_id, arg_max(id, (end_ - start, id)) AS axis, min(start) AS lo, max(end_) AS hi, count(*) FILTER (end_ - start > 5) AS pieces FROM p GROUP BY ALL"""
)
def q109_row_records(spark, sf):
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("piece"), *[F.expr(e).alias(n) for n, e in PIECE.items()]).withColumnRenamed("end_", "end")
    return S.row_records(p, ["tile", "row_id"], 5.0).select("tile", "row_id", "axis", "lo", "hi", F.size("pieces").alias("pieces"))
