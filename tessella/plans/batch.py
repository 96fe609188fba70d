"""The batch run and its surroundings over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batch as B
from ..operators import rasters as A
from ..operators import scenes as S
from ..scratch import Scratch
from .measures import LINE, PARCEL
from .reports import table
from .rules import BOX, derived, derived_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


ROW = {"row_id": "concat('R', CAST(c_custkey AS STRING))", **{c: LINE[c] for c in ("x0", "y0", "x1", "y1")}}
AREA = {"id": "p_partkey", "x0": "CAST(p_partkey * 131 % 380 AS DOUBLE)", "y0": "CAST(p_partkey * 37 % 280 AS DOUBLE)", "x1": "CAST(p_partkey * 131 % 380 + 3 + p_size % 12 AS DOUBLE)", "y1": "CAST(p_partkey * 37 % 280 + 2 + p_size % 9 AS DOUBLE)"}


def tiles(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    col, row = F.col("n_nationkey") % 4, F.floor(F.col("n_nationkey") / 4)
    return n.select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tile"), *[v.cast("double").alias(k) for k, v in (("left", col * 100), ("low", row * 100), ("right", col * 100 + 100), ("high", row * 100 + 100))])


def pixels(spark, sf) -> DataFrame:
    """5 m pixels of the site; green by a rule, from a table so that they are rows at rest."""
    k = F.col("event_id")
    e = table(spark, sf, "events")
    return e.select(F.floor(k / 80).alias("row"), (k % 80).alias("col"), (F.floor(k / 80) * 7 + (k % 80) * 3 + F.floor(k / 37)).alias("m")).select("row", "col", (F.col("m") % 5 < 3).alias("green"))


_TILES = "t AS (SELECT 't' || n_nationkey::VARCHAR AS tile, (n_nationkey % 4 * 100)::DOUBLE AS l, (n_nationkey // 4 * 100)::DOUBLE AS b, (n_nationkey % 4 * 100 + 100)::DOUBLE AS r, (n_nationkey // 4 * 100 + 100)::DOUBLE AS h FROM nation)"
_PX = "px AS (SELECT event_id // 80 AS row, event_id % 80 AS col, (event_id // 80 * 7 + event_id % 80 * 3 + event_id // 37) % 5 < 3 AS green FROM events)"
_LO = "greatest(0, CASE WHEN x1 <> x0 THEN least((l - x0) / (x1 - x0), (r - x0) / (x1 - x0)) ELSE 0 END, CASE WHEN y1 <> y0 THEN least((b - y0) / (y1 - y0), (h - y0) / (y1 - y0)) ELSE 0 END)"
_HI = "least(1, CASE WHEN x1 <> x0 THEN greatest((l - x0) / (x1 - x0), (r - x0) / (x1 - x0)) ELSE 1 END, CASE WHEN y1 <> y0 THEN greatest((b - y0) / (y1 - y0), (h - y0) / (y1 - y0)) ELSE 1 END)"
_ROWS = f"""{_TILES}, {_PX}, k AS (SELECT *, {_LO} AS lo, {_HI} AS hi, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS size FROM ({derived_sql("customer", ROW)}), t WHERE NOT ((x1 = x0 AND NOT x0 BETWEEN l AND r) OR (y1 = y0 AND NOT y0 BETWEEN b AND h))),
p AS (SELECT tile, row_id, lo * size AS s, hi * size AS e, x0 + lo * (x1 - x0) AS ax, y0 + lo * (y1 - y0) AS ay, x0 + hi * (x1 - x0) AS bx, y0 + hi * (y1 - y0) AS bz, row_number() OVER (ORDER BY tile, row_id, lo) AS piece FROM k WHERE lo < hi AND (hi - lo) * size >= 0.1),
q AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(bz - ay, 2)) AS n FROM p), i AS (SELECT *, unnest(range(0, floor(n / 2)::BIGINT + 1)) AS i FROM q WHERE n > 0), g AS (SELECT piece, i, coalesce(green, false) AS green FROM i LEFT JOIN px ON px.row = floor((ay + (bz - ay) / n * i * 2) / 5) AND px.col = floor((ax + (bx - ax) / n * i * 2) / 5)),
u AS (SELECT piece, green, min(i) AS a, count(*) * 2 AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY piece, green ORDER BY i) AS isl FROM g) GROUP BY piece, green, isl), v AS (SELECT *, green AND m >= 0.55 AS vine FROM u),
w AS (SELECT piece, vine, sum(m) AS m FROM (SELECT *, sum(CASE WHEN vine OR coalesce(pv, true) THEN 1 ELSE 0 END) OVER (PARTITION BY piece ORDER BY a) AS isl FROM (SELECT *, lag(vine) OVER (PARTITION BY piece ORDER BY a) AS pv FROM v)) GROUP BY piece, isl, vine),
x AS (SELECT piece, coalesce(max(m) FILTER (NOT vine), 0) AS hole, bool_or(vine) AS any_vine FROM w GROUP BY 1), y AS (SELECT tile, row_id, s, e, CASE WHEN hole < 5 THEN 'regular' WHEN any_vine THEN 'disrupted' ELSE 'unassessable' END AS st FROM q JOIN x USING (piece)),
z AS (SELECT *, lead(s) OVER (PARTITION BY tile, row_id ORDER BY s) - e AS gap FROM y), rows_ AS (SELECT tile, row_id, s, e, CASE WHEN max(gap) OVER (PARTITION BY tile, row_id) >= 5 THEN 'disrupted' ELSE st END AS row_structure FROM z)"""
_AREAS = f"""c AS (SELECT tile, id, greatest(x0, l) AS x0, greatest(y0, b) AS y0, least(x1, r) AS x1, least(y1, h) AS y1 FROM ({derived_sql("part", AREA)}), t), d AS (SELECT *, (x1 - x0) * (y1 - y0) AS area_m2 FROM c WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) >= 0.1),
areas AS (SELECT d.tile, d.id, d.area_m2, avg(green::INT) AS green FROM d LEFT JOIN px ON (px.col + 0.5) * 5 >= x0 AND (px.col + 0.5) * 5 < x1 AND (px.row + 0.5) * 5 >= y0 AND (px.row + 0.5) * 5 < y1 GROUP BY ALL)"""


@query(f"WITH {_ROWS} SELECT tile, row_id, round(e - s, 4) AS length_m, row_structure FROM rows_")
def q141_rows_by_tile(spark, sf):
    out = B.classified_rows(B.row_pieces(derived(table(spark, sf, "customer"), ROW), tiles(spark, sf), 100.0), pixels(spark, sf), 5.0, 2.0)
    return out.select("tile", "row_id", F.round("length_m", 4).alias("length_m"), "row_structure")


@query(f"WITH {_TILES}, {_PX}, {_AREAS} SELECT tile, id, round(area_m2, 4) AS area_m2, round(green, 5) AS green, CASE WHEN green IS NULL THEN 'unassessable' WHEN green < 0.25 THEN 'bare_soil' WHEN green > 0.75 THEN 'vegetation' ELSE 'mixed' END AS interrow_cover FROM areas")
def q142_areas_by_tile(spark, sf):
    out = B.classified_areas(derived(table(spark, sf, "part"), AREA), tiles(spark, sf), pixels(spark, sf), 5.0, 100.0)
    return out.select("tile", "id", F.round("area_m2", 4).alias("area_m2"), F.round("green", 5).alias("green"), "interrow_cover")


@query(
    f"""WITH {_ROWS}, {_AREAS}, f AS (SELECT 'row' AS label, tile, e - s AS m, NULL AS a, row_structure AS attribute FROM rows_ UNION ALL SELECT 'interrow_area', tile, NULL, area_m2, CASE WHEN green IS NULL THEN 'unassessable' WHEN green < 0.25 THEN 'bare_soil' WHEN green > 0.75 THEN 'vegetation' ELSE 'mixed' END FROM areas
UNION ALL SELECT 'vineyard', 't' || (s_suppkey % 12)::VARCHAR, NULL, s_acctbal, NULL FROM supplier) SELECT label, attribute, count(*) AS n, count(DISTINCT tile) AS tiles, round(sum(m), 3) AS length_m, round(sum(a), 3) AS area_m2 FROM f GROUP BY ALL"""
)
def q143_batch(spark, sf):
    none = F.lit(None).cast("double")
    others = table(spark, sf, "supplier").select(F.lit("vineyard").alias("label"), F.concat(F.lit("t"), (F.col("s_suppkey") % 12).cast("string")).alias("tile"), F.col("s_suppkey").cast("string").alias("id"), none.alias("length_m"), F.col("s_acctbal").alias("area_m2"))
    out = B.batch(derived(table(spark, sf, "customer"), ROW), derived(table(spark, sf, "part"), AREA), others, tiles(spark, sf), pixels(spark, sf), 5.0, 2.0, 100.0)
    return out.groupBy("label", "attribute").agg(F.count("*").alias("n"), F.count_distinct("tile").alias("tiles"), F.round(F.sum("length_m"), 3).alias("length_m"), F.round(F.sum("area_m2"), 3).alias("area_m2"))


# --- surroundings

@query(
    """WITH c AS (SELECT DISTINCT p_partkey // 40 AS row, p_partkey % 40 AS col FROM part WHERE p_size % 4 = 0) SELECT a.row + i.a AS row, a.col + j.b AS col, round(count(*) / 9.0, 6) AS density FROM c a, range(-1, 2) AS i(a), range(-1, 2) AS j(b) GROUP BY ALL"""
)
def q144_density(spark, sf):
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).alias("row"), (F.col("p_partkey") % 40).alias("col"), (F.col("p_size") % 4 == 0).alias("set"))
    return B.density(p, 1).select("row", "col", F.round("density", 6).alias("density"))


@query(
    """WITH RECURSIVE c AS (SELECT p_partkey // 40 AS row, p_partkey % 40 AS col FROM part WHERE p_size % 3 = 0), e AS (SELECT a.row * 40 + a.col AS a, b.row * 40 + b.col AS b FROM c a JOIN c b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
r AS (SELECT row * 40 + col AS node, row * 40 + col AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), m AS (SELECT node, min(root) AS root FROM r GROUP BY 1) SELECT node // 40 AS row, node % 40 AS col FROM m WHERE root IN (SELECT root FROM m GROUP BY 1 HAVING count(*) >= 4)"""
)
def q145_structures(spark, sf):
    p = table(spark, sf, "part").where("p_size % 3 = 0").select(F.floor(F.col("p_partkey") / 40).alias("row"), (F.col("p_partkey") % 40).alias("col"))
    return B.structures(p, Scratch(spark, "structures"), 4, 40)


@query(
    f"""WITH RECURSIVE b AS (SELECT id, x0 - 6 AS x0, y0 - 6 AS y0, x1 + 6 AS x1, y1 + 6 AS y1 FROM ({derived_sql("part", BOX)})), e AS (SELECT l.id AS a, r.id AS b FROM b l JOIN b r ON l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1),
r AS (SELECT id AS node, id AS root FROM b UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1) SELECT root, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS obstacles FROM b JOIN c ON node = id GROUP BY 1"""
)
def q146_reach_windows(spark, sf):
    return B.reach_windows(derived(table(spark, sf, "part"), BOX), Scratch(spark, "windows"), 6.0, 30.0)


@query(
    f"""WITH v AS (SELECT id, x0, y0, x1, y1 FROM ({derived_sql("part", AREA)})), f AS (SELECT id AS f, x0 AS l, y0 AS b, x1 AS r, y1 AS t FROM ({derived_sql("supplier", PARCEL)})),
o AS (SELECT v.id, sum((least(x1, r) - greatest(x0, l)) * (least(y1, t) - greatest(y0, b))) AS covered FROM v JOIN f ON least(x1, r) > greatest(x0, l) AND least(y1, t) > greatest(y0, b) GROUP BY 1), j AS (SELECT v.id, (x1 - x0) * (y1 - y0) AS area, coalesce(covered, 0) AS covered FROM v LEFT JOIN o USING (id))
SELECT count(*) FILTER (covered >= 0.5 * area) AS missed_found, count(*) FILTER (covered < 0.5 * area) AS missed_still_missed, round(sum(covered) / sum(area), 6) AS missed_area_recall FROM j"""
)
def q147_missed_recall(spark, sf):
    from ..operators import joins as J

    v, f = derived(table(spark, sf, "part"), AREA), derived(table(spark, sf, "supplier"), PARCEL)
    met = J.overlaps(v, f, [], 60.0, 60.0).select(F.col("a").alias("id"), "b").join(v, "id").join(f.select(F.col("id").alias("b"), *[F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")]), "b")
    cut = met.select("id", F.greatest("x0", "fx0").alias("x0"), F.greatest("y0", "fy0").alias("y0"), F.least("x1", "fx1").alias("x1"), F.least("y1", "fy1").alias("y1"))
    j = v.join(A.box_union_area(cut, "id", 60.0, 60.0).withColumnRenamed("area", "covered"), "id", "left").na.fill(0.0, ["covered"]).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    found = F.col("covered") >= 0.5 * F.col("area")
    return j.agg(F.count_if(found).alias("missed_found"), F.count_if(~found).alias("missed_still_missed"), F.round(F.sum("covered") / F.sum("area"), 6).alias("missed_area_recall"))


@query(
    """WITH RECURSIVE d AS (SELECT c_nationkey AS field, c_custkey AS id, (c_custkey * 53 % 180)::DOUBLE AS angle, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, 'R' || lpad(c_custkey::VARCHAR, 6, '0')) AS k FROM customer),
r AS (SELECT field, id, k, 0 AS pattern, [angle] AS heads FROM d WHERE k = 1 UNION ALL SELECT field, id, k, coalesce(hit, len(heads)), CASE WHEN hit IS NULL THEN list_append(heads, angle) ELSE heads END
 FROM (SELECT d.*, r.heads, list_min(list_filter(range(0, len(r.heads)), lambda i: abs((d.angle - r.heads[i + 1] + 90) - floor((d.angle - r.heads[i + 1] + 90) / 180) * 180 - 90) <= 5)) AS hit FROM r JOIN d ON d.field = r.field AND d.k = r.k + 1))
SELECT field::VARCHAR AS field, 'R' || lpad(id::VARCHAR, 6, '0') AS row_id, pattern::INT AS pattern FROM r"""
)
def q148_angle_patterns(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("field"), F.concat(F.lit("R"), F.lpad(k.cast("string"), 6, "0")).alias("row_id"), (k * 53 % 180).cast("double").alias("angle"), F.col("c_acctbal").alias("length"), k.cast("double").alias("v"))
    return S.angle_patterns(rows).select("field", "row_id", "pattern")


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 OR c_custkey IS NULL THEN 404 WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 422 ELSE 200 END AS status FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END"""
)
def q149_status_requests(spark, sf):
    r = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("id"), F.col("o_orderpriority").alias("status"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return S.answered(r, known, ("1-URGENT", "2-HIGH", "3-MEDIUM")).select("o_orderkey", F.col("code").alias("status"))
