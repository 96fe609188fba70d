"""Hops over rows on a world laid out from the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hops as H
from .reports import table
from .rules import derived, derived_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

ROW = {"row_id": "s_suppkey", "x0": "CAST((s_suppkey - 1) % 5 AS DOUBLE) * 16 + 1", "y0": "CAST(floor((s_suppkey - 1) / 5) AS DOUBLE) * 2.5 + 0.1", "x1": "CAST((s_suppkey - 1) % 5 AS DOUBLE) * 16 + 15", "y1": "CAST(floor((s_suppkey - 1) / 5) AS DOUBLE) * 2.5 + 0.1 + CAST(s_suppkey % 3 AS DOUBLE) / 20"}
CANOPY = {"x0": "CAST(c_custkey * 71 % 800 AS DOUBLE) / 10", "y0": "CAST(c_custkey AS DOUBLE) / 30", "x1": "CAST(c_custkey * 71 % 800 AS DOUBLE) / 10 + 0.2 + CAST(c_custkey % 5 AS DOUBLE) * 0.15", "y1": "CAST(c_custkey AS DOUBLE) / 30 + 0.3 + CAST(c_custkey % 4 AS DOUBLE) * 0.1"}
FORBIDDEN = {"x0": "CAST(n_nationkey AS DOUBLE) * 3", "y0": "CAST(n_nationkey AS DOUBLE) * 2", "x1": "CAST(n_nationkey AS DOUBLE) * 3 + 2", "y1": "CAST(n_nationkey AS DOUBLE) * 2 + 1.5"}
PARAMS = H.HopParams(young_penalty=70.0, rows_max=2)


def _meet_sql(a: tuple, b: tuple) -> str:
    turn = lambda s, x, y: f"sign(({s[2]} - {s[0]}) * ({y} - {s[1]}) - ({s[3]} - {s[1]}) * ({x} - {s[0]}))"
    over = " AND ".join(f"least({a[k]}, {a[k + 2]}) <= greatest({b[k]}, {b[k + 2]}) AND least({b[k]}, {b[k + 2]}) <= greatest({a[k]}, {a[k + 2]})" for k in (0, 1))
    return f"{over} AND {turn(a, b[0], b[1])} * {turn(a, b[2], b[3])} <= 0 AND {turn(b, a[0], a[1])} * {turn(b, a[2], a[3])} <= 0"


def _clear_sql(hops: str, crossings: int, tiers: int) -> str:
    half, h = "len / 2", PARAMS.width / 2
    meets = f"abs(cx) <= ex + {half} * abs(dx) + {h} * abs(dy) AND abs(cy) <= ey + {half} * abs(dy) + {h} * abs(dx) AND abs(cx * dx + cy * dy) <= {half} + ex * abs(dx) + ey * abs(dy) AND abs(cx * dy - cy * dx) <= {h} + ex * abs(dy) + ey * abs(dx)"
    return f"""WITH g AS (SELECT q.a, q.b, (m.i + 0.5::DOUBLE) * 0.5 AS gx, (m.j + 0.5::DOUBLE) * 0.5 AS gy, (n.i + 0.5::DOUBLE) * 0.5 AS hx, (n.j + 0.5::DOUBLE) * 0.5 AS hy, (m.outside + n.outside) / 2 AS share FROM (SELECT DISTINCT a, b FROM {hops}) q JOIN node m ON m.node = q.a JOIN node n ON n.node = q.b),
o AS (SELECT a, b, gx, gy, hx, hy, share, sqrt(pow(hx - gx, 2) + pow(hy - gy, 2)) AS len FROM g JOIN rw ON {_meet_sql(("gx", "gy", "hx", "hy"), ("x0", "y0", "x1", "y1"))} GROUP BY ALL HAVING count(DISTINCT row_id) = {crossings}),
d AS (SELECT *, (hx - gx) / len AS dx, (hy - gy) / len AS dy FROM o),
k AS (SELECT a, b, max(kind) AS kind FROM d, bx, LATERAL (SELECT (x0 + x1) / 2 - (gx + hx) / 2 AS cx, (y0 + y1) / 2 - (gy + hy) / 2 AS cy, (x1 - x0) / 2 AS ex, (y1 - y0) / 2 AS ey) WHERE {meets} GROUP BY ALL)
SELECT a, b, coalesce(kind, 0) + 1 AS tier, len * ((1 - share) + share * 60) AS metres FROM d LEFT JOIN k USING (a, b) WHERE coalesce(kind, 0) + 1 <= {tiers}"""


SQL["q153_hop_edges"] = f"""WITH rw AS ({derived_sql("supplier", ROW)}),
bx AS (SELECT x0, y0, x1, y1, CASE WHEN (x1 - x0) * (y1 - y0) < 0.25::DOUBLE THEN 1 ELSE 2 END AS kind FROM ({derived_sql("customer", CANOPY)}) UNION ALL SELECT x0, y0, x1, y1, 3 FROM ({derived_sql("nation", FORBIDDEN)})),
node AS (SELECT node, node % 160 AS i, node // 160 AS j, CASE WHEN node % 5 = 0 THEN 0.25::DOUBLE ELSE 0 END AS outside FROM (SELECT (p_partkey - 1) * 8 + t AS node FROM part, range(8) AS r(t)) WHERE node * 37 % 11 <> 0),
pt AS (SELECT x0 + t * (x1 - x0) AS px, y0 + t * (y1 - y0) AS py, (x1 - x0) / m AS tx, (y1 - y0) / m AS ty FROM (SELECT *, (k + 0.5::DOUBLE) / n AS t FROM (SELECT *, floor(m / 0.5)::BIGINT AS n FROM (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS m FROM rw)), range(n) AS r(k))),
gp AS (SELECT m.node AS a, o.node AS b, px, py, tx, ty FROM pt JOIN node m ON m.i = floor((px - 0.9 * ty) / 0.5) AND m.j = floor((py + 0.9 * tx) / 0.5) JOIN node o ON o.i = floor((px + 0.9 * ty) / 0.5) AND o.j = floor((py - 0.9 * tx) / 0.5) WHERE m.node <> o.node),
c1 AS ({_clear_sql("gp", 1, 2)}),
pc AS (SELECT gp.a AS s, gp.b AS e, px, py, tx, ty, ty AS dx, -tx AS dy FROM gp JOIN c1 USING (a, b) UNION ALL SELECT gp.b, gp.a, px, py, tx, ty, -ty, tx FROM gp JOIN c1 USING (a, b)),
ch AS (SELECT DISTINCT f.s AS a, g.e AS b FROM pc f JOIN node n ON n.node = f.e JOIN (SELECT pc.*, i, j FROM pc JOIN node ON node = s) g ON sqrt(pow((n.i - g.i) * 0.5, 2) + pow((n.j - g.j) * 0.5, 2)) <= 1.6 AND abs((g.px - f.px) * f.tx + (g.py - f.py) * f.ty) <= 0.3::DOUBLE AND (g.px - f.px) * f.dx + (g.py - f.py) * f.dy > 1 AND g.dx * f.dx + g.dy * f.dy > 0.995::DOUBLE WHERE f.s <> g.e),
c2 AS ({_clear_sql("ch", 2, 1)}),
al AS (SELECT a, b, metres + CASE WHEN tier = 1 THEN 50 ELSE 70 END AS cost, tier, 1 AS crossed FROM c1 UNION ALL SELECT a, b, metres + 100, tier, 2 FROM c2)
SELECT low, high, round(m[1], 6) AS cost, m[3]::INT AS tier, m[2]::INT AS crossed FROM (SELECT least(a, b) AS low, greatest(a, b) AS high, min((cost, crossed, tier)) AS m FROM al GROUP BY ALL)"""


def q153_hop_edges(spark, sf):
    node = table(spark, sf, "part").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: (F.col("p_partkey") - 1) * 8 + t)).alias("node")).where("node * 37 % 11 <> 0")
    node = node.select("node", (F.col("node") % 160).alias("i"), F.floor(F.col("node") / 160).alias("j"), F.when(F.col("node") % 5 == 0, 0.25).otherwise(0.0).alias("outside"))
    out = H.hop_edges(derived(table(spark, sf, "supplier"), ROW), derived(table(spark, sf, "customer"), CANOPY), derived(table(spark, sf, "nation"), FORBIDDEN), node, PARAMS)
    return out.withColumn("cost", F.round("cost", 6))


QUERIES["q153_hop_edges"] = q153_hop_edges
