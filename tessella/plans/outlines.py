"""Ring repair, union outlines and overlap removal over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outlines as O
from ..scratch import Scratch
from .reports import table
from .spatial import _BOX, _boxes

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Units of the grid to one of an embedding's, as a power of two.
FINE = 24


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH p AS (SELECT vec_id, i, round(embedding[2 * i + 1]::DOUBLE * {1 << FINE}) AS x, round(embedding[2 * i + 2]::DOUBLE * {1 << FINE}) AS y, round(embedding[2 * ((i + 1) % 32) + 1]::DOUBLE * {1 << FINE}) AS x2, round(embedding[2 * ((i + 1) % 32) + 2]::DOUBLE * {1 << FINE}) AS y2 FROM embeddings, range(32) AS r(i)),
e AS (SELECT vec_id, i, least(x, x2) AS x0, CASE WHEN x < x2 THEN y ELSE y2 END AS y0, greatest(x, x2) AS x1, (y2 - y) / (x2 - x) AS m FROM p WHERE x <> x2),
c AS (SELECT a.vec_id, (b.y0 - b.m * b.x0 - a.y0 + a.m * a.x0) / (a.m - b.m) AS x, greatest(a.x0, b.x0) AS lo, least(a.x1, b.x1) AS hi FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i AND a.m <> b.m),
xs AS (SELECT vec_id, x FROM p UNION SELECT vec_id, x FROM c WHERE x > lo AND x < hi),
s AS (SELECT vec_id, x AS a, lead(x) OVER (PARTITION BY vec_id ORDER BY x) AS b FROM xs),
y AS (SELECT s.vec_id, a, b, y0 + m * ((a + b) / 2 - x0) AS y FROM s JOIN e ON e.vec_id = s.vec_id AND x0 <= a AND x1 >= b),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id, a ORDER BY y) AS n FROM y)
SELECT vec_id, round(sum((b - a) * CASE WHEN n % 2 = 0 THEN y ELSE -y END) / {1 << 2 * FINE}, 3) AS area FROM n GROUP BY 1"""
)
def q150_repaired_rings(spark, sf):
    scratch = Scratch(spark, "repaired")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y"))))
    points = table(spark, sf, "embeddings").select("vec_id", at.alias("at", "p")).select("vec_id", "at", "p.x", "p.y")
    areas = O.ring_areas(O.repaired(points, "vec_id", 2.0**-FINE, scratch))
    return scratch.settle(areas.groupBy(F.col("k").alias("vec_id")).agg(F.round(F.sum(F.col("twice").cast("double")) / 2 / float(1 << 2 * FINE), 3).alias("area")))


@query(
    f"""WITH {_BOX}, c AS (SELECT DISTINCT brand, x, y FROM (SELECT brand, unnest(range(x0::BIGINT, x1::BIGINT)) AS x, y0, y1 FROM box) b, unnest(range(y0::BIGINT, y1::BIGINT)) AS r(y)),
n AS (SELECT c.*, r.x IS NOT NULL AS right_in, u.x IS NOT NULL AS up_in, d.x IS NOT NULL AS both_in FROM c LEFT JOIN c r ON r.brand = c.brand AND r.x = c.x + 1 AND r.y = c.y LEFT JOIN c u ON u.brand = c.brand AND u.x = c.x AND u.y = c.y + 1 LEFT JOIN c d ON d.brand = c.brand AND d.x = c.x + 1 AND d.y = c.y + 1)
SELECT brand, count(*)::DOUBLE AS area, (4 * count(*) - 2 * (count(*) FILTER (right_in) + count(*) FILTER (up_in)))::DOUBLE AS perimeter, count(*) - count(*) FILTER (right_in) - count(*) FILTER (up_in) + count(*) FILTER (right_in AND up_in AND both_in) AS parts_less_holes FROM n GROUP BY 1"""
)
def q151_union_outlines(spark, sf):
    """Area and perimeter of each brand's union of boxes from its rings, and how many more parts than holes it has."""
    scratch = Scratch(spark, "outlines")
    areas = O.ring_areas(O.box_outlines(_boxes(spark, sf), "brand", scratch))
    shells = F.sum(F.when(F.col("twice") > 0, 1).otherwise(-1)).alias("parts_less_holes")
    return scratch.settle(areas.groupBy(F.col("k").alias("brand")).agg((F.sum("twice") / 2.0).alias("area"), F.sum("perimeter").alias("perimeter"), shells))
