"""Cell sets in tiles over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks as M
from ..operators import overlaps as V
from ..scratch import Scratch
from .reports import table
from .rules import derived, derived_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

REACH = 3
STRIP = {"field": "CAST(p_partkey % 40 AS INT)", "kind": "CAST(p_size % 4 AS INT)", "x0": "p_partkey * 7 % 311", "y0": "p_partkey * 13 % 207", "x1": "p_partkey * 7 % 311 + 2 + p_size % 4", "y1": "p_partkey * 13 % 207 + 15 + p_size % 31"}
#: Offsets within reach, and the sums that tell cell sets apart.
DISC = f"o AS (SELECT a, b FROM range(-{REACH}, {REACH + 1}) AS x(a), range(-{REACH}, {REACH + 1}) AS y(b) WHERE a * a + b * b <= {REACH * REACH})"
SUMS = "count(*) AS cells, sum(i)::BIGINT AS sum_i, sum(j)::BIGINT AS sum_j, sum(i * j % 1009)::BIGINT AS mixed"


def _fill_sql(where: str) -> str:
    return f"SELECT DISTINCT field, i, j FROM (SELECT field, unnest(range(x0, x1)) AS i, y0, y1 FROM b WHERE {where}) t, unnest(range(y0, y1)) AS r(j)"


def _sums(tiles):
    c = M.cells(tiles)
    return c.groupBy(F.col("k").cast("int").alias("field")).agg(F.count("*").alias("cells"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"), F.sum(F.col("i") * F.col("j") % 1009).alias("mixed"))


SQL["q155_field_masks"] = f"""WITH b AS ({derived_sql("part", STRIP)}), {DISC}, s AS ({_fill_sql("kind = 0 AND field % 3 = 0")}), f AS ({_fill_sql("NOT (kind = 0 AND field % 3 = 0) AND field NOT IN (SELECT field FROM b WHERE kind = 0 AND field % 3 = 0)")}),
g AS (SELECT DISTINCT field, i + a AS i, j + b AS j FROM f, o), h AS (SELECT field, i + a AS i, j + b AS j FROM g, o GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM o))
SELECT field, {SUMS} FROM (SELECT * FROM s UNION ALL SELECT * FROM h) GROUP BY 1"""


def q155_field_masks(spark, sf):
    b = derived(table(spark, sf, "part"), STRIP)
    return _sums(M.field_masks(b.where("kind = 0 AND field % 3 = 0"), b.where("NOT (kind = 0 AND field % 3 = 0)"), "field", REACH))


SQL["q156_robust_space"] = f"""WITH b AS ({derived_sql("part", STRIP)}), {DISC}, f AS ({_fill_sql("kind < 2")}), p AS ({_fill_sql("kind = 2")}), x AS ({_fill_sql("kind = 3")}),
g AS (SELECT DISTINCT field, i + a AS i, j + b AS j FROM f, range(-1, 2) AS u(a), range(-1, 2) AS v(b)), h AS (SELECT field, i + a AS i, j + b AS j FROM g, o GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM o))
SELECT field, {SUMS} FROM (SELECT * FROM h UNION SELECT * FROM p EXCEPT SELECT * FROM x) GROUP BY 1"""


def q156_robust_space(spark, sf):
    b = derived(table(spark, sf, "part"), STRIP)
    return _sums(M.robust_space(b.where("kind < 2"), b.where("kind = 2"), b.where("kind = 3"), "field", 1, REACH - 1))


QUERIES |= {"q155_field_masks": q155_field_masks, "q156_robust_space": q156_robust_space}

PLOT = {"k": "lpad(CAST(p_partkey AS STRING), 8, '0')", "field": "CAST(floor(p_partkey / 50) AS INT)", "x0": "p_partkey * 7 % 151", "y0": "p_partkey * 13 % 97", "x1": "p_partkey * 7 % 151 + 4 + p_size % 17", "y1": "p_partkey * 13 % 97 + 5 + p_partkey % 23"}
LEAST = 12

# one plot a field and round, in order; a plot's cells are taken by all rounds after it
SQL["q157_without_overlaps"] = f"""WITH RECURSIVE b AS ({derived_sql("part", PLOT).replace("CAST(p_partkey AS STRING)", "p_partkey::VARCHAR")}), o AS (SELECT *, (x1 - x0) * (y1 - y0) AS cells, row_number() OVER (PARTITION BY field ORDER BY (x1 - x0) * (y1 - y0) DESC, k) AS n FROM b),
c AS (SELECT field, n, i, j FROM (SELECT field, n, unnest(range(x0, x1)) AS i, y0, y1 FROM o) t, unnest(range(y0, y1)) AS r(j)),
s AS (SELECT 1 AS round, field, n, i, j FROM c WHERE n = 1 AND (SELECT max(cells) FROM o WHERE o.field = c.field) >= {LEAST}
UNION ALL (WITH t AS (SELECT * FROM s), f AS (SELECT c.*, (SELECT max(round) FROM t) + 1 AS r FROM c WHERE n = (SELECT max(round) FROM t) + 1), g AS (SELECT f.field, f.n, f.i, f.j, f.r, t.i IS NULL AS free, count(*) OVER w AS all_, count(*) FILTER (t.i IS NULL) OVER w AS left_ FROM f LEFT JOIN t ON t.field = f.field AND t.i = f.i AND t.j = f.j WINDOW w AS (PARTITION BY f.field))
SELECT r, field, n, i, j FROM g WHERE free AND 2 * (all_ - left_) <= all_ AND left_ >= {LEAST} UNION ALL SELECT round + 1, field, n, i, j FROM t WHERE round < (SELECT max(n) FROM o)))
SELECT o.k, o.cells, coalesce(m.left_, 0) AS "left", m.left_ IS NOT NULL AS kept FROM o LEFT JOIN (SELECT field, n, count(*) AS left_ FROM s WHERE round = (SELECT max(n) FROM o) GROUP BY ALL) m ON m.field = o.field AND m.n = o.n"""


def q157_without_overlaps(spark, sf):
    """Every plot with its cells and those it keeps; parts are not told apart, which SQL can't."""
    scratch = Scratch(spark, "overlaps")
    b = derived(table(spark, sf, "part"), PLOT)
    _, verdicts = V.without_overlaps(M.from_boxes(b, "k"), b.select("k", "field"), LEAST, scratch, whole=False)
    return scratch.settle(verdicts.select("k", "cells", "left", "kept"))


QUERIES["q157_without_overlaps"] = q157_without_overlaps
