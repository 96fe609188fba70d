"""Refits, walks, zones, windows, grids, rings and controls over the tables at hand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import geometry as K
from ..operators import graph as G
from ..operators import inspection as I
from ..operators import joins as J
from ..operators import measures as M
from ..operators import refit as RF
from ..operators import rollup as R
from ..operators.joins import dealt, meeting
from .reports import table
from .rules import BOX, PIECE, _segment_sql, derived, derived_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def rings(df: DataFrame, kernel, schema: str) -> DataFrame:
    """A kernel over boxes (id, x0, y0, x1, y1, ...) as rings, a row at a time inside Arrow batches: it gives tuples for the schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([t for r in pdf.itertuples(index=False) for t in kernel(r)], columns=names)

    # by number: a row is much work here, and small tables are read in one task
    return dealt(df, ["id"]).mapInPandas(run, schema)


def ring(x0, y0, x1, y1) -> np.ndarray:
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)


# --- grids and steps

NODE = {"r": "CAST(p_partkey % 2000 - p_partkey % 40 AS BIGINT) / 40", "c": "p_partkey % 40", "cost": "CAST(1 + p_size % 5 AS DOUBLE)"}


@query(
    """WITH n AS (SELECT (p_partkey // 40)::BIGINT AS r, p_partkey % 40 AS c, (1 + p_size % 5)::DOUBLE AS cost FROM part WHERE p_size % 7 <> 0), d AS (SELECT a, b FROM range(-1, 2) AS x(a), range(-1, 2) AS y(b) WHERE a <> 0 OR b <> 0)
SELECT n.r * 1048576 + n.c AS src, m.r * 1048576 + m.c AS dst, round(sqrt((a * a + b * b)::DOUBLE) * (n.cost + m.cost) / 2, 6) AS cost FROM n, d JOIN n m ON m.r = n.r + a AND m.c = n.c + b
WHERE EXISTS (SELECT 1 FROM n k WHERE k.r = n.r AND k.c = m.c) AND EXISTS (SELECT 1 FROM n k WHERE k.r = m.r AND k.c = n.c)"""
)
def q110_grid_edges(spark, sf):
    n = table(spark, sf, "part").where("p_size % 7 <> 0").select(F.floor(F.col("p_partkey") / 40).alias("r"), (F.col("p_partkey") % 40).alias("c"), (1 + F.col("p_size") % 5).cast("double").alias("cost"))
    return G.grid_edges(n).select("src", "dst", F.round("cost", 6).alias("cost"))


@query(
    """WITH s AS (SELECT c_custkey AS id, (c_custkey * 37 % 40)::DOUBLE AS x0, (c_custkey * 11 % 50)::DOUBLE AS y0, (c_custkey * 17 % 40)::DOUBLE AS x1, (c_custkey * 29 % 50)::DOUBLE AS y1 FROM customer), ok AS (SELECT DISTINCT p_partkey // 40 AS row, p_partkey % 40 AS col FROM part WHERE p_size % 3 <> 0)
SELECT id, round(avg(CASE WHEN ok.row IS NULL THEN 1.0 ELSE 0.0 END), 6) AS outside FROM (SELECT id, floor(x0 + (k + 0.5) / 8 * (x1 - x0))::BIGINT AS col, floor(y0 + (k + 0.5) / 8 * (y1 - y0))::BIGINT AS row FROM s, range(8) AS r(k)) p LEFT JOIN ok ON ok.row = p.row AND ok.col = p.col GROUP BY 1"""
)
def q111_outside_share(spark, sf):
    k = F.col("c_custkey")
    s = table(spark, sf, "customer").select(k.alias("id"), *[(k * a % b).cast("double").alias(n) for n, a, b in (("x0", 37, 40), ("y0", 11, 50), ("x1", 17, 40), ("y1", 29, 50))])
    ok = table(spark, sf, "part").where("p_size % 3 <> 0").select(F.floor(F.col("p_partkey") / 40).alias("row"), (F.col("p_partkey") % 40).alias("col")).distinct()
    return G.outside_share(s, ok, 1.0).select("id", F.round("outside", 6).alias("outside"))


# --- lines and boxes

LINE = {"id": "c_nationkey", "k": "c_custkey", "x0": "CAST(c_custkey * 37 % 400 AS DOUBLE)", "y0": "CAST(c_custkey * 11 % 300 AS DOUBLE)", "x1": "CAST(c_custkey * 53 % 400 AS DOUBLE)", "y1": "CAST(c_custkey * 29 % 300 AS DOUBLE)"}
PARCEL = {"id": "s_suppkey", "x0": "CAST(s_suppkey % 10 * 40 + 3 AS DOUBLE)", "y0": "CAST(s_suppkey - s_suppkey % 10 AS DOUBLE) * 3 + 2", "x1": "CAST(s_suppkey % 10 * 40 + 20 + s_suppkey % 15 AS DOUBLE)", "y1": "CAST(s_suppkey - s_suppkey % 10 AS DOUBLE) * 3 + 12 + s_suppkey % 13"}
_PART = """CASE WHEN (x1 = x0 AND NOT x0 BETWEEN l AND r) OR (y1 = y0 AND NOT y0 BETWEEN b AND t) THEN 0 ELSE greatest(0, least(1, CASE WHEN x1 <> x0 THEN greatest((l - x0) / (x1 - x0), (r - x0) / (x1 - x0)) ELSE 1 END, CASE WHEN y1 <> y0 THEN greatest((b - y0) / (y1 - y0), (t - y0) / (y1 - y0)) ELSE 1 END)
 - greatest(0, CASE WHEN x1 <> x0 THEN least((l - x0) / (x1 - x0), (r - x0) / (x1 - x0)) ELSE 0 END, CASE WHEN y1 <> y0 THEN least((b - y0) / (y1 - y0), (t - y0) / (y1 - y0)) ELSE 0 END)) END"""


@query(f"""WITH s AS ({derived_sql("customer", LINE)}), p AS (SELECT DISTINCT x0 AS l, y0 AS b, x1 AS r, y1 AS t FROM ({derived_sql("supplier", PARCEL)})) SELECT id, round(sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) * {_PART}), 4) AS inside FROM s, p GROUP BY 1 HAVING round(sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) * {_PART}), 4) > 0""")
def q112_metres_inside(spark, sf):
    parcels = derived(table(spark, sf, "supplier"), PARCEL)
    return M.metres_inside(derived(table(spark, sf, "customer"), LINE), parcels, 40.0).select("id", F.round("inside", 4).alias("inside")).where("inside > 0")


@query(
    f"""WITH s AS (SELECT k, x0, y0, x1, y1, 100.0::DOUBLE AS l, 80.0::DOUBLE AS b, 250.0::DOUBLE AS r, 200.0::DOUBLE AS t FROM ({derived_sql("customer", LINE)})) SELECT k, round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) * {_PART}, 5) AS length_m FROM s WHERE {_PART} * sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) > 0.1"""
)
def q113_clipped_to_tile(spark, sf):
    tile = [F.lit(v) for v in (100.0, 80.0, 250.0, 200.0)]
    s = derived(table(spark, sf, "customer"), LINE).withColumn("t", C.clip_segment(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], *tile))
    size = (F.col("t.hi") - F.col("t.lo")) * F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    return s.withColumn("length_m", size).where("length_m > 0.1").select("k", F.round("length_m", 5).alias("length_m"))


@query(
    """WITH p AS (SELECT p_partkey AS id, 2.0 + p_size AS la, 1.0 + p_partkey % 30 AS lb, (p_partkey % 20 - 5)::DOUBLE AS off, (p_partkey % 7) / 10.0 AS dy FROM part), c AS (SELECT *, CASE WHEN dy <= 0.4 THEN sqrt(greatest(0, 0.16 - dy * dy)) END AS cap FROM p)
SELECT id, round(CASE WHEN cap IS NULL THEN 0 ELSE least(greatest(0, least(la, off + lb + cap) - greatest(0, off - cap)) / la, greatest(0, least(off + lb, la + cap) - greatest(off, -cap)) / lb) END, 5) AS share FROM c"""
)
def q114_axis_share(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (2.0 + F.col("p_size")).alias("la"), (1.0 + F.col("p_partkey") % 30).alias("lb"), (F.col("p_partkey") % 20 - 5).cast("double").alias("off"), ((F.col("p_partkey") % 7) / 10).alias("dy"))
    share = lambda r: [(r.id, K.axis_share(np.array([[0, 0], [r.la, 0.0]]), np.array([[r.off, r.dy], [r.off + r.lb, r.dy]])))]
    return rings(p, share, "id long, share double").select("id", F.round("share", 5).alias("share"))


@query(
    f"""WITH b AS ({derived_sql("part", BOX)}), s AS (SELECT id, k, greatest(x0, k * 4) AS a, least(x1, (k + 1) * 4) AS z, y0, y1 FROM (SELECT *, unnest(range(floor(x0 / 4)::BIGINT, ceil(x1 / 4)::BIGINT)) AS k FROM b))
SELECT id, k, round((z - a) * (y1 - y0), 4) AS area, round((a + z) / 2, 4) AS cx, round((y0 + y1) / 2, 4) AS cy FROM s WHERE z > a"""
)
def q115_slices(spark, sf):
    cut = lambda r: [(r.id, int(k), float(a), float(c[0]), float(c[1])) for k, a, c in K.slices(ring(r.x0, r.y0, r.x1, r.y1), np.array([1.0, 0.0]), 4.0)]
    b = derived(table(spark, sf, "part"), BOX).select("id", "x0", "y0", "x1", "y1")
    return rings(b, cut, "id long, k long, area double, cx double, cy double").select("id", "k", *[F.round(c, 4).alias(c) for c in ("area", "cx", "cy")])


@query(
    f"""WITH b AS ({derived_sql("part", BOX)}) SELECT id, round((x1 - x0) * (y1 - y0) - 2.0 * 1.5, 4) AS area, round((x1 - x0 + 2) * (y1 - y0 + 2), 4) AS grown, round(CASE WHEN x1 - x0 > 2 AND y1 - y0 > 2 THEN (x1 - x0 - 2) * (y1 - y0 - 2) ELSE 0 END, 4) AS inset FROM b"""
)
def q116_rings_cut_and_moved(spark, sf):
    def cut(r):
        a = ring(r.x0, r.y0, r.x1, r.y1)
        rest = sum(K.area(p) for p in K.difference(a, [ring(r.x0 + 0.5, r.y0 + 0.25, r.x0 + 2.5, r.y0 + 1.75)]))
        moved = [K.moved_edges(a, np.full(4, d)) for d in (1.0, -1.0)]
        return [(r.id, rest, *(K.area(m) if len(m) else 0.0 for m in moved))]

    b = derived(table(spark, sf, "part"), BOX).select("id", "x0", "y0", "x1", "y1")
    return rings(b, cut, "id long, area double, grown double, inset double").select("id", *[F.round(c, 4).alias(c) for c in ("area", "grown", "inset")])


@query(
    f"""WITH b AS ({derived_sql("part", BOX)}) SELECT l.id AS a, r.id AS b, round(sqrt(pow(greatest(l.x0 - r.x1, 0, r.x0 - l.x1), 2) + pow(greatest(l.y0 - r.y1, 0, r.y0 - l.y1), 2)), 5) AS gap,
 round(((l.x1 - l.x0) * (l.y1 - l.y0) + (r.x1 - r.x0) * (r.y1 - r.y0)) / ((greatest(l.x1, r.x1) - least(l.x0, r.x0)) * (greatest(l.y1, r.y1) - least(l.y0, r.y0))), 5) AS envelope FROM b l JOIN b r ON r.id = l.id + 1"""
)
def q117_box_gaps(spark, sf):
    b = derived(table(spark, sf, "part"), BOX)
    side = lambda s: {c: F.col(f"{s}_{c}") for c in ("x0", "y0", "x1", "y1")}
    named = lambda s, k: b.select((F.col("id") - k).alias("a"), *[F.col(c).alias(f"{s}_{c}") for c in ("x0", "y0", "x1", "y1")])
    j = named("l", 0).join(named("r", 1), "a")
    area = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    whole = (F.greatest("l_x1", "r_x1") - F.least("l_x0", "r_x0")) * (F.greatest("l_y1", "r_y1") - F.least("l_y0", "r_y0"))
    return j.select("a", (F.col("a") + 1).alias("b"), F.round(C.box_gap(side("l"), side("r")), 5).alias("gap"), F.round((area("l") + area("r")) / whole, 5).alias("envelope"))


@query(
    """WITH p AS (SELECT vec_id, list_transform(range(8), lambda i: {'x': floor(embedding[2 * i + 1]::DOUBLE / 0.25 + 0.5) * 0.25, 'y': floor(embedding[2 * i + 2]::DOUBLE / 0.25 + 0.5) * 0.25}) AS q FROM embeddings), k AS (SELECT vec_id, list_filter(q, lambda v, i: v <> q[CASE WHEN i = 1 THEN 8 ELSE i - 1 END]) AS q FROM p)
SELECT vec_id, CASE WHEN len(q) >= 3 THEN len(q) END AS vertices, CASE WHEN len(q) >= 3 THEN round(list_sum(list_transform(q, lambda v: v.x * 3 + v.y)), 4) END AS mark FROM k"""
)
def q118_snapped_rings(spark, sf):
    points = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y")))
    s = table(spark, sf, "embeddings").select("vec_id", points.alias("p")).select("vec_id", C.snapped_ring(F.col("p"), 0.25).alias("q"))
    return s.select("vec_id", F.size("q").alias("n"), "q").select("vec_id", F.when(F.col("q").isNotNull(), F.col("n")).alias("vertices"), F.round(F.aggregate("q", F.lit(0.0), lambda a, v: a + v["x"] * 3 + v["y"]), 4).alias("mark"))


@query("""SELECT c_custkey, round(c_acctbal / 100 * cos(radians(c_nationkey * 7)) + c_custkey * sin(radians(c_nationkey * 7)), 4) AS u, round(c_custkey * cos(radians(c_nationkey * 7)) - c_acctbal / 100 * sin(radians(c_nationkey * 7)), 4) AS v FROM customer""")
def q119_row_frame(spark, sf):
    u, v = C.row_frame(F.col("c_acctbal") / 100, F.col("c_custkey").cast("double"), (F.col("c_nationkey") * 7).cast("double"))
    return table(spark, sf, "customer").select("c_custkey", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


WALK = {"walk": "c_nationkey", "place": "c_custkey", "x": "CAST(c_custkey * 37 % 60 AS DOUBLE)", "y": "CAST(c_custkey * 11 % 50 AS DOUBLE)"}
TARGET = {"id": "o_orderkey", "walk": "CAST(o_custkey % 25 AS INT)", "x": "CAST(o_orderkey * 13 % 70 AS DOUBLE) + 0.25", "y": "CAST(o_orderkey * 7 % 60 AS DOUBLE) + 0.5"}


@query(
    f"""WITH w AS ({derived_sql("customer", WALK)}), s0 AS (SELECT walk, place, x AS x0, y AS y0, lead(x) OVER v AS x1, lead(y) OVER v AS y1 FROM w WINDOW v AS (PARTITION BY walk ORDER BY place)), s1 AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS size FROM s0 WHERE x1 IS NOT NULL),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY walk ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s1), t AS ({derived_sql("orders", TARGET)}),
m AS (SELECT id, {_segment_sql("t.x", "t.y", "x0", "y0", "x1", "y1")} AS far, before + size * CASE WHEN pow(x0 - t.x, 2) + pow(y0 - t.y, 2) <= 4 THEN 0 ELSE (-((x0 - t.x) * (x1 - x0) + (y0 - t.y) * (y1 - y0)) - sqrt(greatest(0, pow((x0 - t.x) * (x1 - x0) + (y0 - t.y) * (y1 - y0), 2) - (pow(x1 - x0, 2) + pow(y1 - y0, 2)) * (pow(x0 - t.x, 2) + pow(y0 - t.y, 2) - 4)))) / nullif(pow(x1 - x0, 2) + pow(y1 - y0, 2), 0) END AS pos
 FROM t JOIN s USING (walk) WHERE {_segment_sql("t.x", "t.y", "x0", "y0", "x1", "y1")} <= 2), b AS (SELECT id, min(far) AS d, min(pos) AS pos FROM m GROUP BY 1) SELECT t.id, round(d, 4) AS distance, round(pos, 3) AS at_m FROM t LEFT JOIN b USING (id)"""
)
def q120_along_walk(spark, sf):
    out = M.along_walk(derived(table(spark, sf, "customer"), WALK), derived(table(spark, sf, "orders"), TARGET), 2.0)
    return out.select("id", F.round("distance", 4).alias("distance"), F.round("at_m", 3).alias("at_m"))


@query(f"""WITH p AS (SELECT c_custkey AS id, (c_custkey * 37 % 400)::DOUBLE AS x, (c_custkey * 11 % 300)::DOUBLE AS y FROM customer), e AS ({derived_sql("supplier", {k: v for k, v in LINE.items() if k != "id"}).replace("c_custkey", "s_suppkey")}), d AS (SELECT p.id, min({_segment_sql("x", "y", "x0", "y0", "x1", "y1")}) AS d FROM p, e GROUP BY 1) SELECT id, CASE WHEN d <= 15 THEN round(d, 4) END AS distance FROM d""")
def q121_edge_distance(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 400).cast("double").alias("x"), (k * 11 % 300).cast("double").alias("y"))
    e = table(spark, sf, "supplier").select(*[F.expr(LINE[c].replace("c_custkey", "s_suppkey")).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return M.edge_distance(p, e, 15.0).select("id", F.round("distance", 4).alias("distance"))


# --- fits, lattices, contrasts

FIT = {"p": "CAST(user_id % 5 AS INT)", "r": "CAST(user_id AS INT)", "u": "CAST(event_id % 200 AS DOUBLE) / 4", "v": "CAST(user_id AS DOUBLE) + CAST(event_id % 200 AS DOUBLE) / 4 * 0.01 + (value - 50) / 60", "w": "CAST(1 + event_id % 3 AS DOUBLE)"}


def _moments_sql(where: str, fit: str) -> str:
    """Sums of d over the rows of a fit, as operators/refit.py has them."""
    return f"""SELECT p, r, n, cu + su / sw AS mu, cv + sv / sw AS mv, round(suu - su * su / sw)::HUGEINT AS suu, round(suv - su * sv / sw)::HUGEINT AS suv FROM (
SELECT d.p, d.r, cu, cv, count(*) AS n, sum(w)::DOUBLE AS sw, sum(w * (u - cu))::DOUBLE AS su, sum(w * (v - cv))::DOUBLE AS sv, sum(w * (u - cu) * (u - cu))::DOUBLE AS suu, sum(w * (u - cu) * (v - cv))::DOUBLE AS suv FROM d JOIN {fit} f ON f.p = d.p AND f.r = d.r WHERE {where} GROUP BY ALL)"""


def _slopes_sql(sums: str) -> str:
    return f"SELECT p, CASE WHEN sum(suu) > 0 THEN round(sum(suv)::DOUBLE / sum(suu)::DOUBLE, 12) ELSE 0 END AS s FROM {sums} GROUP BY 1"


def _fit_sql(limits=(8000.0, 3000.0, 1500.0, 1500.0)) -> str:
    out = f"d AS (SELECT p, r, round(u * 10000)::BIGINT AS u, round(v * 10000)::BIGINT AS v, round(w * 1000)::BIGINT AS w FROM ({derived_sql('events WHERE value IS NOT NULL', FIT)})), f0 AS (SELECT *, round(mu)::BIGINT AS cu, round(off)::BIGINT AS cv FROM (SELECT p, r, 0::DOUBLE AS slope, round(sum(w * v)::DOUBLE / sum(w)::DOUBLE, 3) AS off, round(sum(w * u)::DOUBLE / sum(w)::DOUBLE, 3) AS mu, 0 AS n FROM d GROUP BY ALL))"
    for k, limit in enumerate(limits):
        out += f""", r{k} AS ({_moments_sql(f"abs(v::DOUBLE - off - slope * u::DOUBLE) <= {limit}::DOUBLE", f"f{k}")}), s{k} AS ({_slopes_sql(f"r{k}")}),
f{k + 1} AS (SELECT f.p, f.r, coalesce(s, slope) AS slope, CASE WHEN q.n IS NOT NULL THEN round(mv - s * q.mu, 3) ELSE off END AS off, coalesce(q.n, 0) AS n, cu, cv FROM f{k} f LEFT JOIN r{k} q ON q.p = f.p AND q.r = f.r LEFT JOIN s{k} g ON g.p = f.p)"""
    return out


@query(f"""WITH {_fit_sql()} SELECT p, r, round(slope, 5) AS slope, round(off / 10000, 4) AS "offset", n FROM f4""")
def q122_shared_fit(spark, sf):
    out = RF.shared_fit(derived(table(spark, sf, "events").where("value IS NOT NULL"), FIT), "p", "r", "u", "v", "w")
    return out.select("p", "r", F.round("slope", 5).alias("slope"), F.round("offset", 4).alias("offset"), "n")


VINES = {"p": "CAST(c_custkey % 25 AS INT)", "r": "c_custkey", "v_row": "CAST(floor(c_custkey / 25) AS DOUBLE) * 2.5", "start": "CAST(c_custkey % 7 AS DOUBLE)", "end": "CAST(20 + c_custkey % 13 AS DOUBLE)"}
SLICE = {
    "id": "o_orderkey", "p": "CAST(o_custkey % 25 AS INT)", "u": "CAST(o_orderkey % 61 AS DOUBLE) / 2", "w": "CAST(1 + o_orderkey % 3 AS DOUBLE)",
    "v": "CAST(floor(o_custkey / 25) AS DOUBLE) * 2.5 + CAST(o_orderkey % 61 AS DOUBLE) / 2 * 0.004 + CAST(o_custkey * 37 % 17 - 8 AS DOUBLE) / 9.5 + CAST(o_orderkey % 11 - 5 AS DOUBLE) / 100",
}


def _refit_sql(limits=(8000.0, 3000.0, 1500.0, 1500.0)) -> str:
    quoted = derived_sql("customer", {k: v for k, v in VINES.items() if k not in ("start", "end")} | {"s": VINES["start"], "e": VINES["end"]})
    out = f"""rw AS (SELECT p, r, round(v_row * 10000)::BIGINT AS v_row, round(s * 10000)::BIGINT AS s, round(e * 10000)::BIGINT AS e FROM ({quoted})),
pt AS (SELECT id, p, round(u * 10000)::BIGINT AS u, round(v * 10000)::BIGINT AS v, round(w * 1000)::BIGINT AS w FROM ({derived_sql("orders", SLICE)})),
d AS (SELECT p, m[2] AS r, u, m[3] AS v, w FROM (SELECT pt.id, pt.p, u, w, min((abs(v - v_row), r, v - v_row)) AS m FROM pt JOIN rw ON rw.p = pt.p WHERE abs(v - v_row) <= 8000 AND u BETWEEN s - 5000 AND e + 5000 GROUP BY ALL)),
cv AS (SELECT p, r, count(DISTINCT u // 5000) * 5000 AS cover FROM d WHERE u >= 0 GROUP BY ALL),
f0 AS (SELECT rw.p, rw.r, v_row, s, e, coalesce(cover, 0) AS cover, coalesce(cover, 0) >= greatest(30000::DOUBLE, 0.2::DOUBLE * (e - s)) AS supported, (s + e) // 2 AS cu, 0 AS cv, ((s + e) // 2)::DOUBLE AS centre, 0::DOUBLE AS slope, 0::DOUBLE AS off, 0 AS n FROM rw LEFT JOIN cv ON cv.p = rw.p AND cv.r = rw.r)"""
    for k, limit in enumerate(limits):
        out += f""", r{k} AS ({_moments_sql(f"supported AND abs(v::DOUBLE - off - slope * (u::DOUBLE - centre)) <= {limit}::DOUBLE", f"f{k}")}), s{k} AS ({_slopes_sql(f"r{k}")}),
f{k + 1} AS (SELECT f.p, f.r, v_row, s, e, cover, supported, cu, cv, CASE WHEN q.n IS NOT NULL THEN round(mu, 3) ELSE centre END AS centre, coalesce(g.s1, 0) AS slope, CASE WHEN q.n IS NOT NULL THEN round(mv, 3) ELSE 0 END AS off, coalesce(q.n, 0) AS n FROM f{k} f LEFT JOIN r{k} q ON q.p = f.p AND q.r = f.r LEFT JOIN (SELECT p, s AS s1 FROM s{k}) g ON g.p = f.p)"""
    shift = lambda w, at: f"(CASE WHEN {w}moved THEN {w}off ELSE 0 END + {w}slope * ({at}::DOUBLE - {w}centre))"
    names = ("moved", "off", "slope", "centre", "v_row", "s", "e")
    beside = ", ".join(f"lead({c}) OVER w AS b_{c}" for c in names)
    lo, hi = "greatest(s, b_s)", "least(e, b_e)"
    gap = lambda at: f"((b_v_row - v_row)::DOUBLE + {shift('b_', at)} - {shift('', at)})"
    bad = f"{hi} > {lo} AND b_v_row > v_row AND (least({gap(lo)}, {gap(hi)}) < (1 - 0.4::DOUBLE) * (b_v_row - v_row)::DOUBLE OR greatest({gap(lo)}, {gap(hi)}) > (1 + 0.4::DOUBLE) * (b_v_row - v_row)::DOUBLE)"
    # one move a pattern and round: the largest, on a tie the first
    return f"""{out}, st AS (
SELECT 0 AS round, p, r, v_row, s, e, centre, slope, off, cover, supported, supported AND n > 0 AS moved FROM f4
UNION ALL SELECT round + 1, p, r, v_row, s, e, centre, slope, off, cover, supported, moved AND r <> worst.r FROM (
SELECT *, max(CASE WHEN fault THEN {{'size': abs(off), 'first': -k, 'r': r}} END) OVER (PARTITION BY p) AS worst FROM (
SELECT *, moved AND (coalesce(wrong AND mine, false) OR coalesce(lag(wrong AND NOT mine) OVER w, false)) AS fault FROM (
SELECT *, CASE WHEN moved THEN abs(off) ELSE -1 END >= CASE WHEN b_moved THEN abs(b_off) ELSE -1 END AS mine, {bad} AS wrong FROM (
SELECT *, row_number() OVER w AS k, {beside} FROM st WINDOW w AS (PARTITION BY p ORDER BY v_row, r))) WINDOW w AS (PARTITION BY p ORDER BY v_row, r))) WHERE worst IS NOT NULL),
en AS (SELECT p, r, v_row, s, e, centre, slope, off, cover, supported, arg_max(moved, round) AS moved, arg_min(moved, round) AS first FROM st GROUP BY ALL)
SELECT p, r, cover / 10000 AS cover, supported, moved, first AND NOT moved AS reverted, round(slope, 9) AS slope, round({shift("", "s")} / 10000, 5) AS shift_start, round({shift("", "e")} / 10000, 5) AS shift_end FROM en"""


@query(f"WITH RECURSIVE {_refit_sql()}")
def q152_refit_rows(spark, sf):
    out = RF.refit(derived(table(spark, sf, "customer"), VINES), derived(table(spark, sf, "orders"), SLICE))
    return out.select("p", "r", "cover", "supported", "moved", "reverted", *[F.round(c, n).alias(c) for c, n in (("slope", 9), ("shift_start", 5), ("shift_end", 5))])


LATTICE = {"id": "s_suppkey", "g": "s_nationkey % 5", "angle": "CAST(s_suppkey * 53 % 180 AS DOUBLE) / 20", "spacing": "2.0 + CAST(s_suppkey % 9 AS DOUBLE) / 40", "wave": "1.0 + CAST(s_suppkey % 7 AS DOUBLE) / 5", "phase": "CAST(s_suppkey % 11 AS DOUBLE) / 11"}


@query(
    f"""WITH f AS ({derived_sql("supplier", LATTICE)}) SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.g = b.g AND a.id < b.id WHERE abs((a.angle - b.angle + 90) - floor((a.angle - b.angle + 90) / 180) * 180 - 90) <= 3 AND abs(a.spacing - b.spacing) <= 0.08::DOUBLE * least(a.spacing, b.spacing) AND b.wave >= 0.4::DOUBLE * a.wave AND b.wave <= 1.5::DOUBLE * a.wave
AND abs((a.phase - b.phase + 0.5) - floor(a.phase - b.phase + 0.5) - 0.5) <= 0.2::DOUBLE"""
)
def q123_one_lattice(spark, sf):
    f = derived(table(spark, sf, "supplier"), LATTICE)
    side = lambda s: f.select(*[F.col(c).alias(c if c == "g" else f"{s}_{c}") for c in LATTICE])
    of = lambda s: {c: F.col(f"{s}_{c}") for c in ("angle", "spacing", "wave", "phase")}
    # only near angles can meet: cells of the limit
    cell = lambda s: F.floor(F.col(f"{s}_angle") / 3)
    j = meeting(side("a").withColumn("cell", cell("a")), side("b").withColumn("cell", F.explode(F.array(cell("b") - 1, cell("b"), cell("b") + 1))), ["g", "cell"], spread=16)
    return j.where((F.col("a_id") < F.col("b_id")) & C.one_lattice(of("a"), of("b"))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


@query("""SELECT l_suppkey AS axis, round(avg(l_extendedprice) FILTER (abs(l_discount * 30 - 1.5) <= 0.3), 4) AS on_axis, round(avg(l_extendedprice) FILTER (abs(l_discount * 30 - 1.5) BETWEEN 0.9 AND 1.4), 4) AS off_axis, round(avg(l_extendedprice) FILTER (abs(l_discount * 30 - 1.5) <= 0.3) - avg(l_extendedprice) FILTER (abs(l_discount * 30 - 1.5) BETWEEN 0.9 AND 1.4), 3) AS contrast FROM lineitem GROUP BY 1""")
def q124_axis_contrast(spark, sf):
    px = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("axis"), (F.col("l_discount") * 30 - 1.5).alias("v"), F.col("l_extendedprice").alias("value"))
    return M.axis_contrast(px, "axis").select("axis", F.round("on_axis", 4).alias("on_axis"), F.round("off_axis", 4).alias("off_axis"), F.round("contrast", 3).alias("contrast"))


# --- zones

SAMPLE = {
    "vineyard_id": "concat('V', CAST(o_custkey % 6 AS STRING))", "row_id": "concat('V', CAST(o_custkey % 6 AS STRING), '-R', CAST(o_custkey % 30 AS STRING))", "i": "l_orderkey * 8 + l_linenumber",
    "canopy": "l_partkey % 9 < 3", "visible": "l_suppkey % 17 > 0", "zone": "CASE WHEN l_orderkey % 300 < 60 THEN concat('Z', CAST(o_custkey % 6 AS STRING), CAST(o_custkey % 2 AS STRING)) END",
}


def _samples(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = derived(table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")), SAMPLE)
    return s.groupBy("vineyard_id", "row_id", "i").agg(F.bool_or("canopy").alias("canopy"), F.bool_or("visible").alias("visible"), F.max("zone").alias("zone"))


@query(
    f"""WITH s0 AS (SELECT vineyard_id, row_id, i, bool_or(canopy) AS canopy, bool_or(visible) AS visible, max(zone) AS zone FROM ({derived_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", SAMPLE)}) GROUP BY ALL), s AS (SELECT *, visible AND NOT canopy AS e, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY row_id) AS size FROM s0),
t AS (SELECT vineyard_id, count(*) FILTER (visible) AS seen, count(*) FILTER (visible AND canopy) AS planted FROM s GROUP BY 1), g AS (SELECT vineyard_id, row_id, min(k) AS a, max(k) + 1 AS b, max(size) AS size FROM (SELECT *, k - row_number() OVER (PARTITION BY row_id, e ORDER BY k) AS isl FROM s) WHERE e GROUP BY vineyard_id, row_id, isl),
p AS (SELECT t.*, (SELECT count(*) FROM g WHERE g.vineyard_id = t.vineyard_id AND (b - a) * 0.5::DOUBLE >= 2 AND a > 0 AND b < size) AS short FROM t), z AS (SELECT vineyard_id, zone, count(*) FILTER (visible) AS zs, count(*) FILTER (visible AND canopy) AS zp FROM s WHERE zone IS NOT NULL GROUP BY ALL),
zi AS (SELECT vineyard_id, zone, count(*) * 0.5::DOUBLE AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY row_id, zone ORDER BY i) AS isl FROM s WHERE zone IS NOT NULL AND e) GROUP BY vineyard_id, zone, row_id, isl HAVING count(*) * 0.5::DOUBLE >= 2), zg AS (SELECT vineyard_id, zone, count(*) AS zshort, max(m) AS longest FROM zi GROUP BY ALL),
j AS (SELECT z.*, coalesce(zshort, 0) AS zshort, coalesce(longest, 0) AS longest, seen, planted, short, zp / zs AS share, planted / greatest(seen, 1) AS pshare, 100 * coalesce(zshort, 0) / (zs * 0.5::DOUBLE) AS rate, 100 * short / greatest(seen * 0.5::DOUBLE, 1) AS prate FROM z LEFT JOIN zg USING (vineyard_id, zone) JOIN p USING (vineyard_id)),
w AS (SELECT *, array_to_string(list_filter([CASE WHEN share < 0.75 * pshare THEN 'canopy deficit' END, CASE WHEN zshort >= 2 AND rate >= 2 * prate THEN 'short gaps' END, CASE WHEN longest >= 5 THEN 'long gap' END], lambda x: x IS NOT NULL), ', ') AS why FROM j)
SELECT zone, vineyard_id, round(zs * 0.5::DOUBLE, 1) AS row_m, round(share, 3) AS canopy_share, round(pshare, 3) AS plot_share, round(rate, 2) AS rate, round(prate, 2) AS plot_rate, round(longest, 2) AS longest_m, why, why <> '' AS kept FROM w"""
)
def q125_zone_report(spark, sf):
    return M.zone_report(_samples(spark, sf), step_m=0.5)


@query("""SELECT draw, s_suppkey AS id, round((s_suppkey * 13 % 200 + ((s_suppkey * 7919 + draw * 104729 + 15485863) * 31 % 1000003) / 1000003 * 200) - floor((s_suppkey * 13 % 200 + ((s_suppkey * 7919 + draw * 104729 + 15485863) * 31 % 1000003) / 1000003 * 200) / 200) * 200, 3) AS x, round((s_suppkey * 17 % 90 + ((s_suppkey * 7919 + draw * 104729 + 15485863) * 37 % 1000003) / 1000003 * 90) - floor((s_suppkey * 17 % 90 + ((s_suppkey * 7919 + draw * 104729 + 15485863) * 37 % 1000003) / 1000003 * 90) / 90) * 90, 3) AS y FROM supplier, range(1, 6) AS r(draw)""")
def q126_displaced_zones(spark, sf):
    k = F.col("s_suppkey")
    z = table(spark, sf, "supplier").select(k.alias("id"), (k * 13 % 200).cast("double").alias("x"), (k * 17 % 90).cast("double").alias("y"))
    return M.displaced(z, (200.0, 90.0), 5).select("draw", "id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("""SELECT c_custkey AS id, k.k::BIGINT AS k, round(c_acctbal + k.dx, 3) AS x, round(c_custkey + k.dy, 3)::DOUBLE AS y FROM customer, (VALUES (0, 0, 0), (1, 0.5, -0.5), (2, 2, 1)) AS k(k, dx, dy)""")
def q127_jittered(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    return I.jittered(c, [(0.0, 0.0), (0.5, -0.5), (2.0, 1.0)]).select("id", F.col("k").cast("long").alias("k"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


# --- rasters

@query(
    """WITH px AS (SELECT vec_id, (i // 8)::INT AS row, (i % 8)::INT AS col, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) AS r(i)) SELECT vec_id, l::INT AS level, (row // l)::INT AS row, (col // l)::INT AS col, round(avg(v), 6) AS mean FROM px, (VALUES (2), (4), (8)) AS k(l) GROUP BY ALL"""
)
def q128_pyramid(spark, sf):
    from ..operators import rasters as A

    return M.pyramid(A.pixels(table(spark, sf, "embeddings"), "vec_id", "embedding", 8), "vec_id").select("vec_id", "level", "row", "col", F.round("mean", 6).alias("mean"))


@query(
    """WITH t AS (SELECT vec_id % 3 * 2 AS tc, vec_id // 3 AS tr, i // 8 AS r, i % 8 AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) AS x(i)), w AS (SELECT y, x, y + 5 AS gy, x + 11 AS gx FROM range(24) AS a(y), range(20) AS b(x))
SELECT (y // 2)::INT AS y, (x // 2)::INT AS x, round(avg(coalesce(v, 0)), 6) AS v FROM w LEFT JOIN t ON t.tr * 8 + t.r = gy AND t.tc * 8 + t.c = gx GROUP BY ALL"""
)
def q129_world_window(spark, sf):
    from ..operators import rasters as A

    # every second column of tiles is missing
    px = A.pixels(table(spark, sf, "embeddings"), "vec_id", "embedding", 8).select(F.floor(F.col("vec_id") / 3).alias("tile_row"), (F.col("vec_id") % 3 * 2).alias("tile_col"), "row", "col", "v")
    return M.world_window(px, 8, 11, 5, 20, 24, 2).select("y", "x", F.round("v", 6).alias("v"))


@query("""SELECT event_id, CASE WHEN value >= 16 THEN 16 WHEN value >= 8 THEN 8 WHEN value >= 4 THEN 4 WHEN value >= 2 THEN 2 ELSE 1 END AS level FROM events""")
def q130_overview(spark, sf):
    return table(spark, sf, "events").select("event_id", C.overview(F.col("value")).alias("level"))


# --- sweeps, halves, exports, items

@query("""SELECT field, lane, (i // 2) + 1 AS place, (i // 2) % 2 = 0 AS forward FROM (SELECT c_nationkey AS field, c_custkey AS lane, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS i FROM customer) WHERE i % 2 = 0""")
def q131_sweep(spark, sf):
    lanes = table(spark, sf, "customer").select(F.col("c_nationkey").alias("field"), F.col("c_custkey").alias("lane"), F.col("c_acctbal").alias("v"))
    return M.sweep(lanes).select("field", "lane", "place", "forward")


@query(
    """WITH j AS (SELECT CASE WHEN d.doc_id % 2 = 0 THEN 'N' ELSE 'S' END AS half, n_chars AS v, quality = 1 AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id), f AS (SELECT half, t::DOUBLE AS t, coalesce(2.0 * count(*) FILTER (v >= t AND y) / nullif(count(*) FILTER (v >= t) + count(*) FILTER (y), 0), 0)::DOUBLE AS f1 FROM j, (VALUES (100), (300), (900), (2000), (5000)) AS g(t) GROUP BY ALL),
b AS (SELECT half, arg_max(t, (f1, -t)) AS threshold, max(f1) AS f1 FROM f GROUP BY 1) SELECT b.half, threshold, round(b.f1, 6) AS f1, round(o.f1, 6) AS held_out_f1 FROM b JOIN f o ON o.half <> b.half AND o.t = threshold"""
)
def q132_split_half(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    out = M.split_half(j, F.when(F.col("doc_id") % 2 == 0, "N").otherwise("S"), "n_chars", F.col("quality") == 1, (100, 300, 900, 2000, 5000))
    return out.select("half", "threshold", F.round("f1", 6).alias("f1"), F.round("held_out_f1", 6).alias("held_out_f1"))


@query(
    """WITH b AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 4 > 0 END AS hit, 40000 AS total FROM lineitem), c AS (SELECT count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp, count(*) FILTER (hit IS NULL) AS u, max(total) AS total FROM b), p AS (SELECT *, tp / (tp + fp + 0.5 * u) AS p, tp / total AS r FROM c)
SELECT tp, fp, u AS unlabelled, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM p"""
)
def q133_weighted_f1(spark, sf):
    b = table(spark, sf, "lineitem").select(F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 4 > 0).alias("hit"), F.lit(40000).alias("total"))
    return M.weighted_f1(b).select("tp", "fp", "unlabelled", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query("""SELECT o_orderkey, CASE WHEN NOT (o_orderkey % 5 > 0 AND o_custkey % 7 > 0) THEN 'refused' WHEN o_custkey % 30 / 1000.0 > 0.012 OR o_orderkey % 40 / 1000.0 > 0.019 THEN 'warned' ELSE 'written' END AS status FROM orders""")
def q134_export_status(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = table(spark, sf, "orders").select("o_orderkey", (k % 5 > 0).alias("closed"), (c % 7 > 0).alias("legal"), ((c % 30) / 1000).alias("outside_share"), ((k % 40) / 1000).alias("robust_share"))
    return r.select("o_orderkey", M.export_status().alias("status"))


@query(
    """WITH p AS (SELECT c_custkey AS id, c_nationkey AS field, (c_custkey * 37 % 400)::DOUBLE AS x, (c_custkey * 11 % 300)::DOUBLE AS y, c_acctbal AS gap_m FROM customer), k AS (SELECT (p_partkey * 53 % 400)::DOUBLE AS x, (p_partkey * 29 % 300)::DOUBLE AS y FROM part), n AS (SELECT p.id, count(*) AS n FROM p, k WHERE pow(p.x - k.x, 2) + pow(p.y - k.y, 2) <= 64 GROUP BY 1)
SELECT p.id, coalesce(n, 0) AS canopies, row_number() OVER (PARTITION BY field ORDER BY gap_m DESC, p.id) AS place FROM p LEFT JOIN n USING (id)"""
)
def q135_review_items(spark, sf):
    k, q = F.col("c_custkey"), F.col("p_partkey")
    p = table(spark, sf, "customer").select(k.alias("id"), F.col("c_nationkey").alias("field"), (k * 37 % 400).cast("double").alias("x"), (k * 11 % 300).cast("double").alias("y"), F.col("c_acctbal").alias("gap_m"))
    c = table(spark, sf, "part").select((q * 53 % 400).cast("double").alias("x"), (q * 29 % 300).cast("double").alias("y"))
    return M.review_items(p, c, 8.0).select("id", "canopies", "place")


@query(
    """WITH f AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'waste' WHEN 1 THEN 'inspection' ELSE event_type END AS label, CASE WHEN event_id % 3 > 0 THEN event_id::VARCHAR END AS id, event_type AS reason, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 > 1 THEN 'P' || user_id::VARCHAR END AS pattern, 'V' || (user_id % 9)::VARCHAR AS v FROM events)
SELECT event_id, CASE WHEN label = 'waste' THEN 'waste' ELSE reason END AS kind, coalesce(nullif(pattern, ''), v) AS pattern FROM f WHERE label = 'waste' OR (label = 'inspection' AND id IS NOT NULL)"""
)
def q136_visit_points(spark, sf):
    k = F.col("event_id")
    f = table(spark, sf, "events").select(
        "event_id", F.when(k % 4 == 0, "waste").when(k % 4 == 1, "inspection").otherwise(F.col("event_type")).alias("label"), F.when(k % 3 > 0, k.cast("string")).alias("id"), F.col("event_type").alias("reason"),
        F.when(k % 5 == 0, "").when(k % 5 > 1, F.concat(F.lit("P"), F.col("user_id").cast("string"))).alias("pattern"), F.concat(F.lit("V"), (F.col("user_id") % 9).cast("string")).alias("v"),
    )
    return I.visit_points(f).select("event_id", "kind", C.pattern_of(F.col("pattern"), F.col("v")).alias("pattern"))


@query("""WITH k AS (SELECT list(p_name) AS names FROM (SELECT DISTINCT p_name FROM part WHERE p_type = 'ECONOMY')) SELECT p_partkey, CASE WHEN list_contains(names, regexp_replace(t, '^[0-9]+_', '')) THEN regexp_replace(t, '^[0-9]+_', '') ELSE t END AS name FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR || '_' || p_name ELSE p_name END AS t FROM part), k""")
def q137_known_names(spark, sf):
    p = table(spark, sf, "part")
    names = p.where("p_type = 'ECONOMY'").agg(F.collect_set("p_name").alias("names"))  # one row: names are few, however many parts there are
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("_"), F.col("p_name"))).otherwise(F.col("p_name"))
    return p.crossJoin(F.broadcast(names)).select("p_partkey", C.known_name(t, F.col("names")).alias("name"))


@query(
    "WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'prediction' WHEN o_orderstatus = 'F' THEN NULL ELSE 'organizer' END AS source, CASE o_orderkey % 3 WHEN 0 THEN 'row' WHEN 1 THEN 'tile' ELSE 'waste' END AS label, o_custkey % 40 AS tile, o_totalprice AS v FROM orders) SELECT tile, label, count(*) AS n, round(min(v), 2) AS lo, round(max(v), 2) AS hi FROM f WHERE source IS DISTINCT FROM 'prediction' AND label IN ('row', 'tile') GROUP BY ALL"
)
def q138_objects_on_tiles(spark, sf):
    k = F.col("o_orderkey")
    f = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "prediction").when(F.col("o_orderstatus") == "O", "organizer").alias("source"), F.when(k % 3 == 0, "row").when(k % 3 == 1, "tile").otherwise("waste").alias("label"), (F.col("o_custkey") % 40).alias("tile"), F.col("o_totalprice").alias("v"))
    return R.scored(f, "row", "tile").groupBy("tile", "label").agg(F.count("*").alias("n"), F.round(F.min("v"), 2).alias("lo"), F.round(F.max("v"), 2).alias("hi"))


@query(
    """WITH RECURSIVE s AS (SELECT l_orderkey AS line, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS k, l_partkey % 12 AS a, l_suppkey % 12 + 12 * (l_linenumber % 2) AS b FROM lineitem), u AS (SELECT line, k, a AS node FROM s UNION ALL SELECT line, k, b FROM s), d AS (SELECT line, node, count(*) AS n FROM u GROUP BY ALL),
e AS (SELECT DISTINCT x.line, x.k AS p, y.k AS q FROM u x JOIN u y ON x.line = y.line AND x.node = y.node AND x.k <> y.k JOIN d ON d.line = x.line AND d.node = x.node WHERE d.n = 2), r AS (SELECT line, k AS node, k AS root FROM s UNION SELECT e.line, e.q, r.root FROM r JOIN e ON e.line = r.line AND e.p = r.node),
c AS (SELECT line, node, min(root) AS root FROM r GROUP BY ALL) SELECT line, root AS part, count(*) AS pieces FROM c GROUP BY ALL"""
)
def q139_merged_lines(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("line"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_partkey") % 12).alias("a"), (F.col("l_suppkey") % 12 + 12 * (F.col("l_linenumber") % 2)).alias("b"))
    return J.merged_parts(s).withColumnRenamed("root", "part")


@query(
    f"""SELECT tile, count(*) AS n, round(sum(end_ - start), 2) AS metres, row_number() OVER (ORDER BY round(sum(end_ - start), 2) DESC, tile) AS place FROM (SELECT {", ".join(f"{e} AS {n}" for n, e in PIECE.items())} FROM lineitem) WHERE end_ - start > 3 GROUP BY tile"""
)
def q140_longest_flags(spark, sf):
    from ..operators.sequences import numbered

    p = derived(table(spark, sf, "lineitem"), PIECE).where("end_ - start > 3").groupBy("tile").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end_") - F.col("start")), 2).alias("metres"))
    return numbered(p, [F.desc("metres"), F.asc("tile")], "place")
