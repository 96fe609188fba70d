"""Proximity joins, boxes, rasters and graphs over the tables at hand."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph as G
from ..operators import joins as J
from ..operators import rasters as A
from .reports import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_COMPONENTS = """RECURSIVE e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON abs(a.s_acctbal - b.s_acctbal) < 60), r AS (SELECT s_suppkey AS node, s_suppkey AS root FROM supplier UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)"""


def _blocks(spark, sf):
    s = table(spark, sf, "supplier")
    return J.components(s.select(F.col("s_suppkey").alias("node")), J.links(s, "s_suppkey", "s_acctbal", 60.0))


@query(f"WITH {_COMPONENTS} SELECT node, root FROM c")
def q09_connected_blocks(spark, sf):
    return _blocks(spark, sf)


@query(f"WITH {_COMPONENTS}, t AS (SELECT root, sum(s_acctbal) AS total FROM c JOIN supplier ON node = s_suppkey GROUP BY root HAVING sum(s_acctbal) >= 5000) SELECT c.node, c.root, round(total, 2) AS total FROM c JOIN t ON c.root = t.root")
def q10_component_area_filter(spark, sf):
    area = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("area"))
    return J.large_components(_blocks(spark, sf).join(area, "node"), 5000.0).select("node", "root", F.round("total", 2).alias("total"))


@query(
    """WITH p AS (SELECT s_suppkey, min((abs(s_acctbal - c_acctbal), c_name)) AS m FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 100 GROUP BY 1)
SELECT s.s_suppkey, coalesce(m[2], '') AS nearest, round(m[1], 4) AS distance FROM supplier s LEFT JOIN p ON s.s_suppkey = p.s_suppkey"""
)
def q11_nearest_with_reach(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = table(spark, sf, "customer").select("c_name", F.col("c_nationkey").alias("nation"), "c_acctbal")
    return J.nearest(s, c, "s_suppkey", "c_name", "s_acctbal", "c_acctbal", 100.0, ["nation"]).select("s_suppkey", "nearest", F.round("distance", 4).alias("distance"))


_BOX = "box AS (SELECT p_partkey AS id, p_brand AS brand, p_size * 10.0::DOUBLE AS x0, (p_partkey * 37 % 500)::DOUBLE AS y0, (p_size * 10.0 + 5 + p_partkey % 20)::DOUBLE AS x1, (p_partkey * 37 % 500 + 10 + p_partkey % 30)::DOUBLE AS y1 FROM part)"
_OVER = f"""{_BOX}, o AS (SELECT l.brand, l.id AS a, r.id AS b, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS overlap, (l.x1 - l.x0) * (l.y1 - l.y0) AS area_a, (r.x1 - r.x0) * (r.y1 - r.y0) AS area_b
FROM box l JOIN box r ON l.brand = r.brand AND l.id % 2 = 0 AND r.id % 2 = 1 AND least(l.x1, r.x1) > greatest(l.x0, r.x0) AND least(l.y1, r.y1) > greatest(l.y0, r.y0))"""
CELL = (40.0, 60.0)


def _boxes(spark, sf):
    x0, y0, k = F.col("p_size") * 10.0, (F.col("p_partkey") * 37 % 500).cast("double"), F.col("p_partkey")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), x0.alias("x0"), y0.alias("y0"), (x0 + 5 + k % 20).alias("x1"), (y0 + 10 + k % 30).alias("y1"))


def _pairs(spark, sf):
    b = _boxes(spark, sf)
    return J.overlaps(b.where("id % 2 = 0"), b.where("id % 2 = 1"), ["brand"], *CELL)


@query(f"WITH {_OVER}, m AS (SELECT a, max((overlap, b, area_a, area_b)) AS m FROM o GROUP BY a) SELECT id AS a, CASE WHEN m[1] >= 0.1 * least(m[3], m[4]) THEN m[2] END AS b, CASE WHEN m[1] >= 0.1 * least(m[3], m[4]) THEN round(m[1], 4) END AS overlap FROM box LEFT JOIN m ON box.id = m.a WHERE id % 2 = 0")
def q12_max_overlap_join(spark, sf):
    return J.max_overlap_of(_boxes(spark, sf).where("id % 2 = 0"), _boxes(spark, sf).where("id % 2 = 1"), ["brand"], *CELL, 0.1).withColumn("overlap", F.round("overlap", 4))


@query(f"WITH {_OVER} SELECT brand, a, b, round(overlap, 4) AS overlap FROM o")
def q13_bbox_join(spark, sf):
    return _pairs(spark, sf).select("brand", "a", "b", F.round("overlap", 4).alias("overlap"))


@query(
    f"""WITH {_BOX}, xs AS (SELECT brand, x, lead(x) OVER (PARTITION BY brand ORDER BY x) AS nx FROM (SELECT brand, x0 AS x FROM box UNION SELECT brand, x1 FROM box)),
s AS (SELECT xs.brand, x, nx, y0, y1, max(y1) OVER (PARTITION BY xs.brand, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM xs JOIN box ON box.brand = xs.brand AND x0 <= x AND x1 >= nx)
SELECT brand, round(sum((nx - x) * greatest(0, y1 - greatest(y0, coalesce(p, y0)))), 3) AS area FROM s GROUP BY brand"""
)
def q16_box_union_area(spark, sf):
    return A.box_union_area(_boxes(spark, sf), "brand", *CELL).select("brand", F.round("area", 3).alias("area"))


@query(
    """WITH v AS (SELECT vec_id, unnest(range(32)) AS i, embedding FROM embeddings), p AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y, embedding[2 * ((i + 1) % 32) + 1]::DOUBLE AS x2, embedding[2 * ((i + 1) % 32) + 2]::DOUBLE AS y2 FROM v)
SELECT vec_id, round(abs(sum(x * y2 - x2 * y)) / 2, 5) AS area FROM p GROUP BY 1"""
)
def q17_shoelace_area(spark, sf):
    ring = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y")))
    return table(spark, sf, "embeddings").withColumn("ring", ring).select("vec_id", F.round(C.shoelace(F.col("ring")), 5).alias("area"))


@query("SELECT c_custkey, round(628992.0 + c_acctbal * 0.025, 6) AS x, round(5221222.4 - c_custkey::DOUBLE * 0.025, 6) AS y, round((628992.0 + c_acctbal * 0.025 - 628992.0) / 0.025, 3) AS col, round((5221222.4 - (5221222.4 - c_custkey::DOUBLE * 0.025)) / 0.025, 3) AS row FROM customer")
def q18_affine_roundtrip(spark, sf):
    x, y = C.to_world(F.col("c_acctbal"), F.col("c_custkey"), 628992.0, 5221222.4, 0.025)
    col, row = C.to_pixel(x, y, 628992.0, 5221222.4, 0.025)
    return table(spark, sf, "customer").select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(col, 3).alias("col"), F.round(row, 3).alias("row"))


@query(
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS x0, embedding[4]::DOUBLE AS y0, embedding[5]::DOUBLE AS x1, embedding[6]::DOUBLE AS y1 FROM embeddings),
t AS (SELECT *, CASE WHEN (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) > 0 THEN greatest(0, least(1, ((px-x0)*(x1-x0)+(py-y0)*(y1-y0)) / ((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) ELSE 0 END AS t FROM p) SELECT vec_id, round(sqrt(pow(px-x0-t*(x1-x0), 2) + pow(py-y0-t*(y1-y0), 2)), 6) AS distance FROM t"""
)
def q19_segment_distance(spark, sf):
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(6)]
    return table(spark, sf, "embeddings").select("vec_id", F.round(C.segment_distance(*v), 6).alias("distance"))


_PIXELS = "px AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(f"WITH {_PIXELS} SELECT vec_id, (i // 8 // 2)::INT AS row, (i % 8 // 2)::INT AS col, round(avg(v), 6) AS mean FROM px GROUP BY ALL")
def q20_block_mean(spark, sf):
    return A.block_mean(A.pixels(table(spark, sf, "embeddings"), "vec_id", "embedding", 8), "vec_id", 2).select("vec_id", "row", "col", F.round("mean", 6).alias("mean"))


@query(f"WITH {_PIXELS} SELECT vec_id, k::INT AS k, round(pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2), 4) AS power FROM px, range(1, 5) AS f(k) GROUP BY ALL")
def q21_dft_power(spark, sf):
    return A.dft_power(table(spark, sf, "embeddings"), "vec_id", "embedding", 64, (1, 2, 3, 4)).select("vec_id", "k", F.round("power", 4).alias("power"))


@query(f"WITH {_PIXELS}, c AS (SELECT vec_id, avg(v * cos(2 * pi() * i / 5.0)) AS re, avg(v * sin(2 * pi() * i / 5.0)) AS im FROM px GROUP BY 1) SELECT vec_id, round(2 * sqrt(re * re + im * im), 6) AS amplitude, round(atan2(im, re) / (2 * pi()), 5) AS turns FROM c")
def q22_phasor_phase(spark, sf):
    p = A.pixels(table(spark, sf, "embeddings"), "vec_id", "embedding", 8).withColumn("i", F.col("row") * 8 + F.col("col"))
    return A.phasor(p, "vec_id", "i", "v", 5.0).select("vec_id", F.round("amplitude", 6).alias("amplitude"), F.round("turns", 5).alias("turns"))


@query("SELECT vec_id, round(0.7 * 0.4 * embedding[2 * 8 + 3 + 1]::DOUBLE + 0.7 * 0.6 * embedding[2 * 8 + 4 + 1]::DOUBLE + 0.3 * 0.4 * embedding[3 * 8 + 3 + 1]::DOUBLE + 0.3 * 0.6 * embedding[3 * 8 + 4 + 1]::DOUBLE, 6) AS v FROM embeddings")
def q23_bilinear_sample(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(A.bilinear(F.col("embedding"), 8, F.lit(2.3), F.lit(3.6)), 6).alias("v"))


@query("SELECT vec_id, round(CASE WHEN r + g + b > 30 THEN (2 * g - r - b) / (r + g + b) ELSE 0 END, 6) AS exg FROM (SELECT vec_id, abs(embedding[1]::DOUBLE) * 100 AS r, abs(embedding[2]::DOUBLE) * 100 AS g, abs(embedding[3]::DOUBLE) * 100 AS b FROM embeddings)")
def q25_exg_index(spark, sf):
    r, g, b = (F.abs(F.get("embedding", F.lit(i)).cast("double")) * 100 for i in range(3))
    return table(spark, sf, "embeddings").select("vec_id", F.round(C.excess_green(r, g, b), 6).alias("exg"))


@query(f"WITH {_PIXELS} SELECT vec_id, round(avg((v > 0.12)::INT), 6) AS share, CASE WHEN avg((v > 0.12)::INT) < 0.25 THEN 'bare_soil' WHEN avg((v > 0.12)::INT) > 0.75 THEN 'vegetation' ELSE 'mixed' END AS cover FROM px GROUP BY 1")
def q26_cover_class(spark, sf):
    share = F.size(F.filter("embedding", lambda v: v.cast("double") > 0.12)) / F.size("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(share, 6).alias("share"), C.cover_class(share).alias("cover"))


@query(f"WITH {_PIXELS} SELECT label, i::INT AS i, round(median(CASE WHEN v > -0.05 THEN v END), 6) AS med FROM px GROUP BY ALL")
def q47_pixel_nanmedian(spark, sf):
    p = A.pixels(table(spark, sf, "embeddings"), "label", "embedding", 8)
    return p.groupBy("label", (F.col("row") * 8 + F.col("col")).alias("i")).agg(F.round(F.median(F.when(F.col("v") > -0.05, F.col("v"))), 6).alias("med"))


_STEPS = "SELECT src::BIGINT AS src, target::BIGINT AS dst, step::BIGINT AS step, node::BIGINT AS node, cost::DOUBLE AS cost"


@query(
    f"""WITH RECURSIVE t AS (SELECT n_nationkey AS src, n_nationkey AS node, 0 AS step, 0 AS cost, [n_nationkey] AS path FROM nation UNION ALL SELECT t.src, n.n_nationkey, t.step + 1, t.cost + n.n_regionkey + 1, list_append(path, n.n_nationkey) FROM t JOIN nation n ON n.n_nationkey = t.node - 3),
s AS (SELECT t.src, t.node AS target, u.step, u.node, u.cost FROM t JOIN t u ON u.src = t.src AND list_contains(t.path, u.node)) {_STEPS} FROM s"""
)
def q51_path_trace(spark, sf):
    n = table(spark, sf, "nation")
    edges = n.select((F.col("n_nationkey") + 3).alias("src"), F.col("n_nationkey").alias("dst"), (F.col("n_regionkey") + 1).alias("cost"))
    return G.shortest_paths(edges, n.select(F.col("n_nationkey").alias("node")), steps=True)


@query(
    f"""WITH RECURSIVE {_OVER}, p AS (SELECT brand AS part, a AS i, b AS j, round(overlap / (area_a + area_b - overlap), 6) AS score FROM o WHERE overlap / (area_a + area_b - overlap) >= 0.1),
k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, i DESC, j DESC) AS k FROM p),
r AS (SELECT part, k, i, j, score, true AS kept, [i] AS li, [j] AS lj FROM k WHERE k = 1 UNION ALL SELECT k.part, k.k, k.i, k.j, k.score, NOT list_contains(li, k.i) AND NOT list_contains(lj, k.j),
 CASE WHEN list_contains(li, k.i) OR list_contains(lj, k.j) THEN li ELSE list_append(li, k.i) END, CASE WHEN list_contains(li, k.i) OR list_contains(lj, k.j) THEN lj ELSE list_append(lj, k.j) END FROM r JOIN k ON k.part = r.part AND k.k = r.k + 1)
SELECT part, i, j, score FROM r WHERE kept"""
)
def q52_greedy_match(spark, sf):
    b = _boxes(spark, sf)
    return J.greedy_match_boxes(b.where("id % 2 = 0"), b.where("id % 2 = 1"), "brand", *CELL, 0.1)


_EDGES = "e AS (SELECT n_nationkey AS s, (n_nationkey * 7 + 1) % 25 AS d, 1 + n_nationkey % 5 AS c FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 2) % 25, 2 + n_nationkey % 3 FROM nation)"


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT n_nationkey AS src, n_nationkey AS dst, 0 AS cost FROM nation UNION SELECT r.src, e.d, r.cost + e.c FROM r JOIN e ON e.s = r.dst WHERE r.cost + e.c <= 80) SELECT src::BIGINT AS src, dst::BIGINT AS dst, min(cost)::DOUBLE AS cost FROM r GROUP BY ALL")
def q53_shortest_cost(spark, sf):
    k = F.col("n_nationkey")
    n = table(spark, sf, "nation")
    e = n.select(k.alias("src"), ((k * 7 + 1) % 25).alias("dst"), (1 + k % 5).alias("cost")).unionByName(n.select(k.alias("src"), ((k * 3 + 2) % 25).alias("dst"), (2 + k % 3).alias("cost")))
    return G.shortest_paths(e, n.select(k.alias("node"))).select("src", "dst", "cost")


@query(
    """WITH RECURSIVE p AS (SELECT c_mktsegment AS part, c_custkey AS id, c_acctbal AS x, c_custkey % 997 * 11.0::DOUBLE AS y, (c_custkey * 7919 % 10007)::DOUBLE AS score FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, id) AS k FROM p),
r AS (SELECT part, k, id, x, y, score, true AS kept, [{'x': x, 'y': y}] AS l FROM k WHERE k = 1 UNION ALL SELECT part, k, id, x, y, score, ok, CASE WHEN ok THEN list_append(l, {'x': x, 'y': y}) ELSE l END
 FROM (SELECT k.*, r.l, len(list_filter(r.l, lambda q: pow(q.x - k.x, 2) + pow(q.y - k.y, 2) <= 22500)) = 0 AS ok FROM r JOIN k ON k.part = r.part AND k.k = r.k + 1))
SELECT part, id, x, y, score FROM r WHERE kept"""
)
def q57_suppressed_points(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("part"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 997 * 11.0).alias("y"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("score"))
    return J.suppressed(p, 150.0)


@query(
    """WITH s AS (SELECT s_nationkey AS pattern, s_suppkey, s_acctbal AS v FROM supplier), n AS (SELECT *, lead(v) OVER (PARTITION BY pattern ORDER BY v, s_suppkey) AS nv FROM s) SELECT pattern, s_suppkey, round(v + 0.3, 4) AS low, round(nv - 0.3, 4) AS high, round(greatest(0, nv - v - 0.6) * 20, 3) AS area FROM n WHERE nv IS NOT NULL"""
)
def q58_interrow_bands(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("pattern"), "s_suppkey", F.col("s_acctbal").alias("v"))
    n = s.withColumn("nv", F.lead("v").over(W.partitionBy("pattern").orderBy("v", "s_suppkey"))).where("nv IS NOT NULL")
    return n.select("pattern", "s_suppkey", F.round(F.col("v") + 0.3, 4).alias("low"), F.round(F.col("nv") - 0.3, 4).alias("high"), F.round(F.greatest(F.lit(0.0), F.col("nv") - F.col("v") - 0.6) * 20, 3).alias("area"))


