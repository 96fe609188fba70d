"""Smaller operators over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import details as D
from ..operators import inspection as I
from ..operators import scenes as N
from .reports import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'approved,dismissed' WHEN 'view' THEN 'approved,open' ELSE 'open' END AS actions FROM events WHERE event_type IN ('error', 'view')")
def q60_visible_actions(spark, sf):
    e = table(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") == "error", "waste").when(F.col("event_type") == "view", "gap").otherwise("other"))
    status = F.when(F.col("event_type") == "error", "open").when(F.col("event_type") == "view", "done").otherwise("closed")
    return D.visible(e, "farmer", True).select("event_id", "event_type", F.array_join(D.actions("inspector", status), ",").alias("actions"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY coalesce(CASE WHEN p_size % 7 > 0 THEN p_size::DOUBLE END, 101), p_partkey) AS place FROM part WHERE contains(lower(p_name), 'a')")
def q61_field_search(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("double")).alias("score"), F.col("p_partkey").alias("ord"))
    return D.search_fields(p, "A").select(F.col("ord").alias("p_partkey"), "place")


@query("SELECT c_custkey, coalesce(arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FILTER (o_orderkey IS NOT NULL), '') AS answer FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def q62_latest_answers(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("answer"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    return D.latest_answers(table(spark, sf, "customer").select("c_custkey"), a, "c_custkey")


@query("SELECT s_suppkey AS piece, arg_min(c_mktsegment, (abs(s_acctbal - c_acctbal), c_mktsegment)) AS pattern FROM supplier JOIN (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 3) AS c_acctbal FROM customer GROUP BY ALL) ON s_nationkey = c_nationkey GROUP BY 1")
def q63_pieces_on_patterns(spark, sf):
    parts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("row_id"), F.col("c_mktsegment").alias("pattern")).agg(F.round(F.avg("c_acctbal"), 3).alias("part_at"))
    pieces = table(spark, sf, "supplier").join(parts.select(F.col("row_id").alias("s_nationkey")).distinct(), "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("piece"), F.col("s_nationkey").alias("row_id"), F.col("s_acctbal").alias("at"))
    return D.on_patterns(pieces, parts)


@query(
    """WITH p AS (SELECT c_custkey AS piece, c_nationkey AS pattern, c_custkey % 100 AS u, c_acctbal AS v FROM customer), r AS (SELECT s_suppkey AS row, s_nationkey AS pattern, 10 AS u0, 80 AS u1, s_acctbal AS rv FROM supplier),
m AS (SELECT piece, min((abs(v - rv), row)) AS m FROM p JOIN r ON p.pattern = r.pattern AND u >= u0 - 1 AND u <= u1 + 1 AND abs(v - rv) <= 150 GROUP BY 1) SELECT p.piece, coalesce(m[2], -1)::BIGINT AS row FROM p LEFT JOIN m ON p.piece = m.piece"""
)
def q64_nearest_row(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("piece"), F.col("c_nationkey").alias("pattern"), (F.col("c_custkey") % 100).alias("u"), F.col("c_acctbal").alias("v"))
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row"), F.col("s_nationkey").alias("pattern"), F.lit(10).alias("u0"), F.lit(80).alias("u1"), F.col("s_acctbal").alias("rv"))
    return D.nearest_row(p, r, reach=150.0)


@query("SELECT c_custkey, 'R' || n_regionkey::VARCHAR AS pattern FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def q65_propagated(spark, sf):
    names = table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("old"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("new"))
    return D.propagated(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("pattern")), names)


@query(
    """WITH s AS (SELECT o_custkey AS walk, o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS at_m FROM orders), n AS (SELECT walk, id, row_number() OVER (PARTITION BY walk ORDER BY at_m, id) AS n FROM s WHERE at_m IS NOT NULL)
SELECT w.walk, w.id, n.n, CASE WHEN n.n IS NOT NULL THEN 'visited' WHEN s.id IS NOT NULL THEN 'skipped' ELSE 'unknown' END AS state FROM (SELECT o_custkey AS walk, o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000 ELSE 0 END AS id FROM orders) w LEFT JOIN s ON s.walk = w.walk AND s.id = w.id LEFT JOIN n ON n.walk = w.walk AND n.id = w.id"""
)
def q66_walk(spark, sf):
    o = table(spark, sf, "orders")
    stops = o.select(F.col("o_custkey").alias("walk"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("at_m"))
    wanted = o.select(F.col("o_custkey").alias("walk"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 10 == 0, 1000000).otherwise(0)).alias("id"))
    return D.walk(stops, wanted)


@query(
    """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT DISTINCT p_brand, p_partkey FROM r, range(5) AS k(k) WHERE n <= 5 OR i = round(k * (n - 1) / 4, 0)"""
)
def q67_stratified_sample(spark, sf):
    return D.stratified(table(spark, sf, "part"), "p_brand", ["p_retailprice", "p_partkey"], 5).select("p_brand", "p_partkey")


@query("SELECT user_id, (event_id // 400)::BIGINT AS bucket, round(avg((value > 20)::INT), 6) AS share, count(*) AS n FROM events GROUP BY ALL HAVING avg((value > 20)::INT) < 0.6")
def q68_weak_windows(spark, sf):
    return D.weak_windows(table(spark, sf, "events"), "user_id", "event_id", F.col("value") > 20, 400, 0.6).select("user_id", "bucket", F.round("share", 6).alias("share"), "n")


@query(
    """WITH d AS (SELECT c_nationkey, c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS d FROM customer) SELECT c_nationkey, count(*) FILTER (d BETWEEN 50 AND 400) AS n, round(CASE WHEN count(*) FILTER (d BETWEEN 50 AND 400) >= 6 THEN median(d) FILTER (d BETWEEN 50 AND 400) ELSE 170 END, 5) AS distance FROM d GROUP BY 1"""
)
def q69_planting_distance(spark, sf):
    return D.planting_distance(table(spark, sf, "customer"), "c_nationkey", "c_acctbal", 50.0, 400.0, 170.0, 6).select("c_nationkey", "n", F.round("distance", 5).alias("distance"))


@query(
    """WITH a AS (SELECT c_nationkey AS field, c_custkey AS row_id, c_acctbal AS v FROM customer), b AS (SELECT c_nationkey AS field, CASE WHEN c_custkey % 11 = 0 THEN -1 - c_custkey ELSE c_custkey END AS row_id, c_acctbal + c_custkey % 3 AS v FROM customer),
fa AS (SELECT *, v = min(v) OVER (PARTITION BY field) OR v = max(v) OVER (PARTITION BY field) AS o FROM a), fb AS (SELECT *, v = min(v) OVER (PARTITION BY field) OR v = max(v) OVER (PARTITION BY field) AS o FROM b),
j AS (SELECT coalesce(fa.field, fb.field) AS field, fa.o AS oa, fb.o AS ob FROM fa FULL JOIN fb ON fa.field = fb.field AND fa.row_id = fb.row_id)
SELECT field, count(*) FILTER (ob IS NULL) AS deleted, count(*) FILTER (ob IS NULL AND oa) AS deleted_outer, count(*) FILTER (oa IS NULL) AS added, count(*) FILTER (oa IS NULL AND ob) AS added_outer FROM j GROUP BY 1 HAVING count(*) FILTER (ob IS NULL) + count(*) FILTER (oa IS NULL) > 0"""
)
def q70_row_edits(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("field"), F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("v"))
    # some rows were drawn anew, under other ids, and some moved
    after = c.select("field", F.when(F.col("row_id") % 11 == 0, -1 - F.col("row_id")).otherwise(F.col("row_id")).alias("row_id"), (F.col("v") + F.col("row_id") % 3).alias("v"))
    return D.row_edits(c, after)


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'harvest' WHEN 'O' THEN 'sale' ELSE 'gift' END IN ('harvest', 'sale', 'loss') AND o_totalprice - 100000 > 0 AS valid, CASE WHEN o_totalprice >= 1000 THEN round((o_totalprice / 1000)::DECIMAL(18, 6), 2)::DECIMAL(18, 2)::VARCHAR || ' km' ELSE format('{:d} m', round(o_totalprice, 0)::BIGINT) END AS distance FROM orders"""
)
def q71_record_guard(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "harvest").when(F.col("o_orderstatus") == "O", "sale").otherwise("gift")
    return o.select("o_orderkey", D.valid_record(kind, F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice") - 100000).alias("valid"), C.distance_text(F.col("o_totalprice")).alias("distance"))


_RGB = "c AS (SELECT vec_id, abs(embedding[1]::DOUBLE) * 255 AS r, abs(embedding[2]::DOUBLE) * 255 AS g, abs(embedding[3]::DOUBLE) * 255 AS b, embedding[4]::DOUBLE AS v FROM embeddings)"
_LIN = lambda v: f"CASE WHEN {v} / 255 <= 0.04045 THEN {v} / 255 / 12.92 ELSE pow(({v} / 255 + 0.055) / 1.055, 2.4) END"


@query(
    f"""WITH {_RGB}, l AS (SELECT *, {_LIN('r')} AS lr, {_LIN('g')} AS lg, {_LIN('b')} AS lb, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS d FROM c), x AS (SELECT *, (0.4124 * lr + 0.3576 * lg + 0.1805 * lb) / 0.95047 AS x, 0.2126 * lr + 0.7152 * lg + 0.0722 * lb AS y FROM l),
f AS (SELECT *, CASE WHEN x > 216.0 / 24389 THEN cbrt(x) ELSE x * (24389.0 / 27) / 116 + 16.0 / 116 END AS fx, CASE WHEN y > 216.0 / 24389 THEN cbrt(y) ELSE y * (24389.0 / 27) / 116 + 16.0 / 116 END AS fy FROM x)
SELECT vec_id, round(500 * (fx - fy), 4) AS a_star, round(CASE WHEN d > 0 THEN 60 * CASE WHEN top = r THEN (((g - b) / d) % 6 + 6) % 6 WHEN top = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END ELSE 0 END, 4) AS hue, round((g - r) / greatest(g + r, 1e-6), 6) AS index,
round(CASE WHEN v <= -0.1 THEN 0 WHEN v <= 0 THEN (v + 0.1) / 0.1 * 100 WHEN v <= 0.2 THEN 100 + v / 0.2 * 155 ELSE 255 END, 4) AS shade FROM f"""
)
def q72_colours(spark, sf):
    r, g, b = (F.abs(F.get("embedding", F.lit(i)).cast("double")) * 255 for i in range(3))
    v = F.get("embedding", F.lit(3)).cast("double")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(D.lab_a_star(r, g, b), 4).alias("a_star"), F.round(C.hue(r, g, b), 4).alias("hue"), F.round(C.normalised_difference(g, r), 6).alias("index"), F.round(D.ramp(v, [(-0.1, 0), (0.0, 100), (0.2, 255)]), 4).alias("shade")
    )


@query("SELECT c_custkey, substr(sha1('[\"' || c_name || '\",\"' || c_nationkey::VARCHAR || '\"]'), 1, 16) AS plan_key FROM customer")
def q73_plan_key(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", D.plan_key(F.col("c_name"), F.col("c_nationkey")).alias("plan_key"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'site' ELSE 'field' END AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE upper(s_name) END AS argument FROM supplier")
def q74_commands(spark, sf):
    text = F.when(F.col("s_suppkey") % 3 == 0, F.lit("/site@some_bot")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("/field@some_bot  "), F.col("s_name"), F.lit(" "))).otherwise(F.concat(F.lit("/field "), F.col("s_name")))
    name, argument = D.command(F.col("text"))
    return table(spark, sf, "supplier").withColumn("text", text).select("s_suppkey", name.alias("name"), argument.alias("argument"))


@query(
    """WITH m AS (SELECT s_nationkey AS p, median(s_acctbal) AS med, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) >= 3 AND median(s_acctbal) >= 0.1), d AS (SELECT s_nationkey AS p, s_suppkey AS id, s_acctbal AS c, s_acctbal < 0.8 * med AS bare, n, row_number() OVER a AS ka, row_number() OVER b AS kb, bool_and(s_acctbal < 0.8 * med) OVER (a ROWS UNBOUNDED PRECEDING) AS alla, bool_and(s_acctbal < 0.8 * med) OVER (b ROWS UNBOUNDED PRECEDING) AS allb
FROM supplier JOIN m ON s_nationkey = m.p WINDOW a AS (PARTITION BY s_nationkey ORDER BY s_suppkey), b AS (PARTITION BY s_nationkey ORDER BY s_suppkey DESC)), x AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY least(ka, kb), c, id) AS place FROM d WHERE (alla AND ka <= 2) OR (allb AND kb <= 2))
SELECT p AS pattern_id, id::BIGINT AS row_id FROM x WHERE n - place >= 2"""
)
def q75_bare_outer_rows(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("pattern_id"), F.col("s_suppkey").alias("row_id"), F.col("s_suppkey").alias("v"), F.col("s_acctbal").alias("cover"))
    return I.bare_outer_rows(s, share=0.8)


@query(
    """WITH e AS (SELECT user_id AS row_id, event_type <> 'error' AS green, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY row_id, green ORDER BY i) AS isl FROM e), r AS (SELECT row_id, green, min(i) AS s, count(*) AS n FROM g GROUP BY row_id, green, isl),
v AS (SELECT *, green AND n >= 3 AS vine FROM r), h AS (SELECT *, sum(CASE WHEN vine OR coalesce(lag_vine, true) THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY s) AS k FROM (SELECT *, lag(vine) OVER (PARTITION BY row_id ORDER BY s) AS lag_vine FROM v)), q AS (SELECT row_id, k, vine, sum(n) AS n FROM h GROUP BY ALL),
z AS (SELECT row_id, coalesce(max(n) FILTER (NOT vine), 0) AS hole, bool_or(vine) AS any_vine FROM q GROUP BY 1) SELECT row_id, hole::DOUBLE AS hole_m, CASE WHEN hole < 8 THEN 'regular' WHEN any_vine THEN 'disrupted' ELSE 'unassessable' END AS row_structure FROM z"""
)
def q76_row_structure(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("row_id"), (F.col("event_type") != "error").alias("green"), F.expr("row_number() over (partition by user_id order by ts, event_id) - 1").alias("i"))
    return I.row_structure(e, step_m=1.0, hole_m=8.0, ignore_m=3.0)


@query("SELECT event_type || CASE WHEN hit THEN '_still_there' ELSE '_gone' END AS outcome, count(*) AS n FROM (SELECT event_type, event_id IN (SELECT event_id FROM events WHERE value > 30) AS hit FROM events) GROUP BY 1")
def q77_regressions(spark, sf):
    e = table(spark, sf, "events")
    return I.regressions(e.where("value > 30").select(F.col("event_id").alias("verdict_id")), e.select(F.col("event_id").alias("id"), F.col("event_type").alias("verdict")))


@query("SELECT l_suppkey, l_returnflag, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice)) AS l_orderkey, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL")
def q78_upsert(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_shipdate", F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").alias("seq"))
    return N.upsert(l, ["l_suppkey", "l_returnflag"], "seq").drop("seq")


_PTS = "p AS (SELECT c_custkey AS id, c_acctbal AS x, (c_custkey * 37 % 1009)::DOUBLE AS y, c_mktsegment AS verdict FROM customer), a AS (SELECT * FROM p WHERE id % 3 = 0), b AS (SELECT * FROM p WHERE id % 3 <> 0)"


def _points(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 37 % 1009).cast("double").alias("y"), F.col("c_mktsegment").alias("verdict"))


@query(f"WITH {_PTS} SELECT id, verdict, 0 AS rank FROM a UNION ALL SELECT id, verdict, 1 FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 40)")
def q79_label_precedence(spark, sf):
    p = _points(spark, sf)
    return N.by_precedence([p.where("id % 3 = 0"), p.where("id % 3 <> 0")], 40.0).select("id", "verdict", "rank")


@query(f"WITH {_PTS}, m AS (SELECT b.id, min((sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), a.id)) AS m FROM b JOIN a ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 60 GROUP BY 1) SELECT b.id, m[2] AS node, round(m[1], 4) AS distance FROM b LEFT JOIN m ON b.id = m.id")
def q80_snapped(spark, sf):
    p = _points(spark, sf)
    return N.snapped(p.where("id % 3 <> 0"), p.where("id % 3 = 0").withColumnRenamed("id", "node"), 60.0).withColumn("distance", F.round("distance", 4))


@query(
    f"""WITH {_PTS}, m AS (SELECT b.id, a.verdict AS part, min((sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), a.id)) AS m FROM b JOIN a ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 120 GROUP BY ALL) SELECT id, m[2] AS node, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m) AS rank FROM m) WHERE rank <= 3"""
)
def q81_candidates(spark, sf):
    p = _points(spark, sf)
    return N.candidates(p.where("id % 3 <> 0"), p.where("id % 3 = 0").select(F.col("id").alias("node"), "x", "y", F.col("verdict").alias("part")), 120.0, 3)


@query(
    """WITH s AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 10 AS x0, embedding[2]::DOUBLE * 10 AS y0, embedding[3]::DOUBLE * 10 AS x1, embedding[4]::DOUBLE * 10 AS y1 FROM embeddings), n AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS n FROM s), i AS (SELECT *, unnest(range(floor(n / 0.25)::BIGINT + 1)) AS i FROM n WHERE n > 0)
SELECT id, i::INT AS i, round(x0 + (x1 - x0) / n * i * 0.25, 5) AS x, round(y0 + (y1 - y0) / n * i * 0.25, 5) AS y FROM i"""
)
def q82_points_along(spark, sf):
    v = [(F.get("embedding", F.lit(i)).cast("double") * 10).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return N.along(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *v), 0.25).select("id", "i", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("WITH s AS (SELECT c_custkey AS id, 0.0 AS s, (c_custkey % 13 + 0.3)::DOUBLE AS e FROM customer), n AS (SELECT *, greatest(1, round((e - s) / 1.7, 0))::INT AS n FROM s WHERE e - s >= 0.8) SELECT id, k::INT AS k, round(s + (k - 0.5) * (e - s) / n, 6) AS centre FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM n)")
def q83_split_stretches(spark, sf):
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("start"), (F.col("c_custkey") % 13 + 0.3).cast("double").alias("end"))
    return N.split_stretches(s, 0.8, 1.7).withColumn("centre", F.round("centre", 6))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderpriority < '3', o_orderkey % 4, -o_totalprice, -o_orderkey)) AS id FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def q84_best_route(spark, sf):
    r = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("legal"), (F.col("o_orderpriority") < "3").alias("fits"), (F.col("o_orderkey") % 4).alias("visited"), F.col("o_totalprice").alias("length_m"))
    return N.best_route(r, ["o_custkey"])


@query("SELECT c_custkey, z BETWEEN 0 AND 24 AND x >= 0 AND y >= 0 AND x < (1 << z) AND y < (1 << z) AS ok, round(6378137.0 * radians(lon), 3) AS mx, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS my FROM (SELECT c_custkey, (c_custkey % 20)::INT AS z, c_custkey % 300 - 5 AS x, c_custkey % 170 AS y, c_acctbal / 100 AS lon, c_acctbal / 200 AS lat FROM customer)")
def q85_tile_addresses(spark, sf):
    k = F.col("c_custkey")
    mx, my = N.to_mercator(F.col("c_acctbal") / 100, F.col("c_acctbal") / 200)
    return table(spark, sf, "customer").select("c_custkey", N.tile_ok((k % 20).cast("int"), k % 300 - 5, k % 170).alias("ok"), F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"))
