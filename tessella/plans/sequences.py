"""Ordered sequences over the tables at hand: runs, gaps, intervals, folds, logs, top-k."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import sequences as Q
from ..streaming import history as H
from .reports import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_RUNS = """e AS (SELECT user_id, event_type <> 'error' AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, flag ORDER BY i) AS island FROM e), r AS (SELECT user_id, flag, min(i) AS s, max(i) + 1 AS t FROM g GROUP BY user_id, flag, island)"""


@query(f"WITH {_RUNS} SELECT user_id, s::BIGINT AS start, t::BIGINT AS \"end\", (t - s)::BIGINT AS length FROM r WHERE NOT flag")
def q03_gap_runs(spark, sf):
    r = Q.runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error")
    return r.where("NOT flag").drop("flag")


@query(
    f"""WITH {_RUNS}, n AS (SELECT *, lag(flag) OVER w AS b, lead(flag) OVER w AS a FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s)), first AS (SELECT user_id, user_id % 7 AS lattice, min(i) FILTER (flag) AS first FROM e GROUP BY 1),
nb AS (SELECT f.user_id, f.lattice, f.first, (SELECT count(o.first) FROM (SELECT *, row_number() OVER (PARTITION BY lattice ORDER BY user_id) AS k FROM first) o, (SELECT *, row_number() OVER (PARTITION BY lattice ORDER BY user_id) AS k FROM first) m WHERE m.user_id = f.user_id AND o.lattice = m.lattice AND o.user_id <> m.user_id AND abs(o.k - m.k) <= 2) AS n_near,
 (SELECT median(o.first) FROM (SELECT *, row_number() OVER (PARTITION BY lattice ORDER BY user_id) AS k FROM first) o, (SELECT *, row_number() OVER (PARTITION BY lattice ORDER BY user_id) AS k FROM first) m WHERE m.user_id = f.user_id AND o.lattice = m.lattice AND o.user_id <> m.user_id AND abs(o.k - m.k) <= 2) AS med_near FROM first f)
SELECT user_id, 'interior' AS kind, s::DOUBLE AS start, t::DOUBLE AS "end" FROM n WHERE NOT flag AND a AND b AND t - s >= 1 UNION ALL SELECT user_id, 'end', med_near, first FROM nb WHERE n_near >= 2 AND first - med_near >= 1"""
)
def q04_row_gaps(spark, sf):
    e, flag = table(spark, sf, "events"), F.col("event_type") != "error"
    inner = Q.interior_gaps(e, "user_id", ["ts", "event_id"], flag).where("length >= 1").select("user_id", F.lit("interior").alias("kind"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    i = e.withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    first = i.groupBy("user_id").agg(F.min(F.when(flag, F.col("i"))).alias("first")).withColumn("lattice", F.col("user_id") % 7)
    near = Q.neighbour_median(first, "lattice", "user_id", "first").where("n_near >= 2 AND first - med_near >= 1")
    return inner.unionByName(near.select("user_id", F.lit("end").alias("kind"), F.col("med_near").cast("double").alias("start"), F.col("first").cast("double").alias("end")))


@query(
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_at, count(*) AS events, arg_max(CASE WHEN event_id % 3 = 0 THEN 'inspector' ELSE 'farmer' END, (ts, event_id)) = 'inspector' AS approved FROM events GROUP BY 1"""
)
def q07_fold_last_event(spark, sf):
    e = table(spark, sf, "events").withColumn("role", F.when(F.col("event_id") % 3 == 0, "inspector").otherwise("farmer"))
    return Q.fold_events(e, "user_id", ["ts", "event_id"], "event_type", "role").withColumnRenamed("event_type", "status")


_SPANS = "s AS (SELECT o_custkey AS k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS a, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + 30 AS b, o_orderkey FROM orders)"


def _spans(spark, sf):
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), day.alias("a"), (day + 30).alias("b"))


@query(f"WITH {_SPANS}, r AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s) SELECT k, sum(greatest(0, b - greatest(a, coalesce(p, a))))::BIGINT AS covered FROM r GROUP BY k")
def q14_interval_union(spark, sf):
    return Q.covered_length(_spans(spark, sf), "k", "a", "b").select("k", F.col("covered").cast("long").alias("covered"))


_MERGE = """r AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR a - p > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM r)"""


@query(f"WITH {_SPANS}, {_MERGE} SELECT k, min(a)::BIGINT AS start, max(b)::BIGINT AS \"end\", count(*) AS pieces FROM i GROUP BY k, island")
def q15_interval_merge_tolerance(spark, sf):
    m = Q.merged_intervals(_spans(spark, sf), "k", "a", "b", 5)
    return m.select("k", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "pieces")


@query(f"WITH {_SPANS}, r AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s) SELECT k, p::BIGINT AS hole_start, a::BIGINT AS hole_end FROM r WHERE a - p > 0.05 AND a - p <= 15")
def q56_bridges(spark, sf):
    return Q.bridges(_spans(spark, sf), "k", "a", "b").select("k", F.col("hole_start").cast("long").alias("hole_start"), F.col("hole_end").cast("long").alias("hole_end"))


@query(
    """WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), q AS (SELECT vec_id, quantile_cont(v, 0.6) AS p60 FROM v GROUP BY 1), w AS (SELECT *, max(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM v)
SELECT w.vec_id, i::BIGINT AS i, round(v, 6) AS v FROM w JOIN q ON w.vec_id = q.vec_id WHERE v = top AND v > p60"""
)
def q24_local_maxima(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    p = v.groupBy("vec_id").agg(F.percentile("v", 0.6).alias("p60"))
    return Q.local_maxima(v.join(p, "vec_id"), "vec_id", "i", "v", 2, F.col("p60")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(
    """SELECT l_returnflag, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate) AS rank FROM lineitem) WHERE rank <= 5"""
)
def q31_topk_per_group(spark, sf):
    order = [F.desc("l_extendedprice"), *[F.asc(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")]]
    return Q.top_k(table(spark, sf, "lineitem"), "l_returnflag", order, 5).select("l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "rank")


@query(
    """SELECT s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY regexp_replace(s_name, '[0-9]+$', ''), coalesce(try_cast(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT), -1), s_name) AS place FROM supplier"""
)
def q32_natural_sort(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_name", F.row_number().over(W.partitionBy("s_nationkey").orderBy(*C.natural_key(F.col("s_name")))).cast("long").alias("place"))


@query(
    """WITH r AS (SELECT source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) SELECT source, count(*) FILTER (s <= 40000) AS shown, count(*) FILTER (s > 40000) AS more, coalesce(max(s) FILTER (s <= 40000), 0)::BIGINT AS used FROM r GROUP BY source"""
)
def q33_text_budget(spark, sf):
    return Q.within_budget(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 40_000)


@query(
    """WITH RECURSIVE n AS (SELECT p_brand, p_name, p_retailprice AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_retailprice) AS k FROM (SELECT p_brand, lpad(p_partkey::VARCHAR, 9, '0') AS p_name, p_retailprice FROM part)),
f AS (SELECT p_brand, p_name, k, 1 AS part, s AS used FROM n WHERE k = 1 UNION ALL SELECT n.p_brand, n.p_name, n.k, CASE WHEN f.used > 0 AND f.used + n.s > 5000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.used > 0 AND f.used + n.s > 5000 THEN n.s ELSE f.used + n.s END FROM f JOIN n ON n.p_brand = f.p_brand AND n.k = f.k + 1)
SELECT p_brand, p_name, part::INT AS part FROM f"""
)
def q34_part_packing(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("p_name"), "p_retailprice")
    return Q.pack(p, "p_brand", "p_name", "p_retailprice", 5000.0)


@query(
    """WITH RECURSIVE d AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day FROM orders), f AS (SELECT o_custkey, max(day) AS day, 0 AS rank FROM d GROUP BY 1 UNION ALL SELECT f.o_custkey, (SELECT max(day) FROM d WHERE d.o_custkey = f.o_custkey AND date_diff('day', d.day, f.day) >= 4), f.rank + 1 FROM f WHERE f.rank < 2 AND f.day IS NOT NULL)
SELECT o_custkey, rank::INT AS rank, day FROM f WHERE day IS NOT NULL"""
)
def q35_scene_choice(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return Q.greedy_spacing(o, "o_custkey", "day", 4, 3)


@query(
    """WITH t AS (SELECT s_suppkey, 'V' || lpad((s_nationkey)::VARCHAR, 2, '0') || '-' || lpad((s_suppkey % 3)::VARCHAR, 2, '0') AS tile, s_acctbal FROM supplier), n AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY s_acctbal, s_suppkey) AS k FROM t)
SELECT s_suppkey, tile || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS block_id, chr((96 + (1 + (k - 1) % 26))::INT) AS pattern, format('r{:03d}_c{:03d}', floor((10000 - s_acctbal) / 512)::INT, floor((s_suppkey * 10.0) / 512)::INT) AS tile_name FROM n"""
)
def q39_tile_naming(spark, sf):
    s = table(spark, sf, "supplier").withColumn("tile", F.format_string("V%02d-%02d", F.col("s_nationkey"), (F.col("s_suppkey") % 3).cast("int")))
    s = s.withColumn("k", F.row_number().over(W.partitionBy("tile").orderBy("s_acctbal", "s_suppkey")))
    name = C.tile_name(F.col("s_suppkey") * 10.0, F.col("s_acctbal"), 0.0, 10000.0, 512.0)
    return s.select("s_suppkey", F.concat("tile", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")).alias("block_id"), F.char(96 + (1 + (F.col("k") - 1) % 26)).alias("pattern"), name.alias("tile_name"))


@query(
    """SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"""
)
def x01_tumbling(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


@query(
    """SELECT time_bucket(INTERVAL '3 hours', ts) - to_hours(3 * s) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events, range(2) AS r(s) GROUP BY ALL"""
)
def x02_sliding(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "6 hours", "3 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


@query(
    """WITH l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '12 hours' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def x03_session(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


@query(
    """WITH e AS (SELECT DISTINCT user_id, event_id, event_type, ts FROM events WHERE event_id IS NOT NULL) SELECT user_id, row_number() OVER w AS place, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'inspector' ELSE 'farmer' END AS role, event_type AS status, lead(event_id) OVER w IS NULL AS current FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
)
def q154_status_history(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "inspector").otherwise("farmer").alias("role"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.lit(None).cast("string").alias("note"))
    return H.history(e).select(F.col("id").alias("user_id"), F.col("place").cast("long").alias("place"), "seq", "role", "status", "current")
