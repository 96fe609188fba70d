"""Reports, statistics, scores and sets over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import rollup as R
from ..operators import stats as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: customer, orders and lineitem as features: field, row and piece; the order's status tells the source.
FEATURES_SQL = """features AS (
 SELECT CASE l_linenumber % 3 WHEN 0 THEN 'interrow_area' WHEN 1 THEN 'row' ELSE 'vineyard' END AS label,
  CASE o_orderstatus WHEN 'P' THEN 'prediction' WHEN 'F' THEN 'reference' END AS source,
  CASE WHEN c_mktsegment = 'MACHINERY' AND o_orderstatus <> 'P' THEN '' ELSE c_mktsegment END AS vineyard_id,
  c_mktsegment || '-R' || lpad(c_nationkey::VARCHAR, 3, '0') AS row_id, l_quantity AS length_m, l_extendedprice AS area_m2
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.when(F.col("l_linenumber") % 3 == 0, "interrow_area").when(F.col("l_linenumber") % 3 == 1, "row").otherwise("vineyard").alias("label"),
        F.when(F.col("o_orderstatus") == "P", "prediction").when(F.col("o_orderstatus") == "F", "reference").alias("source"),
        F.when((F.col("c_mktsegment") == "MACHINERY") & (F.col("o_orderstatus") != "P"), "").otherwise(F.col("c_mktsegment")).alias("vineyard_id"),
        F.concat("c_mktsegment", F.lit("-R"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0")).alias("row_id"),
        F.col("l_quantity").alias("length_m"),
        F.col("l_extendedprice").alias("area_m2"),
    )


_ROLLUP = """
f AS (SELECT label, length_m, area_m2, vineyard_id AS v, CASE WHEN label = 'row' THEN row_id END AS r FROM {src}),
g AS (SELECT v, r, grouping(v, r) AS lv, count(DISTINCT nullif(v, '')) AS bc, count(DISTINCT r) AS rc, coalesce(sum(length_m) FILTER (label = 'row'), 0) AS len,
 coalesce(sum(area_m2) FILTER (label = 'vineyard'), 0) AS can, coalesce(sum(area_m2) FILTER (label = 'interrow_area'), 0) AS inr FROM f GROUP BY GROUPING SETS ((v, r), (v), ()))
SELECT CASE lv WHEN 3 THEN 'total' WHEN 1 THEN 'block' ELSE 'row' END AS level, coalesce(v, '') AS vineyard_id, CASE WHEN lv = 0 THEN r ELSE '' END AS row_id,
 CASE WHEN lv = 3 THEN bc END AS block_count, CASE WHEN lv > 0 THEN rc END AS row_count, round(len, 2) AS row_length_m,
 CASE WHEN lv > 0 THEN round(can, 2) END AS canopy_area_m2, CASE WHEN lv > 0 THEN round(can / 1e4, 2) END AS canopy_area_ha,
 CASE WHEN lv > 0 THEN round(inr, 2) END AS interrow_area_m2, CASE WHEN lv > 0 THEN round(inr / 1e4, 2) END AS interrow_area_ha
FROM g WHERE lv = 3 OR (v <> '' AND (lv = 1 OR r IS NOT NULL))"""


@query("WITH " + FEATURES_SQL + ", ok AS (SELECT * FROM features WHERE source IS DISTINCT FROM 'prediction')," + _ROLLUP.format(src="ok"))
def q01_measure_rollup(spark, sf):
    return R.report_order(R.measurement_rows(features(spark, sf), 2))


@query(
    "WITH " + FEATURES_SQL + """, ok AS (SELECT *, false AS estimate FROM features WHERE source IS DISTINCT FROM 'prediction'),
w AS (SELECT * FROM ok UNION ALL SELECT *, true FROM features WHERE source = 'prediction' AND vineyard_id NOT IN (SELECT vineyard_id FROM ok WHERE vineyard_id <> ''))
SELECT vineyard_id, estimate, count(*) AS n, count(DISTINCT row_id) AS row_count, round(sum(length_m), 2) AS length_m, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels FROM w GROUP BY ALL"""
)
def q02_browser_fallback(spark, sf):
    w = R.with_estimates(features(spark, sf))
    return w.groupBy("vineyard_id", "estimate").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("row_count"), F.round(F.sum("length_m"), 2).alias("length_m"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))


@query(
    """WITH p AS (SELECT user_id, event_type AS field, date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 / 3600 AS pitch, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT field, count(*) AS n, median(pitch) AS med FROM p WHERE pitch IS NOT NULL GROUP BY 1), r AS (SELECT field, median(value) AS run FROM p GROUP BY 1),
d AS (SELECT p.field, median(abs(pitch - med)) AS mad FROM p JOIN m ON p.field = m.field WHERE pitch IS NOT NULL GROUP BY 1)
SELECT m.field, n, round(med, 5) AS med, round(mad, 5) AS mad, round(least(500, greatest(3, least(med, 200) + 5.0 * 1.4826 * mad - run)), 4) AS threshold FROM m JOIN d ON m.field = d.field JOIN r ON m.field = r.field WHERE n >= 30"""
)
def q05_field_gap_threshold(spark, sf):
    e = table(spark, sf, "events")
    p = e.select(F.col("event_type").alias("field"), (F.expr("timestampdiff(MICROSECOND, lag(ts) over (partition by user_id order by ts, event_id), ts)") / 1e6 / 3600).alias("pitch"), "value")
    out = S.gap_threshold(p, "field", "pitch", "value", top=500.0, pitch_top=200.0)
    return out.select("field", "n", F.round("med", 5).alias("med"), F.round("mad", 5).alias("mad"), F.round("threshold", 4).alias("threshold"))


@query(
    """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT e.event_type, greatest(1.4826 * median(abs(value - med)), 0.01) AS sigma FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1),
z AS (SELECT e.event_type, e.user_id, (value - med) / sigma AS z FROM events e JOIN m ON e.event_type = m.event_type JOIN d ON d.event_type = m.event_type)
SELECT event_type, user_id, count(*) AS n, round(min(z), 5) AS low, bool_and(z <= 0.5) AS low_everywhere FROM z GROUP BY ALL"""
)
def q06_robust_low(spark, sf):
    z = S.robust_z(table(spark, sf, "events").select("event_type", "user_id", "value"), "event_type", "value")
    return z.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.round(F.min("z"), 5).alias("low"), F.bool_and(F.col("z") <= 0.5).alias("low_everywhere"))


@query(
    """WITH s AS (SELECT user_id % 10 AS field, count(*) AS points, count(*) FILTER (event_type = 'error' AND value > 50) AS waste_open, coalesce(sum(value) FILTER (event_type = 'view' AND value < 10), 0) AS missing_m, sum(value) AS row_m FROM events GROUP BY 1)
SELECT field, points, waste_open, round(missing_m, 3) AS missing_m, round(100 - 60 * least(1.0, missing_m / row_m / 0.15) - least(40, 1 * waste_open), 0)::BIGINT AS score, round(100 - 60 - 40, 0)::BIGINT AS model_score FROM s"""
)
def q08_field_score(spark, sf):
    s = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("field")).agg(
        F.count("*").alias("points"),
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 50)).alias("waste_open"),
        F.coalesce(F.sum(F.when((F.col("event_type") == "view") & (F.col("value") < 10), F.col("value"))), F.lit(0.0)).alias("missing_m"),
        F.sum("value").alias("row_m"),
    )
    score = S.field_score(F.lit(1.0), F.col("row_m"), F.col("waste_open") / 10, F.col("missing_m")).cast("long")
    return s.select("field", "points", "waste_open", F.round("missing_m", 3).alias("missing_m"), score.alias("score"), F.lit(0).cast("long").alias("model_score"))


@query(
    """WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), a AS (SELECT sum(n * (n - 1) / 2) AS b, sum(n) AS r FROM c), l AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY quality)), g AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY toxic))
SELECT round((r * (r - 1) / 2 + 2 * b - l.s - g.s) / (r * (r - 1) / 2), 6) AS rand_index FROM a, l, g"""
)
def q28_rand_index(spark, sf):
    return S.rand_index(table(spark, sf, "labels"), "quality", "toxic").select(F.round("rand_index", 6).alias("rand_index"))


@query(
    """WITH g AS (SELECT lang AS t, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN n_chars % 7 = 0 THEN 'en' ELSE lang END AS g0 FROM documents), c AS (SELECT t, coalesce(g0, 'missing') AS g, count(*) AS n FROM g WHERE t IS NOT NULL GROUP BY ALL),
t AS (SELECT t AS label, sum(n) AS nt, sum(n) FILTER (t = g) AS tp FROM c GROUP BY 1), q AS (SELECT g AS label, sum(n) AS ng FROM c GROUP BY 1), f AS (SELECT avg(2 * coalesce(tp, 0) / (nt + coalesce(ng, 0))) AS m FROM t LEFT JOIN q ON t.label = q.label), a AS (SELECT coalesce(sum(n) FILTER (t = g), 0) / sum(n) AS a FROM c)
SELECT round(a, 6) AS accuracy, round(m, 6) AS macro_f1, round((a + m) / 2, 6) AS score FROM a, f"""
)
def q29_attribute_score(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("t"), F.when(F.col("doc_id") % 13 == 0, F.lit(None)).when(F.col("n_chars") % 7 == 0, "en").otherwise(F.col("lang")).alias("g"))
    return S.attribute_score(d, "t", "g").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "score")])


@query(
    """WITH j AS (SELECT source, count(*) AS r, count(quality) AS p, count(*) FILTER (quality = 1) AS m, sum(n_chars) AS chars FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY 1)
SELECT source, round(2.0 * m / nullif(p + r, 0), 6) AS f1, round(0.6 * m / nullif(r, 0) + 0.4 * (2.0 * m / nullif(p + r, 0)), 6) AS canopy, round(greatest(0, 1 - abs(p - r) / r / 0.8), 6) AS counts FROM j"""
)
def q30_scorecard(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("r"), F.count("quality").alias("p"), F.count_if(F.col("quality") == 1).alias("m"))
    f = S.f1(F.col("m").cast("double"), F.col("p"), F.col("r"))
    return j.select("source", F.round(f, 6).alias("f1"), F.round(0.6 * F.col("m") / F.col("r") + 0.4 * f, 6).alias("canopy"), F.round(S.counts_score(F.col("p"), F.col("r"), 0.8), 6).alias("counts"))


#: Orders as annotated shapes: the label by the key, and now and then a wrong shape, attribute, domain, id, image or place.
SHAPE = {
    "k": "o_orderkey", "tile": "concat('m', CAST(o_custkey % 6 AS STRING))", "label": "CASE o_orderkey % 5 WHEN 0 THEN 'row' WHEN 1 THEN 'vineyard' WHEN 2 THEN 'interrow_area' WHEN 3 THEN 'waste' ELSE 'thing' END",
    "tag": "CASE WHEN o_orderkey % 13 = 0 THEN 'mask' WHEN o_orderkey % 5 = 0 THEN 'polyline' WHEN o_orderkey % 5 = 3 THEN 'box' ELSE 'polygon' END",
    "value": "CASE WHEN o_custkey % 11 = 0 THEN 'odd' WHEN o_orderkey % 5 = 0 THEN 'regular' ELSE 'mixed' END", "row_id": "CASE WHEN o_custkey % 17 = 0 THEN '' ELSE 'r' END", "short": "o_orderkey % 7 = 0", "x": "CAST(o_custkey % 1000 AS DOUBLE) / 18",
}


@query(
    f"""WITH s AS (SELECT {", ".join(f"{e} AS {n}" for n, e in SHAPE.items())} FROM orders), r AS (SELECT k, tile, label, unnest([CASE WHEN tile = 'm5' THEN 'unknown image' END, CASE WHEN label = 'thing' THEN 'unknown label' END, CASE WHEN tag = 'mask' AND label <> 'thing' THEN 'wrong shape' END, CASE WHEN short AND label <> 'thing' THEN 'attribute set' END,
CASE WHEN label = 'row' AND value = 'odd' AND NOT short THEN 'domain of row_structure' END, CASE WHEN label = 'interrow_area' AND value = 'odd' AND NOT short THEN 'domain of interrow_cover' END, CASE WHEN label = 'row' AND row_id = '' THEN 'empty id' END, CASE WHEN tile <> 'm5' AND x > 51.2 + 1e-6 THEN 'off the image' END]) AS rule FROM s)
SELECT rule, count(*) AS problems, count(DISTINCT tile) AS tiles FROM r WHERE rule IS NOT NULL GROUP BY 1"""
)
def q36_validator_report(spark, sf):
    from ..sources.features import ATTRIBUTES, annotation_problems

    s = table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in SHAPE.items()])
    closed = {"row": "row_structure", "interrow_area": "interrow_cover"}
    value = lambda name, label: F.col("value") if name == closed.get(label) else F.col("row_id") if name == "row_id" else F.lit("v")
    props = F.lit(None).cast("map<string,string>")
    for label, names in ATTRIBUTES.items():
        kept = names[:-1]  # a short set lacks the last one
        made = lambda ns, label=label: F.create_map(*[x for n in ns for x in (F.lit(n), value(n, label))]) if ns else F.expr("cast(map() as map<string,string>)")
        props = F.when(F.col("label") == label, F.when(F.col("short"), made(kept)).otherwise(made(names))).otherwise(props)
    point = F.array(F.struct(F.col("x").alias("x"), F.lit(-1.0).alias("y")))
    shapes = s.select("tile", "tag", "label", point.alias("points"), F.coalesce(props, F.expr("cast(map() as map<string,string>)")).alias("properties"))
    known = table(spark, sf, "nation").where("n_nationkey < 5").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("name"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"))
    return annotation_problems(shapes, known).groupBy("rule").agg(F.count("*").alias("problems"), F.count_distinct("tile").alias("tiles"))


@query(
    """SELECT 'only documents' AS side, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'only labels', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
UNION ALL SELECT 'both', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'either', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)"""
)
def q37_set_differences(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    sides = {"only documents": d.subtract(l), "only labels": l.subtract(d), "both": d.intersect(l), "either": d.union(l).distinct()}
    out = None
    for name, x in sides.items():
        row = x.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).select(F.lit(name).alias("side"), "n", "ids")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    """SELECT c_custkey, 'WASTE-' || CASE WHEN c_mktsegment = 'MACHINERY' THEN 'NA' ELSE c_mktsegment END || '-' || lpad(((round_even(c_acctbal * 10, 0)::BIGINT % 100000 + 100000) % 100000)::VARCHAR, 5, '0') || '-' || lpad((((c_custkey * 10) % 100000 + 100000) % 100000)::VARCHAR, 5, '0') AS waste_id,
'GAP-' || c_mktsegment || '-R' || c_nationkey::VARCHAR || '-' || lpad(((round_even(c_acctbal, 0)::BIGINT % 10000 + 10000) % 10000)::VARCHAR, 4, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS point_id FROM customer"""
)
def q38_feature_id_format(spark, sf):
    x, y = F.col("c_acctbal"), F.col("c_custkey").cast("double")
    return table(spark, sf, "customer").select(
        "c_custkey",
        C.waste_id(F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")), x, y).alias("waste_id"),
        C.point_id(F.lit("gap"), F.concat("c_mktsegment", F.lit("-R"), F.col("c_nationkey").cast("string")), x, y).alias("point_id"),
    )


@query(
    "WITH " + FEATURES_SQL + """, n AS (SELECT count(*) FILTER (source IS DISTINCT FROM 'prediction') >= 0.25 * count(*) FILTER (source = 'prediction') AS ok FROM features WHERE label = 'interrow_area')
SELECT label, CASE WHEN NOT ok AND source = 'prediction' THEN 'dev' ELSE source END AS source, count(*) AS n, round(sum(area_m2), 2) AS area FROM features, n WHERE CASE WHEN ok THEN source IS DISTINCT FROM 'prediction' ELSE source IN ('prediction', 'organizer') END GROUP BY ALL"""
)
def q40_world_choice(spark, sf):
    return R.planning_world(features(spark, sf)).groupBy("label", "source").agg(F.count("*").alias("n"), F.round(F.sum("area_m2"), 2).alias("area"))


@query(
    """SELECT e.event_id, e.event_type FROM events e WHERE e.event_type NOT IN (SELECT event_type FROM events WHERE user_id = 1 AND event_type <> 'error') AND (e.event_type <> 'error' OR e.value > 50)"""
)
def q41_overlay_anti(spark, sf):
    e = table(spark, sf, "events")
    scene = e.where("user_id = 1 AND event_type <> 'error'").select("event_type").distinct()
    return e.join(scene, "event_type", "left_anti").where("event_type <> 'error' OR value > 50").select("event_id", "event_type")


@query(
    """WITH s AS (SELECT o_custkey AS field, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS fixed, count(*) FILTER (o_orderstatus = 'P') AS dismissed, sum(o_totalprice) AS rows_m, coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'O'), 0) AS walk_m FROM orders GROUP BY 1)
SELECT field, open, fixed, dismissed, round(greatest(0, rows_m - walk_m), 2) AS saved_m, round(greatest(0, rows_m - walk_m) / 1.1 / 60, 3) AS minutes, round(greatest(0, rows_m - walk_m) / 1.1 / 3600 * 12, 2) AS money FROM s"""
)
def q42_savings(spark, sf):
    out = S.savings(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_totalprice")
    return out.select("field", "open", "fixed", "dismissed", F.round("saved_m", 2).alias("saved_m"), F.round("minutes", 3).alias("minutes"), F.round("money", 2).alias("money"))


@query(
    """WITH y AS (SELECT o_orderpriority AS kind, count(*) AS records, sum(o_totalprice) AS kg FROM orders GROUP BY 1)
SELECT kind, records, round(kg, 2) AS kg, '"' || replace(CASE WHEN regexp_matches(kind, '^[=+@-]') THEN '''' || kind ELSE kind END, '"', '""') || '","' || records::VARCHAR || '"' AS line FROM y"""
)
def q43_yield_totals_csv(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("records"), F.sum("o_totalprice").alias("kg"))
    return y.select("kind", "records", F.round("kg", 2).alias("kg"), F.concat_ws(",", C.csv_cell(F.col("kind")), C.csv_cell(F.col("records").cast("string"))).alias("line"))


@query(
    """WITH e AS (SELECT user_id, date_diff('second', TIMESTAMP '2024-01-01', ts) / 86400.0 AS u, value AS r, 1 + event_id % 3 AS w FROM events), s AS (SELECT user_id, sum(w) AS sw, sum(w * u) AS su, sum(w * r) AS sr, sum(w * u * u) AS suu, sum(w * u * r) AS sur FROM e GROUP BY 1),
f AS (SELECT *, (sw * sur - su * sr) / nullif(sw * suu - su * su, 0) AS slope FROM s) SELECT user_id, round(slope, 4) AS slope, round((sr - slope * su) / sw, 3) AS "offset" FROM f"""
)
def q44_weighted_fit(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01', ts)") / 86400.0).alias("u"), F.col("value").alias("r"), (1 + F.col("event_id") % 3).alias("w"))
    return S.weighted_fit(e, "user_id", "u", "r", "w").select("user_id", F.round("slope", 4).alias("slope"), F.round("offset", 3).alias("offset"))


@query(
    """WITH o AS (SELECT o_custkey AS c, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS x, o_totalprice AS y FROM orders) SELECT a.c AS customer, round(median((b.y - a.y) / (b.x - a.x)), 5) AS slope, count(*) AS pairs FROM o a JOIN o b ON a.c = b.c AND b.x > a.x GROUP BY 1"""
)
def q45_theil_sen(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("x"), F.col("o_totalprice").alias("y"))
    return S.theil_sen(o, "customer", "x", "y").select("customer", F.round("slope", 5).alias("slope"), "pairs")


@query(
    """WITH v AS (SELECT value * value AS v FROM events WHERE value IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v), h AS (SELECT least(255, floor((v - lo) / ((hi - lo) / 256)))::INT AS bin, lo, hi, count(*) AS n FROM v, e GROUP BY ALL),
m AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 256 AS mid FROM h), c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS w0, sum(n * mid) OVER (ORDER BY bin) AS m0, sum(n) OVER () AS w, sum(n * mid) OVER () AS mt FROM m),
b AS (SELECT *, w0 * (w - w0) * pow(m0 / w0 - (mt - m0) / (w - w0), 2) AS between FROM c WHERE w > w0) SELECT bin, round(lo + (bin + 1) * (hi - lo) / 256, 4) AS threshold FROM b ORDER BY round(between, 3) DESC, bin LIMIT 1"""
)
def q46_otsu(spark, sf):
    v = table(spark, sf, "events").select((F.col("value") * F.col("value")).alias("v"))
    return S.otsu(v, "v").select("bin", F.round("threshold", 4).alias("threshold"))


@query(
    """WITH j AS (SELECT d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id), t AS (SELECT t, count(*) FILTER (n_chars >= t AND quality = 1) AS m, count(*) FILTER (n_chars >= t) AS p, count(*) FILTER (quality = 1) AS r FROM j, (VALUES (100), (300), (600), (1000), (2000), (4000)) AS g(t) GROUP BY t)
SELECT t::BIGINT AS t, round(2.0 * m / (p + r), 6) AS f1, rank() OVER (ORDER BY round(2.0 * m / (p + r), 6) DESC) = 1 AS best FROM t"""
)
def q48_param_sweep(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    grid = (100, 300, 600, 1000, 2000, 4000)  # a fixed grid: one pass counts for every setting
    counts = j.select("n_chars", "quality", F.explode(F.array(*[F.lit(t) for t in grid])).alias("t")).groupBy("t").agg(
        F.count_if((F.col("n_chars") >= F.col("t")) & (F.col("quality") == 1)).alias("m"), F.count_if(F.col("n_chars") >= F.col("t")).alias("p"), F.count_if(F.col("quality") == 1).alias("r")
    )
    out = counts.select(F.col("t").cast("long").alias("t"), F.round(S.f1(F.col("m").cast("double"), F.col("p"), F.col("r")), 6).alias("f1"))
    return out.withColumn("best", F.rank().over(W.orderBy(F.desc("f1"))) == 1)


@query(
    """WITH j AS (SELECT n_chars, quality = 0 AS bad FROM documents d JOIN labels l ON d.doc_id = l.doc_id), r AS (SELECT bad, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM j)
SELECT count(*) FILTER (bad) AS positives, count(*) FILTER (NOT bad) AS negatives, round((sum(r) FILTER (bad) - count(*) FILTER (bad) * (count(*) FILTER (bad) + 1) / 2) / (count(*) FILTER (bad) * count(*) FILTER (NOT bad)), 6) AS auc FROM r"""
)
def q49_auc(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return S.auc(j, F.col("quality") == 0, "n_chars").select("positives", "negatives", F.round("auc", 6).alias("auc"))


@query(
    """SELECT event_id, event_type AS kind, cutoff::DOUBLE AS cutoff FROM events, (VALUES (NULL), (0.5), (0.7)) AS c(cutoff) WHERE (cutoff IS NULL OR value IS NULL OR value / 100 >= cutoff) AND event_type IN ('error', 'view') AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90)"""
)
def q50_route_targets_filter(spark, sf):
    e = table(spark, sf, "events")
    closed = e.where("event_type = 'signup' AND value > 90").select("user_id").distinct()
    cuts = F.explode(F.array(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.7))).alias("cutoff")
    t = e.where(F.col("event_type").isin("error", "view")).join(closed, "user_id", "left_anti").select("event_id", F.col("event_type").alias("kind"), "value", cuts)
    return t.where("cutoff IS NULL OR value IS NULL OR value / 100 >= cutoff").select("event_id", "kind", "cutoff")


@query(
    """SELECT user_id, count(*) FILTER (v >= 5) AS n, median(v) FILTER (v >= 5) AS med, CASE WHEN count(*) FILTER (v >= 5) >= 10 AND median(v) FILTER (v >= 5) < 45 THEN 5.0 ELSE 20.0 END::DOUBLE AS minimum FROM (SELECT user_id, round(value, 2) AS v FROM events) GROUP BY 1"""
)
def q54_adaptive_minimum(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.round("value", 2).alias("v"))
    return S.adaptive_minimum(e, "user_id", "v", 5.0, 45.0, 10, 20.0)
