"""Query op8_decontaminate and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import contamination


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def contamination_sql(docs: str = "documents", width: int = 10) -> str:
    """DuckDB SQL over a relation with doc_id and text."""
    words = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {words('text')} AS w FROM {docs}),
iw AS (SELECT item_id, {words('text')} AS w FROM benchmark),
pat0 AS (SELECT item_id, w, least(len(w), {width}) AS k, unnest(range(1, len(w) - least(len(w), {width}) + 2)) AS i FROM iw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM pat0),
ks AS (SELECT DISTINCT k FROM pat),
dwin AS (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT rid, item_id, i, k FROM (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM dwin) JOIN pat USING (k, p)),
nh AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS pos FROM hit) GROUP BY rid),
ni AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(nh.n, 0)::BIGINT AS n_hit, coalesce(ni.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (rid) LEFT JOIN ni USING (rid)"""


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE_SQL = {"op8_decontaminate": contamination_sql()}
