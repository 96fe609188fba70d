"""Query op4_revisits and its SQL.

``pages`` has no revisit records, so the query reads it as a crawl log. Page p is captured at time 4 p, and its URL is
asked again, spelled with a fragment, before or after. With it the front page of its host is captured and asked again,
at times that several pages share or that are null; so a front page has many responses, and the latest earlier one
counts. Validators change every so many pages, and some are missing: entity tags first, then dates, then digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .revisits import TRACKING, resolve

SITE = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)"

#: Columns of each kind of record, as SQL that both engines read; p is the page, tag the digest of its markup.
RECORDS = {
    ("response", "own"): {"id": "4 * p", "ts": "4 * p", "etag": "tag", "last_modified": "CAST(NULL AS STRING)", "digest": "tag"},
    ("revisit", "own"): {
        "id": "4 * p + 1", "ts": "4 * p + 3 - 4 * (p % 3)", "etag": "CASE WHEN p % 11 = 0 THEN NULL WHEN p % 7 = 0 THEN 'changed' ELSE concat('W/', tag) END",
        "last_modified": "CAST(NULL AS STRING)", "digest": "CASE WHEN p % 11 = 0 AND p % 2 = 0 THEN tag END",
    },
    ("response", "front"): {
        "id": "4 * p + 2", "ts": "CASE WHEN p % 13 <> 0 THEN CAST(floor(p / 4) AS BIGINT) * 16 END", "etag": "CASE WHEN p % 3 <> 1 THEN concat('v', CAST(CAST(floor(p / 64) AS BIGINT) AS STRING)) END",
        "last_modified": "CASE WHEN p % 4 <> 2 THEN concat('m', CAST(CAST(floor(p / 96) AS BIGINT) AS STRING)) END", "digest": "CASE WHEN p % 5 <> 4 THEN concat('d', CAST(CAST(floor(p / 128) AS BIGINT) AS STRING)) END",
    },
    ("revisit", "front"): {
        "id": "4 * p + 3", "ts": "CASE WHEN p % 17 <> 0 THEN CAST(floor(p / 4) AS BIGINT) * 16 + 8 * (p % 3) - 8 END", "etag": "CASE WHEN p % 2 = 0 THEN concat('W/v', CAST(CAST(floor(p / 64) AS BIGINT) AS STRING)) END",
        "last_modified": "CASE WHEN p % 3 <> 0 THEN concat('m', CAST(CAST(floor(p / 96) AS BIGINT) AS STRING)) END", "digest": "CASE WHEN p % 7 <> 0 THEN concat('d', CAST(CAST(floor(p / 128) AS BIGINT) AS STRING)) END",
    },
}


def _headers(kind: str) -> Column:
    date = F.coalesce(F.col("ts").cast("string"), F.lit("none"))
    if kind == "response":
        return F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("server"), F.col("record_id").cast("string"), F.lit("date"), date, F.lit("vary"), F.lit("cookie"))
    return F.create_map(F.lit("date"), date, F.lit("content-length"), F.lit("0"), F.lit("vary"), F.lit("accept"))


def capture_log(pages: DataFrame) -> DataFrame:
    page = pages.select(F.col("page_id").alias("p"), "url", F.substring(F.md5("html"), 1, 12).alias("tag"))
    out = []
    for (kind, place), c in RECORDS.items():
        if place == "own":
            url = F.col("url") if kind == "response" else F.concat("url", F.lit("#again"))
        else:
            scheme, host = (F.regexp_extract("url", SITE, k) for k in (1, 2))
            url = F.concat(scheme, F.lit("://"), host, F.lit("/")) if kind == "response" else F.concat(F.upper(scheme), F.lit("://"), F.upper(host), F.lit("/?utm_source=x#again"))
        cols = [F.expr(c[n]).alias(n) for n in ("etag", "last_modified", "digest")]
        rec = page.select(F.expr(c["id"]).cast("long").alias("record_id"), url.alias("url"), F.expr(c["ts"]).cast("long").alias("ts"), F.lit(kind).alias("kind"), *cols)
        out.append(rec.withColumn("headers", _headers(kind)))
    first, *rest = out
    for o in rest:
        first = first.unionByName(o)
    return first


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(capture_log(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda h: F.concat(h["key"], F.lit("="), h["value"])), ";")
    return out.select("record_id", "canonical", "refers_to", "state", text.alias("headers"))


def canonical_sql(url: str) -> str:
    u = f"regexp_replace(trim({url}, ' ' || chr(9) || chr(13) || chr(10)), '#.*$', '')"
    rest = f"regexp_replace({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*', '')"
    host = f"regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', '')"
    path = rf"regexp_replace(regexp_replace(regexp_replace({rest}, '\?.*$', ''), '(\.html?|/index\.html?)$', ''), '/+$', '')"
    query = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract({rest}, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&')"
    return f"{host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"


def _records(kind: str) -> str:
    parts = []
    for (k, place), c in RECORDS.items():
        if k == kind:
            # a front page's canonical URL is its host; fragments don't count
            canonical = canonical_sql("url") if place == "own" else f"regexp_replace(lower(regexp_extract(url, '{SITE}', 2)), ':(80|443)$', '')"
            parts.append(f"SELECT {c['id']} AS record_id, {canonical} AS canonical, {c['ts']} AS ts, {c['etag']} AS etag, {c['last_modified']} AS last_modified, {c['digest']} AS digest FROM page")
    return " UNION ALL ".join(parts)


SQL = f"""
WITH page AS (SELECT page_id AS p, url, substr(md5(html), 1, 12) AS tag FROM pages),
resp AS ({_records("response")}), rev AS ({_records("revisit")}),
hit AS (SELECT rev.record_id, max((resp.ts, resp.record_id)) AS k FROM rev JOIN resp ON resp.canonical = rev.canonical AND resp.ts < rev.ts GROUP BY 1),
j AS (SELECT rev.*, resp.record_id AS rid, resp.etag AS retag, resp.last_modified AS rlast, resp.digest AS rdigest FROM rev LEFT JOIN hit USING (record_id) LEFT JOIN resp ON resp.record_id = hit.k[2]),
c AS (SELECT *, CASE WHEN etag IS NOT NULL AND retag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '')
  WHEN last_modified IS NOT NULL AND rlast IS NOT NULL THEN last_modified = rlast WHEN digest IS NOT NULL AND rdigest IS NOT NULL THEN digest = rdigest END AS same FROM j),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'unresolved' WHEN same IS NULL THEN 'unchecked' WHEN same THEN 'resolved' ELSE 'mismatch' END AS state FROM c)
SELECT record_id, canonical, rid AS refers_to, state, CASE WHEN state IN ('resolved', 'unchecked') THEN 'content-type=text/html;date=' || ts || ';server=' || rid || ';vary=accept' END AS headers FROM s"""

QUERIES = {"op4_revisits": op4_revisits}
ORACLE_SQL = {"op4_revisits": SQL}
