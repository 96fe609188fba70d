"""Query op2_lines (``pages``, host from the URL, lines from the markup) and its SQL.

A null or unparsable URL has a null host, whose pages keep their lines; null markup counts as an empty text in the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .lines import LineParams, clean

P = LineParams()

#: Fixed patterns: what is cut, what ends a line, and all other markup.
CUT = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BREAK = r"</?(p|br|li|ul|ol|div|h[1-6]|title|nav|article|footer|header|section|tr|table|body|html|head)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)"


def page_host(url: Column) -> Column:
    """Lower-case host; null where the URL has none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def page_text(html: Column) -> Column:
    """Visible text, a line for each block of the markup."""
    t = F.regexp_replace(html, CUT, "")
    t = F.regexp_replace(t, BREAK, "\n")
    t = F.regexp_replace(t, TAG, "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(t, r"\n+", "\n"), F.lit("\n"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", page_host(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    scratch = Scratch(spark, "pages")
    pages = scratch.write(pages)  # markup is parsed once, and the text read twice
    return scratch.settle(clean(pages, P).select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")))


def lines_sql(pages: str, params: LineParams = P) -> str:
    """CTEs up to ``cleaned(rid, host, text, n_lines, n_dropped)`` over a relation with rid, host, text."""
    trim = lambda x: f"trim({x}, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
    return f"""
pg AS ({pages}),
ln AS (SELECT rid, host, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM pg WHERE text IS NOT NULL),
seen AS (SELECT host, {trim('line')} AS k, count(DISTINCT rid) AS n FROM ln WHERE host IS NOT NULL AND {trim('line')} <> '' GROUP BY ALL),
hosts AS (SELECT host, count(*) AS pages FROM pg GROUP BY host),
bad AS (SELECT host, k FROM seen JOIN hosts USING (host) WHERE n >= 2 AND n - {params.max_ratio} * pages > 0
  AND (n - {params.max_ratio} * pages) * (n - {params.max_ratio} * pages) > {params.z * params.z * params.max_ratio * (1 - params.max_ratio)} * pages),
flag AS (SELECT ln.rid, ln.i, ln.line, {trim('ln.line')} <> '' AS full_line, bad.k IS NOT NULL AS gone FROM ln LEFT JOIN bad ON bad.host = ln.host AND bad.k = {trim('ln.line')}),
agg AS (SELECT rid, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS joined FROM flag GROUP BY rid),
cleaned AS (SELECT pg.rid, pg.host, CASE WHEN pg.text IS NULL THEN NULL ELSE joined END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM pg LEFT JOIN agg USING (rid))"""


def _text_sql() -> str:
    t = f"regexp_replace(html, '{CUT}', '', 'g')"
    t = f"regexp_replace({t}, '{BREAK}', chr(10), 'g')"
    t = f"regexp_replace({t}, '{TAG}', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return f"trim(regexp_replace({t}, '\\n+', chr(10), 'g'), chr(10))"


SQL = f"""
WITH ids AS (SELECT row_number() OVER () AS rid, page_id, url, html FROM pages),
{lines_sql(f"SELECT rid, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, {_text_sql()} AS text FROM ids")}
SELECT page_id, host, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(text, '')) AS text_sha256 FROM cleaned JOIN ids USING (rid)"""

QUERIES = {"op2_lines": op2_lines}
ORACLE_SQL = {"op2_lines": SQL}
