"""Query op7_licenses and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .license_texts import KNOWN
from .licenses import COPYRIGHT, PUNCTUATION, SPELLINGS, scan


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), spark.createDataFrame(list(KNOWN), "license_id string, text string"))


def _canonical(t: str) -> str:
    t = f"regexp_replace(lower({t}), '{COPYRIGHT}', chr(10), 'g')"
    t = f"' ' || regexp_replace({t}, '{PUNCTUATION}', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"trim({t}, ' ')"


_ROWS = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
SQL = f"""
WITH known AS (SELECT sha256(c) AS digest, min(id) AS license_id FROM (SELECT id, {_canonical('t')} AS c FROM (VALUES {_ROWS}) AS k(id, t)) WHERE c <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256({_canonical('text')}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM d LEFT JOIN known USING (digest)"""

QUERIES = {"op7_licenses": op7_licenses}
ORACLE_SQL = {"op7_licenses": SQL}
