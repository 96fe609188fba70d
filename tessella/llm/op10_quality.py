"""Query op10_quality and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import CLASSES, QualityParams, judged

P = QualityParams()


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), P)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _left(t: str, c: str) -> str:
    return f"length(regexp_replace({t}, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))"


def _jsd(p: str, q: str) -> str:
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    return f"{half(p, q)} + {half(q, p)}"


def quality_sql(docs: str = "documents") -> str:
    """DuckDB SQL of every row's measures and verdict."""
    k = [f"k{i}" for i in range(len(CLASSES) + 1)]
    named = [f"{_left('t', c)} AS {k[i + 1]}" for i, (_, c) in enumerate(CLASSES)]
    symbol = 1 + [n for n, _ in CLASSES].index("symbol")
    shares = " UNION ALL ".join(f"SELECT rid, key, '{x}' AS c, {x} / greatest(1, word_chars) AS p, n_chars FROM m" for x in k)
    both = " + ".join(k)
    refs = " UNION ALL ".join(f"SELECT key, '{x}' AS c, (sum({x}) + {P.prior_chars} * (SELECT sum({x}) / greatest(1, sum({both})) FROM m)) / (sum({both}) + {P.prior_chars}) AS q FROM m GROUP BY key" for x in k)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(1)) AS key, coalesce(text, '') AS t FROM {docs}),
w0 AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
m0 AS (SELECT rid, doc_id, key, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS n_chars, {', '.join(named)}, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w0),
m AS (SELECT *, greatest(0, word_chars - {' - '.join(k[1:])}) AS k0 FROM m0),
win AS (SELECT rid, unnest(range(1, n_words - 3)) AS i, w FROM m WHERE n_words >= 5),
win2 AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS v FROM win),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS n FROM win2) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM dup, range(5) AS r(j) GROUP BY rid),
tok AS (SELECT rid, key, lower(unnest(w)) AS word FROM m),
cnt AS (SELECT key, word, count(*) AS n FROM tok GROUP BY ALL),
tot AS (SELECT key, sum(n) AS ref_words FROM cnt GROUP BY key),
pool AS (SELECT word, sum(n) AS n_all, (SELECT sum(n) FROM cnt) AS all_words FROM cnt GROUP BY word),
asked AS (SELECT key, word FROM cnt JOIN tot USING (key) WHERE n >= {P.common_share} * ref_words UNION SELECT key, word FROM tot, pool WHERE n_all >= {P.common_share} * all_words),
common AS (SELECT key, word, (coalesce(n, 0) + {P.prior_words} * (n_all / all_words)) / (ref_words + {P.prior_words}) AS q FROM asked LEFT JOIN cnt USING (key, word) JOIN tot USING (key) JOIN pool USING (word) WHERE q >= {P.common_share}),
found AS (SELECT rid, key, word, count(*) AS c FROM tok JOIN common USING (key, word) GROUP BY ALL),
pairs AS (SELECT m.rid, q, coalesce(c, 0) / greatest(1, n_words) AS p FROM m JOIN common USING (key) LEFT JOIN found ON found.rid = m.rid AND found.word = common.word),
rest AS (SELECT rid, greatest(0, 1 - sum(q)) AS q, greatest(0, 1 - sum(p)) AS p FROM pairs GROUP BY rid),
wd AS (SELECT rid, sqrt(greatest(0, sum({_jsd('p', 'q')}) / 2)) AS d FROM (SELECT rid, q, p FROM pairs UNION ALL SELECT rid, q, p FROM rest) GROUP BY rid),
share AS ({shares}), ref AS ({refs}),
cd AS (SELECT rid, sqrt(greatest(0, sum({_jsd('p', 'q')}) / 2)) AS d FROM share JOIN ref USING (key, c) GROUP BY rid),
j AS (SELECT m.*, coalesce(rep.n, 0) AS n_repeat_words, n_words < {P.min_words} OR 100 * coalesce(rep.n, 0) > {P.max_repeat_pct} * n_words AS base_failed,
  CASE WHEN n_chars >= {P.min_chars} THEN cd.d END AS class_distance,
  CASE WHEN n_words >= {P.min_hist_words} THEN coalesce(wd.d, 0) END AS word_distance
  FROM m LEFT JOIN rep USING (rid) LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, k{symbol}::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= {P.max_class_distance} AND coalesce(word_distance, 0) <= {P.max_word_distance} AS kept FROM j"""


QUERIES = {"op10_quality": op10_quality}
ORACLE_SQL = {"op10_quality": quality_sql()}
