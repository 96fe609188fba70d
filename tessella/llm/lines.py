"""Line dedup by site-relative frequency.

Pages are grouped by host; a line's ratio is the number of the host's pages that contain it divided by the
host's pages. Lines that recur and whose ratio exceeds the limit are boilerplate and go from every page of that host.
"Exceeds" is meant statistically, at sites of any size alike: the lower bound of the ratio's score interval (Wilson's,
``z`` standard errors) is above the limit, which for a line on two pages is so up to ten pages; z = 0 compares the
plain ratio. A line of one page doesn't recur.

Defined results. Lines are compared without surrounding blanks; blank lines stay and count for nothing. A
null text stays null. A null host is no site: its texts stay as they are. Repeated rows count as pages of
their own. A page of which every line is boilerplate keeps an empty text. Only the named columns are read,
so extra columns cannot clash. A line is known by its 64-bit hash; a wrong drop needs a collision with one
of the host's few boilerplate lines. With ``distinct`` pages of the same text (by 64-bit hash) count as one, so that
copies alone make no line boilerplate. Empty tables give empty results; texts are whole, however long, and lines too.

What moves: a (host, hash) row for each distinct line of a task, pre-summed, and a short list for each
host: at most mean lines per page / ratio hashes, since ratios sum to the mean. Texts move only where
those lists outgrow the broadcast bound, and then a hot host's partition is split by the skew join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, held

BLANK = " \t\x0b\x0c\r"


@dataclass(frozen=True)
class LineParams:
    max_ratio: float = 0.05
    z: float = 1.645


def exceeds(n: Column, pages: Column, p: LineParams) -> Column:
    """A line on n of a host's pages is boilerplate. The score interval's lower bound is above r where n is more than z standard errors above r times the pages."""
    over = n - p.max_ratio * pages
    return (n >= 2) & (over > 0) & (over * over > p.z * p.z * p.max_ratio * (1 - p.max_ratio) * pages)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, params: LineParams = LineParams(), distinct: bool = False) -> DataFrame:
    """(host, bad): hashes of each host's boilerplate lines. ``pages`` has host and text."""
    # no filter on the text: it would be pushed below the expression that makes the text, which would then run twice
    p = held(pages, "host", "text").where("host IS NOT NULL")
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(BLANK)) != ""), line_key))
    lines, whole = p.select("host", F.explode(keys).alias("key")), held(pages, "host").where("host IS NOT NULL")
    if distinct:
        same = F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("same")
        lines, whole = p.select("host", same, F.explode(keys).alias("key")).distinct(), p.select("host", same).distinct()
    seen = lines.groupBy("host", "key").agg(F.count("*").alias("n")).where("n >= 2")
    totals = whole.groupBy("host").agg(F.count("*").alias("pages"))
    return seen.join(totals, "host").where(exceeds(F.col("n"), F.col("pages"), params)).groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("bad"))


def clean(pages: DataFrame, params: LineParams = LineParams(), broadcast_bytes: int = BROADCAST_BYTES, distinct: bool = False) -> DataFrame:
    """Every row of ``pages`` (id, host, text, and whatever else is named in ``keep``) with its text cleaned.

    Adds n_lines (lines that aren't blank) and n_dropped.
    """
    scratch = Scratch(pages.sparkSession, "lines")
    bad = scratch.small(boilerplate(pages, params, distinct), broadcast_bytes)
    d = pages.join(bad, "host", "left")
    split = _lines(F.col("text"))
    gone = lambda x: (F.btrim(x, F.lit(BLANK)) != "") & F.array_contains("bad", line_key(x))
    kept = F.when(F.col("bad").isNull(), split).otherwise(F.filter(split, lambda x: ~gone(x)))
    d = d.withColumn("all_lines", split).withColumn("kept_lines", kept)
    n = lambda a: F.coalesce(F.size(F.filter(a, lambda x: F.btrim(x, F.lit(BLANK)) != "")), F.lit(0)).cast("long")
    return (
        d.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n("all_lines")))
        .withColumn("n_dropped", F.when(F.col("text").isNull() | F.col("bad").isNull(), F.lit(0).cast("long")).otherwise((F.size("all_lines") - F.size("kept_lines")).cast("long")))
        .withColumn("text", F.when(F.col("bad").isNull() | (F.col("n_dropped") == 0), F.col("text")).otherwise(F.array_join("kept_lines", "\n")))
        .drop("all_lines", "kept_lines", "bad")
    )
