"""Licence scans by canonical digest.

A text is lowered, its copyright lines go, runs of punctuation and blanks become one blank, equivalent spellings one
spelling; the SHA-256 of the whole canonical text is hash-joined to the digests of known licences.

Defined results. Null texts have no digest and no licence; texts of which nothing is left have the digest of the
empty text and no licence. Known texts with one digest count as the one of the smallest id; without known texts no
document has a licence, and an empty table gives an empty result. Repeated rows: each has its own result. Extra columns stay out. Texts are whole, whatever their length; a digest shared by a
third of all rows does no harm, since the known digests are the small side and the texts don't move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch

COPYRIGHT = r"(^|\n)[^\na-z0-9]*(copyright[ \t]*(\(c\)|©|[0-9{<\[]|by )|\(c\)[ \t]|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’–—…•]+"

#: Equivalent spellings, as words.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencee", "licensee"),
    ("licencees", "licensees"),
    ("sublicence", "sublicense"),
    ("sublicences", "sublicenses"),
    ("sublicenced", "sublicensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("https", "http"),
)


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), COPYRIGHT, "\n")
    t = F.concat(F.lit(" "), F.regexp_replace(t, PUNCTUATION, " "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def scan(docs: DataFrame, known: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, digest, license_id of every row of ``docs`` (doc_id, text); ``known`` has license_id and text."""
    digest = lambda c: F.sha2(canonical(F.col(c)), 256)
    table = known.where("text IS NOT NULL").select("license_id", canonical(F.col("text")).alias("c")).where("c <> ''").groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    table = Scratch(docs.sparkSession, "licenses").small(table, broadcast_bytes)
    return docs.select("doc_id", digest("text").alias("digest")).join(table, "digest", "left").select("doc_id", "digest", "license_id")
