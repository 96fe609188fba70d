"""Query op13_trie: the prefix trie of conversations that begin as the first one of their hundred does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_rows, join_unique, table
from .trie import TrieParams, ordered, trie

#: A conversation takes up to SPAN - 1 turns of the conversation whose id is the last multiple of GROUP.
SPAN, GROUP = 6, 100


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) and (conv_id, at, label, chars, length) of the rebuilt conversations."""
    own = scratch.write(ordered(conversations, scratch), "own")
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SPAN
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = lengths.select("conv_id", "n", h.alias("h"), base.alias("base")).join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("first")), "base", "left")
    convs = convs.withColumn("took", F.least("h", F.coalesce("first", F.lit(0).cast("long")))).withColumn("length", F.col("took") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = scratch.write(convs.select("conv_id", "base", "n", "h", "took", "length"), "rebuilt")
    turns = convs.agg(F.sum("n")).first()[0] or 0
    starts = own.where((F.col("conv_id") % GROUP == 0) & (F.col("at") < SPAN - 1)).withColumnRenamed("conv_id", "base")
    heads = convs.where("took > 0").join(starts, "base").where("at < took").select("conv_id", "at", "label", "chars", "length")
    hot = convs.where(F.col("n") > hot_rows(turns))
    tails = join_unique(own.where(F.col("at") >= h), convs.select("conv_id", "h", "took", "length"), "conv_id", hot)
    tails = tails.select("conv_id", (F.col("at") - F.col("h") + F.col("took")).alias("at"), "label", "chars", "length")
    return convs.select("conv_id", "length"), heads.unionByName(tails)


def op13_trie(spark: SparkSession, sf_dir: str, p: TrieParams = TrieParams()) -> DataFrame:
    scratch = Scratch(spark, "trie")
    return trie(*rebuilt(table(spark, sf_dir, "conversations"), scratch), scratch, p)


QUERIES = {"op13_trie": op13_trie}
#: Nodes are lists of turns here, subtrees are joins of every node with all of its ancestors.
ORACLE_SQL = {
    "op13_trie": """
WITH own AS (
    SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
    SELECT conv_id, list(said ORDER BY k) AS turns FROM own GROUP BY conv_id
), sums AS (
    SELECT conv_id, turns, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
    FROM lists
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
    FROM sums c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100
), members AS (
    SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends FROM rebuilt, unnest(range(0, len(turns) + 1)) AS r(d)
), nodes AS (
    SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY depth, path
), children AS (
    SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), own_sums AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children,
        CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[n.depth].text) END AS saved
    FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path
), subtrees AS (
    SELECT d AS depth, path[1:d] AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM own_sums, unnest(range(0, depth + 1)) AS r(d) GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM own_sums n JOIN subtrees s ON s.depth = n.depth AND s.path = n.path
    LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
}
