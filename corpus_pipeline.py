"""Training-corpus pipeline over ``documents``: quality rules, line dedup, SimHash near-dedup, benchmark
decontamination, mixing to target weights.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame that
is written as Parquet and read again. All but the last return the columns of ``documents`` and no others, so extra
columns of an input go. Empty inputs give empty outputs. A null text is rejected by the first stage, having no
words. A document of which line dedup leaves nothing keeps an empty text. ``n_chars`` follows the text. The last
stage's rows are the corpus: whole texts, and for each how many of its words to take; which block fills which slot of
which shard is a table of its own, written anew by each run (``shards_path``).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, lean_batches, table
from tessella.llm.decontaminate import contamination
from tessella.llm.lines import LineParams, clean
from tessella.llm.mix import MixParams, plan, taken
from tessella.llm.quality import judged
from tessella.llm.simhash import leaders
from tessella.scratch import scratch_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    # exploding none or one, not a filter: the optimizer would push the verdict's whole expression below the columns it is made of
    return judged(docs, keep=COLUMNS).select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur over a source's documents go, copies counted as one; the source stands for the host, a null source for one of its own."""
    host = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    sites = docs.select(host.alias("host"), "text", F.struct("doc_id", "lang", "source", "n_chars").alias("row"))
    out = clean(sites, LineParams(), distinct=True)
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select("row.doc_id", "text", "row.lang", "row.source", n.alias("n_chars"))


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows at rest, each with a number of its own: ids may be null or repeated. The texts are written, not shuffled."""
    return scratch.write(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("rid")), "rows")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id stays of each group. Rows are judged by their texts alone, whether they share an id, have their own or have none."""
    lean_batches(spark)
    scratch = Scratch(spark, "dedup")
    rows = _numbered(docs, scratch)
    kept = scratch.write(leaders(rows, "rid"), "kept")
    # fewer ids travel where those that go are fewer; texts are shuffled only beyond the broadcast bound
    if 2 * kept.count() > rows.count():
        return rows.join(scratch.small(rows.select("rid").join(kept, "rid", "left_anti")), "rid", "left_anti").select(*COLUMNS)
    return rows.join(scratch.small(kept), "rid", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    lean_batches(spark)
    return contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS).where("NOT contaminated").select("row.*")


def shards_path(spark: SparkSession) -> str:
    """The table (shard, slot, order of the source, k, index of the block) of the last mix, in the shared folder."""
    return f"{scratch_dir(spark)}/corpus-shards"


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken: how many of their words it takes, repeats counted. The slots of its shards are written to ``shards_path``."""
    lean_batches(spark)
    scratch = Scratch(spark, "mixed")
    rows = _numbered(docs, scratch)
    planned = plan(rows, MixParams(), keep=("rid",))
    planned.slots.write.mode("overwrite").parquet(shards_path(spark))
    planned = replace(planned, slots=spark.read.schema(planned.slots.schema).parquet(shards_path(spark)))
    counts = planned.scratch.settle(taken(planned).where("taken > 0").select("rid", "size", "source_size", "target", "taken"))
    return rows.join(scratch.small(counts), "rid").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_dedup", near_duplicates), ("decontaminate", decontaminate), ("mix", mix)]

#: SQL has no XXH64 and can't repeat the draws; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
