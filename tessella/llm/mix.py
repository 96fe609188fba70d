"""Mixing sources to target weights.

Sizes are words. Sources, by code point and null last, have weights 5, 2, 1, repeating, and share the total size;
a source's target stops at ``repeats`` times its size and the excess goes to the others by weight.

The documents of a source, in a pseudorandom order, are one stream of words cut into blocks of ``block`` words (the
last may be shorter). The output has as many slots as blocks make the targets, in shards of ``shard`` slots. Every
shard draws its source counts from a multinomial over the targets; a closing shard moves the slots that chance
gave to sources beyond their targets to those below, so the totals are exact. A source's slots are numbered
through all shards; slot k takes the block that the permutation of epoch k div blocks puts at k mod blocks, so no
block is taken more than ``repeats`` times. Blocks are joined by (source, index).

Everything hangs on (seed, ids, sizes) alone, so reruns agree, whatever the partitions are.

Defined results. Null, empty and blank texts have size zero and are never taken. A source of size zero has the
target zero. A null source is a source. Repeated rows and ids are rows of their own; of rows alike in id and text it
doesn't matter which is which. Empty tables give empty results. Only doc_id, text and source, and columns named in
``keep``, are read. Long texts span many blocks.

What moves: ids and sizes, never texts. Running totals are taken inside buckets of a bounded mean number of rows,
dealt by a hash of id and text, and over the buckets' sums, so that no source, however large, and no id, however often
it is repeated or null, is one task's work. Rows without words take no part. Per-source values are one row for each
source; the multinomials need them on the driver, 24 bytes a source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, Scratch, held


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    repeats: int = 3
    block: int = 64
    shard: int = 256
    seed: int = 2025
    #: How far from its target chance may leave a source, as a share of it.
    tolerance: float = 0.01
    #: Mean rows of a bucket of running totals, and shards of a group.
    bucket_rows: int = 2048
    group_shards: int = 64


def n_words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, SPACES, -1)
    return (F.size(parts) - F.when(t.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) - F.when((F.length(t) == 0) | t.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)).cast("long")


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def multinomial(rng: np.random.Generator, n: int, share: np.ndarray) -> np.ndarray:
    """Source counts of a shard of n slots."""
    return rng.multinomial(n, share)


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """Image of each k in 0..n-1 under the permutation of ``key``: a Feistel network on the next even number of bits, walked until it falls inside."""
    if n <= 1:
        return np.zeros(len(k), np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 63) - 1))
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        x = out[todo]
        left, right = x >> h, x & mask
        for r in keys:
            left, right = right, left ^ (_mix64(right + r) & mask)
        x = (left << h) | right
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


def targets(per_source: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """One row for each source: source, source_size, order (1, 2, ...), target. ``per_source``: source, source_size.

    Sources fill up in the order of size / weight, so those that stop at their limit are the first ones of it.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in p.weights]), ((F.col("order") - 1) % len(p.weights) + 1).cast("int"))
    s = per_source.withColumn("order", F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))).withColumn("weight", w)
    s = s.withColumn("top", p.repeats * F.col("source_size").cast("double"))
    fill = W.orderBy((F.col("top") / F.col("weight")).asc(), "order")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    # the level that the rest would share by weight if all before this source stood at their limits
    s = s.withColumn("total", F.sum("source_size").over(W.partitionBy())).withColumn("level", (F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("full", F.col("top") <= F.col("level") * F.col("weight"))
    # the first source that doesn't reach its limit sets the level of all from there on
    s = s.withColumn("final", F.min(F.when(~F.col("full"), F.struct((F.col("top") / F.col("weight")).alias("at"), F.col("order").alias("o"), F.col("level").alias("level")))).over(W.partitionBy())["level"])
    return s.select(*per_source.columns, "order", F.when(F.col("final").isNull(), F.col("top")).otherwise(F.least("top", F.col("final") * F.col("weight"))).alias("target"))


def _running(sized: DataFrame) -> DataFrame:
    """sized (doc_id, order, size, h, bucket) with ``at``: words of the source before each row."""
    sums = sized.groupBy("order", "bucket").agg(F.sum("size").alias("words"))
    over = W.partitionBy("order").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("order", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("offset"))
    inside = W.partitionBy("order", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(offsets, ["order", "bucket"]).withColumn("at", F.col("offset") + F.col("within")).drop("offset", "within")


@dataclass(frozen=True)
class Mix:
    sources: DataFrame  # source, source_size, order, target, blocks, slots
    slots: DataFrame  # shard, slot (in the shard), order (of the source), k, index (of the block)
    pieces: DataFrame  # doc_id, order, index, words: of each document in each block
    docs: DataFrame  # doc_id, order, size, at: where each document's words begin in its source, null without words; and the columns of keep
    keep: tuple[str, ...]
    scratch: Scratch  # tables at rest that all of these read
    block: int  # words of a block


def plan(docs: DataFrame, p: MixParams = MixParams(), keep: tuple[str, ...] = ()) -> Mix:
    """``keep``: columns of the documents' rows that come along."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = held(docs, "doc_id", "text", "source", *keep).select(*keep, F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(p.seed)).alias("h"))
    sized = scratch.write(sized, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    s = targets(per_source, p).withColumn("blocks", F.ceil(F.col("source_size") / p.block).cast("long"))
    # as many slots as blocks of this source's mean size make its target
    s = s.withColumn("slots", F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long"))
    s = scratch.write(s.coalesce(1), "sources")
    # as many buckets as a source's rows ask for, so that a large source's are no fuller than others'
    mine = _known(s).select(F.col("source").alias("own"), "order", "rows")
    dealt = sized.join(mine, F.col("source").eqNullSafe(F.col("own"))).drop("own", "source")
    bucket = F.pmod(F.xxhash64("h", "size"), F.greatest(F.lit(1), F.floor(F.col("rows") / p.bucket_rows)))
    placed = _running(dealt.where("size > 0").withColumn("bucket", bucket).drop("rows"))
    lo, hi = F.floor(F.col("at") / p.block), F.floor((F.col("at") + F.col("size") - 1) / p.block)
    pieces = placed.select("doc_id", "h", "size", "order", "at", F.explode(F.sequence(lo, hi)).alias("index"))
    pieces = pieces.withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("index") + 1) * p.block) - F.greatest(F.col("at"), F.col("index") * p.block))
    blank = dealt.where("size = 0").drop("rows").withColumn("at", F.lit(None).cast("long"))
    return Mix(s, _slots(s, p, scratch), pieces, placed.drop("bucket").unionByName(blank), keep, scratch, p.block)


SLOT = "shard long, slot long, order int, k long, index long"


def settled(drawn: np.ndarray, want: np.ndarray, top: np.ndarray, tolerance: float) -> np.ndarray:
    """Slots of each source: those drawn, unless they leave the bounds; as many in all as wanted."""
    lo = np.ceil(want * (1 - tolerance)).astype(np.int64)
    hi = np.maximum(want, np.minimum(top, np.floor(want * (1 + tolerance)).astype(np.int64)))
    out = np.clip(drawn, lo, hi)
    over = int(out.sum() - want.sum())
    room = out - lo if over > 0 else hi - out
    before = np.concatenate(([0], np.cumsum(room)[:-1]))
    return out - np.sign(over) * np.clip(abs(over) - before, 0, room)


def _slots(s: DataFrame, p: MixParams, scratch: Scratch) -> DataFrame:
    """(shard, slot, order, k, index) of every slot."""
    spark = s.sparkSession
    # one row for each source: what a multinomial needs
    known = [(r["order"], r["slots"], r["blocks"]) for r in s.where("slots > 0").orderBy("order").collect()]
    if not known:
        return spark.createDataFrame([], SLOT)
    order, want, blocks = (np.array(x) for x in zip(*known, strict=True))
    share, total = want / want.sum(), int(want.sum())
    shards = -(-total // p.shard)
    groups = -(-shards // p.group_shards)

    draws = multinomial

    def counts(g: int) -> np.ndarray:
        """Source counts of each shard of a group; the last shard may be smaller."""
        ids = np.arange(g * p.group_shards, min(shards, (g + 1) * p.group_shards))
        return np.array([draws(np.random.default_rng([p.seed, int(i)]), min(p.shard, total - i * p.shard), share) for i in ids])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), g)), pa.array(np.arange(len(order))), pa.array(counts(g).sum(0))], ["g", "i", "n"])

    drawn = scratch.write(spark.range(groups).repartition(max(1, min(groups, 4096)), "id").mapInArrow(sums, "g long, i long, n long"), "drawn")
    # a row for each source again
    totals = {r["i"]: r["n"] for r in drawn.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    got = np.array([totals.get(i, 0) for i in range(len(order))])
    most = settled(got, want, p.repeats * blocks, p.tolerance)
    short = np.maximum(most - got, 0)
    first = np.concatenate(([0], np.cumsum(short)[:-1]))  # of each source's slots in the closing shards

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, offsets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.array([x["offset"] for x in sorted(offsets, key=lambda x: x["i"])])
                c = counts(g)
                shards_of = g * p.group_shards + np.arange(len(c))
                for i in np.flatnonzero(c.any(0)):
                    k = np.arange(at[i], min(at[i] + c[:, i].sum(), most[i]))  # what is beyond is given away
                    if len(k):
                        n = c[:, i]
                        slot = np.repeat(c[:, :i].sum(1) - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        yield made(np.repeat(shards_of, n)[: len(k)], slot[: len(k)], i, k)

    def made(shard: np.ndarray, slot: np.ndarray, i: int, k: np.ndarray) -> pa.RecordBatch:
        epoch, index = k // blocks[i], np.empty(len(k), np.int64)
        for e in np.unique(epoch):
            index[epoch == e] = permuted(k[epoch == e] % blocks[i], int(blocks[i]), hash((p.seed, int(order[i]), int(e))))
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot), pa.array(np.full(len(k), order[i], np.int32)), pa.array(k), pa.array(index)], ["shard", "slot", "order", "k", "index"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, lo, hi in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                place = first[i] + np.arange(lo, hi) - got[i]
                yield made(shards + place // p.shard, place % p.shard, i, np.arange(lo, hi))

    offset = F.coalesce(F.sum("n").over(W.partitionBy("i").orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_group = drawn.withColumn("offset", offset).groupBy("g").agg(F.collect_list(F.struct("i", "offset")).alias("offsets")).repartition(max(1, min(groups, 4096)), "g")
    out = by_group.mapInArrow(draw, SLOT)
    if short.any():
        # slots to make up are dealt in runs, so that one source's are no single task's
        gaps = spark.createDataFrame([(int(i), int(got[i]), int(most[i])) for i in np.flatnonzero(short)], "i long, n long, most long")
        runs = gaps.select("i", "most", F.explode(F.sequence("n", F.col("most") - 1, F.lit(65536))).alias("lo")).select("i", "lo", F.least(F.col("lo") + 65536, "most").alias("hi"))
        out = out.unionByName(runs.mapInArrow(close, SLOT))
    return out


def _known(sources: DataFrame, most: int = 100_000) -> DataFrame:
    """One row for each source, hinted for broadcast unless there are very many."""
    return F.broadcast(sources) if sources.count() <= most else sources


def taken(mix: Mix, places: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row, and its kept columns.

    With ``places`` also slots: (shard, slot, block, from, words) of all of the row's stretches, from being the place in
    the block; there are at most ``repeats`` of them for each block that the row reaches into.
    """
    # merged: Spark estimates slots by the rows of the draws, hundreds of times too few, and would broadcast them
    used = mix.slots.groupBy("order", "index").agg(F.count("*").alias("times"), *([F.collect_list(F.struct("shard", "slot")).alias("into")] if places else []))
    begin = F.greatest(F.col("at") - F.col("index") * mix.block, F.lit(0)).alias("from")
    stretch = F.flatten(F.collect_list(F.transform("into", lambda x: F.struct(x["shard"].alias("shard"), x["slot"].alias("slot"), F.col("index").alias("block"), F.col("from").alias("from"), F.col("words").alias("words"))))) if places else None
    words = mix.pieces.join(used.hint("merge"), ["order", "index"]).withColumn("from", begin).groupBy("order", "h", "size", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), *([F.sort_array(stretch).alias("slots")] if places else []))
    # a row of words is known by where it begins in its source; ids may be null or repeated
    out = mix.docs.select(*mix.keep, "doc_id", "h", "size", "order", "at").join(words.hint("merge"), ["order", "h", "size", "at"], "left")
    known = _known(mix.sources).select("order", "source", "source_size", "target")
    return out.join(known, "order").select(*mix.keep, "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *(["slots"] if places else []))
