"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where over half of the shingle hashes have it. Fingerprints within ``radius``
bits are linked and the links' connected components are the groups.

Search: the 64 bits are cut in ``segments`` parts. If two fingerprints differ in at most ``radius`` bits, some
part differs in at most that part's share of them (the first parts take one bit more, the pigeonhole
principle). Every distinct fingerprint stands in a table by each part, enumerates the Hamming ball around each
part, fetches the table entries of the ball's keys and verifies complete distances. Of two unequal keys only the
larger enumerates, so each pair meets once.

Exact copies are one fingerprint with one representative, so their number doesn't matter. Buckets without a member
of their own are left out. A bucket yields links that span it, fewer than its members and visitors, not all their
pairs. Buckets of more than ``dense`` members and visitors are answered in another exact way: all of them list every
point (for an odd radius, every edge of the hypercube) within ``radius`` / 2 bits of theirs, and all that list the
same one are within ``radius`` of each other, so a link to the least of them is enough; the rows are linear in the
members, and no group is gathered.

Defined results. Null, empty and blank texts have no words: fingerprint zero, linked like any other. Texts of
any length are processed whole, in slices of bounded memory. Repeated rows and repeated ids: each row has its
own result. A null id is never a smallest id; a group of null ids has a null component_id. Empty tables give
empty results. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, held, hot_rows, join_unique, with_least

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SLICE = 1 << 16


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64 bits as a signed integer."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    begin, stop = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begin), SLICE):
        h = np.array([digest(whole[a:b], seed) for a, b in zip(begin[at : at + SLICE], stop[at : at + SLICE], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begin), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` (columns of integers) and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps, pa.int64())], [*keys, "fp"])

    rows = held(docs, "text", *keys).select(F.col("text").cast("binary").alias("text"), *[F.col(k).cast("long").alias(k) for k in keys])
    return rows.mapInArrow(run, ", ".join(f"{k} long" for k in (*keys, "fp")))


def plan_segments(segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(offset, bits, radius) of each segment; a radius below zero: not searched."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    share, more = divmod(radius, segments)
    return [(a, b - a, share - (i > more)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def segments_for(n: int, radius: int) -> int:
    """Number of parts of the least work: rows moved, and comparisons in buckets, of which two hundred cost about a moved row."""

    def work(segments: int) -> float:
        return sum((1 + sum(comb(bits, k) for k in range(1, r + 1)) / 2) * (1 + n / 2**bits / 200) for _, bits, r in plan_segments(segments, radius) if r >= 0)

    return min(range(1, max(1, radius) + 1), key=lambda s: (work(s), s))


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]


def _links(fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one bucket: every member is reached once, so fewer links than members."""
    a, b = [], []
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            if near.any():
                hit, left = left[near], left[~near]
                a.append(np.full(len(hit), rep[x]))
                b.append(rep[hit])
                queue.extend(hit.tolist())
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _verify(radius: int, small: int = 32):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten()
            shift = off[0]
            off = off - shift
            fp = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            rep = flat.field("rep").to_numpy(zero_copy_only=False)
            size = np.diff(off)
            a_all, b_all = [], []
            for n in np.unique(size):
                at = off[:-1][size == n]
                if n > small:
                    for s in at:
                        a, b = _links(fp[s : s + n], rep[s : s + n], radius)
                        a_all.append(a)
                        b_all.append(b)
                    continue
                i, j = np.triu_indices(n, 1)
                for lo in range(0, len(at), max(1, (1 << 20) // max(1, len(i)))):
                    s = at[lo : lo + max(1, (1 << 20) // max(1, len(i)))][:, None]
                    x, y = (s + i).ravel(), (s + j).ravel()
                    ok = np.bitwise_count(fp[x] ^ fp[y]) <= radius
                    a_all.append(rep[x[ok]])
                    b_all.append(rep[y[ok]])
            a = np.concatenate(a_all) if a_all else np.empty(0, np.int64)
            b = np.concatenate(b_all) if b_all else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _points(radius: int):
    """mapInArrow function over (fp, rep): every point within radius / 2 bits; for an odd radius the 64 edges at each, by their end without the bit."""
    masks = np.array([0, *_ball(64, radius // 2)], np.uint64)
    axes = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            step = 64 if radius % 2 == 0 else 1
            for lo in range(0, len(fp), step):
                at = (fp[lo : lo + step, None] ^ masks[None, :]).ravel()
                axis = np.full(len(at), -1, np.int8)
                if radius % 2:
                    axis = np.tile(np.arange(64, dtype=np.int8), len(at))
                    at = (at[:, None] & ~axes[None, :]).ravel()
                who = np.repeat(rep[lo : lo + step], len(at) // len(fp[lo : lo + step]))
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(axis, pa.int8()), pa.array(who)], ["point", "axis", "rep"])

    return run


def links(reps: DataFrame, scratch: Scratch, radius: int = 4, segments: int | None = None, dense: int = 16384) -> DataFrame:
    """Links (a, b) between representatives whose connected components are those of all pairs within ``radius``.

    ``reps``: fp, rep; every fp once.
    """
    parts = plan_segments(segments or segments_for(reps.count(), radius), radius)
    key = lambda a, n: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit(-1 if n == 64 else (1 << n) - 1))
    tag = lambda i, k: F.struct(F.lit(i).cast("byte").alias("part"), k.cast("long").alias("key"))
    none = F.expr("cast(array() as array<struct<part:tinyint,key:bigint>>)")

    def ball(i: int, own: Column) -> Column:
        """Buckets of the smaller keys around this one in part i."""
        _, n, r = parts[i]
        if r < 1:
            return none
        # functions of one argument: a second one would be taken for the index
        around = F.transform(F.array(*[F.lit(x if x < 1 << 63 else x - (1 << 64)).cast("long") for x in _ball(n, r)]), lambda m: m.bitwiseXOR(own))
        return F.transform(F.filter(around, lambda x: x < own), lambda x: tag(i, x))

    searched = [i for i, (_, _, r) in enumerate(parts) if r >= 0]
    home = reps.select("fp", "rep", F.explode(F.array(*[tag(i, key(*parts[i][:2])) for i in searched])).alias("bucket"))
    visits = reps.select("fp", "rep", F.explode(F.concat(none, *[ball(i, key(*parts[i][:2])) for i in searched])).alias("bucket"))
    every = home.unionByName(visits)
    homes = scratch.write(home.groupBy("bucket").agg(F.count("*").alias("n")), "homes")
    # no bucket can have more members and visitors than this
    most = (homes.agg(F.max("n")).first()[0] or 0) * (1 + max(len(_ball(n, r)) for _, n, r in parts))
    gathered, crowded = every, None
    if most > dense:
        guests = F.explode(reduce(lambda c, i: F.when(F.col("bucket.part") == i, ball(i, F.col("bucket.key"))).otherwise(c), searched, none))
        count = homes.select("bucket", "n", F.lit(True).alias("home")).unionByName(homes.select("n", guests.alias("bucket")).select("bucket", "n", F.lit(False).alias("home")))
        full = count.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("home").alias("home")).where(F.col("n") > dense).select("bucket", "home")
        full = scratch.small(full)
        gathered, crowded = every.join(full, "bucket", "left_anti"), full.where("home").select("bucket")
    gathered = gathered.join(homes.select("bucket"), "bucket", "left_semi")
    grouped = gathered.groupBy("bucket").agg(F.collect_list(F.struct("fp", "rep")).alias("members"))
    found = grouped.where("size(members) > 1").select("members").mapInArrow(_verify(radius), "a long, b long")
    if crowded is not None and not crowded.isEmpty():
        inside = every.join(crowded, "bucket", "left_semi").select("fp", "rep").distinct()
        points = scratch.write(inside.mapInArrow(_points(radius), "point long, axis byte, rep long"), "points")
        least = points.groupBy("point", "axis").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1").select("point", "axis", "low")
        found = found.unionByName(points.join(least, ["point", "axis"]).where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct())
    return found


def classes(fps: DataFrame, scratch: Scratch, radius: int = 4, segments: int | None = None, dense: int = 16384) -> DataFrame:
    """(fp, n, root) of every distinct fp: its rows, and the fp that stands for its component."""
    reps = scratch.write(fps.groupBy("fp").agg(F.count("*").alias("n")), "representatives")
    roots = components(links(reps.select("fp", F.col("fp").alias("rep")), scratch, radius, segments, dense), scratch)
    return scratch.write(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")


def rooted(fps: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """fps with the root of each row; ``found`` as ``classes`` returns it. A fingerprint of very many rows is no one task's work."""
    return join_unique(fps, found.select("fp", "root"), "fp", found.where(F.col("n") > hot_rows(rows)))


def groups(docs: DataFrame, width: int = 4, radius: int = 4, segments: int | None = None, dense: int = 16384) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, width), "fingerprints")
    n = fps.count()
    # fingerprints are the nodes, so that one whose ids are all null still joins its neighbours
    found = classes(fps, scratch, radius, segments, dense)
    out = with_least(rooted(fps, found, n), "root", "doc_id", n)
    return scratch.settle(out.select("doc_id", "fp", F.col("m").alias("component_id")))


def leaders(docs: DataFrame, key: str, width: int = 4, radius: int = 4) -> DataFrame:
    """(key) of one row of each group: of the smallest doc_id, and of rows that share it the smallest ``key``, which no two rows share. Null ids come last."""
    scratch = Scratch(docs.sparkSession, "leaders")
    fps = scratch.write(fingerprints(docs, width, ("doc_id", key)), "fingerprints")
    found = rooted(fps, classes(fps, scratch, radius), fps.count())
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first"))
    return scratch.settle(first.select(f"first.{key}"))
