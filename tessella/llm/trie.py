"""Prefix tries of conversations: nodes, members and roll-ups, in shards of succinct level-order tries.

A node is a different sequence of first d turns; its key is a 128-bit sum of hashes of (turn, place), so keys come from
running sums that may be cut anywhere. Nodes are counted by a grouping on their keys, copies meeting in the map stage.

Prefixes of more conversations than a bound are heavy. The bound grows with the rows, so there are never more than
``share`` heavy nodes (and the root): they are the upper levels. A light node under a heavy one is the root of a unit;
units are dealt to shards by that prefix, and cut into bands of ``band`` levels. In a shard, NumPy lays units out in
level order as a LOUDS bit vector (a one for each child, a zero after each node) with label arrays beside it; parents
come from its ones and zeros, and a reversed breadth-first pass adds leaves and savings to them with ``np.add.at``.
Bands are rolled up from the deepest to the first, each handing its tops' sums to the parents above; then the upper
levels, one trie of bounded size, take the sums of all units, already added up by parent.

Defined results. A row without conv_id belongs to no conversation. Null role and text are empty. Turns are in the
order of their number, null first; equal numbers in the order of the turn's digest, so repeated rows are turns of their
own and reruns agree. A conversation may have no turn, or any number. An empty table has no node, not even a root.
Only conv_id, turn, role and text are read.

What moves: digests, never texts. A conversation, a turn or a prefix may hold any share of the rows: equal rows are
counted first, orders come from range-partitioned sorts, running sums are taken in blocks of 4,096 rows and over the
blocks' sums, joins take hot conversations apart. A node's SHA-256 of its members has to read them in order; they
reach the task that does it joined into texts of 256 members. A conversation of more than ``band`` turns costs a
round for each band.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, held, hot_rows, join_unique

#: Rows of a block of running sums, and members of a text that is hashed, as powers of two.
BLOCK, TEXT = 12, 8
LIMB = 0xFFFFFFFF
ROLLED = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, top boolean"


@dataclass(frozen=True)
class TrieParams:
    #: A prefix is heavy beyond this many conversations, or a ``share``-th of all turns, whichever is more.
    heavy: int = 64
    share: int = 1 << 16
    #: Levels of a unit's trie, and nodes from which a shard's trie is closed.
    band: int = 4096
    shard: int = 1 << 17


def running(df: DataFrame, key: str, block: Column, order: str, **values: Column) -> DataFrame:
    """df with running sums of ``values`` over each key in order, the row itself included. A block holds few rows and rises with the order."""
    df = df.withColumns({"_block": block} | {f"_{n}": v for n, v in values.items()})
    sums = df.groupBy(key, "_block").agg(*[F.sum(f"_{n}").alias(n) for n in values])
    over = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(key, "_block", *[F.coalesce(F.sum(n).over(over), F.lit(0)).alias(f"_before_{n}") for n in values])
    inside = W.partitionBy(key, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({n: F.sum(f"_{n}").over(inside) for n in values}).join(before, [key, "_block"])
    return df.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in values}).drop("_block", *[x for n in values for x in (f"_{n}", f"_before_{n}")])


def ordered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, at (0, 1, ...), label, chars of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    label = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = held(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", label.alias("label"), F.length(text).cast("long").alias("chars"))
    turns = turns.groupBy("conv_id", "turn", "label", "chars").agg(F.count("*").alias("copies"))
    turns = scratch.write(turns.sort("conv_id", F.col("turn").asc_nulls_first(), "label").withColumn("row", F.monotonically_increasing_id()), "turns")
    turns = running(turns, "conv_id", F.shiftright("row", BLOCK), "row", to=F.col("copies"))
    return turns.select("conv_id", F.explode(F.sequence(F.col("to") - F.col("copies"), F.col("to") - 1)).alias("at"), "label", "chars")


def keyed(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent's key, chars and last (the conversation ends here) of every turn (conv_id, at, label, chars, length)."""
    h = [F.xxhash64(F.lit(salt), "label", "at") for salt in (1, 2)]
    limbs = {f"s{i}{half}": v for i, x in enumerate(h, 1) for half, v in (("a", F.shiftrightunsigned(x, 32)), ("b", x.bitwiseAND(LIMB)))}
    rows = running(turns.withColumns({f"h{n}": v for n, v in limbs.items()}), "conv_id", F.shiftright("at", BLOCK), "at", **{n: F.col(f"h{n}") for n in limbs})

    def packed(i: int, less: bool) -> Column:
        a, b = (F.col(f"s{i}{half}") - (F.col(f"hs{i}{half}") if less else 0) for half in "ab")
        return F.shiftleft(a.bitwiseAND(LIMB), 32).bitwiseOR(b.bitwiseAND(LIMB))

    keys = [packed(i, less).alias(f"{n}{i}") for n, less in (("k", False), ("p", True)) for i in (1, 2)]
    return rows.select("conv_id", (F.col("at") + 1).alias("depth"), *keys, "chars", (F.col("at") + 1 == F.col("length")).alias("last"))


class Louds:
    """A forest in level order: ``bits`` has a one for each child of the root above all, then of every node, and a zero after each."""

    def __init__(self, depth: np.ndarray, parent: np.ndarray):
        """``parent``: place of each node's parent, -1 for tops; a parent is less deep."""
        n = len(parent)
        level = np.zeros(n, np.int64)
        by_depth = np.argsort(depth, kind="stable")
        for at in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
            level[at] = np.where(parent[at] < 0, 0, level[parent[at]] + 1)
        by_level = np.argsort(level, kind="stable")
        self.starts = np.append(np.searchsorted(level[by_level], np.arange(level.max(initial=-1) + 1)), n)
        rank, self.order = np.full(n + 1, -1, np.int64), by_level
        for lo, hi in zip(self.starts, self.starts[1:], strict=False):
            at = by_level[lo:hi]
            self.order[lo:hi] = at = at[np.argsort(rank[parent[at]], kind="stable")]
            rank[at] = np.arange(lo, hi)
        degrees = np.bincount(rank[parent] + 1, minlength=n + 1)
        bits = np.ones(2 * n + 1, bool)
        bits[np.cumsum(degrees + 1) - 1] = False
        self.n, self.bits = n, np.packbits(bits)

    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=2 * self.n + 1)

    def parents(self) -> np.ndarray:
        """Of every node in level order, the parent's number there; -1 for tops: zeros before its one, less the root's."""
        return np.flatnonzero(self._bits()) - np.arange(self.n) - 1

    def degrees(self) -> np.ndarray:
        """Children of every node in level order."""
        return np.diff(np.flatnonzero(self._bits() == 0)) - 1

    def add_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, for values in level order."""
        out, parent = values.copy(), self.parents()
        for k in range(len(self.starts) - 2, 0, -1):
            at = slice(self.starts[k], self.starts[k + 1])
            np.add.at(out, parent[at], out[at])
        return out


def parents_of(k1: np.ndarray, k2: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Place of each node's parent among the nodes, or -1."""
    n = len(k1)
    a, b = np.concatenate((k1, p1)), np.concatenate((k2, p2))
    order = np.lexsort((b, a))
    code = np.empty(2 * n, np.int64)
    code[order] = np.append(0, np.cumsum((np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
    place = np.full(2 * n, -1, np.int64)
    place[code[:n]] = np.arange(n)
    return place[code[n:]]


def rolled(t: dict[str, np.ndarray]) -> pa.RecordBatch:
    """ROLLED of whole units. ``t``: their nodes' columns, with children, leaves and saved of what hangs below them elsewhere."""
    trie = Louds(t["depth"], parents_of(t["k1"], t["k2"], t["p1"], t["p2"]))
    t = {c: v[trie.order] for c, v in t.items()}
    parent, children = trie.parents(), trie.degrees() + t["children"]
    leaves = trie.add_up(t["leaves"] + (children == 0))
    saved = trie.add_up(t["saved"] + (t["n_convs"] - 1) * t["chars"])
    top = parent < 0
    above = pa.array(t["conv_id"][parent], mask=top)
    out = [t[c] for c in ("depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs")] + [above, children, leaves, saved, top]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], [f.split()[0] for f in ROLLED.split(", ")])


NODE = ("u1", "u2", "depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "chars", "children", "leaves", "saved")


def roll(nodes: DataFrame, shard: int) -> DataFrame:
    """ROLLED of nodes (NODE) whose units (u1, u2) come together, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def close(parts: list) -> pa.RecordBatch:
            return rolled({c: np.concatenate([p[c] for p in parts]) for c in NODE})

        for b in batches:
            cols = {c: b.column(c).to_numpy() for c in NODE}
            if size + b.num_rows >= shard:
                # the last unit may go on in the next batch
                ends = np.flatnonzero((np.diff(cols["u1"]) != 0) | (np.diff(cols["u2"]) != 0)) + 1
                if parts and b.num_rows and any(parts[-1][u][-1] != cols[u][0] for u in ("u1", "u2")):
                    ends = np.append(0, ends)
                if len(ends):
                    head = {c: v[: ends[-1]] for c, v in cols.items()}
                    yield close([*parts, head])
                    parts, size, cols = [], 0, {c: v[ends[-1] :] for c, v in cols.items()}
            parts.append(cols)
            size += len(cols["k1"])
        if size:
            yield close(parts)

    return nodes.select(*NODE).mapInArrow(run, ROLLED)


def digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """k1, k2, ends_sha256 of every node (k1, k2) at which conversations (conv_id) end."""
    rows = scratch.write(ends.sort("k1", "k2", "conv_id").withColumn("row", F.monotonically_increasing_id()), "ends")
    texts = rows.groupBy("k1", "k2", F.shiftright("row", TEXT).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            done = []
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) == now:
                    sha.update(b",")
                else:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (k1, k2), hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["k1", "k2", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], ["k1", "k2", "ends_sha256"])

    return texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _below(tops: list[DataFrame]) -> DataFrame:
    """children, leaves and saved of tops, by parent (k1, k2)."""
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def _with_below(nodes: DataFrame, tops: list[DataFrame]) -> DataFrame:
    if not tops:
        return nodes.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
    return nodes.join(_below(tops), ["k1", "k2"], "left").fillna(0, ["children", "leaves", "saved"])


def trie(convs: DataFrame, turns: DataFrame, scratch: Scratch, p: TrieParams = TrieParams()) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``convs``: conv_id (each once) and length; ``turns``: conv_id, at, label, chars, length.
    """
    convs = scratch.write(convs.select("conv_id", "length"), "convs")
    rows = scratch.write(keyed(turns), "rows")
    size = rows.agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).first()
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "conv_id", "n_convs", zero.alias("chars"))
    nodes = scratch.write(rows.groupBy("depth", "k1", "k2", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")), "nodes")
    # members of heavy nodes add up to at most all turns, so there are no more than ``share`` of them
    bound = max(p.heavy, size["n"] // p.share)
    upper = scratch.write(nodes.where(F.col("n_convs") > bound).unionByName(root), "upper")
    heavy = F.broadcast(upper.select("k1", "k2"))
    # a conversation's unit is its first light prefix
    units = rows.join(heavy, ["k1", "k2"], "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2")).alias("u")).select("conv_id", F.col("u.k1").alias("u1"), F.col("u.k2").alias("u2"))
    light = nodes.join(heavy, ["k1", "k2"], "left_anti")
    hot = convs.where(F.col("length") > hot_rows(size["n"]))
    light = scratch.write(join_unique(light, units, "conv_id", hot).withColumn("band", F.floor((F.col("depth") - 1) / p.band)), "light")
    done, tops = [], []
    deepest = size["deepest"] or 0
    for band in reversed(range(-(-deepest // p.band))):
        here = _with_below(light.where(F.col("band") == band), tops[-1:])
        done.append(scratch.write(roll(here.repartition("u1", "u2").sortWithinPartitions("u1", "u2"), p.shard), "band"))
        tops.append(done[-1].where("top"))
    above = _with_below(upper.withColumns({"u1": zero, "u2": zero}), tops)
    done.append(scratch.write(roll(above.coalesce(1), p.shard), "rolled"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # a top's parent is heavy, or the last of the band above
    known = F.broadcast(upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("a")))
    out = out.join(known, ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "a")).drop("a")
    if deepest > p.band:
        last = light.where(F.col("depth") % p.band == 0).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("a"))
        out = out.join(last, ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "a")).drop("a")
    ends = rows.where("last").select("k1", "k2", "conv_id").unionByName(convs.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    out = out.join(digests(ends, scratch), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return scratch.settle(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie")
