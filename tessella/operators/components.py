"""Connected components, and joins with a unique side in which no key is one task's work.

A key is hot where it holds over a thousandth of the rows: there are fewer than a thousand such keys, whatever the
data, so their rows of the unique side are broadcast, and the many rows of a hot key stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

HOT_SHARE = 1000
#: Edges that a task contracts at a time, and edges that a task is given where few are left.
CHUNK = 1 << 20
LOT = 1 << 18


def hot_rows(rows: int) -> int:
    """A key of more rows than this is hot."""
    return max(1000, rows // HOT_SHARE)


def with_least(df: DataFrame, key: str, value: str, rows: int) -> DataFrame:
    """df with ``m``, the least value of each row's key. ``rows``: how many df has."""
    low = df.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("_n"))
    hot = F.broadcast(low.where(F.col("_n") > hot_rows(rows)).drop("_n"))  # fewer than a thousand keys
    rest = df.join(hot.drop("m"), key, "left_anti")
    return df.join(hot, key).unionByName(rest.join(low.drop("_n"), key))


def join_unique(df: DataFrame, unique: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join with a side that has each key once. ``hot``: df's hot keys (fewer than a thousand rows)."""
    hot = F.broadcast(hot.select(key))
    few = F.broadcast(unique.join(hot, key, "left_semi"))
    return df.join(few, key).unionByName(df.join(hot, key, "left_anti").join(unique, key))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) of every node that isn't the smallest of its component among these edges."""
    ids, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    top = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(top[x], top[y]), np.maximum(top[x], top[y])
        apart = lo != hi
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(top, hi[apart], lo[apart])
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up
    low = top != np.arange(len(ids))
    return ids[top[low]], ids[low]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        a, b = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= CHUNK:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _settled(stars: DataFrame) -> bool:
    """No node has two roots, and no root has one of its own."""
    ends = stars.select(F.col("a").alias("u"), F.lit(0).alias("down")).unionByName(stars.select(F.col("b").alias("u"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("down").alias("down"), F.min("down").alias("least")).where("down > 1 OR (down = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) edges, ids of type long: rows (node, root), root the smallest id.

    Tasks contract their own edges, a bounded number at a time, and again in fewer tasks of a bounded number of edges
    each; what is left alternates large-star and small-star
    contraction, each a pre-aggregated minimum, and every round is written to the shared folder and the one before
    it deleted. The number of rounds grows with the logarithm of the longest path; the number of edges never grows.
    Nodes without an edge to another node have no row; null ends make no edge.
    """
    contracted = lambda e: e.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_contract, "a long, b long")
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    stars = lambda e: e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    now = scratch.write(contracted(ordered.distinct()), "edges")
    for _ in range(rounds):
        if _settled(now):
            return stars(now)
        # what fits few tasks is contracted there once more; what fits one is done
        n = now.count()
        fewer = scratch.write(contracted(now.coalesce(-(-n // LOT))), "edges")
        scratch.drop(now)
        now = fewer
        if n <= LOT:
            return stars(now)
        n = now.count()
        mirrored = now.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(now.select(F.col("a").alias("u"), F.col("b").alias("v")))
        # large star: every larger neighbour of u points to the smallest id around u
        large = with_least(mirrored, "u", "v", 2 * n).where("v > u").select(F.least("m", "u").alias("a"), F.col("v").alias("b")).distinct()
        # small star: the smaller neighbours of b, and b, point to the smallest of them
        small = with_least(large, "b", "a", n).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        after = scratch.write(contracted(small), "edges")
        scratch.drop(now)
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
