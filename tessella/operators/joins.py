"""Spatial and proximity joins as equi joins on cells with a residual predicate, components and one-to-one matching.

No join here compares all pairs: points and boxes are dealt to cells of a fixed size, so a row meets only what
lies in its neighbourhood. Results that are lists of pairs are as large as the pairs the question asks for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch
from .components import components as connected
from .components import forest, with_least


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in as many tasks as shuffles have, by their keys: by number, since small rows may be much work, and would be put together by their size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def meeting(left: DataFrame, right: DataFrame, keys: list[str], spread: int = 1) -> DataFrame:
    """Join on keys (a cell, and parts) that both sides are dealt to. Never by broadcast: Spark's estimates don't know how many rows an explode makes, and the other side of a broadcast stays in the few tasks that read a small file.

    ``spread``: where keys are few, so many tasks share one, each with a part of its left rows and all of its right ones.
    """
    if spread > 1:
        left = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(spread)).cast("int"))
        right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        return meeting(left, right, [*keys, "_part"]).drop("_part")
    return dealt(left, keys).join(dealt(right, keys).hint("merge"), keys)


def within_distance(df: DataFrame, key: str, x: str, reach: float, parts: list[str] | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of keys whose x differ by less than ``reach`` (and that agree in ``parts``): one-dimensional cells of width ``reach``."""
    parts = parts or []
    d = df.select(key, x, *parts, F.floor(F.col(x) / reach).alias("cell"))
    left = d.select(*parts, F.col(key).alias("a"), F.col(x).alias("xa"), "cell")
    right = d.select(*parts, F.col(key).alias("b"), F.col(x).alias("xb"), F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)).alias("cell"))
    return meeting(left, right, [*parts, "cell"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("xa") - F.col("xb")) < reach)).select("a", "b")


def links(df: DataFrame, key: str, x: str, reach: float) -> DataFrame:
    """Pairs (a, b) of keys with the components of ``within_distance``, but at most two for each row, however crowded: neighbours on the line hang together if any two that they lie between do."""
    d = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(F.col(key).alias("a"), F.col(x).alias("xa"), F.floor(F.col(x) / reach).alias("cell"))
    w = W.partitionBy("cell").orderBy("xa", "a")
    inside = d.select("a", "xa", F.lead("a").over(w).alias("b"), F.lead("xa").over(w).alias("xb"))
    ends = d.groupBy("cell").agg(F.min(F.struct("xa", "a")).alias("lo"), F.max(F.struct("xa", "a")).alias("hi"))
    across = ends.select("cell", F.col("hi.a").alias("a"), F.col("hi.xa").alias("xa")).join(ends.select((F.col("cell") - 1).alias("cell"), F.col("lo.a").alias("b"), F.col("lo.xa").alias("xb")), "cell").drop("cell")
    return inside.unionByName(across.select(*inside.columns)).where((F.abs(F.col("xa") - F.col("xb")) < reach) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for every node, root the smallest id of its component."""
    scratch = Scratch(nodes.sparkSession, "components")
    roots = connected(edges, scratch)
    every = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", F.col("node").cast("long")).alias("root"))
    return scratch.settle(every)


def large_components(members: DataFrame, least: float) -> DataFrame:
    """Members (node, root, area) of components whose areas add up to at least ``least``."""
    keep = members.groupBy("root").agg(F.sum("area").alias("total")).where(F.col("total") >= least)
    return members.join(keep, "root")


def nearest_on_line(left: DataFrame, right: DataFrame, key: str, other: str, xl: str, xr: str, reach: float, parts: list[str]) -> DataFrame:
    """(key, best) of the keys that have a right row within ``reach``: best is (d, o), the least distance and its smallest id.

    A row reads its neighbours on either side, in the order of the line, inside a cell that also has the last right row
    of the cell before and the first of the one after; so crowds cost their rows, not their pairs.
    """
    n = right.where(F.col(xr).isNotNull() & ~F.isnan(F.col(xr).cast("double"))).groupBy(*parts, F.col(xr).alias("_x")).agg(F.min(F.struct(F.col(other).alias("o"))).alias("_o"))
    n = n.select(*parts, "_x", F.col("_o.o").alias("_o"), F.floor(F.col("_x") / reach).alias("cell"))
    ends = n.groupBy(*parts, "cell").agg(F.min(F.struct("_x", "_o")).alias("lo"), F.max(F.struct("_x", "_o")).alias("hi"))
    beside = ends.select(*parts, F.explode(F.array(F.struct((F.col("cell") + 1).alias("cell"), F.col("hi").alias("r")), F.struct((F.col("cell") - 1).alias("cell"), F.col("lo").alias("r")))).alias("e"))
    rows = n.unionByName(beside.select(*parts, F.col("e.r._x").alias("_x"), F.col("e.r._o").alias("_o"), F.col("e.cell").alias("cell")))
    rows = rows.select(*parts, "cell", "_x", F.struct("_x", "_o").alias("_r"), F.lit(None).cast(left.schema[key].dataType).alias("_key"), F.lit(False).alias("_left"))
    mine = left.where(F.col(xl).isNotNull() & F.col(key).isNotNull()).select(*parts, F.floor(F.col(xl) / reach).alias("cell"), F.col(xl).alias("_x"), F.lit(None).cast(rows.schema["_r"].dataType).alias("_r"), F.col(key).alias("_key"), F.lit(True).alias("_left"))
    w = W.partitionBy(*parts, "cell")
    # right rows come before left ones at the same place, in both directions
    below = F.last("_r", True).over(w.orderBy("_x", "_left").rowsBetween(W.unboundedPreceding, 0)).alias("_below")
    above = F.last("_r", True).over(w.orderBy(F.desc("_x"), "_left").rowsBetween(W.unboundedPreceding, 0)).alias("_above")
    found = rows.unionByName(mine).select("*", below).select("*", above).where("_left").select("_key", "_x", F.explode(F.array("_below", "_above")).alias("_r"))
    d = F.abs(F.col("_x") - F.col("_r._x"))
    return found.where(d <= reach).groupBy(F.col("_key").alias(key)).agg(F.min(F.struct(d.alias("d"), F.col("_r._o").alias("o"))).alias("best"))


def nearest(left: DataFrame, right: DataFrame, key: str, other: str, xl: str, xr: str, reach: float, parts: list[str]) -> DataFrame:
    """Every left row with its nearest right row no farther than ``reach``; ties by the smallest id; empty string where there is none.

    ``other`` is the right side's id, a string.
    """
    best = nearest_on_line(left, right, key, other, xl, xr, reach, parts)
    return left.select(key).join(best, key, "left").select(key, F.coalesce("best.o", F.lit("")).alias("nearest"), F.col("best.d").alias("distance"))


def cells(x0: str, y0: str, x1: str, y1: str, cx: float, cy: float) -> Column:
    """Array of the (cx, cy) cells that a box covers."""
    side = lambda lo, hi, c: F.sequence(F.floor(F.col(lo) / c), F.floor(F.col(hi) / c))
    return F.flatten(F.transform(side(x0, x1, cx), lambda i: F.transform(side(y0, y1, cy), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def overlaps(left: DataFrame, right: DataFrame, parts: list[str], cx: float, cy: float) -> DataFrame:
    """Pairs of boxes that share area: a, b, and the overlap. Columns id, x0, y0, x1, y1 on both sides, plus ``parts`` to agree on.

    Each pair is reported from one cell only, that of the overlap's lower corner.
    """
    l = left.select(*parts, F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")]).withColumn("cell", F.explode(cells("a_x0", "a_y0", "a_x1", "a_y1", cx, cy)))
    r = right.select(*parts, F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]).withColumn("cell", F.explode(cells("b_x0", "b_y0", "b_x1", "b_y1", cx, cy)))
    lo = {c: F.greatest(f"a_{c}", f"b_{c}") for c in ("x0", "y0")}
    hi = {c: F.least(f"a_{c}", f"b_{c}") for c in ("x1", "y1")}
    j = meeting(l, r, [*parts, "cell"]).where((hi["x1"] > lo["x0"]) & (hi["y1"] > lo["y0"]))
    j = j.where((F.floor(lo["x0"] / cx) == F.col("cell.i")) & (F.floor(lo["y0"] / cy) == F.col("cell.j")))
    area = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    return j.select(*parts, "a", "b", ((hi["x1"] - lo["x0"]) * (hi["y1"] - lo["y0"])).alias("overlap"), area("a").alias("area_a"), area("b").alias("area_b"))


def touching(boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs (a, b), a < b, of boxes (id, x0, y0, x1, y1) that share a point; each is found in the cell of the meeting's lower corner."""
    b = boxes.select("id", "x0", "y0", "x1", "y1", F.explode(cells("x0", "y0", "x1", "y1", cell, cell)).alias("cell"))
    other = b.select(F.col("id").alias("b"), *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")], "cell")
    j = meeting(b, other, ["cell"]).where("id < b AND x0 <= ox1 AND ox0 <= x1 AND y0 <= oy1 AND oy0 <= y1")
    low = (F.floor(F.greatest("x0", "ox0") / cell) == F.col("cell.i")) & (F.floor(F.greatest("y0", "oy0") / cell) == F.col("cell.j"))
    return j.where(low).select(F.col("id").alias("a"), "b")


def _swept(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of boxes that hang together wherever boxes share a point, a few for each box: a sweep along x that keeps, for every y at which a side lies, how far the boxes there reach and the last of them."""
    # boxes that are the same are swept once
    order = np.lexsort((y1, x1, y0, x0))
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in (x0, y0, x1, y1)], axis=0)
    first = order[new][np.cumsum(new) - 1]
    a, b = first[~new].tolist(), order[~new].tolist()
    ys = np.unique(np.concatenate((y0, y1)))
    far, last = np.full(len(ys), -np.inf), np.zeros(len(ys), np.int64)
    kept = order[new]
    for n, lo, hi, left, right in zip(*[c.tolist() for c in (kept, np.searchsorted(ys, y0[kept]), np.searchsorted(ys, y1[kept]) + 1, x0[kept], x1[kept])], strict=True):
        reach, names = far[lo:hi], last[lo:hi]
        met = names[reach >= left]
        if met.size:
            one = met[0]
            a.append(one)
            others = met[met != one]
            if others.size:
                a += np.unique(others).tolist()
            b += [n] * (len(a) - len(b))
        # boxes there that reach on hold this point, so they hang together with it
        names[:] = n
        np.maximum(reach, right, out=reach)
    return np.array(a, np.int64), np.array(b, np.int64)


def meetings(boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs (a, b) of boxes (id, x0, y0, x1, y1) with the components of ``touching``, but at most one for each box and cell, however crowded: each cell is swept, and one is in memory at a time."""
    b = boxes.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    dealt = b.withColumn("cell", F.explode(cells("x0", "y0", "x1", "y1", cell, cell)))
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: small rows are much work here, and would be put together by their size
    dealt = dealt.select("cell.i", "cell.j", "id", "x0", "y0", "x1", "y1").repartition(tasks, "i", "j").sortWithinPartitions("i", "j")

    def pairs(table: pa.Table) -> pa.RecordBatch:
        v = [table[c].to_numpy() for c in ("i", "j", "id", "x0", "y0", "x1", "y1")]
        ends = np.flatnonzero((np.diff(v[0]) != 0) | (np.diff(v[1]) != 0)) + 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip([0, *ends], [*ends, len(v[0])], strict=True):
            if hi - lo > 1:
                p, q = _swept(*[c[lo:hi] for c in v[3:]])
                a.append(v[2][lo:hi][p])
                b.append(v[2][lo:hi][q])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in forest(np.concatenate(a), np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j = batch["i"].to_numpy(), batch["j"].to_numpy()
            # the last cell of a batch may go on in the next one
            cut = int(np.argmax((i == i[-1]) & (j == j[-1])))
            if held and (cut or (i[0], j[0]) != last):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield pairs(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
            last = (i[-1], j[-1])
        if held:
            yield pairs(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long")


def max_overlap(left: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """Left ids with the partner of the largest overlap (ties: the larger id), accepted at ``share`` of the smaller area."""
    best = pairs.groupBy("a").agg(F.max(F.struct("overlap", "b", "area_a", "area_b")).alias("m"))
    ok = F.col("m.overlap") >= share * F.least("m.area_a", "m.area_b")
    return left.select(F.col("id").alias("a")).join(best, "a", "left").select("a", F.when(ok, F.col("m.b")).alias("b"), F.when(ok, F.col("m.overlap")).alias("overlap"))


def max_overlap_of(left: DataFrame, right: DataFrame, parts: list[str], cx: float, cy: float, share: float) -> DataFrame:
    """``max_overlap`` of two sides of boxes (id, x0, y0, x1, y1). Boxes at the same place meet once: a left one for all of them, the right one with the largest id."""
    place = [*parts, "x0", "y0", "x1", "y1"]
    named = left.select("id", *place).join(left.groupBy(*place).agg(F.min("id").alias("first")).hint("merge"), place)
    firsts = left.groupBy(*place).agg(F.min("id").alias("id"))
    lasts = right.groupBy(*place).agg(F.max("id").alias("id"))
    best = max_overlap(firsts, overlaps(firsts, lasts, parts, cx, cy), share)
    # boxes without a place or a part stay, without a partner
    met = named.join(best.select(F.col("a").alias("first"), "b", "overlap").hint("merge"), "first").select(F.col("id").alias("a"), "b", "overlap").distinct()
    return left.select(F.col("id").alias("a")).join(met, "a", "left").select("a", "b", "overlap")


def _lots(rows: DataFrame, edges: DataFrame, scratch: Scratch, large: int, mean: int = 8192) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (with ``node``) of components of two or more nodes, with their ``root``: in lots of whole components, about ``mean`` rows; those of components of more than ``large`` rows; and the rows whose node stands alone."""
    roots = scratch.write(connected(edges, scratch), "roots")
    met = scratch.write(rows.join(roots, "node"), "met")
    sizes = met.groupBy("root").agg(F.count("*").alias("n"))
    crowds = F.broadcast(scratch.write(sizes.where(F.col("n") > large).select("root"), "crowds"))  # fewer than rows / large
    lots = max(1, met.count() // mean)
    small = met.join(crowds, "root", "left_anti").withColumn("lot", F.pmod(F.xxhash64("root"), F.lit(lots)))
    return small, met.join(crowds, "root"), rows.join(roots.select("node"), "node", "left_anti")


def greedy_match(scored: DataFrame, large: int = 200_000) -> DataFrame:
    """One-to-one matching of (part, i, j, score): by score, i, j descending, both sides unused; each part on its own.

    Pairs are matched inside the connected components of the pairs that share a side, since others can't compete; a
    component is a neighbourhood of objects that overlap each other, and a task takes many. Components of more than
    ``large`` pairs are matched in rounds: a pair that is the best of both its sides is matched, and what shares a side
    with it goes. A hash names the nodes: equal hashes would only join two components.
    """
    scratch = Scratch(scored.sparkSession, "matching")
    s = scratch.write(scored.select("part", "i", "j", F.col("score").cast("double").alias("score"), F.xxhash64("part", F.lit(0), "i").alias("node"), F.xxhash64("part", F.lit(1), "j").alias("other")), "pairs")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "i", "j"], ascending=False)
        used, keep = set(), []
        for n, (a, b) in enumerate(zip(pdf["node"], pdf["other"], strict=True)):
            if a not in used and b not in used:
                used.update((a, b))
                keep.append(n)
        return pdf.iloc[keep][["part", "i", "j", "score"]]

    kinds = dict(scored.dtypes)
    found, crowded, _ = _lots(s, s.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch, large)
    out = found.groupBy("lot").applyInPandas(match, f"part {kinds['part']}, i {kinds['i']}, j {kinds['j']}, score double")
    left = scratch.write(crowded.select(*s.columns).distinct(), "left")
    while not left.isEmpty():
        top = F.max(F.struct("score", "i", "j")).alias("top")
        best = left
        for side in ("part", "i"), ("part", "j"):
            best = best.join(left.groupBy(*side).agg(top), list(side)).where((F.col("i") == F.col("top.i")) & (F.col("j") == F.col("top.j"))).drop("top")
        best = scratch.write(best.select(*s.columns), "matched")
        out = out.unionByName(best.select("part", "i", "j", "score"))
        left = scratch.write(left.join(best.select("part", "i"), ["part", "i"], "left_anti").join(best.select("part", "j"), ["part", "j"], "left_anti"), "left")
    return scratch.settle(out)


def _matched_places(pairs: DataFrame, members: DataFrame, scratch: Scratch, large: int, mean: int = 8192) -> DataFrame:
    """(part, i, j, score, a, b): greedy matching of the members (node, id) of places, by score, i, j descending, where ``pairs`` (part, a, b, score) says which places may be matched.

    Connected components of pairs are decided in lots. While one has more than ``large`` pairs, the upper half of the
    scores goes first, and the rest follows among what is left; but pairs of one score stay together.
    """
    kinds = dict(pairs.dtypes) | {"id": dict(members.dtypes)["id"]}

    def match(p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("id", ignore_index=True)  # a member's number in this order stands for its id
        left = {node: list(at) for node, at in m.groupby("node").indices.items()}
        rows: list[tuple] = []
        for score, tied in p.sort_values("score", ascending=False).groupby("score", sort=False):
            near: dict[int, list[int]] = {}
            for a, b in zip(tied["a"], tied["b"], strict=True):
                near.setdefault(a, []).append(b)
            part = dict(zip(tied["a"], tied["part"], strict=True))
            heap = [(-left[a][-1], a) for a in near if left[a]]
            heapq.heapify(heap)
            while heap:
                _, a = heapq.heappop(heap)
                near[a] = [b for b in near[a] if left[b]]
                if near[a]:
                    b = max(near[a], key=lambda b: left[b][-1])
                    rows.append((part[a], left[a].pop(), left[b].pop(), score, a, b))
                    if left[a]:
                        heapq.heappush(heap, (-left[a][-1], a))
        out = pd.DataFrame(rows, columns=["part", "i", "j", "score", "a", "b"])
        ids = m["id"]
        return out.assign(i=ids.take(out["i"].astype(int)).to_numpy(), j=ids.take(out["j"].astype(int)).to_numpy())

    out = None
    while True:
        top, low = pairs, None
        while True:
            roots = scratch.write(connected(top.select("a", "b"), scratch), "roots")
            lots = top.join(roots.withColumnRenamed("node", "a"), "a")
            if (lots.groupBy("root").count().agg(F.max("count")).first()[0] or 0) <= large:
                break
            least, middle, best = top.agg(F.min("score"), F.percentile_approx("score", 0.5), F.max("score")).first()
            if least == best:
                break
            low = middle if middle > least else best
            top = scratch.write(top.where(F.col("score") >= low), "top")
        mine = scratch.write(members.join(roots, "node"), "members")
        lot = F.pmod(F.xxhash64("root"), F.lit(max(1, max(top.count(), mine.count()) // mean))).alias("lot")
        schema = f"part {kinds['part']}, i {kinds['id']}, j {kinds['id']}, score double, a long, b long"
        got = lots.select(*pairs.columns, lot).groupBy("lot").cogroup(mine.select("node", "id", lot).groupBy("lot")).applyInPandas(match, schema)
        got = scratch.write(got, "matched")
        out = got if out is None else out.unionByName(got)
        if low is None:
            return out
        members = scratch.write(members.join(_used(got), ["node", "id"], "left_anti"), "members")
        open_ = scratch.write(members.select("node").distinct(), "open")
        rest = pairs.where(F.col("score") < low)
        for side in "a", "b":
            rest = rest.join(open_.withColumnRenamed("node", side), side, "left_semi")
        pairs = scratch.write(rest.select(*pairs.columns), "pairs")
        if pairs.isEmpty():
            return out


def _used(matched: DataFrame) -> DataFrame:
    return matched.select(F.col("a").alias("node"), F.col("i").alias("id")).unionByName(matched.select(F.col("b").alias("node"), F.col("j").alias("id")))


def greedy_match_boxes(left: DataFrame, right: DataFrame, part: str, cx: float, cy: float, least: float, digits: int = 6, large: int = 200_000, most: int = 1 << 20) -> DataFrame:
    """``greedy_match`` (part, i, j, score) of boxes (id, part, x0, y0, x1, y1) by their share of overlap in union, rounded, where it is at least ``least``; but not by way of all pairs.

    Boxes at the same place are one place with several members, and places meet once. Places are paired from the top
    score down, as far as there are at most ``most`` pairs or two for each place; what is matched is gone before the next
    lower scores are paired, so a crowd's pairs are counted but not kept.
    """
    scratch = Scratch(left.sparkSession, "matching")
    place = ["x0", "y0", "x1", "y1"]
    sides = [df.select(F.col(part).alias("part"), F.lit(k).alias("side"), "id", *place) for k, df in enumerate((left, right))]

    def scored(rows: DataFrame, name: str) -> DataFrame:
        l, r = (rows.where(F.col("side") == k).select("part", F.col(name).alias("id"), *place) for k in (0, 1))
        p = overlaps(l, r, ["part"], cx, cy)
        # tried: the filter may run before the join's own condition, on boxes that don't meet
        iou = F.try_divide(F.col("overlap"), F.col("area_a") + F.col("area_b") - F.col("overlap"))
        return p.where(iou >= least).select("part", "a", "b", F.round(iou, digits).alias("score"))

    boxes = scratch.write(sides[0].unionByName(sides[1]).where("part IS NOT NULL").distinct(), "boxes")
    if not boxes.groupBy("part", "side", "id").count().where("count > 1").isEmpty():
        # an id with several places is used at all of them at once
        return greedy_match(scored(boxes, "id").select("part", F.col("a").alias("i"), F.col("b").alias("j"), "score"), large)
    out = boxes.limit(0).select("part", F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("score"))
    while True:
        places = scratch.write(boxes.select("part", "side", *place).distinct().withColumn("node", F.monotonically_increasing_id()), "places")
        pairs = scored(places, "node").withColumn("_level", F.floor(F.col("score") * 1000))
        levels = sorted((tuple(r) for r in pairs.groupBy("_level").count().collect()), reverse=True)  # at most 1,001
        if not levels:
            break
        bound = max(most, 2 * places.count())
        total = np.cumsum([n for _, n in levels])
        last = max(0, int(np.searchsorted(total, bound, "right")) - 1)
        kept = scratch.write(pairs.where(F.col("_level") >= levels[last][0]).drop("_level"), "pairs")
        members = scratch.write(boxes.join(places, ["part", "side", *place]), "members")
        got = _matched_places(kept, members.select("node", "id"), scratch, large)
        out = out.unionByName(got.select("part", "i", "j", "score"))
        if last == len(levels) - 1:
            break
        boxes = scratch.write(members.join(_used(got), ["node", "id"], "left_anti").select(*boxes.columns), "boxes")
    return scratch.settle(out)


def suppressed(points: DataFrame, reach: float, large: int = 200_000) -> DataFrame:
    """Greedy suppression, best score first (ties: the smaller id): points (part, id, x, y, score) farther than ``reach`` from every better one that is kept.

    Points are dealt to cells in which all are within reach of each other. Cells that might hold points in reach of
    each other hang together; the points of such components, many in a task, are decided in order. Components of more
    than ``large`` points are decided in rounds. Points without coordinates stay, one without a score comes last.
    """
    scratch = Scratch(points.sparkSession, "suppression")
    cell = lambda c: F.floor(F.col(c) / (reach * 0.7)).cast("long")
    p = points.select(*points.columns, cell("x").alias("_i"), cell("y").alias("_j"), F.monotonically_increasing_id().alias("_rid"))
    p = scratch.write(p.withColumn("node", F.xxhash64("part", "_i", "_j")), "points")
    placed = p.where("x IS NOT NULL AND y IS NOT NULL")
    cells = scratch.write(placed.select("part", "_i", "_j", "node").distinct(), "cells")
    ahead = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    there = cells.select("part", F.col("node").alias("b"), *[F.explode(F.array(*[F.struct((F.col("_i") - i).alias("_i"), (F.col("_j") - j).alias("_j")) for i, j in ahead])).alias("c")]).select("part", "b", "c._i", "c._j")
    found, crowded, alone = _lots(placed, cells.join(there, ["part", "_i", "_j"]).select(F.col("node").alias("a"), "b"), scratch, large)
    names = points.columns

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root", "score", "id", "_rid"], ascending=[True, False, True, True])
        ends = np.flatnonzero(np.diff(pdf["root"].to_numpy(), append=np.int64(0)) != 0) + 1
        x, y, rows, lo = pdf["x"].to_numpy(), pdf["y"].to_numpy(), [], 0
        for hi in [*ends[ends < len(pdf)], len(pdf)]:
            free = np.ones(hi - lo, bool)
            for n in range(lo, hi):
                if free[n - lo]:
                    rows.append(n)
                    free &= (x[lo:hi] - x[n]) ** 2 + (y[lo:hi] - y[n]) ** 2 > reach * reach
            lo = hi
        return pdf.iloc[rows][names]

    # a lone cell keeps its best; points of components are decided together
    best = F.row_number().over(W.partitionBy("part", "_i", "_j").orderBy(F.col("score").desc_nulls_last(), "id", "_rid"))
    out = found.groupBy("lot").applyInPandas(keep, points.schema).unionByName(alone.withColumn("_n", best).where("_n = 1").select(*names))
    return scratch.settle(out.unionByName(p.where("x IS NULL OR y IS NULL").select(*names)).unionByName(_by_rounds(crowded, reach, scratch).select(*names)))


def _by_rounds(points: DataFrame, reach: float, scratch: Scratch) -> DataFrame:
    """The kept ones of ``suppressed``'s points: in each round the best of a cell is kept unless a better one is left within reach, and what is within reach of the kept ones goes. A point meets one of each cell around its own, however crowded they are."""
    order = F.struct(F.coalesce(-F.col("score").cast("double"), F.lit(float("inf"))).alias("s"), "id", "_rid")
    left = scratch.write(points.drop("root").withColumn("_order", order), "left")
    kept = left.where("false")
    around = F.explode(F.array(*[F.struct((F.col("_i") + i).alias("_i"), (F.col("_j") + j).alias("_j")) for i in range(-2, 3) for j in range(-2, 3)])).alias("c")
    spread = lambda df: df.select("part", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_order").alias("_mine"), around).select("part", "c._i", "c._j", "_x", "_y", "_mine")
    near = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2) <= reach * reach
    while not left.isEmpty():
        best = left.groupBy("part", "_i", "_j").agg(F.min_by(F.struct("x", "y", "_order"), "_order").alias("b")).select("part", "_i", "_j", "b.*")
        best = scratch.write(best, "best")
        beaten = left.join(spread(best), ["part", "_i", "_j"]).where(near & (F.col("_order") < F.col("_mine"))).select("_mine._rid").distinct()
        first = scratch.write(best.join(beaten, best["_order._rid"] == beaten["_rid"], "left_anti"), "first")
        kept = kept.unionByName(left.join(first.select(F.col("_order._rid").alias("_rid")), "_rid", "left_semi").select(*left.columns))
        gone = left.join(spread(first), ["part", "_i", "_j"]).where(near).select("_rid").distinct()
        left = scratch.write(left.join(gone, "_rid", "left_anti"), "left")
    return kept


def _chains(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the segments (line, k, a, b) of whole lines, the rows of a line side by side: the piece of each row (rows of one k are one piece), a row of each piece, and the piece with the smallest k of each piece's chain."""
    line, k = t["line"].combine_chunks(), t["k"].combine_chunks()
    row = np.cumsum(np.concatenate(([0], pc.not_equal(line[1:], line[:-1]).to_numpy(zero_copy_only=False))).astype(np.int64))
    nameless, k = k.is_null().to_numpy(zero_copy_only=False), k.fill_null(0).to_numpy()
    order = np.lexsort((k, nameless, row))
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in (k, nameless, row)], axis=0)
    piece = np.empty(len(order), np.int64)
    piece[order] = np.cumsum(new) - 1
    first = order[new]
    ends = pa.chunked_array([*t["a"].chunks, *t["b"].chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    end = np.tile(row, 2) * (ends.max() + 1) + ends
    there = np.flatnonzero(ends >= 0)
    there = there[np.argsort(end[there], kind="stable")]
    starts = np.flatnonzero(np.diff(end[there], prepend=-1))
    two = starts[np.diff(starts, append=len(there)) == 2]
    p, q = piece[there[two] % len(row)], piece[there[two + 1] % len(row)]
    joined = (p != q) & ~nameless[first[p]] & ~nameless[first[q]]
    chain = np.arange(len(first))
    root, low = forest(p[joined], q[joined])
    chain[low] = root
    return piece, first, chain


def _line_roots(t: pa.Table) -> pa.Table:
    piece, first, chain = _chains(t)
    return t.append_column("root", t["k"].take(pa.array(first[chain[piece]])))


def _line_parts(t: pa.Table) -> pa.Table:
    _, first, chain = _chains(t)
    roots, pieces = np.unique(chain, return_counts=True)
    at = pa.array(first[roots])
    return pa.table({"line": t["line"].take(at), "root": t["k"].take(at), "pieces": pa.array(pieces.astype(np.int64))})


def _whole_lines(s: DataFrame, kernel, schema: str) -> DataFrame:
    """A kernel over tables of whole lines: lines are dealt to tasks, and a task holds a batch and one line at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            line = batch["line"]
            # the last line of a batch may go on in the next one
            cuts = np.flatnonzero(pc.not_equal(line[1:], line[:-1]).to_numpy(zero_copy_only=False)) + 1
            cut = int(cuts[-1]) if len(cuts) else 0
            if cut or (held and not line[0].equals(held[-1]["line"][-1])):
                yield from kernel(pa.Table.from_batches([*held, batch.slice(0, cut)])).combine_chunks().to_batches()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from kernel(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return dealt(s, ["line"]).sortWithinPartitions("line").mapInArrow(run, schema)


def _crowded_lines(s: DataFrame, scratch: Scratch, large: int) -> DataFrame | None:
    """Lines of more than ``large`` segments, if there are any. Lines are counted by buckets first, so that few counts are shuffled."""
    bucket = F.pmod(F.xxhash64("line"), F.lit(1 << 16))
    more = F.col("count") > large
    full = scratch.write(s.groupBy(bucket.alias("_bucket")).count().where(more).select("_bucket"), "full")
    if full.isEmpty():
        scratch.drop(full)
        return None
    lines = s.withColumn("_bucket", bucket).join(F.broadcast(full), "_bucket").groupBy("line").count()
    found = scratch.write(lines.where(more).select("line"), "crowded")  # fewer than rows / large
    scratch.drop(full)
    return None if found.isEmpty() else F.broadcast(found)


def _crowded_roots(s: DataFrame, scratch: Scratch) -> DataFrame:
    """``merged_lines`` of lines that are too many segments for one task."""
    s = scratch.write(s, "segments")
    name = lambda k: F.xxhash64("line", k)
    ends = s.select("line", "k", F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL")
    joints = ends.groupBy("line", "node").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).where("n = 2 AND lo < hi")
    joints = scratch.write(joints.select("line", "lo", "hi"), "joints")
    roots = connected(joints.select(name("lo").alias("a"), name("hi").alias("b")), scratch)
    # what isn't joined to another segment is its own root
    joined = joints.select("line", F.explode(F.array("lo", "hi")).alias("k")).distinct().withColumn("node", name("k"))
    met = scratch.write(joined.join(roots, "node").select("k", F.struct("line", "root").alias("chain")), "met")
    least = with_least(met, "chain", "k", met.count()).select("chain.line", "k", F.col("m").alias("root"))
    return scratch.settle(s.join(least, ["line", "k"], "left").select("line", "k", "a", "b", F.coalesce("root", "k").alias("root")))


def _merged(segments: DataFrame, large: int, kernel, columns: str, rest) -> DataFrame:
    """A kernel over the whole lines of segments, and the same from ``merged_lines``' rows for those that have no line or are crowded."""
    end = segments.select(F.array("a", "b").alias("e")).schema["e"].dataType.elementType
    s = segments.select("line", F.col("k").cast("long").alias("k"), F.col("a").cast(end).alias("a"), F.col("b").cast(end).alias("b"))
    lines = s.where("line IS NOT NULL")
    out = rest(s.where("line IS NULL").withColumn("root", F.col("k")))
    crowded = _crowded_lines(lines, Scratch(s.sparkSession, "lines"), large)
    if crowded is not None:
        out = out.unionByName(rest(_crowded_roots(lines.join(crowded, "line"), Scratch(s.sparkSession, "lines"))))
        lines = lines.join(crowded, "line", "left_anti")
    return _whole_lines(lines, kernel, f"line {s.schema['line'].dataType.simpleString()}, {columns.format(end=end.simpleString())}").unionByName(out)


def merged_lines(segments: DataFrame, large: int = 1 << 18) -> DataFrame:
    """Segments (line, k, a, b; a and b name end points) with ``root``, the smallest k of the chain that they form: ends where exactly two segments meet join them. Null ends meet nothing, nor do segments without a line.

    Chains stay inside lines, so segments are shuffled once, by their lines; lines of more than ``large`` segments are
    chained by joins.
    """
    return _merged(segments, large, _line_roots, "k long, a {end}, b {end}, root long", lambda df: df.select("line", "k", "a", "b", "root"))


def merged_parts(segments: DataFrame, large: int = 1 << 18) -> DataFrame:
    """The chains of ``merged_lines``: line, root, and ``pieces``, how many different k each has. They are counted where they are found, without another shuffle."""
    # a line's segments without a k are one piece
    return _merged(segments, large, _line_parts, "root long, pieces long", lambda df: df.groupBy("line", "root").agg(F.greatest(F.lit(1).cast("long"), F.count_distinct("k")).alias("pieces")))
