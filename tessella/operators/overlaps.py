"""Overlap removal: of plots that share ground the bigger one keeps it.

Plots are cell sets in tiles (``masks``). In order of area, a plot of which more than half is taken is a copy and goes,
of any other the taken cells go (and with ``whole`` all parts but the largest), and what is left takes its cells. Only
plots that share a cell depend on each other: along the order of the plots in a cell each waits for the one before it,
so there is one link a cell, however many plots lie there. In each round all plots that wait for nobody are decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import masks as M
from .components import components as connected


def counted(tiles: DataFrame) -> DataFrame:
    """(k, cells) of tiles."""
    return tiles.groupBy("k").agg(F.sum(_bits("bits")).alias("cells"))


def _bits(name: str):
    """Bits set in a binary column: of its hexadecimal digits, by how many have one, two, three and four."""
    h = F.hex(name)
    of = lambda digits: F.length(h) - F.length(F.translate(h, digits, ""))
    return (of("1248") + 2 * of("3569AC") + 3 * of("7BDE") + 4 * of("F")).cast("long")


def labelled(cells: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 1 of the parts whose cells share sides, and how many there are: runs of a row joined with those they touch in the row before."""
    out, top, runs = np.zeros(cells.shape, np.int64), [0], []

    def find(a: int) -> int:
        while top[a] != a:
            top[a] = a = top[top[a]]
        return a

    for i, row in enumerate(cells):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.view(np.int8), [0]))))
        now = []
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            mine = {find(n) for a, b, n in runs if a < hi and lo < b}
            n = min(mine) if mine else len(top)
            if not mine:
                top.append(n)
            for other in mine:
                top[other] = n
            out[i, lo:hi] = n
            now.append((lo, hi, n))
        runs = now
    roots = np.array([find(n) for n in range(len(top))])
    used, number = np.unique(roots[1:], return_inverse=True)
    return np.append(0, number + 1)[out], len(used)


def largest_parts(tiles: DataFrame, scratch: Scratch) -> DataFrame:
    """Tiles of each key's largest part (cells that share sides; of equal ones that of the smaller hash)."""
    side = M.SIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, ti, tj, bits in zip(*(b.column(c).to_pylist() for c in ("k", "ti", "tj", "bits")), strict=True):
                marks, n = labelled(M._unpacked(bits, side, side))
                for m in range(1, n + 1):
                    part = marks == m
                    # the places of the part on the tile's four sides: first and last row, first and last column
                    places = [np.flatnonzero(x).tolist() for x in (part[0], part[-1], part[:, 0], part[:, -1])]
                    out.append((k, ti, tj, m, M._packed(part), int(part.sum()), *places))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), *[pa.list_(pa.int64())] * 4))], names)

    names = ["k", "ti", "tj", "m", "bits", "cells", "top", "bottom", "left", "right"]
    parts = tiles.mapInArrow(run, "k string, ti long, tj long, m long, bits binary, cells long, top array<long>, bottom array<long>, left array<long>, right array<long>")
    parts = scratch.write(parts.withColumn("node", F.xxhash64("k", "ti", "tj", "m")), "parts")
    # a side between tiles belongs to the one with the larger row or column
    at = lambda kind, places, di, dj: parts.select("k", F.lit(kind).alias("kind"), (F.col("ti") + di).alias("ti"), (F.col("tj") + dj).alias("tj"), F.explode(places).alias("at"), "node")
    near = at("row", "top", 0, 0).unionByName(at("column", "left", 0, 0))
    far = at("row", "bottom", 1, 0).unionByName(at("column", "right", 0, 1)).withColumnRenamed("node", "b")
    edges = near.join(far, ["k", "kind", "ti", "tj", "at"]).select(F.col("node").alias("a"), "b").distinct()
    roots = scratch.write(connected(edges, scratch), "roots")
    named = parts.select("k", "ti", "tj", "bits", "cells", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("k", "root").agg(F.sum("cells").alias("n"))
    best = sizes.groupBy("k").agg(F.max_by("root", F.struct("n", -F.col("root").cast("decimal(20,0)"))).alias("root"))
    # parts of one tile may hang together elsewhere
    kept = named.join(best, ["k", "root"]).select("k", "ti", "tj", "bits")
    return scratch.write(M.combined([kept]), "largest")


def without_overlaps(tiles: DataFrame, fields: DataFrame, least: int, scratch: Scratch, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Plots' tiles after overlap removal, and (k, cells, covered, left, kept) of every plot. ``fields``: (k, field); plots of different fields don't meet.

    A plot that is left with fewer than ``least`` cells goes, too, and takes none. Plots are ordered by cells, then k.
    """
    t = scratch.write(tiles.join(fields, "k").select("field", "k", "ti", "tj", "bits"), "tiles")
    plots = scratch.write(counted(t).join(fields, "k").select("k", "field", "cells"), "plots")
    size = t.join(plots.select("k", "cells"), "k")
    place = M.cells(size.select(F.to_json(F.struct("field", F.lpad((F.lit(1 << 40) - F.col("cells")).cast("string"), 14, "0").alias("o"), "k")).alias("k"), "ti", "tj", "bits"))
    place = place.withColumn("p", F.from_json("k", f"field {dict(fields.dtypes)['field']}, o string, k string"))
    before = F.lag("p.k").over(W.partitionBy("p.field", "i", "j").orderBy("p.o", "p.k"))
    waits = scratch.write(place.select(F.col("p.k").alias("k"), before.alias("on")).where("on IS NOT NULL").distinct(), "waits")
    open_, taken, verdicts, kept = plots, None, None, None
    while not open_.isEmpty():
        held = waits.join(open_.select(F.col("k").alias("on")), "on").select("k").distinct()
        ready = scratch.write(open_.join(held, "k", "left_anti"), "ready")
        mine = t.join(ready.select("k"), "k")
        if taken is None:
            left = scratch.write(mine, "left")
        else:
            both = mine.join(taken.select(F.col("k").alias("field"), "ti", "tj", F.col("bits").alias("gone")), ["field", "ti", "tj"], "left")
            left = scratch.write(_less(both, dict(fields.dtypes)["field"]), "left")
        n = counted(left).withColumnRenamed("cells", "rest")
        seen = ready.join(n, "k", "left").withColumn("covered", F.col("cells") - F.coalesce("rest", F.lit(0).cast("long"))).where("2 * covered <= cells")
        rest = scratch.write(left.join(seen.select("k", "covered"), "k"), "rest")
        if whole:
            cut = rest.where("covered > 0").select("k", "ti", "tj", "bits")
            rest = scratch.write(rest.where("covered = 0").select("k", "ti", "tj", "bits").unionByName(largest_parts(cut, scratch)), "rest")
        final = scratch.write(counted(rest).where(F.col("cells") >= least).withColumnRenamed("cells", "left"), "final")
        mine = rest.join(final.select("k"), "k").select("k", "ti", "tj", "bits")
        covered = ready.join(n, "k", "left").select("k", "cells", (F.col("cells") - F.coalesce("rest", F.lit(0).cast("long"))).alias("covered"))
        verdict = covered.join(final, "k", "left").select("k", "cells", "covered", F.coalesce("left", F.lit(0).cast("long")).alias("left"), F.col("left").isNotNull().alias("kept"))
        verdicts, kept = (verdict, mine) if verdicts is None else (verdicts.unionByName(verdict), kept.unionByName(mine))
        ground = mine.join(fields, "k").select(F.col("field").cast("string").alias("k"), "ti", "tj", "bits")
        taken = scratch.write(M.combined([ground] if taken is None else [taken, ground]), "taken")
        open_ = scratch.write(open_.join(ready.select("k"), "k", "left_anti"), "open")
    if verdicts is None:
        return t.select("k", "ti", "tj", "bits"), plots.select("k", "cells", F.lit(0).cast("long").alias("covered"), "cells", F.lit(True).alias("kept")).toDF("k", "cells", "covered", "left", "kept")
    return kept, verdicts


def _less(both: DataFrame, kind: str) -> DataFrame:
    """Tiles (field, k, ti, tj, bits) without the cells that are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [x if g is None else (np.frombuffer(x, np.uint8) & ~np.frombuffer(g, np.uint8)).tobytes() for x, g in zip(b.column("bits").to_pylist(), b.column("gone").to_pylist(), strict=True)]
            some = [any(x) for x in bits]
            out = pa.RecordBatch.from_arrays([*[b.column(c) for c in ("field", "k", "ti", "tj")], pa.array(bits, pa.binary())], ["field", "k", "ti", "tj", "bits"])
            yield out.filter(pa.array(some))

    return both.select("field", "k", "ti", "tj", "bits", "gone").mapInArrow(run, f"field {kind}, k string, ti long, tj long, bits binary")
