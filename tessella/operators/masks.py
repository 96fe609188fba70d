"""Areas as sets of grid cells, held in tiles: growing, shrinking and closing with an exchange between neighbours.

A tile is SIDE by SIDE cells of one key, as bits; only tiles with a cell set exist. To grow or shrink by ``reach``
cells, every tile hands its neighbours the strip that lies within reach of them (a shuffle of strips by tile, nothing
else moves), and each tile is worked out on its own, with the strips around it. A tile gets at most one strip from
each of eight neighbours, so tasks hold one tile at a time, however large the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 64
TILE = "k string, ti long, tj long, bits binary"
PIECE = "k string, ti long, tj long, op int, i long, j long, h long, w long, bits binary"


def _packed(a: np.ndarray) -> bytes:
    return np.packbits(a.ravel()).tobytes()


def _unpacked(b: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=h * w).reshape(h, w).astype(bool)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[t]) for n, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _by_tile(pieces: DataFrame, pad: int, work: Callable[[np.ndarray, bool], np.ndarray]) -> DataFrame:
    """Tiles from pieces (PIECE: cells i.., j.. of a tile, which may lie ``pad`` outside it), put together by op: 0 sets, 1 clears afterwards, 2 sets and makes the tile one that was there. ``work`` makes the tile's cells from the padded ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grid, own, out = None, None, False, []
        size = SIDE + 2 * pad

        def close() -> None:
            made = work(grid, own)
            if made.any():
                out.append((*now, _packed(made)))

        for b in batches:
            for k, ti, tj, op, i, j, h, w, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, ti, tj) != now:
                    if now is not None:
                        close()
                        if len(out) >= 256:
                            yield _batch(out, TILE)
                            out = []
                    now, grid, own = (k, ti, tj), np.zeros((size, size), bool), False
                cells = np.ones((h, w), bool) if bits is None else _unpacked(bits, h, w)
                own |= op == 2
                at = (slice(i + pad, i + pad + h), slice(j + pad, j + pad + w))
                grid[at] = grid[at] & ~cells if op == 1 else grid[at] | cells
        if now is not None:
            close()
        if out:
            yield _batch(out, TILE)

    # what clears comes after what sets
    return pieces.repartition("k", "ti", "tj").sortWithinPartitions("k", "ti", "tj", F.col("op") % 2).mapInArrow(run, TILE)


def from_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """Tiles of the cells that boxes (x0, y0, x1, y1: whole cells, the far sides not included) cover."""
    b = boxes.where(f"x0 < x1 AND y0 < y1 AND `{key}` IS NOT NULL").select(F.col(key).cast("string").alias("k"), *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])
    tile = lambda c: F.floor(c / SIDE).cast("long")
    for t, lo, hi in (("ti", "x0", "x1"), ("tj", "y0", "y1")):
        b = b.withColumn(t, F.explode(F.sequence(tile(F.col(lo)), tile(F.col(hi) - 1))))
    lo = lambda t, c: F.greatest(F.lit(0).cast("long"), F.col(c) - F.col(t) * SIDE)
    hi = lambda t, c: F.least(F.lit(SIDE).cast("long"), F.col(c) - F.col(t) * SIDE)
    p = b.select("k", "ti", "tj", F.lit(2).alias("op"), lo("ti", "x0").alias("i"), lo("tj", "y0").alias("j"), (hi("ti", "x1") - lo("ti", "x0")).alias("h"), (hi("tj", "y1") - lo("tj", "y0")).alias("w"), F.lit(None).cast("binary").alias("bits"))
    # boxes that cover the same part of a tile are one
    return _by_tile(p.distinct(), 0, lambda grid, own: grid)


def _strips(tiles: DataFrame, reach: int) -> DataFrame:
    """PIECE of every tile itself and of what its neighbours need of it."""
    if not 0 <= reach <= SIDE:
        raise ValueError(f"a reach of {reach} cells is more than a tile's {SIDE}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, ti, tj, bits in zip(*(b.column(c).to_pylist() for c in ("k", "ti", "tj", "bits")), strict=True):
                cells = _unpacked(bits, SIDE, SIDE)
                out.append((k, ti, tj, 2, 0, 0, SIDE, SIDE, bits))
                for di in (-1, 0, 1):
                    for dj in (-1, 0, 1):
                        # the part that lies within reach of the neighbour, in the neighbour's own cells
                        side = {-1: (0, reach, SIDE), 0: (0, SIDE, 0), 1: (SIDE - reach, SIDE, -reach)}
                        (a, z, i), (c, d, j) = side[di], side[dj]
                        part = cells[a:z, c:d]
                        if (di or dj) and part.any():
                            out.append((k, ti + di, tj + dj, 0, i, j, *part.shape, _packed(part)))
            yield _batch(out, PIECE)

    return tiles.mapInArrow(run, PIECE)


def spread(grid: np.ndarray, reach: int, round_: bool) -> np.ndarray:
    """Cells within reach of a set one, inside the grid: by their centres' distance, or in a square."""
    out = np.zeros_like(grid)
    n = grid.shape[1]
    sums = np.zeros((grid.shape[0], n + 1), np.int64)
    sums[:, 1:] = grid.cumsum(1)
    for d in range(-reach, reach + 1):
        w = int((reach * reach - d * d) ** 0.5 + 1e-9) if round_ else reach
        near = sums[:, np.minimum(np.arange(n) + w + 1, n)] > sums[:, np.maximum(np.arange(n) - w, 0)]
        lo, hi = max(0, d), min(len(grid), len(grid) + d)
        out[lo:hi] |= near[lo - d : hi - d]
    return out


def grown(tiles: DataFrame, reach: int, round_: bool = True) -> DataFrame:
    """Tiles of all cells within reach of a set one."""
    crop = slice(reach, reach + SIDE)
    return _by_tile(_strips(tiles, reach), reach, lambda grid, own: spread(grid, reach, round_)[crop, crop])


def shrunk(tiles: DataFrame, reach: int, round_: bool = True) -> DataFrame:
    """Tiles of the cells whose whole surroundings within reach are set."""
    crop = slice(reach, reach + SIDE)
    # cells beyond what a tile was handed don't matter: they are out of reach
    return _by_tile(_strips(tiles, reach), reach, lambda grid, own: ~spread(~grid, reach, round_)[crop, crop] if own else np.zeros((SIDE, SIDE), bool))


def closed(tiles: DataFrame, reach: int, round_: bool = True) -> DataFrame:
    return shrunk(grown(tiles, reach, round_), reach, round_)


def combined(sets: list[DataFrame], less: DataFrame | None = None) -> DataFrame:
    """Tiles of the union of sets, without the cells of ``less``."""
    piece = lambda t, op: t.select("k", "ti", "tj", F.lit(op).alias("op"), *[F.lit(v).cast("long").alias(c) for c, v in (("i", 0), ("j", 0), ("h", SIDE), ("w", SIDE))], "bits")
    out = piece(sets[0], 2)
    for s in sets[1:]:
        out = out.unionByName(piece(s, 2))
    return _by_tile(out if less is None else out.unionByName(piece(less, 1)), 0, lambda grid, own: grid)


def cells(tiles: DataFrame) -> DataFrame:
    """k, i, j of every set cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, ti, tj, bits in zip(*(b.column(c).to_pylist() for c in ("k", "ti", "tj", "bits")), strict=True):
                i, j = np.nonzero(_unpacked(bits, SIDE, SIDE))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(i), pa.string()), pa.array(ti * SIDE + i), pa.array(tj * SIDE + j)], ["k", "i", "j"])

    return tiles.mapInArrow(run, "k string, i long, j long")


def field_masks(blocks: DataFrame, interrows: DataFrame, key: str, reach: int) -> DataFrame:
    """Tiles of each field: of its blocks, or where it has none of its inter-rows closed by ``reach``; both sides are boxes in cells."""
    other = interrows.join(blocks.where("x0 < x1 AND y0 < y1").select(key).distinct(), key, "left_anti")
    return from_boxes(blocks, key).unionByName(closed(from_boxes(other, key), reach))


def robust_space(interrows: DataFrame, passages: DataFrame, forbidden: DataFrame, key: str, snap: int, margin: int) -> DataFrame:
    """Tiles of the space to plan in: inter-rows grown by ``snap`` (which joins pieces that a tile's side parted) and shrunk by that and ``margin``, with the passages, without what is forbidden."""
    inner = shrunk(grown(from_boxes(interrows, key), snap, round_=False), snap + margin, round_=True)
    return combined([inner, from_boxes(passages, key)], from_boxes(forbidden, key))
