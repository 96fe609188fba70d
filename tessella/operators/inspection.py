"""Row inspection: samples along rows, gaps, points to visit, their status, satellite zones, waste, scene regressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import point_id, segment_distance
from .sequences import runs
from .stats import field_score, robust_z


@dataclass(frozen=True)
class GapParams:
    step_m: float = 0.05
    least_planted_m: float = 1.0
    end_gap_m: float = 5.0
    neighbours: int = 2
    hidden_share: float = 0.2
    long_green: float = 0.75
    short_green: float = 0.1
    low_row: float = 0.25
    planting_m: float = 15.0


def row_gaps(samples: DataFrame, thresholds: DataFrame, p: GapParams = GapParams()) -> DataFrame:
    """Gaps of rows sampled at fixed steps: vineyard_id, row_id, kind (interior or end), start, end (sample numbers), gap_m.

    ``samples``: vineyard_id, row_id, i, canopy; ``thresholds``: vineyard_id, threshold (metres). Rows planted over less
    than a metre are left out. A row's ends are held against the median first and last planted sample of two
    rows on either side of the same lattice (the row id without its number); at least two neighbours are needed.
    """
    ends = samples.groupBy("vineyard_id", "row_id").agg(F.min(F.when(F.col("canopy"), F.col("i"))).alias("first"), F.max(F.when(F.col("canopy"), F.col("i"))).alias("last"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_if("canopy").alias("n"))
    ends = ends.where(F.col("n") * p.step_m >= p.least_planted_m)
    inner = runs(samples.join(ends.select("row_id"), "row_id", "left_semi"), "row_id", ["i"], F.col("canopy"))
    w = W.partitionBy("row_id").orderBy("start")
    inner = inner.withColumn("before", F.lag("flag").over(w)).withColumn("after", F.lead("flag").over(w)).where("NOT flag AND before AND after")
    inner = inner.join(ends.select("vineyard_id", "row_id", "lo"), "row_id").join(thresholds, "vineyard_id", "left")
    metres = (F.col("end") - F.col("start")) * p.step_m
    inner = inner.where(metres >= F.coalesce("threshold", F.lit(p.end_gap_m))).select("vineyard_id", "row_id", F.lit("interior").alias("kind"), (F.col("start") + F.col("lo")).alias("start"), (F.col("end") + F.col("lo")).alias("end"), F.round(metres, 3).alias("gap_m"))
    lattice = ends.withColumn("lattice", F.regexp_replace("row_id", r"-R[^-]*$", ""))
    lw = W.partitionBy("lattice").orderBy("row_id")

    def around(c: str) -> Column:
        near = F.array_sort(F.concat(F.collect_list(c).over(lw.rowsBetween(-p.neighbours, -1)), F.collect_list(c).over(lw.rowsBetween(1, p.neighbours))))
        mid = lambda k: F.get(near, F.floor(k).cast("int"))
        return F.when(F.size(near) >= 2, (mid((F.size(near) - 1) / 2) + mid(F.size(near) / 2)) / 2)

    e = lattice.withColumn("head", F.greatest("lo", around("first"))).withColumn("tail", F.least("hi", around("last")))
    both = e.select("vineyard_id", "row_id", F.explode(F.array(F.struct(F.col("head").cast("long").alias("start"), F.col("first").cast("long").alias("end")), F.struct((F.col("last") + 1).cast("long").alias("start"), (F.col("tail") + 1).cast("long").alias("end")))).alias("g"))
    metres = (F.col("g.end") - F.col("g.start")) * p.step_m
    outer = both.where(metres >= p.end_gap_m).select("vineyard_id", "row_id", F.lit("end").alias("kind"), F.col("g.start").alias("start"), F.col("g.end").alias("end"), F.round(metres, 3).alias("gap_m"))
    return inner.unionByName(outer)


def gap_points(gaps: DataFrame, obstacles: DataFrame | None = None, rule: str = "deviation", p: GapParams = GapParams()) -> DataFrame:
    """Gaps as points to visit, at the middle of each: id, reason, challenge, confidence and what they come from.

    ``gaps``: vineyard_id, row_id, kind (``gap`` in a row, ``planting`` at its end), gap_m, green and hidden (shares of
    it), row_planted (of the whole row), x0, y0, x1, y1. A gap hidden over a fifth is left out. Doubts halve the
    confidence: green over half of what makes a missed row, a hardly planted row, a row's end. A stretch that an
    obstacle (obstacle_id, x, y, kind, in_block) reaches has the reason ``obstacle``, whose kind comes along (the
    nearest's, ties by id), and is no challenge.
    """
    g = gaps.where(F.col("hidden") <= p.hidden_share).withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", (F.col("y0") + F.col("y1")) / 2)
    if obstacles is None:
        g = g.withColumn("obstacle_type", F.lit(None).cast("string"))
    else:
        from .joins import meeting

        most, cell = 6.0, lambda c: F.floor(c / 6.0)
        key = ["x0", "y0", "x1", "y1"]
        side = lambda a, b: F.sequence(cell(F.least(a, b) - most), cell(F.greatest(a, b) + most))
        cells = F.flatten(F.transform(side("x0", "x1"), lambda i: F.transform(side("y0", "y1"), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        o = obstacles.select("obstacle_id", F.col("kind").alias("obstacle_type"), F.col("x").alias("ox"), F.col("y").alias("oy"), reach_of(F.col("kind"), F.col("in_block")).alias("reach"), F.struct(cell(F.col("x")).alias("i"), cell(F.col("y")).alias("j")).alias("cell"))
        far = segment_distance(*[F.col(c) for c in ("ox", "oy", "x0", "y0", "x1", "y1")])
        # stretches and obstacles at the same place meet once
        o = o.groupBy("ox", "oy", "reach", "cell").agg(F.min_by("obstacle_type", "obstacle_id").alias("obstacle_type"), F.min("obstacle_id").alias("obstacle_id"))
        near = meeting(g.select(*key).distinct().select(*key, F.explode(cells).alias("cell")), o, ["cell"]).withColumn("far", far).where("far <= reach")
        g = g.join(near.groupBy(*key).agg(F.min_by("obstacle_type", F.struct("far", "obstacle_id")).alias("obstacle_type")).hint("merge"), key, "left")
    free, gap = F.col("obstacle_type").isNull(), F.col("kind") == "gap"
    reason = F.when(free, F.col("kind")).otherwise("obstacle")
    doubt = (F.col("green") >= p.long_green / 2).cast("int") + (F.col("row_planted") < p.low_row).cast("int") + (~gap).cast("int")
    bare = F.when(gap, F.col("green") < F.when(F.col("gap_m") >= p.end_gap_m, p.long_green).otherwise(p.short_green)).otherwise((F.col("green") < p.short_green) & (F.col("gap_m") <= p.planting_m))
    return g.select(
        point_id(reason, F.col("row_id"), F.col("x"), F.col("y")).alias("id"), reason.alias("reason"), (free & bare).alias("challenge"), "obstacle_type", "vineyard_id", "row_id",
        F.round("gap_m", 2).alias("gap_m"), F.when(gap, F.lit(rule)).otherwise("fixed").alias("gap_rule"), F.round("green", 2).alias("green_share"), F.round("row_planted", 2).alias("row_planted"),
        F.round((1 - F.col("hidden")) / F.pow(F.lit(2.0), doubt), 2).alias("confidence"), "x", "y",
    )


def gap_measures(gaps: DataFrame, samples: DataFrame) -> DataFrame:
    """Gaps (vineyard_id, row_id, kind interior or end, start, end, gap_m) with the shares and end points that ``gap_points`` reads.

    ``samples``: row_id, i, x, y, green, seen, canopy.
    """
    rows = samples.groupBy("row_id").agg(F.avg(F.col("canopy").cast("double")).alias("row_planted"))
    j = gaps.join(samples.select("row_id", "i", "x", "y", "green", "seen"), "row_id").where("i >= start AND i < end")
    share = lambda c: F.avg(c.cast("double"))
    m = j.groupBy("vineyard_id", "row_id", "kind", "start", "end", "gap_m").agg(
        share(F.col("green")).alias("green"), share(~F.col("seen")).alias("hidden"), F.min_by("x", "i").alias("x0"), F.min_by("y", "i").alias("y0"), F.max_by("x", "i").alias("x1"), F.max_by("y", "i").alias("y1")
    )
    return m.join(rows, "row_id").withColumn("kind", F.when(F.col("kind") == "interior", "gap").otherwise("planting"))


def visit_points(features: DataFrame) -> DataFrame:
    """Waste and inspections with an id, and their kind."""
    return features.where((F.col("label") == "waste") | ((F.col("label") == "inspection") & F.col("id").isNotNull())).withColumn("kind", F.when(F.col("label") == "waste", "waste").otherwise(F.col("reason")))


def scores(points: DataFrame, records: DataFrame, fields: DataFrame) -> DataFrame:
    """Per field: open counts and metres, score, the score with all points open, and those to review.

    ``points``: id, vineyard_id, kind, gap_m; ``records``: id, status, role (folded log); ``fields``: vineyard_id,
    area_m2, row_m. A point without a record is open; a farmer's closing status waits for review.
    """
    j = points.join(records, "id", "left").withColumn("open", F.coalesce(F.col("status") == "open", F.lit(True)))
    waste = F.col("kind") == "waste"
    s = j.groupBy("vineyard_id").agg(
        F.count_if(waste & F.col("open")).alias("waste_open"), F.count_if(waste).alias("waste"), F.count_if(~waste & F.col("open")).alias("missing_open"),
        F.coalesce(F.sum(F.when(~waste & F.col("open"), F.col("gap_m"))), F.lit(0.0)).alias("missing_open_m"), F.coalesce(F.sum(F.when(~waste, F.col("gap_m"))), F.lit(0.0)).alias("missing_m"),
        F.count_if((F.col("role") == "farmer") & ~F.col("open")).alias("to_review"),
    )
    f = fields.join(s, "vineyard_id", "left").na.fill(0)
    return f.select("*", field_score(F.col("area_m2"), F.col("row_m"), F.col("waste_open"), F.col("missing_open_m")).cast("int").alias("score"), field_score(F.col("area_m2"), F.col("row_m"), F.col("waste"), F.col("missing_m")).cast("int").alias("model_score"))


def stray_rows(features: DataFrame, share: float = 0.7, span: float = 1.4) -> DataFrame:
    """(pattern_id, row_id) kept by a scan of each pattern's rows in the order of their ids: a middle row goes when it is closer than 0.7 steps to the last row kept and to the next one, and these two distances add up to 0.7 to 1.4 steps.

    ``features``: pattern_id, row_id, v, step (of the pattern). Rows pass in order, a batch at a time, and only the last
    row kept is carried, since it is the left neighbour; a pattern may have any number of rows.
    """
    w = W.partitionBy("pattern_id").orderBy("row_id", "v", "step")
    step, v = F.col("step").cast("double"), F.col("v").cast("double")
    right = F.abs(F.lead(v).over(w) - v)  # null on the last row, which stays
    ordered = features.select("pattern_id", "row_id", "v", v.alias("_v"), step.alias("_step"), right.alias("_right"), (F.row_number().over(w) == 1).alias("_first"))
    names = ["pattern_id", "row_id", "v"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = np.nan
        for batch in batches:
            if not batch.num_rows:
                continue
            at, size, after = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("_v", "_step", "_right"))
            kept = np.ones(len(at), bool)
            for i in np.flatnonzero((after < share * size) & ~batch["_first"].to_numpy(zero_copy_only=False)):
                if i and kept[i - 1]:
                    carried = at[i - 1]
                before = abs(at[i] - carried)
                kept[i] = not (before < share * size[i] and share * size[i] <= before + after[i] <= span * size[i])
            if kept[-1]:
                carried = at[-1]
            yield batch.select(names).filter(pa.array(kept))

    return ordered.mapInArrow(scan, features.select(names).schema)


def bare_outer_rows(rows: DataFrame, share: float = 0.3, least: float = 0.1, most: int = 2) -> DataFrame:
    """Outer rows to drop: from each side inward up to two whose cover is below 0.3 of the pattern's median (of at least 0.1, three rows or more; two stay)."""
    med = rows.groupBy("pattern_id").agg(F.median("cover").alias("med"), F.count("*").alias("n")).where((F.col("n") >= 3) & (F.col("med") >= least))
    d = rows.join(med, "pattern_id").withColumn("bare", F.col("cover") < share * F.col("med"))
    for side, order in (("a", F.asc("v")), ("b", F.desc("v"))):
        w = W.partitionBy("pattern_id").orderBy(order, "row_id")
        d = d.withColumn(f"k_{side}", F.row_number().over(w)).withColumn(f"all_{side}", F.bool_and("bare").over(w.rowsBetween(W.unboundedPreceding, 0)))
    drop = (F.col("all_a") & (F.col("k_a") <= most)) | (F.col("all_b") & (F.col("k_b") <= most))
    d = d.where(drop).withColumn("place", F.row_number().over(W.partitionBy("pattern_id").orderBy(F.least("k_a", "k_b"), "cover", "row_id")))
    return d.where(F.col("n") - F.col("place") >= 2).select("pattern_id", "row_id")


def row_structure(samples: DataFrame, step_m: float = 0.05, hole_m: float = 5.0, ignore_m: float = 0.55) -> DataFrame:
    """Per row: regular, disrupted (a stretch of at least 5 m without vines) or unassessable (none at all); green runs below 0.55 m don't count."""
    r = runs(samples, "row_id", ["i"], F.col("green")).withColumn("vine", F.col("flag") & (F.col("length") * step_m >= ignore_m))
    w = W.partitionBy("row_id").orderBy("start")
    r = r.withColumn("island", F.sum(F.when(F.col("vine") | F.coalesce(F.lag("vine").over(w), F.lit(True)), 1).otherwise(0)).over(w))
    holes = r.groupBy("row_id", "island", "vine").agg(F.sum("length").alias("n"))
    s = holes.groupBy("row_id").agg(F.coalesce(F.max(F.when(~F.col("vine"), F.col("n") * step_m)), F.lit(0.0)).alias("hole_m"), F.bool_or("vine").alias("any_vine"))
    return s.select("row_id", F.round("hole_m", 3).alias("hole_m"), F.when(F.col("hole_m") < hole_m, "regular").when(F.col("any_vine"), "disrupted").otherwise("unassessable").alias("row_structure"))


def disrupted_pieces(pieces: DataFrame, hole_m: float = 5.0) -> DataFrame:
    """All pieces of a row on a tile are disrupted when two neighbours, by start and then end, lie 5 m apart or more. ``pieces``: tile, row_id, start, end, row_structure."""
    w = W.partitionBy("tile", "row_id")
    gap = F.lead("start").over(w.orderBy("start", "end")) - F.col("end")
    return pieces.withColumn("_gap", gap).withColumn("row_structure", F.when(F.max("_gap").over(w) >= hole_m, "disrupted").otherwise(F.col("row_structure"))).drop("_gap")


def low_zones(pixels: DataFrame, z: float = -1.5) -> DataFrame:
    """Pixels (plot, row, col) whose robust z within the plot is low on every scene. ``pixels``: plot, date, row, col, value."""
    scored = robust_z(pixels.where("value IS NOT NULL").withColumn("key", F.concat_ws("|", "plot", F.col("date").cast("string"))), "key", "value")
    return scored.groupBy("plot", "row", "col").agg(F.bool_and(F.col("z") <= z).alias("low"), F.count("*").alias("scenes"), F.min("z").alias("z")).where("low").drop("low")


def choose_scenes(items: DataFrame, least_clear: float = 0.99) -> DataFrame:
    """Scenes clear enough, newest first and four days apart, three at most. ``items``: site, date, clear."""
    from .sequences import greedy_spacing

    return greedy_spacing(items.where(F.col("clear") >= least_clear), "site", "date", 4, 3)


def location_of(in_interrow: Column, in_block: Column, block_m: Column, reach: float = 10.0) -> Column:
    """Containment in priority order: inter-row, block, headland near a block, outside."""
    return F.when(in_interrow, "interrow").when(in_block, "block").when(block_m <= reach, "headland").otherwise("outside")


def located(points: DataFrame, interrows: DataFrame, blocks: DataFrame, reach: float = 10.0) -> DataFrame:
    """(id, location) of points (id, x, y): in an inter-row, in a block, within reach of a block, outside. Both sides are boxes (x0, y0, x1, y1), dealt to cells of the reach. Places and boxes that occur several times are met once."""
    from .joins import cells, meeting

    places = points.select("x", "y").distinct().withColumn("cell", F.struct(F.floor(F.col("x") / reach).alias("i"), F.floor(F.col("y") / reach).alias("j")))
    out = points.select("id", "x", "y")
    for name, boxes, pad in (("row_m", interrows, 0.0), ("block_m", blocks, reach)):
        padded = boxes.select("x0", "y0", "x1", "y1").distinct().select("*", (F.col("x0") - pad).alias("a0"), (F.col("y0") - pad).alias("b0"), (F.col("x1") + pad).alias("a1"), (F.col("y1") + pad).alias("b1"))
        dealt = padded.withColumn("cell", F.explode(cells("a0", "b0", "a1", "b1", reach, reach)))
        side = lambda lo, v, hi: F.greatest(F.col(lo) - F.col(v), F.lit(0.0), F.col(v) - F.col(hi))
        far = F.sqrt(F.pow(side("x0", "x", "x1"), 2) + F.pow(side("y0", "y", "y1"), 2))
        near = meeting(places, dealt, ["cell"]).groupBy("x", "y").agg(F.min(far).alias(name))
        out = out.join(points.select("id", "x", "y").join(near.hint("merge"), ["x", "y"]).groupBy("id").agg(F.min(name).alias(name)).hint("merge"), "id", "left")
    return out.select("id", location_of(F.coalesce(F.col("row_m") <= 0, F.lit(False)), F.coalesce(F.col("block_m") <= 0, F.lit(False)), F.col("block_m"), reach).alias("location"))


def owner_majority(pixels: DataFrame) -> DataFrame:
    """(blob, owner, pixels): the owner of most of a blob's pixels, the smallest of equal ones. ``pixels``: blob, owner."""
    n = pixels.groupBy("blob", "owner").agg(F.count("*").alias("n"))
    return n.groupBy("blob").agg(F.max_by("owner", F.struct("n", -F.col("owner"))).alias("owner"), F.sum("n").alias("pixels"))


def merged_boxes(boxes: DataFrame, members: DataFrame) -> DataFrame:
    """Envelopes of touching boxes: ``members`` is (id, root) of their components; location by rank, areas added, tiles in order."""
    rank = F.when(F.col("location") == "interrow", 0).when(F.col("location") == "block", 1).when(F.col("location") == "headland", 2).otherwise(3)
    j = boxes.join(members, "id").groupBy("root").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min_by("location", rank).alias("location"), F.round(F.sum("area_m2"), 2).alias("area_m2"), F.array_sort(F.collect_set("tile")).alias("tiles"))
    return j


def regressions(predicted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counts of verdict outcomes: wrong ones gone or still there, right ones still there or gone. ``predicted``: verdict_id of each prediction near one; ``verdicts``: id, verdict."""
    there = verdicts.join(predicted.select(F.col("verdict_id").alias("id")).distinct().withColumn("hit", F.lit(True)), "id", "left")
    name = F.concat("verdict", F.when(F.col("hit"), "_still_there").otherwise("_gone"))
    return there.groupBy(name.alias("outcome")).agg(F.count("*").alias("n"))


def plot_scores(best: DataFrame) -> DataFrame:
    """Per half: F1 at 0.5 and 0.75 of best overlaps, and their upper median. ``best``: half, iou, predicted, reference (counts of the half)."""
    s = best.groupBy("half").agg(F.count_if(F.col("iou") >= 0.5).alias("m50"), F.count_if(F.col("iou") >= 0.75).alias("m75"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY iou DESC)").alias("v"), F.max("predicted").alias("p"), F.max("reference").alias("r"))
    ratio = lambda m: F.try_divide(2.0 * F.col(m), (F.col("p") + F.col("r")).cast("double"))
    return s.select("half", ratio("m50").alias("f1_50"), ratio("m75").alias("f1_75"), F.col("v").alias("median_iou"))


def reach_of(kind: Column, in_block: Column, tree_m: float = 2.0, building_m: float = 6.0) -> Column:
    """How far an obstacle reaches: by its own kind if at least half of it is in a block (or nothing is known of that), else like a tree."""
    return F.when((F.coalesce(in_block, F.lit(1.0)) >= 0.5) & (kind == "building"), building_m).otherwise(tree_m)


def near_obstacles(points: DataFrame, obstacles: DataFrame, most: float = 6.0) -> DataFrame:
    """Points (id, x, y) with the nearest obstacle (obstacle_id, x, y, kind, in_block) that reaches them, or none."""
    cell = lambda c: F.floor(F.col(c) / most)
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("i"), (cell("y") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("cell")
    o = obstacles.select("obstacle_id", F.col("x").alias("ox"), F.col("y").alias("oy"), reach_of(F.col("kind"), F.col("in_block")).alias("reach"), F.struct(cell("x").alias("i"), cell("y").alias("j")).alias("cell"))
    d = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    best = points.select("id", "x", "y", around).join(o, "cell").where(d <= F.col("reach")).groupBy("id").agg(F.min(F.struct(d.alias("d"), "obstacle_id")).alias("m"))
    return points.join(best, "id", "left").withColumn("obstacle_id", F.col("m.obstacle_id")).drop("m")


def peer_z(plots: DataFrame, floor: float = 0.01, least: int = 5) -> DataFrame:
    """Each plot's value against plots of the same main cover (all plots where those are fewer than five): plot, cover, value, z."""
    size = F.count("*").over(W.partitionBy("cover"))
    d = plots.withColumn("peers", F.when(size >= least, F.col("cover")).otherwise(""))
    every = plots.withColumn("peers", F.lit("")).unionByName(plots.withColumn("peers", F.col("cover")))
    from .stats import MAD_SIGMA, robust_spread

    s = robust_spread(every, "peers", "value")
    return d.join(s, "peers").select("plot", "cover", "value", ((F.col("value") - F.col("med")) / F.greatest(F.col("mad") * MAD_SIGMA, F.lit(floor))).alias("z"))


def jittered(points: DataFrame, offsets: list[tuple[float, float]]) -> DataFrame:
    """Every point (id, x, y) moved by every offset, for sensitivity curves: a fixed, small number of copies."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(offsets)])).alias("o")
    return points.select("id", "x", "y", o).select("id", F.col("o.k").alias("k"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))


def owner_of(blobs: DataFrame, pixels: DataFrame) -> DataFrame:
    """The owner that most pixels of a blob belong to (ties: the smaller): blobs (id, row, col), pixels (row, col, owner)."""
    return owner_majority(blobs.join(pixels, ["row", "col"]).withColumnRenamed("id", "blob")).select(F.col("blob").alias("id"), "owner")