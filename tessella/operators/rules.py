"""Rule classifiers, ranks, flags and texts over one row of measured features: column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tier:
    """Limits of one tier; None: no limit."""

    least_m2: float
    most_m2: float
    width_m: float
    lum: float
    chroma: float
    dev: float
    row_m: float
    hue: float | None = None


@dataclass(frozen=True)
class WasteRules:
    """Thresholds of the verifier, in square metres, metres, 8-bit levels and shares."""

    most_m2: float = 1.5
    elongation: float = 3.0
    strict: Tier = Tier(0.03, 1.5, 0.04, 220.0, 15.0, 150.0, 0.9)
    small: Tier = Tier(0.02, 0.15, 0.03, 220.0, 20.0, 100.0, 0.55)
    pile: Tier = Tier(0.15, 1.5, 0.10, 208.0, 32.0, 110.0, 0.7, 50.0)
    colour_m2: float = 0.02
    colour_chroma: float = 80.0
    colour_dev: float = 100.0
    fill: float = 0.35
    ring_green: float = 0.5
    near_density: float = 0.10
    far_density: float = 0.03
    building_m: float = 10.0
    row_m: float = 0.55
    rest_m2: tuple[float, float] = (0.03, 1.5)
    blue_m2: tuple[float, float] = (0.04, 1.5)
    blue_hue: tuple[float, float] = (185.0, 265.0)
    blue_texture: float = 20.0
    clipped: float = 0.05
    near_lum: float = 220.0
    far_lum: float = 225.0
    rest_chroma: float = 25.0
    texture: float = 9.5
    disc_fill: float = 0.6
    disc_side: float = 1.3
    disc_texture: float = 10.0


def _meets(t: Tier) -> Column:
    ok = F.col("area_m2").between(t.least_m2, t.most_m2) & (F.col("width_m") >= t.width_m) & (F.col("lum") >= t.lum) & (F.col("chroma") <= t.chroma) & (F.col("dev") >= t.dev) & (F.col("row_m") >= t.row_m)
    return ok if t.hue is None else ok & (F.col("hue") <= t.hue)


def waste_tier(p: WasteRules = WasteRules()) -> Column:
    """Tier by which a blob is waste, null if it isn't: strict, small_bright, pile or colour between the rows; scrap, white or blue elsewhere.

    Columns: kind (white, colour, black), location (interrow if null, block, headland, outside), area_m2, length_m,
    width_m, w_m, h_m, lum, lum_std, chroma, dev, hue, fill, ring_green, density, structure, clipped, row_m, forbidden_m.
    """
    place = F.coalesce("location", F.lit("interrow"))
    white, colour, area = F.col("kind") == "white", F.col("kind") == "colour", F.col("area_m2")
    vivid = colour & (area >= p.colour_m2) & (F.col("chroma") >= p.colour_chroma) & (F.col("dev") >= p.colour_dev)
    between = F.when(white & _meets(p.strict), "strict").when(white & _meets(p.small), "small_bright").when(white & _meets(p.pile), "pile").when(vivid, "colour")
    near = place.isin("block", "headland")
    apart = (F.col("structure") == 0) & (F.col("forbidden_m") >= p.building_m)
    scrap = (place == "block") & white & apart & (_meets(p.strict) | _meets(p.small))
    # other evidence around: the blob's own share of the three metres square is taken off
    crowd = F.col("density") - area / 9 <= F.when(near, p.near_density).otherwise(p.far_density)
    alone = apart & crowd & (F.col("fill") >= p.fill) & (F.col("ring_green") >= p.ring_green) & (F.col("row_m") >= p.row_m)
    disc = (F.col("fill") >= p.disc_fill) & (F.greatest("w_m", "h_m") < p.disc_side * F.least("w_m", "h_m")) & (F.col("lum_std") < p.disc_texture)
    bright = ~disc & area.between(*p.rest_m2) & (F.col("clipped") >= p.clipped) & (F.col("lum") >= F.when(near, p.near_lum).otherwise(p.far_lum)) & (F.col("chroma") <= p.rest_chroma) & (F.col("lum_std") >= p.texture)
    blue = F.col("hue").between(*p.blue_hue) & area.between(*p.blue_m2) & (F.col("lum_std") >= p.blue_texture)
    elsewhere = F.when(scrap, "scrap").when(alone & white & bright, "white").when(alone & colour & blue, "blue")
    possible = (area <= p.most_m2) & (F.col("length_m") <= p.elongation * F.greatest("width_m", F.lit(1e-3)))
    return F.when(possible, F.when(place == "interrow", between).otherwise(elsewhere))


def review_rank(accepted: Column, digits: int = 4) -> Column:
    """Order of review: size, compactness, distance from the rows and colour, each clipped; twice as high for accepted blobs; null where a measure that it needs is."""
    clip = lambda v, lo, hi: F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))
    size = F.least(F.lit(3.0), F.sqrt(F.col("area_m2") / 0.04))
    compact = F.when(F.col("length_m") <= 3 * F.greatest("width_m", F.lit(1e-3)), 1.0).otherwise(0.35)
    colour = (
        F.when(F.col("kind") == "white", clip((F.col("lum") - 185) / 35, 0.05, 1.5) * clip((35 - F.col("chroma")) / 20, 0.15, 1.2))
        .when(F.col("kind") == "colour", clip((F.col("chroma") - 45) / 40, 0.1, 1.5) * F.least(F.lit(1.3), F.col("dev") / 100))
        .otherwise(0.15 * F.least(F.lit(1.0), F.col("area_m2") / 0.08))
    )
    return F.round(size * compact * clip(F.col("row_m") / 0.8, 0.25, 1.2) * colour * F.when(accepted, 2.0).otherwise(1.0), digits)


def rule_flags() -> Column:
    """Names of the rules that a blob likely breaks, in a fixed order; none for a blob without measurements."""
    area, lum, chroma, dev = (F.col(c) for c in ("area_m2", "lum", "chroma", "dev"))
    dull = F.when(F.col("kind") == "black", "dark").when((area >= 0.15) & ((lum < 215) | (chroma > 22)) & (dev < 170), "dull").when((F.col("kind") == "white") & (lum < 212) & (dev < 170), "not bright")
    flags = F.array(
        F.when(area < 0.02, "tiny"), dull, F.when(dev < 105, "low contrast"),
        F.when((F.col("row_m") < 0.5) & F.col("location").isin("interrow", "block"), "on a row"),
        F.when(F.col("length_m") > 3.5 * F.greatest("width_m", F.lit(1e-3)), "long"),
    )
    return F.when(lum.isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.filter(flags, lambda x: x.isNotNull()))


@dataclass(frozen=True)
class PlotRules:
    """Fixed values; a threshold of 0 turns its rule off."""

    cover: float = 0.25
    contrast: float = 0.015
    vine_m: float = 4.0
    hedge: float = 0.5


def plot_reason(p: PlotRules = PlotRules()) -> Column:
    """Why a pattern is no vineyard, by the first rule it breaks: cover, contrast or patchy; null where it is kept. Columns cover, contrast, len_med."""
    out = F.lit(None).cast("string")
    if p.vine_m:
        out = F.when((F.col("len_med") > p.vine_m) & (F.col("cover") < p.hedge), "patchy").otherwise(out)
    if p.contrast:
        out = F.when(F.col("contrast") < p.contrast, "contrast").otherwise(out)
    return F.when(F.col("cover") < p.cover, "cover").otherwise(out) if p.cover else out


def off_route_text(status: Column, needs_m: Column, reason: Column, left_m: Column) -> Column:
    """Why a route passes a target by."""
    whole = lambda v: F.format_string("%d", F.floor(v + 0.5))
    needs = F.when(needs_m.isNotNull(), F.concat(F.lit("~"), whole(needs_m), F.lit(" m"))).otherwise("more")
    rest = F.when(left_m.isNotNull(), F.concat(F.lit("; "), whole(F.greatest(left_m, F.lit(0.0))), F.lit(" m are left"))).otherwise("")
    over = F.concat(F.lit("Not on this route: it needs "), needs, F.lit(" outside the lanes"), rest, F.lit("."))
    lost = F.concat(F.lit("Not on this route: no legal path"), F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(" ("), reason, F.lit(")"))).otherwise(""), F.lit("."))
    return F.when(status == "over_budget", over).when(status == "unreachable", lost).otherwise("Not on this route: it passes more than 2 m away.")


def reflectance(dn: Column, scale: Column | None = None, offset: Column | None = None) -> Column:
    """Digital numbers as reflectance; a band without metadata has scale 0.0001 and offset -0.1."""
    return dn * F.coalesce(scale if scale is not None else F.lit(None).cast("double"), F.lit(1e-4)) + F.coalesce(offset if offset is not None else F.lit(None).cast("double"), F.lit(-0.1))


def clear_share(scl: Column, cloud: tuple[int, ...] = (3, 8, 9, 10, 11)) -> Column:
    """Aggregate: share of pixels whose scene class isn't cloud or shadow."""
    return 1 - F.avg(F.when(scl.isin(*cloud), 1.0).otherwise(0.0))


def across_at(u: Column, u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
    """Where a line through (u0, v0) and (u1, v1) is at u; v0 where it has no extent along."""
    return F.when(u1 != u0, v0 + (v1 - v0) * (u - u0) / (u1 - u0)).otherwise(v0)


def in_search(day: Column, cloud: Column, item: Column, end: Column, tile: str, days: int = 45, most: float = 50.0) -> Column:
    """Scenes of one tile in the days before a flight, its own day included, less cloudy than a limit."""
    return day.between(F.date_sub(end, days), end) & (cloud < most) & F.contains(item, F.lit(tile))


def utc_seconds(ts: Column) -> Column:
    """ISO text to the second, in UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def fixed_or_none(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", value))


def easting_northing(text: Column) -> Column:
    """Struct of both numbers of ``E,N``; null for anything else."""
    part = lambda k: F.get(F.split(text, ",", -1), k).try_cast("double")
    return F.when((F.size(F.split(text, ",", -1)) == 2) & part(0).isNotNull() & part(1).isNotNull(), F.struct(part(0).alias("e"), part(1).alias("n")))


def request_error(body_bytes: Column, lon: Column, lat: Column, scope: Column, cutoff: Column, inside: Column) -> Column:
    """Status of a route request: 413 too long, 422 invalid, 200. A missing start is the site's own."""
    placed = (lon.isNull() & lat.isNull()) | (lon.between(-180, 180) & lat.between(-90, 90))
    ok = F.coalesce(placed, F.lit(False)) & scope.rlike(r"\A[A-Za-z0-9_-]{1,16}\z") & (cutoff.isNull() | cutoff.isin(0.5, 0.7)) & (lon.isNull() | inside)
    return F.when(body_bytes > 2048, 413).when(F.coalesce(ok, F.lit(False)), 200).otherwise(422)
