"""Column expressions: identifiers, text, colour indices, simple geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def waste_id(vineyard: Column, x: Column, y: Column) -> Column:
    """WASTE-{field or NA}-{decimetres of x mod 100000}-{of y}."""
    part = lambda v: F.lpad(F.pmod(F.bround(v * 10, 0).cast("long"), F.lit(100000)).cast("string"), 5, "0")
    return F.concat(F.lit("WASTE-"), F.coalesce(F.nullif(vineyard, F.lit("")), F.lit("NA")), F.lit("-"), part(x), F.lit("-"), part(y))


def point_id(reason: Column, row_id: Column, x: Column, y: Column) -> Column:
    part = lambda v: F.lpad(F.pmod(F.bround(v, 0).cast("long"), F.lit(10000)).cast("string"), 4, "0")
    return F.concat_ws("-", F.upper(reason), row_id, part(x), part(y))


def tile_name(x: Column, y: Column, left: float, top: float, size: float, prefix: str = "r") -> Column:
    row, col = F.floor((F.lit(top) - y) / size).cast("int"), F.floor((x - left) / size).cast("int")
    return F.format_string(f"{prefix}%03d_c%03d", row, col)


def pattern_of(pattern: Column, vineyard: Column) -> Column:
    return F.coalesce(F.nullif(pattern, F.lit("")), vineyard)


def csv_cell(value: Column) -> Column:
    """Quoted, quotes doubled, and defused where a spreadsheet would read a formula."""
    v = F.coalesce(value, F.lit(""))
    v = F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)
    return F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))


def natural_key(text: Column) -> list[Column]:
    """Sort keys by which numbers at the end of a text order as numbers."""
    return [F.regexp_replace(text, r"[0-9]+$", ""), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"([0-9]+)$", 1), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(-1)), text]


def distance_text(metres: Column) -> Column:
    return F.when(metres >= 1000, F.format_string("%.2f km", F.round(metres / 1000, 2))).otherwise(F.format_string("%d m", F.round(metres, 0).cast("long")))


def excess_green(r: Column, g: Column, b: Column, dark: float = 30.0) -> Column:
    """(2g - r - b) / (r + g + b), zero in the dark."""
    total = r + g + b
    return F.when(total > dark, (2 * g - r - b) / total).otherwise(0.0)


def normalised_difference(a: Column, b: Column, floor: float = 1e-6) -> Column:
    return (a - b) / F.greatest(a + b, F.lit(floor))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees, 0 for greys."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.when(d > 0, 60 * h).otherwise(0.0)


def to_world(col: Column, row: Column, left: float, top: float, px: float) -> tuple[Column, Column]:
    return left + col * px, top - row * px


def to_pixel(x: Column, y: Column, left: float, top: float, px: float) -> tuple[Column, Column]:
    return (x - left) / px, (top - y) / px


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / n))).otherwise(0.0)
    return F.sqrt(F.pow(px - x0 - t * dx, 2) + F.pow(py - y0 - t * dy, 2))


def shoelace(points: Column) -> Column:
    """Area of a ring given as array<struct<x, y>>."""
    n = F.size(points)
    ring = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(ring, F.lit(0.0), lambda s, v: s + v)) / 2


def undirected_angle(dx: Column, dy: Column) -> Column:
    """Degrees modulo 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def circular_gap(a: Column, b: Column, bins: int) -> Column:
    d = F.pmod(a - b, F.lit(bins))
    return F.least(d, bins - d)


def cover_class(green: Column) -> Column:
    return F.when(green.isNull(), "unassessable").when(green < 0.25, "bare_soil").when(green > 0.75, "vegetation").otherwise("mixed")


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, left: Column, low: Column, right: Column, high: Column) -> Column:
    """Parameters (lo, hi) of the part of a segment inside a box; null where it stays outside or only touches. Each side bounds one of the two by the line's crossing with it."""
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    outside = F.lit(False)
    for at, d, a, b in ((x0, x1 - x0, left, right), (y0, y1 - y0, low, high)):
        enter.append(F.when(d != 0, F.least((a - at) / d, (b - at) / d)))
        leave.append(F.when(d != 0, F.greatest((a - at) / d, (b - at) / d)))
        outside = outside | ((d == 0) & ~at.between(a, b))
    lo, hi = F.greatest(*enter), F.least(*leave)
    return F.when(~outside & (lo < hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def row_frame(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """(u along, v across) in the frame of rows at an angle."""
    a = F.radians(degrees)
    return x * F.cos(a) + y * F.sin(a), y * F.cos(a) - x * F.sin(a)


def snapped_ring(points: Column, grid: float) -> Column:
    """Ring on a grid: every vertex rounded, vertices equal to the one before (the last before the first) left out; null below three."""
    on = F.transform(points, lambda p: F.struct((F.floor(p["x"] / grid + 0.5) * grid).alias("x"), (F.floor(p["y"] / grid + 0.5) * grid).alias("y")))
    kept = F.filter(on, lambda p, i: p != F.element_at(on, F.when(i == 0, F.lit(-1)).otherwise(i)))
    return F.when(F.size(kept) >= 3, kept)


def box_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Length of the shortest line between two boxes (x0, y0, x1, y1); 0 where they meet."""
    side = lambda lo, hi: F.greatest(a[lo] - b[hi], F.lit(0.0), b[lo] - a[hi])
    return F.sqrt(F.pow(side("x0", "x1"), 2) + F.pow(side("y0", "y1"), 2))


def one_lattice(a: dict[str, Column], b: dict[str, Column], degrees: float = 3.0, spacing: float = 0.08, wave: tuple[float, float] = (0.4, 1.5), phase: float = 0.2) -> Column:
    """Two fits (angle, spacing, wave, phase in turns) are rows of one lattice: nearly one angle and spacing, waves alike in strength, in step."""
    turn = F.abs(F.pmod(a["angle"] - b["angle"] + 90, F.lit(180.0)) - 90)
    step = F.abs(F.pmod(a["phase"] - b["phase"] + 0.5, F.lit(1.0)) - 0.5)
    alike = F.abs(a["spacing"] - b["spacing"]) <= spacing * F.least(a["spacing"], b["spacing"])
    return (turn <= degrees) & alike & (b["wave"] >= wave[0] * a["wave"]) & (b["wave"] <= wave[1] * a["wave"]) & (step <= phase)


def overview(wanted: Column, levels: tuple[int, ...] = (2, 4, 8, 16)) -> Column:
    """The coarsest overview that isn't coarser than wanted; 1 is the full resolution."""
    out = F.lit(1)
    for k in levels:
        out = F.when(wanted >= k, F.lit(k)).otherwise(out)
    return out


def known_name(name: Column, known: Column) -> Column:
    """A name without its numeric prefix, where the rest is a known name (an array); else as it is."""
    bare = F.regexp_replace(name, "^[0-9]+_", "")
    return F.when(F.array_contains(known, bare), bare).otherwise(name)
