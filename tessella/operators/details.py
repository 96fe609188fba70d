"""Smaller relational operators: visibility, search, latest answers, piece joins, walks, samples, sweeps, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import meeting, nearest_on_line
from .sequences import numbered


def visible(items: DataFrame, role: str, show_missing: bool = False) -> DataFrame:
    """Row-level visibility: inspectors see all; farmers see waste, and missing canopy when they ask for it."""
    if role == "inspector":
        return items
    return items.where((F.col("kind") == "waste") | (F.lit(show_missing) & (F.col("kind") == "gap")))


def actions(role: str, status: Column) -> Column:
    """Next statuses that a role may set."""
    if role == "inspector":
        return F.when(status == "open", F.array(F.lit("approved"), F.lit("dismissed"))).when(status == "done", F.array(F.lit("approved"), F.lit("open"))).otherwise(F.array(F.lit("open")))
    return F.when(status == "open", F.array(F.lit("done"))).when(status == "done", F.array(F.lit("open"))).otherwise(F.expr("cast(array() as array<string>)"))


def search_fields(fields: DataFrame, text: str) -> DataFrame:
    """Fields whose name contains a text, whatever the case; place by score ascending, no score last (101), then given order."""
    hit = fields.where(F.contains(F.lower("name"), F.lit(text.lower())))
    return numbered(hit, [F.coalesce("score", F.lit(101.0)), F.col("ord")], "place")


def latest_answers(items: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Items with the latest answer, empty where there is none."""
    last = answers.groupBy(key).agg(F.max_by("answer", F.struct("at", "seq")).alias("answer"))
    return items.join(last, key, "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def on_patterns(pieces: DataFrame, parts: DataFrame) -> DataFrame:
    """Every piece with the nearest part of its row (ties: the smaller pattern); a piece without a row fails."""
    j = pieces.join(parts, "row_id", "left")
    pattern = F.when(F.col("pattern").isNull(), F.raise_error(F.concat(F.lit("no row "), F.col("row_id"))).cast("string")).otherwise(F.col("pattern"))
    return j.groupBy("piece").agg(F.min_by(pattern, F.struct(F.abs(F.col("at") - F.col("part_at")).alias("d"), "pattern")).alias("pattern"))


def nearest_row(pieces: DataFrame, rows: DataFrame, reach: float = 0.6, extend: float = 1.0) -> DataFrame:
    """piece, row (-1 if none): of the rows of its pattern whose extent (and a metre) covers it, the nearest across, no farther than ``reach``.

    ``pieces``: pattern, piece, u, v; ``rows``: pattern, row, u0, u1, rv.
    """
    # rows of one extent are a line; a piece meets each extent near it once, and on its line the neighbours only
    cell = lambda c: F.floor(F.col(c) / reach)
    near = F.explode(F.array(cell("rv") - 1, cell("rv"), cell("rv") + 1)).alias("cell")
    extents = rows.select("pattern", "u0", "u1", near).distinct()
    cand = meeting(pieces.withColumn("cell", cell("v")), extents, ["pattern", "cell"]).where((F.col("u") >= F.col("u0") - extend) & (F.col("u") <= F.col("u1") + extend))
    best = nearest_on_line(cand, rows, "piece", "row", "v", "rv", reach, ["pattern", "u0", "u1"])
    return pieces.select("piece").join(best, "piece", "left").select("piece", F.coalesce("best.o", F.lit(-1)).cast("long").alias("row"))


def propagated(dependents: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of kept patterns only, renamed by (old, new)."""
    return dependents.join(names.withColumnRenamed("old", "pattern"), "pattern").withColumn("pattern", F.col("new")).drop("new")


def walk(stops: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ids with their number in walking order; skipped and unknown ones without."""
    w = W.partitionBy("walk").orderBy("at_m", "id")
    numbered = stops.where("at_m IS NOT NULL").withColumn("n", F.row_number().over(w).cast("long")).select("walk", "id", "n")
    j = wanted.join(stops.select("walk", "id", F.lit(True).alias("known")), ["walk", "id"], "left").join(numbered, ["walk", "id"], "left")
    return j.select("walk", "id", "n", F.when(F.col("n").isNotNull(), "visited").when(F.col("known"), "skipped").otherwise("unknown").alias("state"))


def stratified(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """``k`` rows of each key at evenly spaced ranks over the sorted list (all of them if there are fewer)."""
    w = W.partitionBy(key)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    ranks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.round(i * (F.col("_n") - 1) / (k - 1), 0).cast("int"))
    return d.where((F.col("_n") <= k) | F.array_contains(ranks, F.col("_i"))).drop("_i", "_n")


def weak_windows(px: DataFrame, key: str, at: str, green: Column, size: float, least: float) -> DataFrame:
    """Tumbling stretches of ``size`` along a row whose green share is below ``least``."""
    return px.groupBy(key, F.floor(F.col(at) / size).alias("bucket")).agg(F.avg(green.cast("double")).alias("share"), F.count("*").alias("n")).where(F.col("share") < least)


def planting_distance(pieces: DataFrame, key: str, at: str, low: float, high: float, default: float, least: int) -> DataFrame:
    """Median distance of consecutive pieces between low and high; the default where there are too few."""
    step = F.col(at) - F.lag(at).over(W.partitionBy(key).orderBy(at))
    d = pieces.withColumn("_d", step)
    ok = F.when(F.col("_d").between(low, high), F.col("_d"))
    return d.groupBy(key).agg(F.count(ok).alias("n"), F.median(ok).alias("med")).select(key, "n", F.when(F.col("n") >= least, F.col("med")).otherwise(default).alias("distance"))


def row_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows deleted and added by field, and which of them were outermost. Both: field, row_id, v."""
    flag = lambda d: d.withColumn("outer", (F.row_number().over(W.partitionBy("field").orderBy("v", "row_id")) == 1) | (F.row_number().over(W.partitionBy("field").orderBy(F.desc("v"), F.desc("row_id"))) == 1))
    a, b = flag(before).select("field", "row_id", F.col("outer").alias("outer_a")), flag(after).select("field", "row_id", F.col("outer").alias("outer_b"))
    j = a.join(b, ["field", "row_id"], "full")
    gone, new = F.col("outer_b").isNull(), F.col("outer_a").isNull()
    return j.groupBy("field").agg(F.count_if(gone).alias("deleted"), F.count_if(gone & F.col("outer_a")).alias("deleted_outer"), F.count_if(new).alias("added"), F.count_if(new & F.col("outer_b")).alias("added_outer")).where("deleted + added > 0")


def valid_record(kind: Column, day: Column, quantity: Column) -> Column:
    """Type guard of a yield record."""
    return F.coalesce(kind.isin("harvest", "sale", "loss") & day.rlike(r"^\d{4}-\d{2}-\d{2}$") & (quantity > 0) & ~F.isnan(quantity) & (quantity < float("inf")), F.lit(False))


def lab_a_star(r: Column, g: Column, b: Column) -> Column:
    """CIELAB a* of 8-bit sRGB."""
    lin = lambda v: F.when(v / 255.0 <= 0.04045, v / 255.0 / 12.92).otherwise(F.pow((v / 255.0 + 0.055) / 1.055, 2.4))
    x = (0.4124 * lin(r) + 0.3576 * lin(g) + 0.1805 * lin(b)) / 0.95047
    y = 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise(t * (24389 / 27) / 116 + 16 / 116)
    return 500 * (f(x) - f(y))


def ramp(value: Column, stops: list[tuple[float, int]]) -> Column:
    """Piecewise linear interpolation over stops, clipped; null stays null."""
    v = F.greatest(F.lit(stops[0][0]), F.least(F.lit(stops[-1][0]), value))
    out = F.lit(float(stops[-1][1]))
    for (a, p), (b, q) in reversed(list(zip(stops[:-1], stops[1:], strict=True))):
        out = F.when(v <= b, p + (v - a) / (b - a) * (q - p)).otherwise(out)
    return F.when(value.isNotNull(), out)


def plan_key(*parts: Column) -> Column:
    """First sixteen hex digits of the SHA-1 of the parts' JSON array."""
    return F.substring(F.sha1(F.concat(F.lit('["'), F.concat_ws('","', *[p.cast("string") for p in parts]), F.lit('"]'))), 1, 16)


def command(text: Column) -> tuple[Column, Column]:
    """(name, argument) of a chat command; a bot's suffix goes, the argument is trimmed and upper-cased."""
    return F.regexp_extract(text, r"^/([a-z]+)", 1), F.upper(F.trim(F.regexp_extract(text, r"^/[a-z]+(?:@[A-Za-z_]+)?\s*(.*)$", 1)))
