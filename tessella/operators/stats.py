"""Robust statistics, scores of agreement and adaptive thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAD_SIGMA = 1.4826


def robust_spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, med, mad: exact medians in two passes of grouped aggregation."""
    med = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.median(value).alias("med"))
    off = df.where(F.col(value).isNotNull()).join(med, key).groupBy(key).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return med.join(off, key)


def gap_threshold(pairs: DataFrame, field: str, pitch: str, run: str, k: float = 5.0, floor: float = 3.0, top: float = 5.0, pitch_top: float = 2.0, least: int = 30) -> DataFrame:
    """Per field with enough pairs: min(top, max(floor, min(median pitch, 2) + k sigma - median run))."""
    spread = robust_spread(pairs, field, pitch).where(F.col("n") >= least)
    runs = pairs.groupBy(field).agg(F.median(run).alias("run"))
    level = F.least(F.col("med"), F.lit(pitch_top)) + k * MAD_SIGMA * F.col("mad") - F.col("run")
    return spread.join(runs, field).select(field, "n", "med", "mad", F.least(F.lit(top), F.greatest(F.lit(floor), level)).alias("threshold"))


def robust_z(df: DataFrame, key: str, value: str, floor: float = 0.01) -> DataFrame:
    """df with z = (value - median) / (1.4826 MAD, floored)."""
    s = robust_spread(df, key, value).select(key, "med", F.greatest(F.col("mad") * MAD_SIGMA, F.lit(floor)).alias("sigma"))
    return df.join(s, key).withColumn("z", (F.col(value) - F.col("med")) / F.col("sigma")).drop("med", "sigma")


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: share of pairs on which two groupings agree; null below two rows."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("rows"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("left"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("right"))
    all_ = pairs(F.col("rows"))
    return both.crossJoin(left).crossJoin(right).select(F.when(F.col("rows") >= 2, (all_ + 2 * F.col("both") - F.col("left") - F.col("right")) / all_).alias("rand_index"))


def attribute_score(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: (accuracy + macro F1 over the labels of the truth) / 2; a missing guess is the label ``missing``."""
    c = df.where(F.col(truth).isNotNull()).select(F.col(truth).cast("string").alias("t"), F.coalesce(F.col(guess).cast("string"), F.lit("missing")).alias("g")).groupBy("t", "g").agg(F.count("*").alias("n"))
    acc = c.agg((F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    truths = c.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("nt"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("tp"))
    guesses = c.groupBy(F.col("g").alias("label")).agg(F.sum("n").alias("ng"))
    f1 = truths.join(guesses, "label", "left").agg(F.avg(2 * F.col("tp") / (F.col("nt") + F.coalesce("ng", F.lit(0)))).alias("macro_f1"))
    return acc.crossJoin(f1).select("accuracy", "macro_f1", ((F.col("accuracy") + F.col("macro_f1")) / 2).alias("score"))


def f1(matched: Column, predicted: Column, reference: Column) -> Column:
    """2 m / (p + r); null when both are empty."""
    return F.try_divide(2 * matched, predicted + reference)


def counts_score(predicted: Column, reference: Column, tolerance: float) -> Column:
    return F.when(reference > 0, F.greatest(F.lit(0.0), 1 - F.abs(predicted - reference) / reference / tolerance))


def field_score(area: Column, row_m: Column, waste_open: Column, missing_m: Column) -> Column:
    """round(100 - 60 min(1, missing / rows / 0.15) - min(40, 10 open waste)); fields without rows lose nothing for gaps."""
    gaps = F.when(row_m > 0, F.least(F.lit(1.0), missing_m / row_m / 0.15)).otherwise(0.0)
    return F.round(100 - 60 * gaps - F.least(F.lit(40), 10 * waste_open), 0)


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """One row: threshold (upper edge of a bin) of the largest between-class variance over an equal-width histogram."""
    edge = df.where(F.col(value).isNotNull()).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width))).otherwise(0).cast("int")
    h = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(bin_.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    h = h.withColumn("mid", F.col("lo") + (F.col("bin") + 0.5) * width)
    up = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # at most ``bins`` rows
    h = h.withColumn("w0", F.sum("n").over(up)).withColumn("m0", F.sum(F.col("n") * F.col("mid")).over(up)).withColumn("w", F.sum("n").over(W.partitionBy())).withColumn("m", F.sum(F.col("n") * F.col("mid")).over(W.partitionBy()))
    w1 = F.col("w") - F.col("w0")
    h = h.where(w1 > 0).withColumn("between", F.col("w0") * w1 * F.pow(F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / w1, 2))
    return h.agg(F.max_by(F.struct("bin", (F.col("lo") + (F.col("bin") + 1) * width).alias("threshold")), F.struct(F.round("between", 3), -F.col("bin"))).alias("best")).select("best.*")


def auc(df: DataFrame, label: Column, value: str, slices: int = 256) -> DataFrame:
    """One row: area under the ROC curve by rank sums over distinct values; ties count half. Null values are left out.

    Distinct values are cut into slices at quantiles; running counts are taken inside the slices and over their sums, so
    that no task orders all values.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("q"))
    cuts = c.agg(F.percentile_approx("v", F.array(*[F.lit((k + 1) / slices) for k in range(slices - 1)]), 10 * slices).alias("cuts"))  # one row
    c = c.crossJoin(F.broadcast(cuts)).select("v", "p", "q", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("slice"))
    sums = c.groupBy("slice").agg(F.sum("q").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # ``slices`` rows at most
    inside = F.coalesce(F.sum("q").over(W.partitionBy("slice").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = c.withColumn("inside", inside).join(F.broadcast(sums.select("slice", "before")), "slice").withColumn("wins", F.col("p") * (F.col("before") + F.col("inside") + F.col("q") / 2))
    return s.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.try_divide(F.sum("wins"), (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def adaptive_minimum(df: DataFrame, key: str, size: str, small: float, limit: float, least: int, normal: float) -> DataFrame:
    """Per key: ``small`` where the median of sizes of at least ``small`` is below ``limit`` on ``least`` pieces or more, else ``normal``."""
    ok = F.when(F.col(size) >= small, F.col(size))
    return df.groupBy(key).agg(F.count(ok).alias("n"), F.median(ok).alias("med")).select(key, "n", "med", F.when((F.col("n") >= least) & (F.col("med") < limit), small).otherwise(normal).alias("minimum"))


def theil_sen(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per key: median of pairwise slopes; for groups of bounded size (the end points of one plot's rows)."""
    a, b = df.select(key, F.col(x).alias("x0"), F.col(y).alias("y0")), df.select(key, F.col(x).alias("x1"), F.col(y).alias("y1"))
    return a.join(b, key).where("x1 > x0").groupBy(key).agg(F.median((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).alias("slope"), F.count("*").alias("pairs"))


def weighted_fit(df: DataFrame, key: str, u: str, r: str, w: str) -> DataFrame:
    """Per key: weighted least-squares line through r over u by five sums."""
    s = df.groupBy(key).agg(*[F.sum(e).alias(n) for n, e in (("sw", F.col(w)), ("su", F.col(w) * F.col(u)), ("sr", F.col(w) * F.col(r)), ("suu", F.col(w) * F.col(u) * F.col(u)), ("sur", F.col(w) * F.col(u) * F.col(r)))])
    d = F.col("sw") * F.col("suu") - F.col("su") * F.col("su")
    slope = F.try_divide(F.col("sw") * F.col("sur") - F.col("su") * F.col("sr"), d)
    return s.select(key, slope.alias("slope"), F.try_divide(F.col("sr") - slope * F.col("su"), F.col("sw")).alias("offset"))


def savings(df: DataFrame, key: str, status: str, metres: str, speed: float = 1.1, wage: float = 12.0) -> DataFrame:
    """Per field what a walk to its points saves over walking its rows: points open, fixed and dismissed (O, F, P), metres, minutes at a speed, money at an hourly wage. The walk passes the points that aren't open."""
    st, m = F.col(status), F.col(metres)
    s = df.groupBy(F.col(key).alias("field")).agg(F.count_if(st == "O").alias("open"), F.count_if(st == "F").alias("fixed"), F.count_if(st == "P").alias("dismissed"), F.sum(m).alias("_rows"), F.coalesce(F.sum(F.when(st != "O", m)), F.lit(0.0)).alias("_walk"))
    saved = F.greatest(F.lit(0.0), F.col("_rows") - F.col("_walk"))
    return s.select("field", "open", "fixed", "dismissed", saved.alias("saved_m"), (saved / speed / 60).alias("minutes"), (saved / speed / 3600 * wage).alias("money"))
