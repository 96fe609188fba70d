"""Ordered sequences: runs, gaps, interval unions, folds, event logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch


def runs(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Run-length encoding by gaps and islands: key, flag, start, end (half open, positions in order), length."""
    w = W.partitionBy(key).orderBy(*order)
    d = df.select(key, *order, F.coalesce(flag, F.lit(False)).alias("flag")).withColumn("i", F.row_number().over(w) - 1)
    d = d.withColumn("island", F.col("i") - F.row_number().over(W.partitionBy(key, "flag").orderBy(*order)))
    return d.groupBy(key, "flag", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end")).select(key, "flag", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("end") - F.col("start")).cast("long").alias("length"))


def interior_gaps(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """False runs with True on either side."""
    r = runs(df, key, order, flag)
    w = W.partitionBy(key).orderBy("start")
    return r.withColumn("before", F.lag("flag").over(w)).withColumn("after", F.lead("flag").over(w)).where("NOT flag AND before AND after").drop("flag", "before", "after")


def neighbour_median(df: DataFrame, lattice: str, order: str, value: str, reach: int = 2) -> DataFrame:
    """df with n and med: count and median of the value at the nearest rows on either side on one lattice, the row itself left out."""
    w = W.partitionBy(lattice).orderBy(order)
    near = F.concat(F.collect_list(value).over(w.rowsBetween(-reach, -1)), F.collect_list(value).over(w.rowsBetween(1, reach)))
    d = df.withColumn("_s", F.array_sort(near)).withColumn("n_near", F.size("_s").cast("long"))
    mid = lambda i: F.get("_s", i.cast("int"))
    return d.withColumn("med_near", F.when(F.col("n_near") > 0, (mid(F.floor((F.col("n_near") - 1) / 2)) + mid(F.floor(F.col("n_near") / 2))) / 2)).drop("_s")


def covered_length(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key: length of the union of intervals, by the running maximum of ends."""
    w = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumn("_reach", F.max(end).over(w))
    add = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce("_reach", F.col(start))))
    return d.groupBy(key).agg(F.sum(add).alias("covered"))


def merged_intervals(df: DataFrame, key: str, start: str, end: str, tolerance: float) -> DataFrame:
    """Intervals joined where the next begins no more than ``tolerance`` after the reach so far."""
    w = W.partitionBy(key).orderBy(start, end)
    d = df.withColumn("_reach", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    d = d.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > tolerance), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("pieces")).drop("_island")


def bridges(df: DataFrame, key: str, start: str, end: str, least: float = 0.05, most: float = 15.0) -> DataFrame:
    """Holes between sorted pieces: key, hole_start, hole_end where least < start - reach <= most."""
    w = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumn("_reach", F.max(end).over(w))
    return d.where((F.col(start) - F.col("_reach") > least) & (F.col(start) - F.col("_reach") <= most)).select(key, F.col("_reach").alias("hole_start"), F.col(start).alias("hole_end"))


def fold_events(events: DataFrame, key: str, seq: list[str], status: str, role: str) -> DataFrame:
    """Last event wins: key, status, last_at (first of ``seq``), events, approved (the last role is the inspector's)."""
    last = F.max_by(F.struct(status, role, seq[0]), F.struct(*seq))
    d = events.groupBy(key).agg(last.alias("last"), F.count("*").alias("events"))
    return d.select(key, F.col("last")[status].alias("status"), F.col("last")[seq[0]].alias("last_at"), "events", (F.col("last")[role] == "inspector").alias("approved"))


def greedy_spacing(df: DataFrame, key: str, day: str, least: int, keep: int) -> DataFrame:
    """Newest first, each at least ``least`` days before the one kept last; the first ``keep`` of each key."""
    days = F.sort_array(F.collect_set(day), asc=False)
    fold = F.aggregate(days, F.expr("cast(array() as array<date>)"), lambda a, d: F.when((F.size(a) < keep) & ((F.size(a) == 0) | (F.date_diff(F.element_at(a, -1), d) >= least)), F.concat(a, F.array(d))).otherwise(a))
    return df.where(F.col(day).isNotNull()).groupBy(key).agg(fold.alias("days")).select(key, F.posexplode("days").alias("rank", "day"))


def pack(df: DataFrame, key: str, order: str, size: str, limit: float) -> DataFrame:
    """Greedy next-fit in order, within each key: part numbers from 1; linear in a key's rows, which are one inventory."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        part, used, parts = 1, 0.0, []
        for s in pdf[size].to_numpy(float):
            if used > 0 and used + s > limit:
                part, used = part + 1, 0.0
            used += s
            parts.append(part)
        return pdf[[key, order]].assign(part=parts)

    kinds = dict(df.dtypes)
    return df.select(key, order, F.col(size).cast("double").alias(size)).groupBy(key).applyInPandas(fit, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, part int")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place in one order of all rows, from 1, without a task that sees all rows: ranges are sorted on their own and start where those before them end. Give an order without ties."""
    scratch = Scratch(df.sparkSession, "numbered")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    d = scratch.write(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    return d.join(F.broadcast(sizes.drop("_n")), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def local_maxima(df: DataFrame, key: str, i: str, value: str, reach: int, above: Column) -> DataFrame:
    """Rows whose value is the maximum of 2 reach + 1 positions and over ``above``."""
    w = W.partitionBy(key).orderBy(i).rowsBetween(-reach, reach)
    return df.withColumn("_top", F.max(value).over(w)).where((F.col(value) == F.col("_top")) & (F.col(value) > above)).drop("_top")


def top_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def placed(df: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's place in the order of its key's list, from 1; give an order without ties."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long"))


def within_budget(df: DataFrame, key: str, order: list[str], length: str, budget: int) -> DataFrame:
    """Per key: rows shown while the running length stays within the budget, and how many more there are."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("_sum", F.sum(length).over(w))
    return d.groupBy(key).agg(F.count_if(F.col("_sum") <= budget).alias("shown"), F.count_if(F.col("_sum") > budget).alias("more"), F.coalesce(F.max(F.when(F.col("_sum") <= budget, F.col("_sum"))), F.lit(0)).alias("used"))
