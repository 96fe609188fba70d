"""Measurement reports: filters over scored features and the total / block / row roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURED = ("row", "vineyard", "interrow_area")


def is_scored(source: Column) -> Column:
    """All but predictions; a feature without a source is scored."""
    return ~source.eqNullSafe(F.lit("prediction"))


def scored(features: DataFrame, *labels: str) -> DataFrame:
    out = features.where(is_scored(F.col("source")))
    return out.where(F.col("label").isin(*labels)) if labels else out


def _of(label: str, value: Column) -> Column:
    return F.when(F.col("label") == label, value)


def measurement_rows(features: DataFrame, digits: int = 3) -> DataFrame:
    """Levels total, block and row in one pass of grouping sets.

    ``features``: label, source, vineyard_id, row_id, length_m, area_m2 (areas of disjoint geometries, or
    already united). Blocks are the non-empty ids of any measured label; the total's rows are the distinct row
    ids of all scored rows, a missing id counting as one.
    """
    f = scored(features, *MEASURED).select("label", "length_m", "area_m2", F.coalesce("vineyard_id", F.lit("")).alias("v"), F.when(F.col("label") == "row", F.coalesce("row_id", F.lit(""))).alias("r"))
    sums = f.groupingSets([["v", "r"], ["v"], []], "v", "r").agg(
        F.grouping_id().alias("level"),
        F.count_distinct(F.nullif("v", F.lit(""))).alias("block_count"),
        F.count_distinct("r").alias("row_count"),
        F.coalesce(F.sum(_of("row", F.col("length_m"))), F.lit(0.0)).alias("length"),
        F.coalesce(F.sum(_of("vineyard", F.col("area_m2"))), F.lit(0.0)).alias("canopy"),
        F.coalesce(F.sum(_of("interrow_area", F.col("area_m2"))), F.lit(0.0)).alias("interrow"),
    )
    sums = sums.where("level = 3 OR (v <> '' AND (level = 1 OR r IS NOT NULL))")
    wide = F.col("level") > 0
    out = lambda c, name: F.when(wide, F.round(c, digits)).alias(name)
    return sums.select(
        F.when(F.col("level") == 3, "total").when(F.col("level") == 1, "block").otherwise("row").alias("level"),
        F.coalesce("v", F.lit("")).alias("vineyard_id"),
        F.when(F.col("level") == 0, F.col("r")).otherwise("").alias("row_id"),
        F.when(F.col("level") == 3, F.col("block_count")).alias("block_count"),
        F.when(wide, F.col("row_count")).alias("row_count"),
        F.round("length", digits).alias("row_length_m"),
        out(F.col("canopy"), "canopy_area_m2"),
        out(F.col("canopy") / 1e4, "canopy_area_ha"),
        out(F.col("interrow"), "interrow_area_m2"),
        out(F.col("interrow") / 1e4, "interrow_area_ha"),
    )


def report_order(report: DataFrame) -> DataFrame:
    """Total first, then each block followed by its rows, ids by byte order."""
    rank = F.when(F.col("level") == "total", 0).when(F.col("level") == "block", 1).otherwise(2)
    return report.orderBy(F.when(F.col("level") == "total", 0).otherwise(1), "vineyard_id", rank, "row_id")


def with_estimates(features: DataFrame) -> DataFrame:
    """Scored features, and predictions of the fields that have none, flagged ``estimate``."""
    ok = scored(features)
    fields = ok.where("vineyard_id <> ''").select("vineyard_id").distinct()
    rest = features.where(~is_scored(F.col("source"))).join(fields, "vineyard_id", "left_anti")
    return ok.withColumn("estimate", F.lit(False)).unionByName(rest.withColumn("estimate", F.lit(True)))


def planning_world(features: DataFrame, share: float = 0.25) -> DataFrame:
    """The scored world if it has at least ``share`` of the predicted inter-rows, else predictions as ``dev`` and organizer features; tiles go."""
    n = features.where("label = 'interrow_area'").agg(F.count_if(is_scored(F.col("source"))).alias("s"), F.count_if(F.col("source").eqNullSafe(F.lit("prediction"))).alias("p"))
    f = features.where("label <> 'tile'").crossJoin(F.broadcast(n.select((F.col("s") >= share * F.col("p")).alias("use_scored"))))
    kept = F.when(F.col("use_scored"), is_scored(F.col("source"))).otherwise(F.col("source").isin("prediction", "organizer"))
    return f.where(kept).withColumn("source", F.when(~F.col("use_scored") & (F.col("source") == "prediction"), "dev").otherwise(F.col("source"))).drop("use_scored")


def overlay(scene: DataFrame, layers: DataFrame) -> DataFrame:
    """Layer features whose label the scene lacks; inspections only as challenges or for a satellite reason."""
    extra = layers.join(scene.select("label").distinct(), "label", "left_anti")
    return extra.where("label <> 'inspection' OR challenge OR reason LIKE 'sentinel%'")
