"""Pyramid levels: lookup by pixel spacing, correction, and choice of a mask level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def level_by_spacing(levels: DataFrame, wanted: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """``levels(image_id, level, spacing)``, ``wanted(image_id, want)`` -> the first level whose tolerance interval holds ``want``, else null."""
    fits = F.col("want").between(F.col("spacing") * (1 - tolerance), F.col("spacing") * (1 + tolerance))
    found = wanted.join(levels, "image_id", "left").groupBy("image_id", "want").agg(
        F.min(F.when(fits, F.struct("level", "spacing"))).alias("m"))
    return found.select("image_id", "want", F.col("m.level").alias("level"), F.col("m.spacing").alias("spacing"))


def correct_spacing(levels: DataFrame, level: int, spacing: float) -> DataFrame:
    """Set the spacing of one level and scale all others by their downsampling."""
    own = levels.where(F.col("level") == level).select("image_id", F.col("downsampling").alias("_own"))
    return levels.join(F.broadcast(own), "image_id").withColumn("spacing", F.lit(spacing) * F.col("downsampling") / F.col("_own")).drop("_own")


def mask_level(levels: DataFrame, masks: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """For each ``levels(image_id, level, rows, cols, spacing)``: the mask level of equal shape; else of fitting spacing; else the last one that is not coarser."""
    m = masks.select("image_id", *[F.col(n).alias(f"m_{n}") for n in ("level", "rows", "cols", "spacing")])
    j = levels.join(m, "image_id", "left")
    shape = (F.col("rows") == F.col("m_rows")) & (F.col("cols") == F.col("m_cols"))
    near = F.col("spacing").between(F.col("m_spacing") * (1 - tolerance), F.col("m_spacing") * (1 + tolerance))
    finer = F.col("m_spacing") <= F.col("spacing")
    return j.groupBy("image_id", "level").agg(
        F.coalesce(F.min(F.when(shape, F.col("m_level"))), F.min(F.when(near, F.col("m_level"))), F.max(F.when(finer, F.col("m_level")))).alias("mask_level"))


def interpolation_defaults(levels: DataFrame) -> DataFrame:
    """Writer defaults: monochrome images get lzw and nearest, all others jpeg and linear."""
    mono = F.col("coding") == "monochrome"
    return levels.withColumns({"compression": F.when(mono, "lzw").otherwise("jpeg"), "interpolation": F.when(mono, "nearest").otherwise("linear"), "skip_empty": mono})


def match_stats(levels: DataFrame, stats: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """``levels(image_id, level, height, width, spacing)``, ``stats(image_id, height, width, spacing)`` -> the first level of each image that the statistics fit.

    Shapes must be equal and spacings closer than ``tolerance``; images without such a level give no row.
    """
    own = stats.select("image_id", "height", "width", F.col("spacing").alias("_s"))
    return levels.join(own, ["image_id", "height", "width"]).where(F.abs(F.col("spacing") - F.col("_s")) < tolerance).groupBy("image_id").agg(F.min("level").alias("level"))
