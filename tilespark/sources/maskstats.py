"""Stored statistics of masks: written once, read or built on demand."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tilespark.operators import maskstats

KEYS = ["image_id", "tile_row", "tile_col", "label", "n", "tile", "spacing"]


def write(mask: DataFrame, path: str, tile: int = 512, spacing: float | None = None) -> None:
    """Counts by tile and label of ``mask(image_id, r, c, label)`` with tile size and spacing, as one Parquet table; what stood at the path is replaced."""
    counts = maskstats.tile_counts(mask, tile).withColumns({"tile": F.lit(tile), "spacing": F.lit(spacing).cast("double")})
    counts.select(*KEYS).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; one that lacks a column is an error."""
    found = spark.read.parquet(path)
    if missing := set(KEYS) - set(found.columns):
        raise ValueError(f"no mask statistics, for want of {sorted(missing)}")
    return found.select(*KEYS)


def open_or_build(mask: DataFrame, path: str, tile: int = 512, spacing: float | None = None) -> DataFrame:
    """The stored statistics if the path holds some, else those of the mask, stored there. Of another tile size they are an error."""
    spark = mask.sparkSession
    try:
        found = read(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        write(mask, path, tile, spacing)
        return read(spark, path)
    other = found.where(F.col("tile") != tile).select("tile").first()
    if other:
        raise ValueError(f"the statistics have tiles of {other['tile']} pixels, not {tile}")
    return found
