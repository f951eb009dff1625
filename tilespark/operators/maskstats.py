"""Label statistics of masks: counts by tile, prefix sums, and the k-th pixel of a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tilespark.operators.pointwise import with_tiles


def tile_counts(mask: DataFrame, tile: int = 512) -> DataFrame:
    """``image_id, tile_row, tile_col, label, n``."""
    return with_tiles(mask, tile).groupBy("image_id", "tile_row", "tile_col", "label").agg(F.count("*").alias("n"))


def label_counts(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image_id", "label").agg(F.count("*").alias("n"))


def tile_prefix(counts: DataFrame) -> DataFrame:
    """``n_cum``: running label counts along the tile columns of each tile row."""
    w = Window.partitionBy("image_id", "label", "tile_row").orderBy("tile_col").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("n_cum", F.sum("n").over(w))


def tile_row_prefix(counts: DataFrame) -> DataFrame:
    """Counts by tile row with their running sum over the tile rows."""
    rows = counts.groupBy("image_id", "label", "tile_row").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("image_id", "label").orderBy("tile_row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n_cum", F.sum("n").over(w))


def homogeneous_tiles(counts: DataFrame, tile: int = 512) -> DataFrame:
    """Tiles that hold one label only, over their full size."""
    return counts.where(F.col("n") == tile * tile).select("image_id", "tile_row", "tile_col", "label")


def pixel_of_label(mask: DataFrame, wanted: DataFrame, tile: int = 512) -> DataFrame:
    """``wanted(image_id, label, k)`` -> the k-th pixel (from 0) of the label in order of (tile row, tile column, row, column).

    A two-level select: prefix sums over tiles find the tile that holds the k-th pixel, and only pixels of such tiles are
    ranked, so no window runs over all pixels of a label.
    """
    counts = tile_counts(mask, tile)
    w = Window.partitionBy("image_id", "label").orderBy("tile_row", "tile_col").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    hit = wanted.join(upto, ["image_id", "label"]).where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("upto")))
    hit = hit.select("image_id", "label", "k", "tile_row", "tile_col", (F.col("k") - F.col("before")).alias("at"))
    tiles = hit.select("image_id", "label", "tile_row", "tile_col").distinct()
    inner = Window.partitionBy("image_id", "label", "tile_row", "tile_col").orderBy("r", "c")
    ranked = with_tiles(mask, tile).join(tiles, ["image_id", "label", "tile_row", "tile_col"], "left_semi").withColumn("at", (F.row_number().over(inner) - 1).cast("long"))
    return hit.join(ranked, ["image_id", "label", "tile_row", "tile_col", "at"]).select("image_id", "label", "k", "r", "c")
