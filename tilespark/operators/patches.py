"""Patch windows over images: extraction, central labels, synthesis of label patches from homogeneous tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tilespark.operators import maskstats
from tilespark.operators.pointwise import with_tiles


def centre(coordinate: float, ratio: float) -> int:
    """A sampled coordinate on another level: cut after scaling, moved to the middle of the pixel it stands for."""
    return int(coordinate * ratio) + max(0, int(ratio) // 2 - 1)


def _cells(centres: DataFrame, height: int, width: int) -> DataFrame:
    """Every cell of every patch with the pixel it shows; the window starts (shape - 1) // 2 before the centre."""
    grid = centres.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.withColumns({"r": F.col("row") - (height - 1) // 2 + F.col("y"), "c": F.col("col") - (width - 1) // 2 + F.col("x")})


def extract(centres: DataFrame, pixels: DataFrame, height: int, width: int, value: str = "v", tile: int = 512) -> DataFrame:
    """``centres(image_id, patch_id, row, col)`` -> ``image_id, patch_id, y, x, <value>``; outside the image 0.

    Patches are dealt to the tiles their windows touch; tiles meet them there, so pixels of tiles that no window touches drop out
    before the cells are joined.
    """
    cells = _cells(centres, height, width)
    touched = cells.select("image_id", F.expr(f"cast(floor(r / {tile}) as int)").alias("tile_row"), F.expr(f"cast(floor(c / {tile}) as int)").alias("tile_col")).distinct()
    near = with_tiles(pixels.select("image_id", "r", "c", value), tile).join(touched, ["image_id", "tile_row", "tile_col"], "left_semi").drop("tile_row", "tile_col")
    return cells.join(near, ["image_id", "r", "c"], "left").select("image_id", "patch_id", "y", "x", F.coalesce(value, F.lit(0)).alias(value))


def central_labels(centres: DataFrame, mask: DataFrame) -> DataFrame:
    m = mask.select("image_id", F.col("r").alias("row"), F.col("c").alias("col"), "label")
    return centres.join(m, ["image_id", "row", "col"])


def synthesize(centres: DataFrame, mask: DataFrame, height: int, width: int, tile: int = 512) -> DataFrame:
    """Label patches from tile statistics: a homogeneous tile gives its constant, a missing one 0, only mixed tiles are read by pixel."""
    cells = with_tiles_floor(_cells(centres, height, width), tile)
    constant = maskstats.homogeneous_tiles(maskstats.tile_counts(mask, tile), tile).withColumnRenamed("label", "_const")
    keyed = cells.join(constant, ["image_id", "tile_row", "tile_col"], "left")
    same = keyed.where("_const is not null").select("image_id", "patch_id", "y", "x", F.col("_const").alias("label"))
    mixed = keyed.where("_const is null").join(mask.select("image_id", "r", "c", "label"), ["image_id", "r", "c"], "left")
    return same.unionByName(mixed.select("image_id", "patch_id", "y", "x", F.coalesce("label", F.lit(0)).alias("label")))


def with_tiles_floor(df: DataFrame, tile: int) -> DataFrame:
    """Tile address of cells that may lie outside the image (negative addresses included)."""
    return df.withColumns({"tile_row": F.expr(f"cast(floor(r / {tile}) as int)"), "tile_col": F.expr(f"cast(floor(c / {tile}) as int)")})
