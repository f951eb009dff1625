"""Slides: stored pyramids that know their pixel spacings, and windows read at a spacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilespark.operators.levels import level_by_spacing
from tilespark.sources import images


def write(pixels: DataFrame, spacings: DataFrame, path: str, levels: int = 3, tile: int = 512, interpolation: str = "nearest", value: str = "v") -> None:
    """``pixels(image_id, r, c, <value>)`` and ``spacings(image_id, spacing)`` of level 0 as tiles of all levels and a table of levels under ``path``.

    An image without a positive spacing, or with two of them, is an error before anything is written. Images that are written again replace
    themselves; others stay.
    """
    shapes = pixels.groupBy("image_id").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    known = spacings.where((F.col("spacing") > 0) & (F.col("spacing") < float("inf"))).groupBy("image_id").agg(
        F.min("spacing").cast("double").alias("spacing"), F.max("spacing").cast("double").alias("_high"))
    broken = shapes.join(known.where(F.col("spacing") == F.col("_high")), "image_id", "left_anti").select("image_id").take(5)
    if broken:
        raise ValueError(f"images without one positive spacing: {[r['image_id'] for r in broken]}, ..")
    images.write_pyramid(pixels, f"{path}/tiles", levels, tile, interpolation, value=value)
    each = shapes.join(known, "image_id").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    scale = F.pow(F.lit(2.0), F.col("level"))
    table = each.select("image_id", "level", F.ceil(F.col("rows") / scale).cast("int").alias("rows"), F.ceil(F.col("cols") / scale).cast("int").alias("cols"),
                        (F.col("spacing") * scale).alias("spacing"), scale.alias("downsampling"), F.lit(tile).alias("tile"))
    table.repartition("image_id").write.partitionBy("image_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/levels")


def levels(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, level, rows, cols, spacing, downsampling, tile`` of every stored level."""
    found = spark.read.parquet(f"{path}/levels")
    return found.select(F.col("image_id").cast("long").alias("image_id"), *[c for c in found.columns if c != "image_id"])


def placed(spark: SparkSession, path: str, windows: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """``windows(window_id, image_id, spacing, row, col, height, width)`` with the first level that fits their spacing, cut to the level's extent.

    ``level`` is null where the image is not stored, or none of its levels fits.
    """
    held = levels(spark, path)
    keyed = windows.select("window_id", F.col("image_id").cast("long").alias("image_id"), F.col("spacing").cast("double").alias("want"), "row", "col", "height", "width")
    fits = level_by_spacing(held, keyed.select("image_id", "want").distinct(), tolerance).select("image_id", "want", "level")
    out = keyed.join(fits, ["image_id", "want"], "left").join(held.select("image_id", "level", "rows", "cols", "tile"), ["image_id", "level"], "left")
    top, left = F.greatest("row", F.lit(0)), F.greatest("col", F.lit(0))
    return out.select("window_id", "image_id", F.col("want").alias("spacing"), "level", "row", "col", "tile", top.alias("top"), left.alias("left"),
                      (F.least(F.col("row") + F.col("height"), "rows") - 1).alias("bottom"), (F.least(F.col("col") + F.col("width"), "cols") - 1).alias("right"))


def read(spark: SparkSession, path: str, windows: DataFrame, tolerance: float = 0.25, strict: bool = True, value: str = "v") -> DataFrame:
    """The pixels of many windows: ``window_id, image_id, level, r, c, <value>``, addressed from the window's own corner.

    Row and column of a window count pixels of the level that fits its spacing; what lies outside the image gives no pixel. ``strict`` makes a window without a
    fitting level an error, else it gives no rows. Only images and levels that some window needs are listed, and of their tiles only those that
    a window touches are cut, line by line.
    """
    at = placed(spark, path, windows, tolerance)
    if strict:
        lost = at.where(F.col("level").isNull()).select("window_id", "image_id", "spacing").take(5)
        if lost:
            raise ValueError(f"no level fits within {tolerance}: {[tuple(r) for r in lost]}, ..")
    span = lambda a, b: F.explode(F.sequence(F.expr(f"cast({a} div tile as int)"), F.expr(f"cast({b} div tile as int)")))
    touched = at.where("top <= bottom and left <= right").withColumn("tile_row", span("top", "bottom")).withColumn("tile_col", span("left", "right"))
    tiles = spark.read.parquet(f"{path}/tiles")
    found = touched.join(tiles.select("image_id", "level", "tile_row", "tile_col", "w", "data"), ["image_id", "level", "tile_row", "tile_col"])
    cut = found.withColumns({"c0": F.expr("greatest(left, tile_col * tile)"), "c1": F.expr("least(right, tile_col * tile + w - 1)"),
                             "r0": F.expr("greatest(top, tile_row * tile)"), "r1": F.expr("least(bottom, tile_row * tile + cast(size(data) / w as int) - 1)")})
    lines = cut.where("c0 <= c1 and r0 <= r1").withColumn("r", F.explode(F.sequence("r0", "r1")))
    line = F.expr("slice(data, cast((r - tile_row * tile) * w + c0 - tile_col * tile + 1 as int), cast(c1 - c0 + 1 as int))")
    out = lines.select("window_id", "image_id", "level", (F.col("r") - F.col("row")).cast("int").alias("r"), (F.col("c0") - F.col("col")).alias("_c"), F.posexplode(line).alias("_k", value))
    return out.where(F.col(value).isNotNull()).select("window_id", "image_id", "level", "r", (F.col("_c") + F.col("_k")).cast("int").alias("c"), value)
