"""Binary dilation and erosion by an L1 distance, and region margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tilespark.functions.storage import materialize
from tilespark.operators import distance

#: Tile of the distance arrays.
TILE = 512


def iterations(distance: float, spacing: float) -> int:
    """Half-even rounding of distance over spacing."""
    return round(distance / spacing)


def dilate(mask: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Pixels within L1 distance k of the foreground ``mask(image_id, r, c)``, inside the image."""
    return distance.between(distance.distances(mask, height, width, TILE), 0, k, TILE).select("image_id", "r", "c")


def erode(mask: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Foreground pixels farther than k from all background; outside the image counts as background."""
    far = distance.distances(mask, height, width, TILE, invert=True, border=True)
    return distance.between(far, k + 1, height + width, TILE).select("image_id", "r", "c")


def margins(mask: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """``image_id, r, c, side``: inner (foreground that erosion removes) and outer (background that dilation adds)."""
    stored = materialize(mask.select("image_id", "r", "c"), "mask")
    side = lambda invert, name: distance.between(distance.distances(stored, height, width, TILE, invert, invert), 1, k, TILE).select(
        "image_id", "r", "c", F.lit(name).alias("side"))
    return side(True, "inner").unionByName(side(False, "outer"))
