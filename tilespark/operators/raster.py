"""Reads and writes of rasters: window reads with padding, tile assembly, empty-tile skipping, form conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tilespark.operators.pointwise import with_tiles


def window_read(pixels: DataFrame, row: int, col: int, height: int, width: int, fill=0, value: str = "v", tile: int = 512) -> DataFrame:
    """The window's pixels, addressed from its own corner; what lies outside the image is ``fill``.

    The bounds on rows and columns reach the scan; where the table holds ``tile_row, tile_col`` the derived bounds on them do as well.
    """
    inside = F.col("r").between(row, row + height - 1) & F.col("c").between(col, col + width - 1)
    if "tile_row" in pixels.columns:
        inside &= F.col("tile_row").between(row // tile, (row + height - 1) // tile) & F.col("tile_col").between(col // tile, (col + width - 1) // tile)
    cut = pixels.where(inside).select("image_id", (F.col("r") - row).alias("r"), (F.col("c") - col).alias("c"), F.col(value).alias("_v"))
    images = pixels.select("image_id").distinct()
    full = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return full.join(cut, ["image_id", "r", "c"], "left").select("image_id", "r", "c", F.coalesce("_v", F.lit(fill)).alias(value))


def to_tiles(pixels: DataFrame, tile: int, value: str = "v") -> DataFrame:
    """Row-major arrays by tile: ``image_id, tile_row, tile_col, h, w, data``; pixels missing inside a tile's extent are null."""
    t = with_tiles(pixels, tile)
    cell = F.struct((F.col("r") % tile).alias("y"), (F.col("c") % tile).alias("x"), F.col(value).alias("v"))
    g = t.groupBy("image_id", "tile_row", "tile_col").agg(
        (F.max(F.col("r") % tile) + 1).alias("h"), (F.max(F.col("c") % tile) + 1).alias("w"), F.array_sort(F.collect_list(cell)).alias("cells"))
    gaps = """concat(flatten(transform(cells, (x, i) -> concat(
        array_repeat(null, x.y * w + x.x - if(i = 0, 0, cells[i - 1].y * w + cells[i - 1].x + 1)), array(x.v)))),
        array_repeat(null, h * w - 1 - element_at(cells, -1).y * w - element_at(cells, -1).x))"""
    return g.select(
        "image_id", "tile_row", "tile_col", "h", "w",
        F.when(F.size("cells") == F.col("h") * F.col("w"), F.transform("cells", lambda x: x["v"])).otherwise(F.expr(gaps)).alias("data"))


def to_pixels(tiles: DataFrame, tile: int, value: str = "v") -> DataFrame:
    """Inverse of ``to_tiles``; null cells give no pixel."""
    p = tiles.select("image_id", "tile_row", "tile_col", "w", F.posexplode("data").alias("p", "_v")).where("_v is not null")
    return p.select("image_id", F.expr(f"cast(tile_row * {tile} + p div w as int)").alias("r"), F.expr(f"cast(tile_col * {tile} + p % w as int)").alias("c"), F.col("_v").alias(value))


def skip_empty(pixels: DataFrame, tile: int, empty=0, value: str = "label") -> DataFrame:
    """Pixels of the tiles that hold something other than the empty value."""
    t = with_tiles(pixels, tile)
    full = t.where(F.col(value) != empty).select("image_id", "tile_row", "tile_col").distinct()
    return t.join(full, ["image_id", "tile_row", "tile_col"], "left_semi").select("image_id", "r", "c", value)


def select_channels(pixels: DataFrame, channels: list[int]) -> DataFrame:
    """Keep the listed channels, renumbered in the listed order; ``pixels(image_id, r, c, ch, v)``."""
    order = F.create_map(*[F.lit(x) for i, ch in enumerate(channels) for x in (ch, i)])
    return pixels.where(F.col("ch").isin(channels)).withColumn("ch", F.element_at(order, F.col("ch")))


def reflect_index(index, size: int):
    """Mirror an index into 0..size-1 without repeating the border."""
    period = max(1, 2 * (size - 1))
    m = F.pmod(index, F.lit(period))
    return F.when(m < size, m).otherwise(period - m).cast("int")


def _reflections(index, size: int, pad: int):
    """All places of 0..size+2*pad-1 whose mirrored index is ``index``: the inverse of ``reflect_index`` after a pad."""
    period, last = max(1, 2 * (size - 1)), size + 2 * pad - 1
    ways = []
    for at in (pad + index, pad - index):
        first = F.pmod(at, F.lit(period)).cast("int")
        ways.append(F.when(first <= last, F.sequence(first, F.greatest(first, F.lit(last)), F.lit(period))).otherwise(F.array().cast("array<int>")))
    return F.array_union(*ways)


def reflect_pad(pixels: DataFrame, height: int, width: int, pad: int, value: str = "v") -> DataFrame:
    """Pad by mirroring: each target pixel takes the source pixel of its mirrored address. Source pixels are dealt to their places, so no grid is joined."""
    inside = pixels.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    rows = inside.select("image_id", F.explode(_reflections(F.col("r"), height, pad)).alias("r"), "c", value)
    return rows.select("image_id", "r", F.explode(_reflections(F.col("c"), width, pad)).alias("c"), value)
