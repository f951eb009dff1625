"""Pixel-wise algebra, thresholds, normalisation, label maps and colour lookups on long-form pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Value count of the unsigned pixel types; their arithmetic wraps.
WRAP = {"uint8": 1 << 8, "uint16": 1 << 16, "uint32": 1 << 32}


def wrap(value: Column, dtype: str = "uint8") -> Column:
    """Modular arithmetic of an unsigned type; ``float32`` and others pass."""
    return F.pmod(value.cast("long"), F.lit(WRAP[dtype])).cast("int" if dtype != "uint32" else "long") if dtype in WRAP else value


def arithmetic(left: DataFrame, right: DataFrame, operand: str, keys=("image_id", "r", "c"), dtype: str = "uint8", accept_singles: bool = False) -> DataFrame:
    """``left`` + - * ``right`` on the pixel key; a pixel of one side only is dropped, or copied with ``accept_singles``."""
    joined = left.select(*keys, F.col("v").alias("a")).join(right.select(*keys, F.col("v").alias("b")), list(keys), "full" if accept_singles else "inner")
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    found = {"+": a + b, "-": a - b, "*": a * b}[operand]
    return joined.select(*keys, wrap(F.coalesce(found, a, b) if accept_singles else found, dtype).alias("v"))


def low_threshold(value: Column, limit: float) -> Column:
    """1 where the value reaches the limit, else 0."""
    return (value >= F.lit(limit)).cast("int")


def quantize(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Scale low..high to 0..255, clip, and cut the fraction off."""
    return F.least(F.greatest((value - low) / (high - low) * 255, F.lit(0.0)), F.lit(255.0)).cast("int")


def zero_one(value: Column) -> Column:
    return value / 255.0


def rgb_range(value: Column, low: float, high: float) -> Column:
    return value * ((high - low) / 255.0) + low


def general_range(value: Column, target: tuple[float, float], source: tuple[float, float]) -> Column:
    """(x - source low) over (source size times target size), plus target low."""
    return (value - source[0]) / ((source[1] - source[0]) * (target[1] - target[0])) + target[0]


def label_map(mapping: dict[int, int]) -> Column:
    """The mapping as a literal; targets must be 0, 1, 2, ... without gaps and sources 0..254."""
    if sorted(set(mapping.values())) != list(range(len(set(mapping.values())))):
        raise ValueError("targets must be contiguous from 0")
    if any(not 0 <= k <= 254 for k in mapping):
        raise ValueError("labels must be 0..254")
    return F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])


def remap_labels(df: DataFrame, mapping: dict[int, int], label: str = "label") -> DataFrame:
    """Replace labels; unknown ones become invalid (``valid`` false) and take the label that maps to 0."""
    mapped = F.try_element_at(label_map(mapping), F.col(label))
    return df.withColumns({"valid": mapped.isNotNull(), label: F.coalesce(mapped, F.lit(0))})


def nonempty_tiles(df: DataFrame, tile: int, label: str = "label") -> DataFrame:
    """``image_id, tile_row, tile_col, nonempty``: a tile is non-empty if some pixel is neither 0 nor 255."""
    return with_tiles(df, tile).groupBy("image_id", "tile_row", "tile_col").agg(F.bool_or(~F.col(label).isin(0, 255)).alias("nonempty"))


def with_tiles(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumns({"tile_row": F.expr(f"cast(r div {tile} as int)"), "tile_col": F.expr(f"cast(c div {tile} as int)")})


def normalize_mask(df: DataFrame, mapping: dict[int, int], empty_label: int, tile: int = 512, label: str = "label") -> DataFrame:
    """Remap the labels of non-empty tiles (others stay as they are) and set whole empty tiles to ``empty_label``."""
    tiles = nonempty_tiles(df, tile, label)
    new = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in sorted(mapping.items()) for x in p]), F.col(label)), F.col(label))
    return with_tiles(df, tile).join(tiles, ["image_id", "tile_row", "tile_col"]).select(
        "image_id", "r", "c", F.when(F.col("nonempty"), new).otherwise(empty_label).cast("int").alias(label))


def stain_lookup(rgb: DataFrame, lut: DataFrame) -> DataFrame:
    """``rgb(image_id, r, c, red, green, blue)`` as fractions; index red*65536 + green*256 + blue of the 0..255 values into ``lut(idx, red, green, blue)``."""
    at = sum(F.floor(F.col(n) * 255).cast("long") * w for n, w in (("red", 65536), ("green", 256), ("blue", 1)))
    new = lut.select("idx", *[F.col(n).alias(f"new_{n}") for n in ("red", "green", "blue")])
    return rgb.withColumn("idx", at).join(new, "idx").select("image_id", "r", "c", *[(F.col(f"new_{n}") / 255.0).alias(n) for n in ("red", "green", "blue")])


def preview(image: DataFrame, palette: DataFrame, alpha: float) -> DataFrame:
    """``image(image_id, r, c, red, green, blue, label)``: labelled pixels turn grey and mix with ``palette(label, pr, pg, pb)``; background stays."""
    grey = 0.2125 * F.col("red") + 0.7154 * F.col("green") + 0.0721 * F.col("blue")
    mixed = lambda n, p: F.when(F.col("label") > 0, grey * (1 - alpha) + F.col(p) * alpha).otherwise(F.col(n).cast("double")).alias(n)
    return image.join(F.broadcast(palette), "label", "left").select("image_id", "r", "c", mixed("red", "pr"), mixed("green", "pg"), mixed("blue", "pb"))


def one_hot(label: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == label, F.lit(1)).otherwise(F.lit(0)))


def argmax_label(scores: Column) -> Column:
    """1-based position of the first largest score."""
    return F.array_position(scores, F.array_max(scores)).cast("int")


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def parse_color(text: Column) -> Column:
    part = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("red"), part(4).alias("green"), part(6).alias("blue"))


def format_color(red: Column, green: Column, blue: Column) -> Column:
    return F.format_string("#%02X%02X%02X", red, green, blue)


def mask_multiply(scores: DataFrame, mask: DataFrame) -> DataFrame:
    """Scores become 0 where the mask is 0 or missing."""
    m = mask.select("image_id", "r", "c", F.col("label").alias("_m"))
    return scores.join(m, ["image_id", "r", "c"], "left").withColumn("v", F.when(F.col("_m") > 0, F.col("v")).otherwise(F.lit(0.0))).drop("_m")


def mask_at(pixels: DataFrame, mask: DataFrame, downsampling: int) -> DataFrame:
    """``pixels`` with the ``label`` of a mask whose pixels are ``downsampling`` times as large; 0 where the mask has none."""
    m = mask.select("image_id", F.col("r").alias("_mr"), F.col("c").alias("_mc"), "label")
    at = pixels.withColumns({"_mr": F.expr(f"cast(r div {downsampling} as int)"), "_mc": F.expr(f"cast(c div {downsampling} as int)")})
    return at.join(m, ["image_id", "_mr", "_mc"], "left").select(*pixels.columns, F.coalesce("label", F.lit(0)).alias("label"))


def reorder_axes(data: Column, channels: int, height: int, width: int, to: str = "BHWC") -> Column:
    """A flat patch array from channel-first to channel-last order (``to="BHWC"``) or back (``"BCHW"``); rows are the batch axis."""
    if to not in ("BHWC", "BCHW"):
        raise ValueError(f"unknown order {to}")
    area = height * width
    source = (lambda k: k % channels * area + F.floor(k / channels)) if to == "BHWC" else (lambda k: k % area * channels + F.floor(k / area))
    return F.transform(F.sequence(F.lit(0), F.lit(channels * area - 1)), lambda k: F.get(data, source(k).cast("int")))
