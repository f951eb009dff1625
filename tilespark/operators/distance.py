"""Exact L1 distances by sweeps over tile arrays with carried borders.

The L1 distance is the distance along columns followed by the one along rows. A sweep along one axis needs from the tiles before and behind
a tile two numbers a line: the least of distance less position, and of distance plus position. These summaries are a table of their own, a
row for each line and tile, and running minima over it carry them across the image. Work and rows don't depend on how far distances reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tilespark.functions.storage import materialize

_FAR = 1 << 30
#: Pixels of tiles that are passed on at once, about.
_CELLS = 1 << 18
_TILES = "image_id long, tile_row int, tile_col int, h int, w int, d binary"
_KEY = ["image_id", "tile_row", "tile_col"]


def _packed(mask: DataFrame, height: int, width: int, tile: int, invert: bool) -> DataFrame:
    """All tiles of the mask's images with distance 0 on the foreground (``invert``: on the background) and far away elsewhere."""
    inside = mask.select("image_id", "r", "c").where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    at = ((F.col("r") % tile) * tile + F.col("c") % tile).cast("int")
    cells = inside.groupBy("image_id", F.expr(f"cast(r div {tile} as int)").alias("tile_row"), F.expr(f"cast(c div {tile} as int)").alias("tile_col")).agg(F.collect_list(at).alias("at"))
    grid = mask.select("image_id").distinct().withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.lit((height - 1) // tile)))).withColumn(
        "tile_col", F.explode(F.sequence(F.lit(0), F.lit((width - 1) // tile))))
    joined = grid.join(cells.hint("merge"), _KEY, "left").select(
        *_KEY, F.least(F.lit(tile), F.lit(height) - F.col("tile_row") * tile).cast("int").alias("h"), F.least(F.lit(tile), F.lit(width) - F.col("tile_col") * tile).cast("int").alias("w"), "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, w, at in zip(batch["h"], batch["w"], batch.pop("at")):
                hit = np.zeros((tile, tile), bool)
                if at is not None:
                    hit.ravel()[np.asarray(at, np.int64)] = True
                out.append(np.where(hit[:h, :w] != invert, 0, _FAR).astype("<i4").tobytes())
            yield batch.assign(d=out)

    return joined.mapInPandas(run, _TILES)


def _sweep(tiles: DataFrame, axis: int, size: int, tile: int, border: bool) -> DataFrame:
    """Distances carried along one axis of the whole image; with ``border`` both ends of every line are sources just outside."""
    step, across = ("tile_row", "tile_col") if axis == 0 else ("tile_col", "tile_row")

    def grid(h: int, w: int, d: bytes) -> np.ndarray:
        """Lines in rows, positions in columns."""
        a = np.frombuffer(d, "<i4").reshape(h, w).astype(np.int64)
        return a.T if axis == 0 else a

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low, high = [], []
            for at, h, w, d in zip(batch[step], batch["h"], batch["w"], batch["d"]):
                a = grid(h, w, d)
                pos = np.arange(a.shape[1]) + at * tile
                low.append((a - pos).min(axis=1))
                high.append((a + pos).min(axis=1))
            yield batch[_KEY].assign(low=pd.Series(low, dtype=object, index=batch.index), high=pd.Series(high, dtype=object, index=batch.index))

    lines = tiles.mapInPandas(sums, "image_id long, tile_row int, tile_col int, low array<long>, high array<long>")
    lines = lines.select(*_KEY, F.posexplode(F.arrays_zip("low", "high")).alias("line", "s")).select(*_KEY, "line", "s.low", "s.high")
    order = Window.partitionBy("image_id", across, "line").orderBy(step)
    before = F.min("low").over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min("high").over(order.rowsBetween(1, Window.unboundedFollowing))
    carried = lines.select(*_KEY, "line", F.least(before, F.lit(1 if border else _FAR).cast("long")).alias("low"), F.least(behind, F.lit(size if border else 2 * _FAR).cast("long")).alias("high"))
    sides = carried.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("line", "low", "high"))).alias("s"))
    both = tiles.join(sides.hint("merge"), _KEY).select(*_KEY, "h", "w", "d", F.col("s.low").alias("low"), F.col("s.high").alias("high"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, h, w, d, low, high in zip(batch[step], batch["h"], batch["w"], batch["d"], batch.pop("low"), batch.pop("high")):
                a = grid(h, w, d)
                pos = np.arange(a.shape[1]) + at * tile
                fore = np.minimum(np.minimum.accumulate(a - pos, axis=1), np.asarray(low, np.int64)[:, None]) + pos
                back = np.minimum(np.minimum.accumulate((a + pos)[:, ::-1], axis=1)[:, ::-1], np.asarray(high, np.int64)[:, None]) - pos
                best = np.minimum(np.minimum(fore, back), _FAR)
                out.append(np.ascontiguousarray(best.T if axis == 0 else best).astype("<i4").tobytes())
            yield batch.assign(d=out)

    return both.mapInPandas(run, _TILES)


def distances(mask: DataFrame, height: int, width: int, tile: int = 512, invert: bool = False, border: bool = False) -> DataFrame:
    """``mask(image_id, r, c)`` -> tiles ``image_id, tile_row, tile_col, h, w, d``: L1 distances to the nearest foreground pixel as little-endian 32-bit integers.

    With ``invert`` to the nearest background pixel; with ``border`` what lies outside the image is a source as well. 2^30 stands for no
    source at all. Images without a pixel in ``mask`` are unknown here and give nothing.
    """
    first = materialize(_packed(mask, height, width, tile, invert), "tiles")
    second = materialize(_sweep(first, 0, height, tile, border), "tiles")
    return _sweep(second, 1, width, tile, border)


def between(tiles: DataFrame, low: int, high: int, tile: int) -> DataFrame:
    """``image_id, r, c, d`` of the pixels whose distance is from ``low`` to ``high``."""

    def rows(found: list) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("image_id", "r", "c", "d"), map(np.concatenate, zip(*found)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, cells = [], 0
            for image, ty, tx, h, w, d in zip(*(batch[c] for c in ("image_id", "tile_row", "tile_col", "h", "w", "d"))):
                a = np.frombuffer(d, "<i4").reshape(h, w)
                r, c = np.nonzero((a >= low) & (a <= high))
                found.append((np.full(len(r), image, np.int64), (r + ty * tile).astype(np.int32), (c + tx * tile).astype(np.int32), a[r, c]))
                cells += len(r)
                if cells >= _CELLS:
                    yield rows(found)
                    found, cells = [], 0
            if found:
                yield rows(found)

    return tiles.mapInPandas(run, "image_id long, r int, c int, d int")
