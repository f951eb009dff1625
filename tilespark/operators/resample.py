"""Zoom by nearest, bilinear and spline interpolation, zoom to a template, and pyramids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tilespark.operators.raster import reflect_pad

#: Side of the source tiles that bilinear zoom takes at once, and cells of a batch of them.
_TILE, _CELLS = 32, 1 << 18
#: Poles of the B-spline prefilters of orders 2 to 5.
POLES = {
    2: (math.sqrt(8) - 3,),
    3: (math.sqrt(3) - 2,),
    4: (math.sqrt(664 - math.sqrt(438976)) + math.sqrt(304) - 19, math.sqrt(664 + math.sqrt(438976)) - math.sqrt(304) - 19),
    5: (math.sqrt(67.5 - math.sqrt(4436.25)) + math.sqrt(26.25) - 6.5, math.sqrt(67.5 + math.sqrt(4436.25)) - math.sqrt(26.25) - 6.5),
}


def zoom_nearest(pixels: DataFrame, shape: tuple[int, int], target: tuple[int, int], value: str = "v", corners: bool = False) -> DataFrame:
    """Target pixel (r, c) takes source pixel (floor(r * h / H), floor(c * w / W)).

    With ``corners`` the corner pixels are aligned: it takes (r * (h-1)/(H-1), c * (w-1)/(W-1)) rounded, halves up.
    The inverse of the address map: every source pixel is dealt to its target rows and columns, so no grid is joined.
    """
    def reach(col: str, size: int, new: int):
        at = F.col(col).cast("long")
        start = lambda x: F.ceil(x * new / size)
        if corners:
            start = lambda x: F.ceil((2 * x - 1) * (new - 1) / (2 * (size - 1))) if size > 1 and new > 1 else F.when(x > 0, F.lit(new)).otherwise(0)
        first = F.greatest(start(at), F.lit(0)).cast("int")
        last = F.least(F.when(at < size - 1, start(at + 1) - 1).otherwise(new - 1) if corners else start(at + 1) - 1, F.lit(new - 1)).cast("int")
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    out = pixels.select("image_id", F.explode(reach("r", shape[0], target[0])).alias("_r"), "c", value)
    return out.select("image_id", F.col("_r").alias("r"), F.explode(reach("c", shape[1], target[1])).alias("c"), value)


def _first_neighbour(size: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every target place along one axis the first of its two source places, and how far it lies beyond it."""
    place = np.arange(new) * (size - 1) / max(1, new - 1)
    first = np.minimum(np.floor(place), max(0, size - 2)).astype(np.int64)
    return first, place - first


def zoom_bilinear(pixels: DataFrame, shape: tuple[int, int], target: tuple[int, int], value: str = "v", pad: int = 0) -> DataFrame:
    """Corner-aligned bilinear zoom: target r maps to r * (h-1)/(H-1); each target pixel sums its four weighted neighbours.

    Source pixels meet by tile, with one more row and column after it, so no grid is joined and a task holds a few tiles. Missing and null
    pixels add nothing, repeated ones add up; a target pixel without any neighbour is left out, one whose neighbours are all null is null.
    With ``pad`` the image is padded by mirroring first, and h, w are those of the padded image; an image of one tile is padded in its task.
    """
    if pad and max(shape) > _TILE:
        return zoom_bilinear(reflect_pad(pixels, *shape, pad, value), tuple(size + 2 * pad for size in shape), target, value)
    near, offset = pixels.where(F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1)), []
    for axis, name, size in (("r", "ty", shape[0]), ("c", "tx", shape[1])):
        one, at = F.lit(0), F.col(axis)
        if size > _TILE:
            one = F.explode(F.array_distinct(F.array(*[F.floor(x / _TILE).cast("int") for x in (F.greatest(at - 1, F.lit(0)), at)])))
        near = near.withColumn(name, one)
        offset.append(at - F.col(name) * _TILE)
    inner = [max(2, min(_TILE + 1, size)) for size in shape]
    cell = F.struct((offset[0] * inner[1] + offset[1]).cast("int").alias("at"), F.col(value).cast("double").alias("v"))
    tiles = near.groupBy("image_id", "ty", "tx").agg(F.collect_list(cell).alias("p"))

    def chunk(images: pa.Array, cells: pa.StructArray, of: np.ndarray, k: int, axes: list) -> pa.RecordBatch:
        """Target pixels of ``k`` tiles at one place; ``of`` is the tile of every source pixel."""
        where = of * inner[0] * inner[1] + cells.field("at").to_numpy(zero_copy_only=False)
        real = cells.field("v").is_valid().to_numpy(zero_copy_only=False)
        v = np.where(real, cells.field("v").to_numpy(zero_copy_only=False), 0.0)
        full = lambda weights: np.bincount(where, weights, k * inner[0] * inner[1]).reshape(k, *inner)
        dense, seen, known = full(v), full(None) > 0, full(real) > 0
        (rows, y0, y1, dy), (cols, x0, x1, dx) = axes
        total, some, sure = np.zeros((k, len(rows), len(cols))), False, False
        for y, wy in ((y0, 1 - dy), (y1, dy)):
            for x, wx in ((x0, 1 - dx), (x1, dx)):
                pick = np.ix_(np.arange(k), y, x)
                total += wy[:, None] * wx[None, :] * dense[pick]
                some, sure = some | seen[pick], sure | known[pick]
        i, y, x = np.nonzero(some)
        return pa.RecordBatch.from_arrays(
            [images.take(pa.array(i)), pa.array(rows[y].astype(np.int32)), pa.array(cols[x].astype(np.int32)), pa.array(total[i, y, x], mask=~sure[i, y, x])], ["image_id", "r", "c", value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = [_first_neighbour(size + 2 * pad, new) for size, new in zip(shape, target)]
        for batch in batches:
            images, (ty, tx) = batch.column("image_id"), (batch.column(n).to_numpy() for n in ("ty", "tx"))
            place = ty.astype(np.int64) << 32 | tx
            order = np.argsort(place, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                if not len(group):
                    continue
                axes = []
                for t, size, (first, beyond) in zip((int(ty[group[0]]), int(tx[group[0]])), shape, lines):
                    if pad:
                        axes.append((np.arange(len(first)), _reflected(first - pad, size), _reflected(first + 1 - pad, size), beyond))
                        continue
                    own = np.arange(*np.searchsorted(first, (t * _TILE, (t + 1) * _TILE)))
                    axes.append((own, first[own] - t * _TILE, first[own] + 1 - t * _TILE, beyond[own]))
                step = max(1, _CELLS // max(inner[0] * inner[1], len(axes[0][0]) * len(axes[1][0])))
                for part in np.split(group, range(step, len(group), step)):
                    cells = batch.column("p").take(pa.array(part))
                    n = cells.value_lengths().to_numpy(zero_copy_only=False)
                    yield chunk(images.take(pa.array(part)), cells.flatten(), np.repeat(np.arange(len(part)), n), len(part), axes)

    return tiles.mapInArrow(run, f"image_id {pixels.schema['image_id'].dataType.simpleString()}, r int, c int, `{value}` double")


def _reflected(at: np.ndarray, size: int) -> np.ndarray:
    """Places inside 0..size-1 for places anywhere, the line mirrored at its ends without repeating its end values."""
    k = at % max(1, 2 * (size - 1))
    return np.where(k < size, k, 2 * (size - 1) - k)


def mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Places inside 0..size-1 for places anywhere, the line mirrored at its ends with its end values repeated."""
    k = at % (2 * size)
    return np.where(k < size, k, 2 * size - 1 - k)


def spline_coefficients(lines: np.ndarray, order: int) -> np.ndarray:
    """B-spline coefficients of lines (one a row) that are mirrored at their ends."""
    size = lines.shape[1]
    for pole in POLES.get(order, ()):
        reach = math.ceil(math.log(1e-17) / math.log(-pole))
        taps = (1 - pole) / (1 + pole) * pole ** np.abs(np.arange(-reach, reach + 1.0))
        wide = lines[:, mirrored(np.arange(-reach, size + reach), size)]
        lines = np.stack([np.convolve(line, taps, "valid") for line in wide])
    return lines


def spline_weights(place: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First coefficient that counts at each place, and the weights of it and of the ``order`` that follow."""
    first = np.floor(place + (0 if order % 2 else 0.5)).astype(int) - order // 2
    weights = []
    for step in range(order + 1):
        away = place - (first + step) + (order + 1) / 2
        weights.append(sum((-1) ** k * math.comb(order + 1, k) * np.maximum(away - k, 0) ** order for k in range(order + 2)) / math.factorial(order) if order else np.ones(place.shape))
    return first, weights


def gather(image: np.ndarray, y: np.ndarray, x: np.ndarray, order: int) -> np.ndarray:
    """The image at any coordinates by a B-spline of order 0 to 5, mirrored at its borders."""
    c = spline_coefficients(spline_coefficients(image.astype(float), order).T, order).T
    (y0, wy), (x0, wx) = spline_weights(y, order), spline_weights(x, order)
    rows, cols = [mirrored(y0 + i, c.shape[0]) for i in range(order + 1)], [mirrored(x0 + j, c.shape[1]) for j in range(order + 1)]
    return sum(wy[i] * sum(wx[j] * c[rows[i], cols[j]] for j in range(order + 1)) for i in range(order + 1))


def _spline_lines(lines: np.ndarray, new: int, order: int) -> np.ndarray:
    """Lines (one a row) resampled to ``new`` values: prefilter by its truncated impulse response, then B-spline weights."""
    size = lines.shape[1]
    lines = spline_coefficients(lines, order)
    first, weights = spline_weights(np.arange(new) * ((size - 1) / max(1, new - 1)), order)
    return sum(lines[:, mirrored(first + step, size)] * weight for step, weight in enumerate(weights))


def zoom_spline(pixels: DataFrame, shape: tuple[int, int], target: tuple[int, int], order: int = 3, value: str = "v") -> DataFrame:
    """Corner-aligned zoom with B-splines of order 0 to 5; the image is mirrored at its borders, edge pixels repeated.

    Separable: first rows, then columns are resampled, so a task holds single lines and never an image. Null and missing pixels count as 0.
    """
    if order not in range(6):
        raise ValueError(f"order {order} is not 0 to 5")

    def along(df: DataFrame, axis: str, other: str, size: int, new: int) -> DataFrame:
        @F.pandas_udf("array<double>")
        def resampled(at: pd.Series, values: pd.Series) -> pd.Series:
            lines = np.zeros((len(at), size))
            for line, a, v in zip(lines, at, values):
                line[np.asarray(a, dtype=int)] = v
            return pd.Series(list(_spline_lines(lines, new, order)) if len(lines) else [])

        seen = df.where(F.col(value).isNotNull())
        lines = seen.groupBy("image_id", other).agg(F.collect_list(axis).alias("_at"), F.collect_list(F.col(value).cast("double")).alias("_line"))
        return lines.select("image_id", other, F.posexplode(resampled("_at", "_line")).alias(axis, value))

    rows = along(pixels, "c", "r", shape[1], target[1])
    return along(rows, "r", "c", shape[0], target[0]).select("image_id", "r", "c", value)


def target_shape(shape: tuple[int, int], factor: float) -> tuple[int, int]:
    """Half-even rounded shape of a zoom."""
    return round(shape[0] * factor), round(shape[1] * factor)


def zoom_factor(shape: tuple[int, int], target: tuple[int, int], tolerance: float = 0.01) -> float:
    """The common factor of a zoom to a target shape; rows and columns must agree to one per cent."""
    fr, fc = target[0] / shape[0], target[1] / shape[1]
    if not math.isclose(fr, fc, rel_tol=tolerance):
        raise ValueError(f"row and column factors differ: {fr} and {fc}")
    return fr


def pyramid(pixels: DataFrame, levels: int, interpolation: str = "nearest", value: str = "v") -> DataFrame:
    """Levels 0..``levels`` of repeated halving: ``level`` is added. ``nearest`` keeps the upper left pixel, ``linear`` the mean of what is there."""
    out, cur = pixels.select("image_id", F.lit(0).alias("level"), "r", "c", value), pixels
    for level in range(1, levels + 1):
        if interpolation == "nearest":
            nxt = pixels.where((F.col("r") % (1 << level) == 0) & (F.col("c") % (1 << level) == 0)).select(
                "image_id", F.shiftright("r", level).alias("r"), F.shiftright("c", level).alias("c"), value)
        else:
            nxt = cur.groupBy("image_id", F.shiftright("r", 1).alias("r"), F.shiftright("c", 1).alias("c")).agg(F.avg(value).alias(value))
        out = out.unionByName(nxt.select("image_id", F.lit(level).alias("level"), "r", "c", value))
        cur = nxt
    return out
