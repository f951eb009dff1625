"""Connected regions of binary rasters on run-length rows: tile-local labelling, boundary merge, boxes, small-region filter, hole filling.

A run is a stretch of foreground pixels in one row of a tile. A tile's pixels come as one row and leave as labelled runs; only runs at tile
borders meet in joins, and pixels appear again where a result is asked for by pixel. Stored runs pack so well that their files look small; the
joins are hinted to be dealt out by key, not broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tilespark.functions.storage import materialize
from tilespark.operators.graph import connected_components

#: Columns an image may have at most in a pixel id.
STRIDE = 1 << 31
_RUNS = "image_id long, r int, c0 int, c1 int, local long"


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by hooking the larger root under the smaller one and pointer jumps."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def _tile_runs(at: np.ndarray, tile: int, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the pixels ``row * tile + column`` of one tile: rows, first and last columns, and the first run of each one's region."""
    at = np.unique(at)
    row = at // tile
    begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])))
    end = np.append(begin[1:], len(at)) - 1
    y, c0, c1 = row[begin], at[begin] % tile, at[end] % tile
    reach, wide = int(full), tile + 2
    low = np.searchsorted(y * wide + c1 + 1, (y + 1) * wide + c0 + 1 - reach)
    high = np.searchsorted(y * wide + c0 + 1, (y + 1) * wide + c1 + 1 + reach, side="right")
    n = np.maximum(high - low, 0)
    above = np.repeat(np.arange(len(y)), n)
    below = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return y, c0, c1, _roots(len(y), above, below)


def _packed(pixels: DataFrame, tile: int, mark: Column | int = 0) -> DataFrame:
    """A row a tile: ``image_id, tile_row, tile_col, at``, the pixels as 2 * (row * tile + column) plus their mark."""
    inner = (F.pmod("r", F.lit(tile)) * tile + F.pmod("c", F.lit(tile))).cast("int") * 2
    return pixels.groupBy("image_id", F.floor(F.col("r") / tile).cast("int").alias("tile_row"), F.floor(F.col("c") / tile).cast("int").alias("tile_col")).agg(F.collect_list(inner + mark).alias("at"))


def _label(packed: DataFrame, full: bool, tile: int, holes: bool = False) -> DataFrame:
    """Runs ``image_id, r, c0, c1, component`` of packed tiles; with ``holes`` of the pixels that carry no mark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for image, ty, tx, at in zip(batch["image_id"], batch["tile_row"], batch["tile_col"], batch["at"]):
                at = np.asarray(at, np.int64)
                places = np.setdiff1d(at[at % 2 == 0] // 2, at[at % 2 == 1] // 2) if holes else at // 2
                if not len(places):
                    continue
                y, c0, c1, root = _tile_runs(places, tile, full)
                r, c0, c1 = y + ty * tile, c0 + tx * tile, c1 + tx * tile
                out.append([np.full(len(r), image), r, c0, c1, (r * STRIDE + c0)[root]])
            if out:
                yield pd.DataFrame(dict(zip(("image_id", "r", "c0", "c1", "local"), map(np.concatenate, zip(*out)))))

    stored = materialize(packed.mapInPandas(run, _RUNS), "runs")
    reach = int(full)
    # to the row below, across a border between tile rows
    top = stored.where(F.pmod("r", F.lit(tile)) == 0).select("image_id", "r", F.floor(F.col("c0") / tile).alias("t"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("local").alias("dst"))
    columns = F.array_distinct(F.array(*[F.floor(x / tile) for x in (F.col("c0") - reach, F.col("c0"), F.col("c1") + reach)]))
    bottom = stored.where(F.pmod("r", F.lit(tile)) == tile - 1).select("image_id", (F.col("r") + 1).alias("r"), F.explode(columns).alias("t"), "c0", "c1", F.col("local").alias("src"))
    down = bottom.join(top.hint("merge"), ["image_id", "r", "t"]).where((F.col("d0") <= F.col("c1") + reach) & (F.col("d1") >= F.col("c0") - reach)).select("image_id", "src", "dst")
    # to the right, across a border between tile columns
    left = stored.where(F.pmod("c0", F.lit(tile)) == 0).select("image_id", "r", F.col("c0").alias("c"), F.col("local").alias("dst"))
    rows = F.explode(F.sequence(F.col("r") - reach, F.col("r") + reach)).alias("r")
    right = stored.where(F.pmod("c1", F.lit(tile)) == tile - 1).select("image_id", rows, (F.col("c1") + 1).alias("c"), F.col("local").alias("src"))
    met = down.unionByName(right.join(left.hint("merge"), ["image_id", "r", "c"]).select("image_id", "src", "dst"))
    key = lambda name: F.struct("image_id", F.col(name).alias("p"))
    groups = connected_components(met.where("src <> dst").select(key("src").alias("src"), key("dst").alias("dst")).distinct())
    names = groups.select(F.col("id.image_id").alias("image_id"), F.col("id.p").alias("local"), F.col("component.p").alias("component"))
    return stored.join(names.hint("merge"), ["image_id", "local"], "left").select("image_id", "r", "c0", "c1", F.coalesce("component", "local").alias("component"))


def label_runs(pixels: DataFrame, full_connectivity: bool = True, tile: int = 512) -> DataFrame:
    """``pixels(image_id, r, c)``, foreground only -> its runs ``image_id, r, c0, c1, component`` (a run ends at its tile's border)."""
    return _label(_packed(pixels, tile), full_connectivity, tile)


def expand(runs: DataFrame) -> DataFrame:
    """The pixels of runs: ``image_id, r, c`` and what else the runs carry."""
    others = [c for c in runs.columns if c not in ("image_id", "r", "c0", "c1")]
    return runs.select("image_id", "r", F.explode(F.sequence("c0", "c1")).alias("c"), *others)


def label_components(pixels: DataFrame, full_connectivity: bool = True, tile: int = 512) -> DataFrame:
    """``pixels(image_id, r, c)``, foreground only -> with ``component``: the smallest pixel id (row * 2^31 + column) of the region.

    Tiles are labelled on their own; equal-region pairs across tile borders (one side's border runs joined to the other's) make a
    graph whose components rename the tile labels. A region may span any number of tiles.
    """
    return expand(label_runs(pixels, full_connectivity, tile))


def _boxed(grouped, pixels, c0: str, c1: str) -> DataFrame:
    g = grouped.agg(pixels.alias("pixels"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min(c0).alias("c0"), F.max(c1).alias("c1"))
    h, w = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    return g.withColumns({"h": h, "w": w, "diagonal2": (h * h + w * w).cast("long")})


def boxes(components: DataFrame) -> DataFrame:
    """Size, bounding box and diagonal of each component, from pixels or from runs."""
    grouped = components.groupBy("image_id", "component")
    if "c0" in components.columns:
        return _boxed(grouped, F.sum(F.col("c1") - F.col("c0") + 1).cast("long"), "c0", "c1")
    return _boxed(grouped, F.count("*"), "c", "c")


def filter_regions(mask: DataFrame, threshold: float, full_connectivity: bool = True, tile: int = 512) -> DataFrame:
    """Foreground pixels of ``mask(image_id, r, c)`` whose component's diagonal is above the threshold (strictly), with ``component``."""
    runs = materialize(label_runs(mask, full_connectivity, tile), "regions")
    keep = boxes(runs).where(F.col("diagonal2") > threshold * threshold).select("image_id", "component")
    return expand(runs.join(keep.hint("merge"), ["image_id", "component"], "left_semi")).select("image_id", "r", "c", "component")


def fill_holes(mask: DataFrame, frame: DataFrame, threshold: float, full_connectivity: bool = True, tile: int = 512) -> DataFrame:
    """Pixels of ``frame`` outside ``mask`` whose component of the complement has a diagonal of at most the threshold; border ones too.

    Frame and mask meet tile by tile, and the complement is taken there, so no background pixel becomes a row unless it is filled.
    """
    key = ["image_id", "r", "c"]
    both = frame.select(*key, F.lit(0).alias("_m")).unionByName(mask.select(*key, F.lit(1).alias("_m")))
    runs = materialize(_label(_packed(both, tile, F.col("_m")), full_connectivity, tile, holes=True), "holes")
    small = boxes(runs).where(F.col("diagonal2") <= threshold * threshold).select("image_id", "component")
    return expand(runs.join(small.hint("merge"), ["image_id", "component"], "left_semi")).select("image_id", "r", "c")
