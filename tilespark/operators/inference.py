"""Tiled scoring: tile plan, receptive-field geometry, scorer protocol, post-processing chain and step names."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tilespark.functions.storage import materialize
from tilespark.operators import components as cc, morphology, resample, rings


class Scorer(Protocol):
    """What a model must offer: scores of a batch of windows (n, height, width) as (n, classes, height, width)."""

    def predict(self, windows: np.ndarray) -> np.ndarray: ...


def tile_plan(images: DataFrame, tile: int, lost: int, interpolation_lost: int = 0) -> DataFrame:
    """``images(image_id, height, width)`` -> window starts, ``lost`` pixels outside at each border, one stride apart.

    The stride is the tile without what both sides lose; each window's result covers ``out`` pixels, cut at the image's end.
    """
    stride = tile - 2 * lost - 2 * interpolation_lost
    if stride <= 0:
        raise ValueError("the tile is smaller than what it loses")
    plan = images.withColumn("i", F.explode(F.expr(f"sequence(0, cast((height - 1) div {stride} as int))"))).withColumn("j", F.explode(F.expr(f"sequence(0, cast((width - 1) div {stride} as int))")))
    return plan.select(
        "image_id", (F.col("i") * stride).alias("row"), (F.col("j") * stride).alias("col"),
        (F.col("i") * stride - lost - interpolation_lost).alias("read_row"), (F.col("j") * stride - lost - interpolation_lost).alias("read_col"),
        F.least(F.lit(stride), F.col("height") - F.col("i") * stride).cast("int").alias("out_height"), F.least(F.lit(stride), F.col("width") - F.col("j") * stride).cast("int").alias("out_width"))


def reconstruction(layers: DataFrame) -> DataFrame:
    """``layers(model, k, kernel, stride, padding)`` -> ``model, downsampling, lost, interpolation_lost``.

    A fold over the layers in order: pixels lost at each side grow by (kernel - 1) / 2 - padding times the downsampling so far, and the
    downsampling multiplies by the stride; interpolation loses ceil((downsampling - 1) / 2).
    """
    one = layers.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("k", "kernel", "stride", "padding"))).alias("l"))
    fold = """aggregate(l, named_struct('ds', 1L, 'lost', 0.0D),
        (s, x) -> named_struct('ds', s.ds * x.stride, 'lost', s.lost + ((x.kernel - 1) / 2 - x.padding) * s.ds))"""
    return one.select("model", F.expr(fold).alias("s")).select(
        "model", F.col("s.ds").alias("downsampling"), F.col("s.lost").alias("lost"), F.ceil((F.col("s.ds") - 1) / 2).cast("int").alias("interpolation_lost"))


def masked_tiles(plan: DataFrame, mask: DataFrame, stride: int) -> DataFrame:
    """Windows of the plan whose result covers some foreground pixel of ``mask(image_id, r, c)``."""
    hit = mask.select("image_id", F.expr(f"cast(r div {stride} as int) * {stride}").alias("row"), F.expr(f"cast(c div {stride} as int) * {stride}").alias("col")).distinct()
    return plan.join(hit, ["image_id", "row", "col"], "left_semi")


def threshold_value(confidence: Column, quantized: bool) -> Column:
    """The limit that scores must reach: the confidence, or its whole part on 0..255."""
    return F.floor(255 * confidence).cast("double") if quantized else confidence.cast("double")


def upsample(scores: DataFrame, shape: tuple[int, int], downsampling: int, soft: bool, value: str = "v") -> DataFrame:
    """Scores of a network that loses resolution, back on its input's grid: bilinear for soft ones, nearest for labels."""
    target = (shape[0] * downsampling, shape[1] * downsampling)
    return (resample.zoom_bilinear if soft else resample.zoom_nearest)(scores, shape, target, value)


STEPS = ("prediction", "zoom", "threshold", "filter", "dilate", "fill", "outline")


def step_paths(steps: DataFrame, base: str, ending: str = ".tif") -> DataFrame:
    """``steps(job, k, name, enabled)`` -> ``path``: intermediate names carry the step, the last enabled one the plain name, disabled ones repeat the previous."""
    from pyspark.sql import Window

    w = Window.partitionBy("job").orderBy("k")
    last = F.max(F.when(F.col("enabled"), F.col("k"))).over(Window.partitionBy("job"))
    own = F.when(F.col("enabled"), F.when(F.col("k") == last, F.concat(F.lit(base), F.lit(ending))).otherwise(F.concat(F.lit(base + "_"), F.col("name"), F.lit(ending))))
    return steps.withColumn("own", own).select("job", "k", "name", F.last("own", ignorenulls=True).over(w).alias("path"))


def predict(pixels: DataFrame, scorer: Scorer, tile: int = 64, lost: int = 0, value: str = "v") -> DataFrame:
    """Score every pixel: ``image_id, r, c, scores``. Tiles get a halo of ``lost`` pixels from their neighbours, zeros outside the image.

    The halo is an exchange: a pixel goes to each tile whose padded window holds it (its own and up to eight more, or further
    rings where the halo is wider than a tile), and a task holds one padded tile.
    """
    shared = pixels.sparkSession.sparkContext.broadcast(scorer)
    near = pixels.select("image_id", "r", "c", F.col(value).cast("double").alias("v"))
    near = near.withColumn("ty", F.explode(F.expr(f"sequence(cast(floor((r - {lost}) / {tile}) as int), cast(floor((r + {lost}) / {tile}) as int))")))
    near = near.withColumn("tx", F.explode(F.expr(f"sequence(cast(floor((c - {lost}) / {tile}) as int), cast(floor((c + {lost}) / {tile}) as int))")))

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        _, ty, tx = key
        size = tile + 2 * lost
        a = np.zeros((size, size))
        y, x = frame["r"].to_numpy() - ty * tile + lost, frame["c"].to_numpy() - tx * tile + lost
        a[y, x] = frame["v"]
        own = (y >= lost) & (y < lost + tile) & (x >= lost) & (x < lost + tile)
        if not own.any():
            return pd.DataFrame({"image_id": [], "r": [], "c": [], "scores": []}).astype({"image_id": "int64", "r": "int32", "c": "int32", "scores": object})
        s = shared.value.predict(a[None])[0]
        return pd.DataFrame({"image_id": frame["image_id"][own], "r": frame["r"][own], "c": frame["c"][own], "scores": list(s[:, y[own], x[own]].T)})

    return near.groupBy("image_id", "ty", "tx").applyInPandas(run, "image_id long, r int, c int, scores array<double>")


def postprocess(scores: DataFrame, frame: DataFrame, height: int, width: int, limit: float, min_diagonal: float = 0.0, dilation: int = 0,
                hole_diagonal: float = 0.0, mask: DataFrame | None = None, tile: int = 512) -> DataFrame:
    """The chain threshold, region filter, dilation, hole filling on ``scores(image_id, r, c, v)``; a step with a zero setting is left out."""
    keys = ["image_id", "r", "c"]
    out = scores.where(F.col("v") >= limit).select(*keys)
    if mask is not None:
        out = out.join(mask.select(*keys), keys, "left_semi")
    if min_diagonal > 0:
        out = cc.filter_regions(out, min_diagonal, tile=tile).select(*keys)
    if dilation > 0:
        out = morphology.dilate(out, dilation, height, width)
    if hole_diagonal > 0:
        out = out.unionByName(cc.fill_holes(out, frame, hole_diagonal, tile=tile)).distinct()
    return out


def chain(scores: DataFrame, shape: tuple[int, int], limit: float, *, zoom: int = 1, soft: bool = False, min_diagonal: float = 0.0, dilation: int = 0,
          hole_diagonal: float = 0.0, epsilon: float = 1.0, tile: int = 512, outline: bool = True) -> dict[str, DataFrame]:
    """Every raster of the post-processing of ``scores(image_id, r, c, v)``, by step: prediction, zoom, threshold, filter, dilate, fill, outline.

    Each is stored and the next one read from it; a step with a zero setting is left out. The outline has one polygon a region and is left
    out, with the work for it, where ``outline`` is not set.
    """
    keys, out = ["image_id", "r", "c"], {"prediction": scores}
    cur = scores
    if zoom > 1:
        cur = out["zoom"] = materialize(upsample(cur, shape, zoom, soft), "zoom")
    height, width = shape[0] * zoom, shape[1] * zoom
    frame = cur.select(*keys)
    cur = out["threshold"] = materialize(cur.where(F.col("v") >= limit).select(*keys), "threshold")
    if min_diagonal > 0:
        cur = out["filter"] = materialize(cc.filter_regions(cur, min_diagonal, tile=tile).select(*keys), "filter")
    if dilation > 0:
        cur = out["dilate"] = materialize(morphology.dilate(cur, dilation, height, width), "dilate")
    if hole_diagonal > 0:
        cur = out["fill"] = materialize(cur.unionByName(cc.fill_holes(cur, frame, hole_diagonal, tile=tile)).distinct(), "fill")
    if outline:
        points, regions = outline_points(cur, epsilon, tile)
        out["outline"] = rings.as_polygons(points, regions).where("type = 'polygon'")
    return out


def outline_points(mask: DataFrame, epsilon: float = 1.0, tile: int = 512) -> tuple[DataFrame, DataFrame]:
    """The points of the simplified outer rings of a mask's regions, and the regions' pixels."""
    regions = materialize(cc.label_components(mask, True, tile=tile), "components").withColumn("label", F.lit(1))
    return materialize(rings.simplify_rings(rings.outline_rings(regions, tile), epsilon), "rings"), regions


def normalizer(kind: str, **settings) -> Callable[[Column], Column]:
    """Registry of pixel normalisers by name."""
    from tilespark.operators import pointwise

    kinds = {
        "pass-through": lambda x: x, "rgb_to_0-1": pointwise.zero_one,
        "rgb": lambda x: pointwise.rgb_range(x, *settings["target"]),
        "general": lambda x: pointwise.general_range(x, settings["target"], settings["source"])}
    if kind not in kinds:
        raise ValueError(f"unknown normaliser {kind}")
    return kinds[kind]
