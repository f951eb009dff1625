"""Patch augmentation: flips, quarter turns, crops, contrast, HSB, HED, noise, blur, elastic; choice of augmenters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tilespark.operators import resample
from tilespark.operators.sampling import seeded


def flip(patch: DataFrame, mode: str, height: int, width: int) -> DataFrame:
    """``none``, ``vertical`` (rows mirrored), ``horizontal`` (columns mirrored) or ``both``."""
    if mode not in ("none", "vertical", "horizontal", "both"):
        raise ValueError(mode)
    r = height - 1 - F.col("r") if mode in ("vertical", "both") else F.col("r")
    c = width - 1 - F.col("c") if mode in ("horizontal", "both") else F.col("c")
    return patch.withColumns({"r": r, "c": c})


def rotate90(patch: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """k counter-clockwise quarter turns."""
    r, c = F.col("r"), F.col("c")
    new = {0: (r, c), 1: (width - 1 - c, r), 2: (height - 1 - r, width - 1 - c), 3: (c, height - 1 - r)}[k % 4]
    return patch.withColumns({"r": new[0], "c": new[1]})


def center_crop(patch: DataFrame, shape: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    r0, c0 = (shape[0] - target[0]) // 2, (shape[1] - target[1]) // 2
    inside = F.col("r").between(r0, r0 + target[0] - 1) & F.col("c").between(c0, c0 + target[1] - 1)
    return patch.where(inside).withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})


def required_shape(target: tuple[int, int], min_factor: float | None = None) -> tuple[int, int]:
    """Shape to extract so that scaling down to ``min_factor`` still fills the target."""
    return target if not min_factor else tuple(int(np.ceil(t / min_factor)) for t in target)


def contrast(patch: DataFrame, sigma: Column, value: str = "q") -> DataFrame:
    """Stretch a patch around its mean on 0..255: the range (s * m, 255 - s * (255 - m)) is mapped to 0..255, clipped and cut."""
    mean = patch.groupBy("image_id").agg(F.avg(value).alias("_m"))
    low, high = sigma * F.col("_m"), 255 - sigma * (255 - F.col("_m"))
    new = F.least(F.greatest((F.col(value) - low) / (high - low) * 255, F.lit(0.0)), F.lit(255.0)).cast("int")
    return patch.join(mean, "image_id").withColumn(value, new).drop("_m")


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Of fractions 0..1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    hue = F.when(d == 0, 0.0).when(high == r, F.pmod((g - b) / d, F.lit(6.0))).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return F.struct(hue.alias("h"), F.when(high == 0, 0.0).otherwise(d / high).alias("s"), high.alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(channel(5).alias("red"), channel(3).alias("green"), channel(1).alias("blue"))


def hsb_shift(rgb: DataFrame, hue: float, saturation: float, brightness: float) -> DataFrame:
    """``rgb(.., red, green, blue)`` as fractions: hue moves round the circle; saturation and brightness move toward 1 (positive) or 0 (negative)."""
    toward = lambda x, s: x + (1 - x) * s if s > 0 else x * (1 + s)
    d = rgb.withColumn("_h", rgb_to_hsv(F.col("red"), F.col("green"), F.col("blue")))
    new = hsv_to_rgb(F.pmod(F.col("_h.h") + hue, F.lit(1.0)), toward(F.col("_h.s"), saturation), toward(F.col("_h.v"), brightness))
    return d.withColumn("_n", new).withColumns({n: F.col(f"_n.{n}") for n in ("red", "green", "blue")}).drop("_h", "_n")


# The hematoxylin, eosin and DAB stain vectors of Ruifrok and Johnston.
HED_FROM_STAINS = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]])


def hed_shift(rgb: DataFrame, sigmas: tuple, biases: tuple, cutoff: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Deconvolve to stain densities, scale each by 1 + sigma and add its bias, and go back; patches whose mean is outside the cutoff stay."""
    to_stains = np.linalg.inv(HED_FROM_STAINS)
    names = ("red", "green", "blue")
    density = [-F.log(F.greatest(F.col(n), F.lit(1e-6))) for n in names]
    stains = [sum(density[i] * float(to_stains[i, j]) for i in range(3)) * (1 + sigmas[j]) + biases[j] for j in range(3)]
    back = {n: F.least(F.greatest(F.exp(-sum(stains[j] * float(HED_FROM_STAINS[j, i]) for j in range(3))), F.lit(0.0)), F.lit(1.0)) for i, n in enumerate(names)}
    mean = rgb.groupBy("image_id").agg(F.avg((F.col("red") + F.col("green") + F.col("blue")) / 3).alias("_m"))
    inside = F.col("_m").between(*cutoff)
    return rgb.join(mean, "image_id").withColumns({n: F.when(inside, e).otherwise(F.col(n)) for n, e in back.items()}).drop("_m")


def gaussian_noise(patch: DataFrame, sigma: float, seed: int, value: str = "q") -> DataFrame:
    """Additive noise on 0..255 values by the Box-Muller rule from two seeded hashes, clipped and cut."""
    u = (seeded(seed, "image_id", "r", "c", F.lit("a")) + 1) / F.lit(4294967297.0)
    t = seeded(seed, "image_id", "r", "c", F.lit("b")) / F.lit(4294967296.0)
    noise = F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * t) * sigma * 255
    return patch.withColumn(value, F.least(F.greatest(F.col(value) + noise, F.lit(0.0)), F.lit(255.0)).cast("int"))


def _kernel(sigma: float) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    return k / k.sum()


def _blur(a: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return a
    k = _kernel(sigma)
    reach = len(k) // 2
    for axis in (0, 1):
        a = np.moveaxis(a, axis, 0)
        p = np.pad(a, [(reach, reach)] + [(0, 0)] * (a.ndim - 1), mode="symmetric")
        a = np.moveaxis(sum(w * p[i : i + len(a)] for i, w in enumerate(k)), 0, axis)
    return a


def _per_patch(patch: DataFrame, kernel, value: str) -> DataFrame:
    """Apply an array kernel to each patch (a patch has a bounded size)."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        h, w = int(frame["r"].max()) + 1, int(frame["c"].max()) + 1
        a = np.zeros((h, w))
        a[frame["r"], frame["c"]] = frame[value]
        out = kernel(a, int(key[0]))
        return pd.DataFrame({"image_id": frame["image_id"], "r": frame["r"], "c": frame["c"], value: out[frame["r"], frame["c"]]})

    return patch.select("image_id", "r", "c", value).groupBy("image_id").applyInPandas(run, f"image_id long, r int, c int, {value} double")


def gaussian_blur(patch: DataFrame, sigma: float, value: str = "v") -> DataFrame:
    """Separable Gaussian blur with mirrored borders."""
    return _per_patch(patch, lambda a, _: _blur(a, sigma), value)


def _drawn(seed: int, *keys) -> float:
    """The number 0..1 that ``seeded`` gives for plain keys, on the driver."""
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16) / 4294967296.0


def deformation_maps(shape: tuple[int, int], sigmas: tuple[float, float], alphas: tuple[float, float], maps: int, seed: int, max_bytes: int = 1 << 26) -> np.ndarray:
    """Displacements (map, row or column, r, c) of Simard, Steinkraus and Platt (2003) for patches of one shape.

    Noise in -1..1 is smoothed by a Gaussian of a width drawn from ``sigmas``, with zeros beyond the borders, and scaled by a factor drawn from ``alphas``.
    All maps go to every task, so their size is bounded.
    """
    if maps < 1 or not 0 < sigmas[0] <= sigmas[1] or not 0 <= alphas[0] <= alphas[1]:
        raise ValueError("there must be a map, and intervals of positive widths and factors must ascend")
    if maps * shape[0] * shape[1] * 16 > max_bytes:
        raise ValueError(f"{maps} maps of {shape} are over {max_bytes} bytes")
    out = np.zeros((maps, 2, *shape))
    for m in range(maps):
        sigma, alpha = (low + (high - low) * _drawn(seed, name, m) for name, (low, high) in (("sigma", sigmas), ("alpha", alphas)))
        k = _kernel(sigma)
        for axis in range(2):
            a = np.array([[2 * _drawn(seed, m, axis, r, c) - 1 for c in range(shape[1])] for r in range(shape[0])])
            for _ in range(2):  # rows, then columns
                reach = len(k) // 2
                p = np.pad(a, [(reach, reach), (0, 0)])
                a = sum(w * p[i : i + len(a)] for i, w in enumerate(k)).T
            out[m, axis] = a * alpha
    return out


def elastic(patch: DataFrame, shape: tuple[int, int], sigmas: tuple[float, float], alphas: tuple[float, float], maps: int, seed: int, order: int = 1, value: str = "v") -> DataFrame:
    """Patches of one shape, each deformed by one of ``maps`` seeded maps: ``image_id, r, c, <value>``.

    A patch's map follows from its id. Values between pixels come from B-splines of order 0 to 5; the patch is mirrored at its borders, edge
    pixels repeated. Null and missing pixels count as 0, and of repeated pixels the largest counts.
    """
    if order not in range(6):
        raise ValueError(f"order {order} is not 0 to 5")
    moved = deformation_maps(shape, sigmas, alphas, maps, seed)
    grid = np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"))

    @F.pandas_udf("array<double>")
    def deformed(which: pd.Series, at: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for m, a, v in zip(which, at, values):
            image = np.zeros(shape[0] * shape[1])
            image[np.asarray(a, int)] = v
            out.append(resample.gather(image.reshape(shape), *(grid + moved[m]), order).ravel())
        return pd.Series(out, dtype=object)

    pixels = patch.where(F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1)).groupBy(
        "image_id", (F.col("r") * shape[1] + F.col("c")).cast("int").alias("_at")).agg(F.coalesce(F.max(F.col(value).cast("double")), F.lit(0.0)).alias("_v"))
    whole = pixels.groupBy("image_id").agg(F.collect_list(F.struct("_at", "_v")).alias("_p"))
    moved_to = deformed((seeded(seed, "image_id") % maps).cast("int"), F.col("_p._at"), F.col("_p._v"))
    return whole.select("image_id", F.posexplode(moved_to).alias("_k", value)).select(
        "image_id", F.expr(f"cast(_k div {shape[1]} as int)").alias("r"), (F.col("_k") % shape[1]).cast("int").alias("c"), value)


def choose(df: DataFrame, ratios: list[tuple[str, float]], seed: int, key: str = "image_id") -> DataFrame:
    """One augmenter a row by normalised ratio and seeded hash."""
    total, upto, pick = sum(r for _, r in ratios), 0, None
    u = seeded(seed, key)
    for name, ratio in ratios[:-1]:
        upto += ratio
        hit = u < int(upto / total * 4294967296)
        pick = F.when(hit, name) if pick is None else pick.when(hit, name)
    return df.withColumn("augmenter", pick.otherwise(ratios[-1][0]) if pick is not None else F.lit(ratios[0][0]))


def draw(low: float, high: float, seed: int, *keys: str) -> Column:
    """A parameter drawn evenly from low..high by seeded hash."""
    return F.lit(low) + F.lit(high - low) * seeded(seed, *keys) / F.lit(4294967296.0)


def scaling(patch: DataFrame, shape: tuple[int, int], factor: float, value: str = "v") -> DataFrame:
    """Zoom about the centre, bilinear: mirrored borders fill a shrunk patch, a grown one is cropped to its shape."""
    if factor <= 0:
        raise ValueError("the factor must be positive")
    pad = tuple(int(np.ceil(s * (1 / factor - 1) / 2)) if factor < 1 else 0 for s in shape)
    if pad[0] != pad[1]:
        raise ValueError("patches are square")
    size = tuple(s + 2 * pad[0] for s in shape)
    target = resample.target_shape(size, factor)
    border = tuple((t - s) // 2 for t, s in zip(target, shape))
    zoomed = resample.zoom_bilinear(patch, shape, target, value, pad[0])
    inside = F.col("r").between(border[0], border[0] + shape[0] - 1) & F.col("c").between(border[1], border[1] + shape[1] - 1)
    return zoomed.where(inside).select("image_id", (F.col("r") - border[0]).alias("r"), (F.col("c") - border[1]).alias("c"), value)


def pass_through(patch: DataFrame) -> DataFrame:
    return patch


def apply_pool(patch: DataFrame, groups: list[tuple[bool, list[tuple[Callable[[DataFrame], DataFrame], float]]]], seed: int) -> DataFrame:
    """Groups of (augmenter, ratio) in order: a group in sequence applies all of its members, any other the one that each image draws by ratio.

    All augmenters must return the same columns. Ratios are relative to their group and must not be negative.
    """
    for k, (sequential, members) in enumerate(groups):
        if not members or any(r < 0 for _, r in members) or not sum(r for _, r in members):
            raise ValueError("a group needs a member with a positive ratio")
        if sequential:
            for f, _ in members:
                patch = f(patch)
            continue
        drawn = choose(patch, [(str(i), r) for i, (_, r) in enumerate(members)], seed + k)
        parts = [f(drawn.where(F.col("augmenter") == str(i)).drop("augmenter")) for i, (f, r) in enumerate(members) if r > 0]
        patch = parts[0]
        for part in parts[1:]:
            patch = patch.unionByName(part)
    return patch
