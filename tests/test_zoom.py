"""Zoom and padding deal source pixels out: no grid of pixels meets them in a join, which Spark would take for small and broadcast."""

import numpy as np
import pytest

from tilespark.operators import augment as au, raster, resample as rs


def _image(spark, size, seed=0):
    v = np.random.default_rng(seed).normal(size=(2, *size)).round(3)
    rows = [(k, r, c, float(v[k, r, c])) for k in range(2) for r in range(size[0]) for c in range(size[1])]
    return v, spark.createDataFrame(rows, "image_id long, r int, c int, v double")


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


@pytest.mark.parametrize("size, target", [((8, 8), (15, 11)), ((40, 70), (23, 101)), ((33, 32), (65, 5)), ((1, 4), (3, 9)), ((5, 2), (1, 1))])
def test_bilinear_joins_no_grid(spark, size, target):
    v, p = _image(spark, size)
    out = rs.zoom_bilinear(p, size, target)
    assert _joins(out) == 0
    got = np.full((2, *target), np.nan)
    for x in out.collect():
        got[x.image_id, x.r, x.c] = x.v
    place = [np.arange(n) * (s - 1) / max(1, n - 1) for s, n in zip(size, target)]
    weights = [np.maximum(0, 1 - np.abs(y[:, None] - np.arange(s))) for y, s in zip(place, size)]
    assert np.allclose(got, np.einsum("yr,krc,xc->kyx", weights[0], v, weights[1]))


def test_bilinear_of_missing_null_and_repeated_pixels(spark):
    p = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 0, 4.0), (0, 0, 1, None), (1, 1, 1, None), (1, 9, 9, 1.0)], "image_id long, r int, c int, v double")
    got = {(x.image_id, x.r, x.c): x.v for x in rs.zoom_bilinear(p, (2, 2), (3, 3)).collect()}
    want = {(0, r, c): 6 * (1 - r / 2) * (1 - c / 2) for r in range(3) for c in range(3)} | {(1, r, c): None for r in range(3) for c in range(3)}
    assert got == want


@pytest.mark.parametrize("size, pad", [((8, 8), 3), ((3, 5), 7), ((1, 2), 4), ((4, 4), 0)])
def test_reflection_joins_no_grid(spark, size, pad):
    v, p = _image(spark, size)
    out = raster.reflect_pad(p, *size, pad)
    assert _joins(out) == 0
    got = {(x.image_id, x.r, x.c): x.v for x in out.collect()}
    wide = np.pad(v, [(0, 0), (pad, pad), (pad, pad)], mode="reflect")
    assert out.count() == wide.size and got == {k: float(x) for k, x in np.ndenumerate(wide)}


def test_scaling_joins_no_grid(spark):
    assert _joins(au.scaling(_image(spark, (8, 8))[1], (8, 8), 0.5)) == 0


@pytest.mark.parametrize("size, factor", [((8, 8), 0.5), ((5, 5), 0.3), ((1, 1), 0.4), ((2, 2), 0.2), ((40, 40), 0.7), ((6, 6), 1.5)])
def test_scaling_pads_in_the_task(spark, size, factor):
    """A patch of one tile is sent along as it is: the shuffle carries its own pixels and none of its mirrored border."""
    v, p = _image(spark, size)
    out = au.scaling(p, size, factor)
    assert size[0] > 32 or "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    pad = max(0, int(np.ceil(size[0] * (1 / factor - 1) / 2)))
    wide = np.pad(v, [(0, 0), (pad, pad), (pad, pad)], mode="reflect")
    new = round(wide.shape[1] * factor)
    place = np.arange(new) * (wide.shape[1] - 1) / max(1, new - 1)
    weights = np.maximum(0, 1 - np.abs(place[:, None] - np.arange(wide.shape[1])))
    first = (new - size[0]) // 2
    want = np.einsum("yr,krc,xc->kyx", weights, wide, weights)[:, first:first + size[0], first:first + size[1]]
    got = {(x.image_id, x.r, x.c): x.v for x in out.collect()}
    assert len(got) == want.size and all(np.isclose(got[k], x) for k, x in np.ndenumerate(want))


def test_scaling_of_missing_null_and_repeated_pixels(spark):
    rows = [(0, 0, 0, 2.0), (0, 0, 0, 4.0), (0, 1, 1, None), (0, 2, 0, 1.0), (1, 1, 1, None), (1, 9, 9, 1.0)]
    p = spark.createDataFrame(rows, "image_id long, r int, c int, v double")
    out = lambda df: {(x.image_id, x.r, x.c): x.v for x in df.collect()}
    want = out(rs.zoom_bilinear(raster.reflect_pad(p, 3, 3, 2), (7, 7), (4, 4)))
    assert out(rs.zoom_bilinear(p, (3, 3), (4, 4), pad=2)) == want and None in want.values()
