"""Polygons to pixels: batches of polygons pass on unions of stretches."""

import numpy as np
import pytest

from tilespark.operators import annotation as an


def _brute(polygons, height, width):
    out = np.zeros((height, width), bool)
    for p in polygons:
        for r in range(height):
            cuts = [x + (r - y) * (x2 - x) / (y2 - y) for (y, x), (y2, x2) in zip(p, p[1:] + p[:1]) if (y > r) != (y2 > r)]
            for c in range(width):
                out[r, c] |= sum(x > c for x in cuts) % 2 == 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_batches_pass_on_unions(seed):
    """However many polygons a batch holds, it gives at most a stretch for every second column of a row."""
    rng = np.random.default_rng(seed)
    polygons = [[(float(y), float(x)) for y, x in rng.choice([rng.integers(-4, 24, (k, 2)), rng.normal(9, 9, (k, 2))])] for k in rng.integers(3, 9, 60)]
    code = rng.integers(0, 2, 60)
    points = np.concatenate([np.array(p) for p in polygons])
    spans = an._covered(code, points[:, 0], points[:, 1], np.array([len(p) for p in polygons]), 17, 13)
    got = np.zeros((2, 17, 14), bool)
    for a, b in spans:
        got.ravel()[a:b] = True
    assert not got[:, :, 13].any() and len(spans) <= 2 * 17 * 7
    for k in (0, 1):
        assert (got[k, :, :13] == _brute([p for p, c in zip(polygons, code) if c == k], 17, 13)).all()


def test_groups_in_order_and_outside(spark):
    square = lambda r, c, n: [{"row": float(y), "col": float(x)} for y, x in ((r, c), (r, c + n), (r + n, c + n), (r + n, c))]
    rows = [("a", square(0, 0, 4)), ("b", square(2, 2, 4)), ("b", square(90, 90, 3)), ("c", square(0, 0, 9)), ("a", square(1, 1, 2)[:2])]
    polygons = spark.createDataFrame(rows, "grp string, coords array<struct<row:double,col:double>>")
    got = {(x.r, x.c): x.label for x in an.rasterize(polygons, {"a": 2, "b": 1}, {"a": 5, "b": 7}, 8, 8).collect()}
    want = {(r, c): 7 for r in range(2, 6) for c in range(2, 6)} | {(r, c): 5 for r in range(4) for c in range(4)}
    assert got == want
    assert an.rasterize(polygons.where("grp = 'c'"), {"a": 2, "b": 1}, {"a": 5, "b": 7}, 8, 8).count() == 0
