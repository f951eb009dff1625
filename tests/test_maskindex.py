"""Mask indexes: refresh by content, errors, selection against a plain rank; distances against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.functions.storage import new_path
from tilespark.operators import distance
from tilespark.sources import maskindex


def _mask(spark, images):
    rows = [(i, r, c, int(v)) for i, a in enumerate(images) for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id long, r int, c int, label int")


@pytest.fixture(scope="module")
def images():
    seed = np.random.default_rng(1)
    return [seed.integers(0, 3, (9, 11)), seed.integers(1, 3, (5, 5)), np.ones((6, 4), int)]


def test_refresh_counts_changed_images_only(spark, images):
    path = new_path(spark, "index")
    assert maskindex.refresh(_mask(spark, images), path, [1, 2], tile=4) == 1
    changed = [images[0], 3 - images[1]]
    assert maskindex.refresh(_mask(spark, changed), path, [2, 1], tile=4) == 2
    found = maskindex.read(spark, path)
    assert {r.image_id: r.holder for r in found.select("image_id", "holder").distinct().collect()} == {0: 1, 1: 2}  # the third image is gone
    counts = {(r.image_id, r.label): r.n for r in found.groupBy("image_id", "label").agg(F.sum("n").alias("n")).collect()}
    assert counts == {(i, x): int((a == x).sum()) for i, a in enumerate(changed) for x in (1, 2)}
    assert {r.holder for r in maskindex.read(spark, path, 1).collect()} == {1}


@pytest.mark.parametrize("more", [{"tile": 8}, {"spacing": 2.0}, {"labels": [1]}])
def test_other_settings_are_errors(spark, images, more):
    path = new_path(spark, "index")
    settings = {"labels": [1, 2], "tile": 4, "spacing": 1.0}
    maskindex.refresh(_mask(spark, images), path, **settings)
    with pytest.raises(ValueError, match="index has tiles"):
        maskindex.refresh(_mask(spark, images), path, **(settings | more))


def test_no_index_is_an_error(spark):
    with pytest.raises(ValueError, match="no mask index"):
        maskindex.read(spark, new_path(spark, "nothing"))


def test_select(spark, images):
    path = new_path(spark, "index")
    maskindex.refresh(_mask(spark, images), path, [0, 1, 2], tile=4)
    index = maskindex.read(spark, path)
    wanted = spark.createDataFrame([(i, x, k) for i in range(3) for x in range(3) for k in range(-1, 120)], "image_id long, label int, k long")
    got = {(r.image_id, r.label, r.k): (r.r, r.c) for r in maskindex.select(index, wanted).collect()}
    expected = {}
    for i, a in enumerate(images):
        for x in range(3):
            cells = sorted((r // 4, c // 4, r, c) for r, c in zip(*np.nonzero(a == x)))
            expected |= {(i, x, k): (int(r), int(c)) for k, (_, _, r, c) in enumerate(cells)}
    assert got == expected


@pytest.mark.parametrize("invert, border, tile", [(False, False, 4), (True, True, 4), (True, False, 64), (False, True, 5)])
def test_distances(spark, invert, border, tile):
    seed = np.random.default_rng(2)
    images = [(seed.random((13, 18)) < p) for p in (0.02, 0.5, 0.97)]
    images[0][0, 0] = True
    rows = [(i, int(r), int(c)) for i, a in enumerate(images) for r, c in zip(*np.nonzero(a))]
    mask = spark.createDataFrame(rows, "image_id long, r int, c int")
    found = {(x.image_id, x.r, x.c): x.d for x in distance.between(distance.distances(mask, 13, 18, tile, invert, border), 0, 1 << 29, tile).collect()}
    for i, a in enumerate(images):
        sources = [(r, c) for r, c in zip(*np.nonzero(a != invert))]
        if border:
            sources += [(r, c) for r in range(-1, 14) for c in (-1, 18)] + [(r, c) for r in (-1, 13) for c in range(-1, 19)]
        for r in range(13):
            for c in range(18):
                assert found[i, r, c] == min(abs(r - y) + abs(c - x) for y, x in sources)


def test_distances_without_sources(spark):
    none = spark.createDataFrame([], "image_id long, r int, c int")
    assert distance.distances(none, 5, 5).collect() == []
