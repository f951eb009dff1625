"""Outlines: rings against a plain walk, over tile sizes; simplification against a plain version; corner cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.operators import components as cc, rings
from tilespark.operators.annotation import simplify

SHAPES = {
    "dot": ["1"], "bar": ["111"], "square": ["11", "11"], "corner": ["10", "01"], "ring": ["111", "101", "111"], "spiral": ["11111", "00001", "11101", "10001", "11111"],
    "pinch": ["1100", "1101", "0011", "1110"], "two": ["1101", "0001", "1000"],
}


def _table(spark, images):
    rows = [(i, r, c) for i, lines in enumerate(images) for r, line in enumerate(lines) for c, x in enumerate(line) if x == "1"]
    return cc.label_components(spark.createDataFrame(rows, "image_id long, r int, c int"), True, tile=3)


def _walk(cells, start):
    """Edges of the outer ring, by a walk with the region on the right that joins cells at corners."""
    sides = [(-1, 0), (0, 1), (1, 0), (0, -1)]
    cell, side, out = start, 0, []
    while True:
        d, a = sides[side], sides[(side + 1) % 4]
        out.append((2 * cell[0] + d[0], 2 * cell[1] + d[1]))
        front = (cell[0] + a[0], cell[1] + a[1])
        corner = (front[0] + d[0], front[1] + d[1])
        if corner in cells:
            cell, side = corner, (side + 3) % 4
        elif front in cells:
            cell = front
        else:
            side = (side + 1) % 4
        if (cell, side) == (start, 0):
            return [*out, out[0]]


def _expected(components):
    cells = {}
    for x in components.collect():
        cells.setdefault((x.image_id, x.component), set()).add((x.r, x.c))
    return {k: _walk(v, min(v)) for k, v in cells.items()}


def _found(points):
    out = {}
    for x in sorted(points.collect(), key=lambda x: x.pos):
        out.setdefault((x.image_id, x.component), []).append((x.y2, x.x2))
    return out


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_rings_equal_a_walk(spark, tile):
    seed = np.random.default_rng(3)
    images = [*SHAPES.values(), *[["".join(map(str, row)) for row in (seed.random((17, 13)) < p).astype(int)] for p in (0.4, 0.6, 0.8)]]
    comp = _table(spark, images)
    assert _found(rings.outline_rings(comp, tile)) == _expected(comp)


def test_long_ring_over_many_tiles(spark):
    """A comb, whose ring passes every tile border."""
    rows = [(0, r, c) for r in range(40) for c in range(60) if c % 2 == 0 or r == 0]
    comp = cc.label_components(spark.createDataFrame(rows, "image_id long, r int, c int"), True, tile=8)
    assert _found(rings.outline_rings(comp, 4)) == _expected(comp)


@pytest.mark.parametrize("epsilon", [0.0, 0.6, 1.0, 2.5])
def test_simplified_rings(spark, epsilon):
    seed = np.random.default_rng(5)
    comp = _table(spark, [["".join(map(str, row)) for row in (seed.random((15, 15)) < 0.65).astype(int)] for _ in range(3)])
    points = rings.outline_rings(comp, 4)
    full, found = _found(points), _found(rings.simplify_rings(points, epsilon))
    for k, ring in full.items():
        assert found[k] == [tuple(p) for p in (simplify(np.array(ring, float), 2 * epsilon)).astype(int).tolist()]


def test_polygons(spark):
    comp = _table(spark, [SHAPES["dot"], SHAPES["square"]]).withColumn("label", F.lit(4))
    got = {x.image_id: x for x in rings.polygons(comp, 2.0, 1.0, single_points=True).collect()}
    assert (got[0].type, got[0].label, len(got[0].coords)) == ("dot", 4, 1)
    assert got[1].type == "polygon" and min(p.row for p in got[1].coords) == -1.0
    assert [x.image_id for x in rings.polygons(comp, 2.0, 1.0).collect()] == [1]
    assert rings.polygons(comp.limit(0), 2.0).collect() == []


def test_short_rings_take_no_rounds(spark, monkeypatch):
    shapes = {1: [(0, 0), (0, 3), (4, 3), (4, 0), (0, 0)], 2: [(0, 0), (0, 2), (5, 3), (0, 4), (0, 8), (4, 8), (4, 0), (0, 0)]}
    points = spark.createDataFrame([(0, k, pos, y, x) for k, ring in shapes.items() for pos, (y, x) in enumerate(ring)], "image_id long, component long, pos long, y2 int, x2 int").coalesce(1)
    expected = {(0, k): [tuple(p) for p in simplify(np.array(ring, float), 2.0).astype(int).tolist()] for k, ring in shapes.items()}
    stored, materialize = [], rings.materialize
    monkeypatch.setattr(rings, "materialize", lambda df, name: stored.append(name) or materialize(df, name))
    assert _found(rings.simplify_rings(points, 1.0)) == expected and stored == ["points", "rings"]
    assert _found(rings.simplify_rings(points, 1.0, in_task=5)) == expected and "splits" in stored
