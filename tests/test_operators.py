"""Hand-made rasters, properties and error contracts."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tilespark.operators import annotation as an, augment as au, components as cc, evaluate as ev, inference as inf, levels as lv, morphology as mo
from tilespark.operators import patches as pt, pointwise as pw, raster, resample as rs, sampling as sm, telemetry as tl
from tilespark.operators.graph import connected_components
from tilespark.sources import catalog as ct


def pixels(spark, text: str):
    rows = [(0, r, c) for r, line in enumerate(text.split()) for c, ch in enumerate(line) if ch == "#"]
    return spark.createDataFrame(rows, "image_id long, r int, c int")


def points(df):
    return {(x.r, x.c) for x in df.select("r", "c").collect()}


SHAPE = """
##..#
#..#.
....#
##.##
#...#"""


@pytest.mark.parametrize("tile", [1, 2, 3, 64])
@pytest.mark.parametrize("full", [True, False])
def test_components_do_not_depend_on_tiles(spark, tile, full):
    got = cc.label_components(pixels(spark, SHAPE), full, tile).collect()
    ref = cc.label_components(pixels(spark, SHAPE), full, 64).collect()
    assert {(x.r, x.c, x.component) for x in got} == {(x.r, x.c, x.component) for x in ref}


def test_components_of_nothing(spark):
    assert cc.label_components(pixels(spark, "..."), True, 2).count() == 0


def test_graph_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1200)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (1, 0)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1200)) and len(got) == 501


def test_graph_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_region_filter_is_strict_and_holes_fill(spark):
    ring = pixels(spark, "##### #...# #...# #...# #####")
    frame = pixels(spark, "##### ##### ##### ##### #####")
    assert points(cc.fill_holes(ring, frame, 4.0, False)) == set()
    assert points(cc.fill_holes(ring, frame, 4.25, False)) == {(r, c) for r in (1, 2, 3) for c in (1, 2, 3)}
    dot = pixels(spark, "#..##")
    assert points(cc.filter_regions(dot, 2**0.5)) == {(0, 3), (0, 4)}


def test_dilate_and_erode_are_dual(spark):
    a = pixels(spark, SHAPE)
    grown = points(mo.dilate(a, 2, 5, 5))
    want = {(r, c) for r in range(5) for c in range(5) if any(abs(r - x) + abs(c - y) <= 2 for x, y in points(a))}
    assert grown == want and points(a) <= grown
    assert points(mo.erode(pixels(spark, "### ### ###"), 1, 3, 3)) == {(1, 1)}
    assert points(mo.dilate(a, 0, 5, 5)) == points(a)


@pytest.mark.parametrize("k", [0, 1, 3])
def test_morphology_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    for share in (0.0, 0.1, 0.85, 1.0):
        fg = {(int(r), int(c)) for r, c in np.argwhere(rng.random((7, 9)) < share)}
        m = spark.createDataFrame([(0, r, c) for r, c in fg], "image_id long, r int, c int")
        frame = {(r, c) for r in range(7) for c in range(9)}
        near = lambda p, some: any(abs(p[0] - r) + abs(p[1] - c) <= k for r, c in some)
        outside = {(r, c) for r in range(-1, 8) for c in range(-1, 10)} - fg
        dilated, eroded = {p for p in frame if near(p, fg)}, {p for p in fg if not near(p, outside)}
        assert points(mo.dilate(m, k, 7, 9)) == dilated
        assert points(mo.erode(m, k, 7, 9)) == eroded
        sides = mo.margins(m, k, 7, 9)
        assert points(sides.where("side = 'inner'")) == fg - eroded and points(sides.where("side = 'outer'")) == dilated - fg
        assert sides.count() == len(fg - eroded) + len(dilated - fg)


def test_wrap_and_singles(spark):
    left = spark.createDataFrame([(0, 0, 0, 250), (0, 0, 1, 3)], "image_id long, r int, c int, v int")
    right = spark.createDataFrame([(0, 0, 0, 10)], "image_id long, r int, c int, v int")
    assert [r.v for r in pw.arithmetic(left, right, "+").collect()] == [4]
    assert sorted(r.v for r in pw.arithmetic(left, right, "+", accept_singles=True).collect()) == [3, 4]
    assert [r.v for r in pw.arithmetic(right, left, "-").collect()] == [16]


def test_label_map_contract():
    with pytest.raises(ValueError):
        pw.label_map({1: 0, 2: 2})
    with pytest.raises(ValueError):
        pw.label_map({255: 0})


def test_zoom_contract():
    assert rs.zoom_factor((8, 8), (16, 16)) == 2
    with pytest.raises(ValueError):
        rs.zoom_factor((8, 8), (16, 24))
    with pytest.raises(ValueError):
        inf.normalizer("none of them")


def test_tile_round_trip_keeps_ragged_borders(spark):
    p = spark.createDataFrame([(0, r, c, r * 10 + c) for r in range(5) for c in range(7) if (r, c) != (1, 1)], "image_id long, r int, c int, v int")
    back = raster.to_pixels(raster.to_tiles(p, 3), 3)
    assert {(x.r, x.c, x.v) for x in back.collect()} == {(x.r, x.c, x.v) for x in p.collect()}


def test_flips_and_turns(spark):
    p = spark.createDataFrame([(0, r, c, r * 3 + c) for r in range(2) for c in range(3)], "image_id long, r int, c int, v int")
    key = lambda d: {(x.r, x.c, x.v) for x in d.collect()}
    assert key(au.flip(au.flip(p, "both", 2, 3), "both", 2, 3)) == key(p)
    a = np.array([[0, 1, 2], [3, 4, 5]])
    for k in range(5):
        want = np.rot90(a, k)
        assert key(au.rotate90(p, k, 2, 3)) == {(r, c, int(want[r, c])) for r in range(want.shape[0]) for c in range(want.shape[1])}
    with pytest.raises(ValueError):
        au.flip(p, "sideways", 2, 3)


def test_hsv_round_trip(spark):
    d = spark.createDataFrame([(0, 0, i, i / 10, 1 - i / 20, (i * 7 % 10) / 10) for i in range(10)], "image_id long, r int, c int, red double, green double, blue double")
    for x, y in zip(d.orderBy("c").collect(), au.hsb_shift(d, 0.0, 0.0, 0.0).orderBy("c").collect()):
        assert np.allclose([x.red, x.green, x.blue], [y.red, y.green, y.blue])


def test_blur_keeps_the_mean_of_a_flat_patch(spark):
    p = spark.createDataFrame([(0, r, c, 0.5) for r in range(6) for c in range(6)], "image_id long, r int, c int, v double")
    assert all(abs(x.v - 0.5) < 1e-9 for x in au.gaussian_blur(p, 1.5).collect())


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=6), st.integers(0, 40), st.integers(0, 3))
def test_allocation_meets_total_and_bounds(spark, weights, total, seed):
    low, high = 0, max(1, total)
    rows = [(str(i), w / sum(weights), low, high) for i, w in enumerate(weights)]
    got = sm.allocate(spark.createDataFrame(rows, "key string, ratio double, low long, high long"), total, seed=seed).collect()
    assert sum(r.share for r in got) == total and all(low <= r.share <= high for r in got) and len(got) == len(weights)


def test_allocation_with_tight_bounds(spark):
    rows = [("a", 0.8, 0, 3), ("b", 0.1, 0, 9), ("c", 0.1, 2, 9)]
    got = {r.key: r.share for r in sm.allocate(spark.createDataFrame(rows, "key string, ratio double, low long, high long"), 10).collect()}
    assert got["a"] == 3 and sum(got.values()) == 10


def test_sampling_is_the_same_for_any_partitioning(spark):
    d = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("category"))
    ratios = [("a", 0.5), ("b", 0.5)]
    one = sm.purpose_split(d.repartition(1), ratios, 3).collect()
    many = sm.purpose_split(d.repartition(7), ratios, 3).collect()
    assert sorted(one) == sorted(many)
    assert sm.ticks(0) == [] and sm.ticks(3) == [0, 1, 2] and sm.ticks(101)[-1] == 100


def test_plateau_counts_from_the_first_best(spark):
    e = spark.createDataFrame(list(enumerate([0.5, 0.7, 0.7, 0.6, 0.65, 0.8])), "epoch int, v double")
    assert [r.plateau for r in tl.plateau(e, "v").orderBy("epoch").collect()] == [0, 0, 0, 2, 3, 0]


def test_dice_from_jaccard(spark):
    a, b = pixels(spark, "##.. ##.."), pixels(spark, ".##. .##.")
    r = ev.pixel_measures(a, b).first()
    assert (r.n_both, r.n_union) == (2, 6) and abs(r.dice - 2 * r.jaccard / (1 + r.jaccard)) < 1e-12


def test_level_outside_every_interval(spark):
    levels = spark.createDataFrame([(0, 0, 0.5), (0, 1, 1.0)], "image_id long, level int, spacing double")
    want = spark.createDataFrame([(0, 0.5), (0, 9.0), (1, 0.5)], "image_id long, want double")
    got = {(r.image_id, r.want): r.level for r in lv.level_by_spacing(levels, want).collect()}
    assert got == {(0, 0.5): 0, (0, 9.0): None, (1, 0.5): None}


def test_tile_plan_needs_a_stride(spark):
    with pytest.raises(ValueError):
        inf.tile_plan(spark.createDataFrame([(0, 10, 10)], "image_id long, height int, width int"), 8, 4)


def test_predict_does_not_depend_on_tiles(spark):
    from tilespark.plans.mask_queries import BoxScorer

    p = spark.createDataFrame([(0, r, c, float(r * c)) for r in range(7) for c in range(9)], "image_id long, r int, c int, v double")
    key = lambda t: {(x.r, x.c, round(x.scores[0], 9)) for x in inf.predict(p, BoxScorer(), t, 1).collect()}
    assert key(3) == key(16)


def test_simplify_and_trace():
    line = np.array([[0, 0], [0, 1], [0, 2], [3, 2], [3, 0]], float)
    assert len(an.simplify(line, 0.5)) == 4
    ring = an.trace(np.array([[1, 1], [1, 0]]))
    assert ring[:, 0].min() == -0.5 and ring[:, 0].max() == 1.5 and ring[:, 1].max() == 1.5
    assert len(an.trace(np.zeros((2, 2)))) == 0


def test_sparse_tiles_hold_nulls(spark):
    rows = [(0, 0, 2, 7), (0, 1, 1, 8), (0, 2, 0, 9), (0, 3, 3, 6)]
    tiles = raster.to_tiles(spark.createDataFrame(rows, "image_id long, r int, c int, v int"), 3)
    assert {(t.tile_row, t.tile_col): t.data for t in tiles.collect()} == {(0, 0): [None, None, 7, None, 8, None, 9, None, None], (1, 1): [6]}


def test_trace_needs_boundary_cells_only():
    rng = np.random.default_rng(3)
    for _ in range(30):
        m = rng.random((9, 9)) < 0.8
        inner = np.zeros_like(m)
        inner[1:-1, 1:-1] = np.all([m[1 + a : 8 + a, 1 + b : 8 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        assert (an.trace(m & ~inner) == an.trace(m)).all()


def test_outline_does_not_depend_on_tiles(spark):
    big = [(0, r, c, 0, 1) for r in range(13) for c in range(17) if (r - 6) ** 2 + (c - 8) ** 2 < 36]
    rows = big + [(0, 20, c, 20, 2) for c in range(3)] + [(1, 5, 5, 5, 1)]
    d = spark.createDataFrame(rows, "image_id long, r int, c int, component long, label int")
    found = [sorted(map(tuple, an.outline(d, 2.0, 0.75, True, tile=t).collect())) for t in (4, 64)]
    assert found[0] == found[1] and [x[:4] for x in found[0]] == [(0, 0, 1, "polygon"), (0, 20, 2, "polygon"), (1, 5, 1, "dot")]
    dots = [sorted(map(tuple, an.outline(d.where("component > 0"), 2.0, 5.0, True, tile=t).collect())) for t in (2, 64)]
    assert dots[0] == dots[1] and [(x[3], [tuple(p) for p in x[4]]) for x in dots[0]] == [("dot", [(40.0, 2.0)]), ("dot", [(10.0, 10.0)])]
    assert an.outline(d.limit(0)).count() == 0


def test_annotation_arity(spark):
    p = [(0.0, 0.0)]
    rows = [("dot", p), ("dot", p * 2), ("polygon", p * 2), ("polygon", p * 3), ("rectangle", p * 4), ("points", p), ("unknown", p)]
    d = spark.createDataFrame(rows, "type string, coords array<struct<row:double,col:double>>")
    assert [r.valid for r in an.validate(d).collect()] == [True, False, False, True, True, True, False]


def test_empty_groups_are_collected(spark):
    groups = spark.createDataFrame([("a", None), ("b", "a"), ("c", None), ("d", "c")], "name string, parent string")
    items = spark.createDataFrame([(1, "b"), (2, None)], "id int, grp string")
    assert {r.name for r in an.collect_empty_groups(items, groups).collect()} == {"a", "b"}
    kept, left = an.remove_group(items, groups, None)
    assert kept.count() == 0 and left.count() == 0


def test_parameters_merge_existing_keys_only():
    base = {"a": 1, "n": {"x": 1, "y": 2}, "m": {"x": 1}}
    assert ct.merge_parameters(base, {"a": 2, "new": 3, "n": {"x": 5, "z": 6}, "m": {"q": 1}}, frozenset({"m"})) == {"a": 2, "n": {"x": 5, "y": 2}, "m": {"q": 1}}


def test_catalogue_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("training", "a", "x"), ("training", "b", "y"), ("validation", "a", "z")], "purpose string, category string, item string")
    ct.write_catalogue(items, str(tmp_path / "c"))
    assert sorted(ct.read_catalogue(spark, str(tmp_path / "c")).collect()) == sorted(items.collect())


def test_purposes_valid(spark):
    have = spark.createDataFrame([("a", 6.0), ("b", 2.0)], "purpose string, ratio double")
    good = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "purpose string, ratio double")
    bad = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "purpose string, ratio double")
    assert ct.purposes_valid(have, good).first().valid and not ct.purposes_valid(have, bad).first().valid


def test_patch_centre():
    assert pt.centre(10, 1.0) == 10 and pt.centre(10, 4.0) == 41 and pt.centre(3, 0.5) == 1


def test_polygon_raster_takes_all_orders(spark, tmp_path):
    from tilespark.plans import catalogue

    rng = np.random.default_rng(8)
    orders = [(k, ("1-URGENT", "2-HIGH", "5-LOW")[k % 3]) for k in range(1, 16)]  # no key is a multiple of 20
    lines = [(k, n, int(rng.integers(1000)), int(rng.integers(1000)), 1.0, 1.0) for k, _ in orders for n in range(1, 2 + k % 6)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for k, group in orders:
        p = [(a % 97, b % 89) for key, _, a, b, _, _ in lines if key == k]
        if group != "5-LOW" and len(p) > 2:
            for r in range(97):
                cuts = [x + (r - y) * (x2 - x) / (y2 - y) for (y, x), (y2, x2) in zip(p, p[1:] + p[:1]) if (y > r) != (y2 > r)]
                for c in range(89):
                    if sum(x > c for x in cuts) % 2:
                        want[r, c] = max(want.get((r, c), 0), 7 if group == "1-URGENT" else 5)
    got = {(r.r, r.c): r.label for r in catalogue.queries()["polygon_raster_all"](spark, str(tmp_path)).collect()}
    assert want and got == want


def test_positions_over_many_partitions_need_no_single_task(spark):
    rng = np.random.default_rng(2)
    slots = rng.permutation(5000).tolist()
    rows = [(s, float(e)) for s, e in zip(slots, rng.random(5000))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = tl.partition_order(spark.createDataFrame(rows, "slot long, error double").repartition(7), 0.5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got.inputFiles()) > 1
    want = {s: k for k, (_, s) in enumerate(sorted((e >= 0.5, s) for s, e in rows), 1)}
    assert {r.slot: r.position for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_o0" not in plan and "windowspecdefinition(error" not in plan
    assert "row_number() windowspecdefinition(_part" in plan


@pytest.mark.parametrize("size, new, order", [(7, 12, 2), (7, 4, 3), (9, 9, 4), (6, 11, 5), (1, 4, 3), (2, 1, 5), (5, 8, 1), (5, 8, 0)])
def test_spline_interpolates(size, new, order):
    """Against the linear system of the mirrored line: spline values at the samples must be the samples."""
    def basis(u):
        if order == 0:
            return (-0.5 <= u < 0.5) * 1.0
        return sum((-1) ** k * rs.math.comb(order + 1, k) * max(u + (order + 1) / 2 - k, 0) ** order for k in range(order + 2)) / rs.math.factorial(order)
    fold = lambda k: k % (2 * size) if k % (2 * size) < size else 2 * size - 1 - k % (2 * size)
    def rows(places):
        m = np.zeros((len(places), size))
        for at, x in enumerate(places):
            for k in range(-8, size + 8):
                m[at, fold(k)] += basis(x - k)
        return m
    line = np.random.default_rng(size).normal(size=(3, size))
    coefficients = np.linalg.solve(rows(range(size)), line.T)
    places = [o * (size - 1) / max(1, new - 1) for o in range(new)]
    assert np.allclose(rs._spline_lines(line, new, order), (rows(places) @ coefficients).T, atol=1e-9)


def test_zoom_spline_frames(spark):
    rows = [(k, r, c, float(r * r - c + k)) for k in (0, 1) for r in range(4) for c in range(5)]
    p = spark.createDataFrame(rows, "image_id long, r int, c int, v double")
    same = {(x.image_id, x.r, x.c): round(x.v, 6) + 0 for x in rs.zoom_spline(p, (4, 5), (4, 5), 5).collect()}
    assert same == {(k, r, c): v for k, r, c, v in rows}
    linear = lambda d: sorted((x.image_id, x.r, x.c, round(x.v, 6)) for x in d.collect())
    assert linear(rs.zoom_spline(p, (4, 5), (9, 7), 1)) == linear(rs.zoom_bilinear(p, (4, 5), (9, 7)))
    assert rs.zoom_spline(p.where("r > 9"), (4, 5), (9, 7)).count() == 0
    assert {x.v for x in rs.zoom_spline(p.where("image_id = 1").withColumn("v", F.when(F.col("r") == 0, F.col("v"))), (4, 5), (4, 5), 0).where("r > 0").collect()} == {0.0}
    with pytest.raises(ValueError):
        rs.zoom_spline(p, (4, 5), (9, 7), 6)


@pytest.mark.parametrize("size, new", [(8, 13), (8, 5), (1, 4), (4, 1), (3, 3), (2, 9)])
def test_zoom_nearest_corners(spark, size, new):
    p = spark.createDataFrame([(0, 0, c, c) for c in range(size)], "image_id long, r int, c int, v int")
    got = {x.c: x.v for x in rs.zoom_nearest(p, (1, size), (1, new), corners=True).collect()}
    assert got == {t: (2 * t * (size - 1) + new - 1) // (2 * (new - 1)) if new > 1 else 0 for t in range(new)}


def test_axes_round_trip(spark):
    df = spark.createDataFrame([(list(range(24)),), (None,)], "d array<int>")
    last = df.withColumn("d", pw.reorder_axes(F.col("d"), 2, 3, 4))
    assert last.first().d == np.arange(24).reshape(2, 3, 4).transpose(1, 2, 0).ravel().tolist()
    assert last.select(pw.reorder_axes(F.col("d"), 2, 3, 4, "BCHW").alias("d")).first().d == list(range(24))
    with pytest.raises(ValueError):
        pw.reorder_axes(F.col("d"), 2, 3, 4, "CBHW")
