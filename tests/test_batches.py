"""Batches, stored statistics, regrouping and pools of augmenters against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.functions import naming, storage
from tilespark.operators import annotation as an, augment as au, batches as ba, inference as inf
from tilespark.sources import maskstats


def test_shares_add_up_and_stay_even(spark):
    rows = [(i, k) for i in range(37) for k in range(3) if (i + k) % (k + 1) == 0]
    sources = spark.createDataFrame(rows, "image_id long, label int")
    got = ba.distribute(sources, {0: 0.5, 1: 0.3, 2: 0.1, 7: 0.1, 8: 0.0}, 200, 3).collect()
    by = {k: [r.share for r in got if r.label == k] for k in range(3)}
    assert sum(map(sum, by.values())) == 200 and all(max(v) - min(v) <= 1 and len(v) == sum(1 for _, k in rows if k == j) for j, v in by.items())
    assert sum(by[0]) == round(200 * 0.5 / 0.9)
    with pytest.raises(ValueError):
        ba.distribute(sources, {9: 1.0}, 5, 1)


def test_batches_hold_patches_around_their_labels(spark):
    size = 12
    pixels = spark.createDataFrame([(i, r, c, (r * 7 + c * 3 + i) % 5) for i in range(4) for r in range(size) for c in range(size)], "image_id long, r int, c int, v int")
    masks = pixels.select("image_id", "r", "c", (F.col("v") % 3).alias("label"))
    rows = ba.assemble(pixels, masks, {0: 0.5, 2: 0.5}, 30, 3, 5, "v", 4).collect()
    assert sorted({r.position for r in rows}) == list(range(30)) and len(rows) == 30 * 9
    assert all(r.v % 3 == r.label for r in rows if r.y == r.x == 1)
    first = {}
    for r in sorted(rows, key=lambda r: r.position):
        first.setdefault((r.image_id, r.label), r.position)
    assert list(first) == sorted(first)


def test_stored_statistics(spark, tmp_path):
    mask = spark.createDataFrame([(0, r, c, (r // 2 + c) % 2) for r in range(6) for c in range(5)], "image_id long, r int, c int, label int")
    path = str(tmp_path / "stat")
    built = maskstats.open_or_build(mask, path, 2, 0.25)
    again = maskstats.open_or_build(mask.limit(0), path, 2)  # not built anew
    assert sorted(map(tuple, built.collect())) == sorted(map(tuple, again.collect())) and built.agg(F.sum("n")).first()[0] == 30
    with pytest.raises(ValueError):
        maskstats.open_or_build(mask, path, 4)
    mask.write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        maskstats.read(spark, str(tmp_path / "other"))


def test_regroup_drops_groups_that_empty(spark):
    groups = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", None)], "name string, parent string")
    items = spark.createDataFrame([(1, "c"), (2, "d"), (3, None)], "id int, grp string")
    i, g = an.regroup(items, groups, "x", item=F.col("id") == 1)
    assert {(r.name, r.parent) for r in g.collect()} == {("a", None), ("d", "a"), ("e", None), ("x", None)}
    assert {(r.id, r.grp) for r in i.collect()} == {(1, "x"), (2, "d"), (3, None)}
    _, g = an.regroup(items, groups, None, moved="c")
    assert {(r.name, r.parent) for r in g.collect()} == {("a", None), ("c", None), ("d", "a"), ("e", None)}
    with pytest.raises(ValueError):
        an.regroup(items, groups, "x")


def test_group_trees_too_deep_are_an_error(spark):
    groups = spark.createDataFrame([(f"it's {k}", f"it's {k - 1}" if k else None) for k in range(9)], "name string, parent string")
    assert an.descendants(groups, "it's 3").count() == 6
    with pytest.raises(Exception, match="nested too deeply"):
        an.descendants(groups, "it's 0", max_depth=5).collect()


def test_scaling_keeps_the_shape(spark):
    a = np.random.default_rng(0).normal(size=(6, 6))
    patch = spark.createDataFrame([(0, r, c, float(a[r, c])) for r in range(6) for c in range(6)], "image_id long, r int, c int, v double")
    place = lambda n, k: np.arange(n) * (k - 1) / (n - 1)
    for factor in (2.0, 1.5, 0.5):
        pad = int(np.ceil(6 * (1 / factor - 1) / 2)) if factor < 1 else 0
        p = np.pad(a, pad, mode="reflect")
        n = round(len(p) * factor)
        at = place(n, len(p))
        rows = np.stack([np.interp(at, np.arange(len(p)), row) for row in p])
        want = np.stack([np.interp(at, np.arange(len(p)), col) for col in rows.T]).T
        b = (n - 6) // 2
        got = np.full((6, 6), np.nan)
        for r in au.scaling(patch, (6, 6), factor).collect():
            got[r.r, r.c] = r.v
        assert np.allclose(got, want[b : b + 6, b : b + 6]), factor


def test_pool_members_must_have_ratios(spark):
    patch = spark.createDataFrame([(0, 0, 0, 1)], "image_id long, r int, c int, q int")
    for bad in ([], [(au.pass_through, -1.0)], [(au.pass_through, 0.0)]):
        with pytest.raises(ValueError):
            au.apply_pool(patch, [(False, bad)], 0)
    assert au.apply_pool(patch, [], 0).count() == 1


def test_chain_gives_every_raster_and_an_outline(spark):
    scores = spark.createDataFrame([(0, r, c, 1.0 if 1 <= r <= 4 and 1 <= c <= 4 and (r, c) != (2, 2) else 0.0) for r in range(8) for c in range(8)], "image_id long, r int, c int, v double")
    steps = inf.chain(scores, (8, 8), 0.5, zoom=2, min_diagonal=3.0, hole_diagonal=5.0)
    assert list(steps) == ["prediction", "zoom", "threshold", "filter", "fill", "outline"]
    assert [steps[k].count() for k in ("zoom", "threshold", "filter", "fill")] == [256, 60, 60, 64]
    assert [r.type for r in steps["outline"].collect()] == ["polygon"]


def test_unused_names_and_shared_folder(spark):
    assert naming.unused(["a", "N", "n_"], "n") == "n__" and naming.unused([], "x") == "x"

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
