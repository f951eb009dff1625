import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.operators import augment as au, resample as rs
from tilespark.sources import batchstore, slides


def pixels(spark, rows=21, cols=17):
    return spark.range(rows * cols).select(F.explode(F.array(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("image_id"), F.expr(f"cast(id div {cols} as int)").alias("r"),
                                           F.expr(f"cast(id % {cols} as int)").alias("c"), F.expr("cast(id as int)").alias("v"))


def test_windows_by_spacing(spark, tmp_path):
    path = str(tmp_path / "s")
    spacing = spark.createDataFrame([(0, 0.25), (3, 0.5)], "image_id long, spacing double")
    slides.write(pixels(spark), spacing, path, levels=2, tile=4)
    schema = "window_id int, image_id int, spacing double, row int, col int, height int, width int"
    asked = [(0, 0, 0.25, 3, 2, 7, 9), (1, 0, 0.55, 1, 1, 4, 3), (2, 3, 0.5, -2, -3, 6, 6), (3, 3, 2.0, 3, 2, 9, 9), (4, 0, 0.25, 30, 0, 2, 2), (0, 0, 0.25, 3, 2, 7, 9)]
    out = slides.read(spark, path, spark.createDataFrame(asked, schema))
    level = {0: 0, 1: 1, 2: 0, 3: 2, 4: 0}
    want = []
    for w, image, _, row, col, height, width in asked:
        k = level[w]
        want += [(w, image, k, r - row, c - col, (r << k) * 17 + (c << k)) for r in range(max(0, row), row + height) for c in range(max(0, col), col + width) if r << k < 21 and c << k < 17]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    lost = spark.createDataFrame([(9, 0, 9.0, 0, 0, 1, 1), (8, 7, 0.25, 0, 0, 1, 1)], schema)
    with pytest.raises(ValueError, match="no level fits"):
        slides.read(spark, path, lost)
    assert slides.read(spark, path, lost, strict=False).count() == 0
    assert {(r.image_id, r.level, r.rows, r.cols, r.spacing) for r in slides.levels(spark, path).collect()} == {
        (i, k, -(-21 >> k), -(-17 >> k), s * 2**k) for i, s in ((0, 0.25), (3, 0.5)) for k in range(3)}


def test_spacings_are_checked(spark, tmp_path):
    for held in ([(0, 0.25)], [(0, 0.25), (3, 0.0)], [(0, 0.25), (3, None)], [(0, 0.25), (3, 0.5), (3, 0.6)]):
        with pytest.raises(ValueError, match="one positive spacing"):
            slides.write(pixels(spark), spark.createDataFrame(held, "image_id long, spacing double"), str(tmp_path / "x"), tile=8)
    assert not (tmp_path / "x").exists()


def test_batch_store(spark, tmp_path):
    path = str(tmp_path / "b")
    batch = spark.range(50).select((F.col("id") % 25).cast("int").alias("position"), "id", F.when(F.col("id") > 3, F.col("id") * 0.5).alias("v"))
    assert batchstore.manifest(spark, path).count() == 0 and batchstore.verify(spark, path).count() == 0
    batchstore.write(batch, path, 0, {"order": "bchw"}, piece=4)
    batchstore.write(batch.where("position < 3"), path, 7, piece=4)
    rows = sorted(map(tuple, batch.fillna(-1).collect()))
    got = lambda *a, **k: sorted(map(tuple, batchstore.read(spark, path, *a, **k).fillna(-1).collect()))
    assert got(0) == rows and got(7) == [r for r in rows if r[0] < 3]
    assert got(0, 10, 5, settings={"order": "bchw"}) == [r for r in rows if 10 <= r[0] < 15]
    assert got(0, 25) == [] and got(0, 3, 0) == []
    part = batchstore.read(spark, path, 0, 10, 5)
    assert len({f.rsplit("/", 2)[1] for f in part.inputFiles()}) <= 7
    assert "PartitionFilters: [isnotnull(piece" in part._jdf.queryExecution().executedPlan().toString()
    assert {(r.repetition, r.cells, r.whole) for r in batchstore.verify(spark, path).collect()} == {(0, 50, True), (7, 6, True)}
    for call, text in ((lambda: batchstore.write(batch, path, 0), "stored already"), (lambda: batchstore.read(spark, path, 1), "not stored"),
                       (lambda: batchstore.read(spark, path, 0, 26), "position 26"), (lambda: batchstore.read(spark, path, 0, settings={"order": "bhwc"}), "other settings"),
                       (lambda: batchstore.write(batch.where("position <> 4"), path, 2), "without gaps"), (lambda: batchstore.write(batch.withColumn("piece", F.lit(1)), path, 2), "taken")):
        with pytest.raises(ValueError, match=text):
            call()
    with pytest.raises(ValueError, match="not stored"):
        batchstore.read(spark, path, 2)  # it was refused, so it isn't whole
    batchstore.write(batch.where("position < 0"), path, 3)
    with pytest.raises(ValueError, match="empty"):
        batchstore.read(spark, path, 3)


@pytest.mark.parametrize("order", range(6))
def test_gather_at_any_place(order):
    a = np.random.default_rng(order).normal(size=(6, 5))
    y, x = np.meshgrid(np.arange(6), np.arange(5), indexing="ij")
    assert np.allclose(rs.gather(a, y, x, order), a)
    for dy, dx in ((6, 0), (-6, 5), (12, -10)):  # beyond the border the image stands mirrored
        flip = a[::-1] if dy % 12 else a
        assert np.allclose(rs.gather(a, y + dy, x + dx, order), flip[:, ::-1] if dx % 10 else flip)
    lines = rs._spline_lines(rs._spline_lines(a, 9, order).T, 11, order).T
    fine = np.meshgrid(np.arange(11) * 0.5, np.arange(9) * 0.5, indexing="ij")
    assert np.allclose(rs.gather(a, *fine, order), lines)


def test_elastic(spark):
    p = pixels(spark, 8, 8)
    still = au.elastic(p, (8, 8), (1.0, 2.0), (0.0, 0.0), 3, 1, order=3)
    assert {(r.image_id, r.r, r.c, round(r.v, 6)) for r in still.collect()} == {(r.image_id, r.r, r.c, float(r.v)) for r in p.collect()}
    holes = p.where("r > 0").withColumn("v", F.when(F.col("c") > 0, F.col("v"))).unionByName(p.where("r = 3"))
    found = {(r.image_id, r.r, r.c): r.v for r in au.elastic(holes, (8, 8), (1.0, 1.0), (0.0, 0.0), 2, 1).collect()}
    assert found == {(i, r, c): float(r * 8 + c) if (r and c) or r == 3 else 0.0 for i in (0, 3) for r in range(8) for c in range(8)}
    assert au.elastic(p.where("r > 9"), (8, 8), (1.0, 1.0), (2.0, 2.0), 2, 1).count() == 0
    maps = au.deformation_maps((8, 8), (1.0, 2.0), (1.0, 3.0), 3, 1)
    assert maps.shape == (3, 2, 8, 8) and not np.allclose(maps[0], maps[1]) and np.abs(maps).max() < 3
    for bad in (dict(maps=0), dict(sigmas=(0.0, 1.0)), dict(alphas=(2.0, 1.0)), dict(order=6), dict(shape=(4096, 4096))):
        with pytest.raises(ValueError):
            au.elastic(p, **{"shape": (8, 8), "sigmas": (1.0, 1.0), "alphas": (1.0, 1.0), "maps": 2, "seed": 1, **bad})
