"""Round trips of tables and files, and streams against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tilespark.operators import telemetry as tl
from tilespark.sources import images, plain
from tilespark.streaming import replay


def image(spark, h=21, w=17):
    return spark.createDataFrame([(k, r, c, (r * c + k) % 7) for k in (0, 3) for r in range(h) for c in range(w)], "image_id long, r int, c int, v int")


def test_pyramid_round_trip_and_window(spark, tmp_path):
    p = image(spark)
    path = str(tmp_path / "p")
    images.write_pyramid(p, path, levels=2, tile=8)
    key = lambda d: {(x.image_id, x.r, x.c, x.v) for x in d.collect()}
    assert key(images.read_level(spark, path, 0, 8)) == key(p)
    assert {(x.r, x.c) for x in images.read_level(spark, path, 2, 8).collect()} == {(r, c) for r in range(6) for c in range(5)}
    win = images.read_window(spark, path, 0, 15, 10, 9, 10, 8)
    want = {(k, r, c): ((r + 15) * (c + 10) + k) % 7 if r + 15 < 21 and c + 10 < 17 else 0 for k in (0, 3) for r in range(9) for c in range(10)}
    assert {(x.image_id, x.r, x.c): x.v for x in win.collect()} == want


def test_pyramid_keeps_other_images(spark, tmp_path):
    p, path = image(spark), str(tmp_path / "k")
    images.write_pyramid(p.where("image_id = 0"), path, levels=0, tile=8)
    images.write_pyramid(p.where("image_id = 3"), path, levels=0, tile=8)
    images.write_pyramid(p.where("image_id = 3").withColumn("v", F.col("v") + 1), path, levels=0, tile=8)
    want = {(x.image_id, x.r, x.c, x.v + (x.image_id == 3)) for x in p.collect()}
    assert {(x.image_id, x.r, x.c, x.v) for x in images.read_level(spark, path, 0, 8).collect()} == want


def test_empty_tiles_are_not_stored(spark, tmp_path):
    p = image(spark).withColumn("v", F.when(F.col("r") < 8, 0).otherwise(F.col("v")))
    images.write_pyramid(p, str(tmp_path / "e"), levels=0, tile=8, skip_empty=True)
    assert spark.read.parquet(str(tmp_path / "e")).agg(F.min("tile_row")).first()[0] == 1


def test_annotations_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("f", "a<\"&", "polygon", "g", "#FF0000", [(1.0, 2.0), (3.0, 4.5), (0.0, 1.0)]), ("f", "b", "dot", None, "#00FF00", [(7.0, 8.0)])],
                                  "file string, name string, type string, grp string, color string, coords array<struct<row:double,col:double>>")
    groups = spark.createDataFrame([("f", "g", None, "#0000FF"), ("f", "h", "g", "#0000FF")], "file string, name string, parent string, color string")
    images.annotation_xml(items, groups, 2.0).select("value").coalesce(1).write.text(str(tmp_path / "x"))
    i, g = images.read_annotations(spark, str(tmp_path / "x"), 2.0)
    assert sorted(i.drop("file").collect(), key=lambda r: r.name) == sorted(items.drop("file").collect(), key=lambda r: r.name)
    assert sorted(map(str, g.drop("file").collect())) == sorted(map(str, groups.drop("file").collect()))


def test_epochs_batches_and_results(spark, tmp_path):
    one = spark.createDataFrame([(0, 0.5)], "epoch int, loss double")
    both = images.append_epoch(one, spark.createDataFrame([(1, 0.9)], "epoch int, accuracy double"))
    images.write_epochs(both, str(tmp_path / "c"))
    assert sorted(images.read_epochs(spark, str(tmp_path / "c"), "epoch int, loss double, accuracy double").collect()) == [(0, 0.5, None), (1, None, 0.9)]
    images.write_batch(one, str(tmp_path / "b"), [0.5], [0, 1, 2], "bchw", 7, 1)
    assert spark.read.parquet(str(tmp_path / "b")).first().channels == [0, 1, 2]
    jobs = spark.createDataFrame([("a", "x", None), ("b", "y", "broken")], "image string, output string, error string")
    assert '"status":"failed"' in images.results_json(jobs).first().value
    assert images.redact_columns(jobs, ["error"]).where("error is not null").count() == 0


def test_stream_of_pushes_gives_the_batch_buffer(spark, tmp_path):
    rows = [("k", i, float(i)) for i in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "key string, seq long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay.ring_buffer(stream, 8).writeStream.outputMode("append").format("memory").queryName("ring").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("ring").groupBy("slot").agg(F.max_by("value", "seq").alias("v")).collect()
    want = tl.replay(spark.createDataFrame([(i, float(i)) for i in range(40)], "seq long, value double"), 8).collect()
    assert {r.slot: r.v for r in last} == {r.slot: r.value for r in want}


def test_windowed_means_close_after_the_watermark(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=10 * i), "click", float(i)) for i in range(30)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = replay.windowed_means(stream).writeStream.outputMode("append").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("means").orderBy("start").collect()
    assert got and all(r.n == 6 for r in got) and got[0]["mean"] == 2.5


def test_plain_images_round_trip(spark, tmp_path):
    gray = [("gray", r, c, 0, (r * 7 + c) % 256) for r in range(9) for c in range(5)]
    color = [("color", r, c, ch, (r + 50 * ch + c) % 256) for r in range(3) for c in range(4) for ch in range(3)]
    p = spark.createDataFrame(gray + color, plain.PIXELS)
    sizes = {x.path.rsplit("/", 1)[1]: x.bytes for x in plain.write_plain(plain.encode_png(p), tmp_path.as_uri()).collect()}
    assert set(sizes) == {"gray.png", "color.png"} and sizes["gray.png"] == (tmp_path / "gray.png").stat().st_size
    (tmp_path / "broken.png").write_bytes(b"no image")
    back = plain.read_plain(spark, str(tmp_path)).withColumn("image_id", F.regexp_extract("image_id", r"(\w+)\.png$", 1))
    assert {tuple(x) for x in back.collect()} == set(gray + color)


def test_plain_images_values(spark, tmp_path):
    p = spark.createDataFrame([("a", 0, 0, 0, 100), ("a", 1, 1, 0, None), ("a", 0, 1, 0, 3)], plain.PIXELS)
    plain.write_plain(plain.encode_png(p, multiplier=3), tmp_path.as_uri()).collect()
    assert {(x.r, x.c): x.v for x in plain.read_plain(spark, str(tmp_path)).collect()} == {(0, 0): 300 - 256, (0, 1): 9, (1, 0): 0, (1, 1): 0}
    assert plain.encode_png(p.where("r > 5")).count() == 0
    assert {x.v for x in plain.clear(p).collect()} == {0}
    two = spark.createDataFrame([("a", 0, 0, 1, 1)], plain.PIXELS)
    with pytest.raises(Exception, match="1 or 3 channels"):
        plain.encode_png(two).collect()


def test_save_level(spark, tmp_path):
    path, target = str(tmp_path / "p"), str(tmp_path / "t")
    images.write_pyramid(image(spark), path, levels=2, tile=8)
    images.save_level(spark, path, 1, target)
    key = lambda d: {(x.image_id, x.r, x.c, x.v) for x in d.collect()}
    assert key(images.read_level(spark, target, 0, 8)) == key(images.read_level(spark, path, 1, 8))
