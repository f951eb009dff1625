"""Mask statistics that know their mask: an index by image, renewed where the mask's content changed, with a select structure.

A stored index is a folder with ``tiles/version=N`` (one row for each image, tile and label) and ``images/version=N`` (one row an image: content
hash, spacing and the version that holds its tiles). A refresh hashes the masks, counts those whose hash is new into a version of its
own and writes the list of images last, so a refresh that fails leaves the former version in force.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tilespark.functions.storage import materialize
from tilespark.operators.pointwise import with_tiles

_IMAGES = "image_id long, hash string, spacing double, tile int, labels array<int>, holder int"


def content_hashes(mask: DataFrame) -> DataFrame:
    """``mask(image_id, r, c, label)`` -> ``image_id, hash``; equal for equal pixels in any order. Partial sums by task, nothing is sorted."""
    one = F.xxhash64("r", "c", "label")
    both = F.concat_ws(":", F.count("*"), F.sum(one.cast("decimal(38,0)")), F.bit_xor(F.xxhash64("label", "c", "r")))
    return mask.groupBy("image_id").agg(F.sha2(both, 256).alias("hash"))


def tile_runs(mask: DataFrame, tile: int) -> DataFrame:
    """Pixels of one label as runs along rows, by tile: ``image_id, label, tile_row, tile_col, n, row, first, upto``.

    ``row, first`` are where the runs begin inside the tile, in order, ``upto`` the pixels up to each run's end; a tile's runs are one row.
    """
    t = with_tiles(mask, tile).select("image_id", "label", "tile_row", "tile_col", F.pmod("r", F.lit(tile)).cast("int").alias("y"), F.pmod("c", F.lit(tile)).cast("int").alias("x"))
    cells = t.groupBy("image_id", "label", "tile_row", "tile_col").agg(F.array_sort(F.collect_list(F.col("y") * tile + F.col("x"))).alias("at"))
    begins = f"filter(sequence(0, size(at) - 1), i -> i = 0 or at[greatest(i - 1, 0)] + 1 <> at[i] or at[i] % {tile} = 0)"
    runs = cells.withColumn("begins", F.expr(begins))
    return runs.select(
        "image_id", "label", "tile_row", "tile_col", F.size("at").cast("long").alias("n"), F.expr(f"transform(begins, i -> int(at[i] div {tile}))").alias("row"),
        F.expr(f"transform(begins, i -> int(at[i] % {tile}))").alias("first"), F.expr("concat(slice(begins, 2, size(begins)), array(size(at)))").alias("upto"))


def _latest(spark: SparkSession, path: str) -> int | None:
    try:
        found = spark.read.parquet(f"{path}/images").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found


def _images(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(_IMAGES).parquet(f"{path}/images/version={version}")


def refresh(mask: DataFrame, path: str, labels: list[int], tile: int = 512, spacing: float = 1.0, hashes: DataFrame | None = None) -> int:
    """Brings the index at ``path`` up to ``mask(image_id, r, c, label)``; returns its version.

    Only images that are new or whose content hash changed are counted. ``hashes(image_id, hash)`` spares reading the masks for that. Images that
    are gone leave the index. Pixels of other labels than ``labels`` take no part. An index of another tile size, spacing or label list
    is an error. A mask without pixels gives an empty index.
    """
    spark = mask.sparkSession
    now = materialize((content_hashes(mask) if hashes is None else hashes).select(F.col("image_id").cast("long").alias("image_id"), "hash"), "hashes")
    last = _latest(spark, path)
    version = (last or 0) + 1
    wanted = sorted(set(labels))
    old = spark.createDataFrame([], _IMAGES)
    if last is not None:
        old = _images(spark, path, last)
        wrong = old.where((F.col("tile") != tile) | (F.abs(F.col("spacing") - spacing) > 1e-9) | (F.to_json("labels") != F.lit(str(wanted).replace(" ", "")))).first()
        if wrong:
            raise ValueError(f"the index has tiles of {wrong['tile']} pixels at spacing {wrong['spacing']} for labels {wrong['labels']}, not {tile}, {spacing}, {wanted}")
    same = now.join(old.select("image_id", "hash", "holder"), ["image_id", "hash"], "left")
    fresh = same.where("holder is null").select("image_id")
    counted = tile_runs(mask.where(F.col("label").isin(wanted)).join(fresh, "image_id", "left_semi"), tile)
    counted.write.mode("overwrite").parquet(f"{path}/tiles/version={version}")
    list_ = F.array(*[F.lit(x) for x in wanted]).cast("array<int>")
    same.select("image_id", "hash", F.lit(float(spacing)).alias("spacing"), F.lit(tile).alias("tile"), list_.alias("labels"), F.coalesce("holder", F.lit(version)).alias("holder")).write.mode(
        "overwrite").parquet(f"{path}/images/version={version}")
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The runs of the index: ``image_id, label, tile_row, tile_col, n, row, first, upto, tile, holder``, ``holder`` being the version that counted the image."""
    version = _latest(spark, path) if version is None else version
    if version is None:
        raise ValueError(f"no mask index at {path}")
    images = _images(spark, path, version)
    tiles = spark.read.option("basePath", f"{path}/tiles").parquet(f"{path}/tiles").withColumnRenamed("version", "holder")
    return tiles.join(images.select("image_id", "holder", "tile"), ["image_id", "holder"]).select(
        "image_id", "label", "tile_row", "tile_col", "n", "row", "first", "upto", "tile", "holder")


def _not_above(sums: str, k: str) -> Column:
    """How many of the ascending ``sums`` are at most ``k``, by halving: a step for each binary digit of their number."""
    return F.expr(f"aggregate(transform(sequence(0, length(bin(size({sums}))) - 1), i -> shiftleft(1, length(bin(size({sums}))) - 1 - i)), 0, (a, b) -> if(a + b <= size({sums}) and {sums}[greatest(least(a + b, size({sums})) - 1, 0)] <= {k}, a + b, a))")


def select(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(image_id, label, k)`` -> ``image_id, label, k, r, c``: the k-th pixel (from 0) of a label by tile row, tile column, row and column.

    Three lookups, each a join on a whole key and a search in sums: the tile row in the image's sums, the tile in the row's, the run
    in the tile's. The mask itself is not read. Numbers beyond a label's pixels give no row. The tile size is that of the index.
    """
    sums = lambda by, over: Window.partitionBy(*by).orderBy(over).rowsBetween(Window.unboundedPreceding, 0)
    rows = index.groupBy("image_id", "label", "tile_row").agg(F.sum("n").alias("n"))
    of_image = rows.withColumn("s", F.sum("n").over(sums(["image_id", "label"], "tile_row"))).groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct("s", "tile_row"))).alias("rows"))
    cols = index.select("image_id", "label", "tile_row", "tile_col", F.sum("n").over(sums(["image_id", "label", "tile_row"], "tile_col")).alias("s"))
    of_row = cols.groupBy("image_id", "label", "tile_row").agg(F.array_sort(F.collect_list(F.struct("s", "tile_col"))).alias("cols"))
    a = wanted.join(of_image, ["image_id", "label"]).withColumn("i", _not_above("rows.s", "k")).where("k >= 0 and i < size(rows)")
    a = a.select("image_id", "label", "k", F.expr("get(rows, i).tile_row").alias("tile_row"), F.expr("k - if(i > 0, get(rows, i - 1).s, 0)").alias("left"))
    b = a.join(of_row, ["image_id", "label", "tile_row"]).withColumn("i", _not_above("cols.s", "left"))
    b = b.select("image_id", "label", "k", "tile_row", F.expr("get(cols, i).tile_col").alias("tile_col"), F.expr("left - if(i > 0, get(cols, i - 1).s, 0)").alias("left"))
    c = b.join(index.select("image_id", "label", "tile_row", "tile_col", "row", "first", "upto", "tile"), ["image_id", "label", "tile_row", "tile_col"])
    c = c.withColumn("i", _not_above("upto", "left"))
    size = F.col("tile")
    return c.select("image_id", "label", "k", (F.col("tile_row") * size + F.expr("get(row, i)")).cast("int").alias("r"),
                    (F.col("tile_col") * size + F.expr("get(first, i) + left - if(i > 0, get(upto, i - 1), 0)")).cast("int").alias("c"))
