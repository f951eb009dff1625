"""Raster tables: pyramids as partitioned Parquet tiles, annotation XML, epoch CSV, batches, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilespark.operators import raster, resample
from tilespark.operators.pointwise import with_tiles


def write_pyramid(pixels: DataFrame, path: str, levels: int = 3, tile: int = 512, interpolation: str = "nearest", skip_empty: bool = False, empty=0, value: str = "v") -> None:
    """Tiles of every level, partitioned by image and level so that a read of one level lists nothing else.

    The levels written replace those of the same images under ``path``; other images and levels stay.
    """
    p = resample.pyramid(pixels, levels, interpolation, value)
    if skip_empty:
        t = with_tiles(p, tile)
        full = t.where(F.col(value) != empty).select("image_id", "level", "tile_row", "tile_col").distinct()
        p = t.join(full, ["image_id", "level", "tile_row", "tile_col"], "left_semi").select("image_id", "level", "r", "c", value)
    keyed = p.withColumn("image_id", F.struct("image_id", "level"))
    tiles = raster.to_tiles(keyed, tile, value).select("image_id.*", "tile_row", "tile_col", "h", "w", "data")
    ordered = tiles.repartition("image_id", "level", "tile_row").sortWithinPartitions("image_id", "level", "tile_row", "tile_col")
    ordered.write.partitionBy("image_id", "level").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_level(spark: SparkSession, path: str, level: int, tile: int = 512, value: str = "v") -> DataFrame:
    """All pixels of one level."""
    return raster.to_pixels(spark.read.parquet(path).where(F.col("level") == level), tile, value)


def read_window(spark: SparkSession, path: str, level: int, row: int, col: int, height: int, width: int, tile: int = 512, fill=0, value: str = "v") -> DataFrame:
    """A window of one level; only the partitions of the level and the row groups of the touched tiles are read."""
    t = spark.read.parquet(path).where(
        (F.col("level") == level) & F.col("tile_row").between(row // tile, (row + height - 1) // tile) & F.col("tile_col").between(col // tile, (col + width - 1) // tile))
    return raster.window_read(raster.to_pixels(t, tile, value), row, col, height, width, fill, value)


def save_level(spark: SparkSession, path: str, level: int, target: str) -> None:
    """Copy the tiles of one level as level 0 of a pyramid of its own; tiles are not decoded, and other images under ``target`` stay."""
    tiles = spark.read.parquet(path).where(F.col("level") == level).withColumn("level", F.lit(0))
    tiles.write.partitionBy("image_id", "level").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)


ANNOTATION_SCHEMA = """struct<Annotations:struct<Annotation:array<struct<_Name:string,_Type:string,_PartOfGroup:string,_Color:string,
  Coordinates:struct<Coordinate:array<struct<_Order:int,_X:double,_Y:double>>>>>>,
  AnnotationGroups:struct<Group:array<struct<_Name:string,_PartOfGroup:string,_Color:string>>>>"""


def read_annotations(spark: SparkSession, path: str, spacing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """XML files of annotations -> ``items(file, name, type, grp, color, coords)`` and ``groups(file, name, parent, color)``.

    Coordinates are (row, col) times the spacing, in their written order; the group name ``None`` stands for no group.
    """
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    doc = text.select("file", F.from_xml("value", ANNOTATION_SCHEMA).alias("d"))
    none = lambda c: F.nullif(F.col(c), F.lit("None"))
    i = doc.select("file", F.explode("d.Annotations.Annotation").alias("a"))
    ordered = F.array_sort("a.Coordinates.Coordinate")
    items = i.select(
        "file", F.col("a._Name").alias("name"), F.lower("a._Type").alias("type"), none("a._PartOfGroup").alias("grp"), F.col("a._Color").alias("color"),
        F.transform(ordered, lambda p: F.struct((p["_Y"] * spacing).alias("row"), (p["_X"] * spacing).alias("col"))).alias("coords"))
    g = doc.select("file", F.explode("d.AnnotationGroups.Group").alias("g"))
    return items, g.select("file", F.col("g._Name").alias("name"), none("g._PartOfGroup").alias("parent"), F.col("g._Color").alias("color"))


def annotation_xml(items: DataFrame, groups: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Inverse of ``read_annotations``: ``file, value`` with one XML document a file; coordinates are divided by the spacing."""
    quote = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("None")), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    point = F.transform("coords", lambda p, k: F.format_string('<Coordinate Order="%d" X="%s" Y="%s" />', k, (p["col"] / spacing).cast("string"), (p["row"] / spacing).cast("string")))
    a = items.select("file", "name", F.format_string('<Annotation Name="%s" Type="%s" PartOfGroup="%s" Color="%s"><Coordinates>%s</Coordinates></Annotation>',
                     quote("name"), F.initcap("type"), quote("grp"), quote("color"), F.array_join(point, "")).alias("x"))
    g = groups.select("file", "name", F.format_string('<Group Name="%s" PartOfGroup="%s" Color="%s"><Attributes /></Group>', quote("name"), quote("parent"), quote("color")).alias("x"))
    joined = lambda d, n: d.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "x"))), lambda s: s["x"]), "").alias(n))
    both = joined(a, "a").join(joined(g, "g"), "file", "full")
    return both.select("file", F.format_string("<AnnotationFile><Annotations>%s</Annotations><AnnotationGroups>%s</AnnotationGroups></AnnotationFile>", F.coalesce("a", F.lit("")), F.coalesce("g", F.lit(""))).alias("value"))


def append_epoch(epochs: DataFrame | None, row: DataFrame) -> DataFrame:
    """Add a row of statistics; metrics that one side lacks become null."""
    return row if epochs is None else epochs.unionByName(row, allowMissingColumns=True)


def write_epochs(epochs: DataFrame, path: str) -> None:
    epochs.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_batch(batch: DataFrame, path: str, spacings: list[float], channels: list[int], order: str, seed: int, repetition: int) -> None:
    """Patches with their settings as columns, one folder a repetition."""
    settings = {"spacings": F.array(*map(F.lit, spacings)), "channels": F.array(*map(F.lit, channels)), "order": F.lit(order), "seed": F.lit(seed), "repetition": F.lit(repetition)}
    batch.withColumns(settings).write.mode("append").partitionBy("repetition").parquet(path)


def results_json(jobs: DataFrame) -> DataFrame:
    """``jobs(image, output, error)`` -> JSON lines, failed jobs first."""
    failed = F.col("error").isNotNull()
    return jobs.orderBy(~failed, "image").select(F.to_json(F.struct("image", "output", F.when(failed, "failed").otherwise("done").alias("status"), "error")).alias("value"))


def redact_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null out identifying columns, as slide anonymisation clears vendor fields."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})
