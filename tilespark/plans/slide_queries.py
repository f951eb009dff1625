"""Queries of stored slides, read by pixel spacing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions.storage import new_path
from tilespark.plans.registry import query
from tilespark.sources import slides
from tilespark.sources.fixtures import MOSAIC, PATCHES, mosaic, table


def _slide(spark, sf) -> str:
    path = new_path(spark, "slides")
    spacing = spark.createDataFrame([(0, 0.25)], "image_id long, spacing double")
    slides.write(mosaic(spark, sf), spacing, path, levels=2, tile=32, value="q")
    return path


@query("image_scan", f"""WITH {PATCHES} SELECT image_id AS window_id, CAST(0 AS BIGINT) AS image_id, CAST(image_id % 3 AS INTEGER) AS level, CAST(r >> (image_id % 3) AS INTEGER) AS r, CAST(c >> (image_id % 3) AS INTEGER) AS c, q
  FROM px WHERE r % (1 << (image_id % 3)) = 0 AND c % (1 << (image_id % 3)) = 0""")
def image_scan(spark, sf):
    """A window on every patch of the mosaic, each at the spacing of one of three levels or near it."""
    level = F.col("vec_id") % 3
    place = lambda p: F.expr(f"cast(({p}) * shiftright(8, cast(vec_id % 3 as int)) as int)")
    size = F.expr("shiftright(8, cast(vec_id % 3 as int))")
    windows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("window_id"), F.lit(0).alias("image_id"), F.when(level == 0, 0.28).when(level == 1, 0.5).otherwise(1.1).alias("spacing"),
        place("vec_id div 25").alias("row"), place("vec_id % 25").alias("col"), size.alias("height"), size.alias("width"))
    return slides.read(spark, _slide(spark, sf), windows, value="q")


@query("image_levels", f"""WITH {MOSAIC}, s AS (SELECT image_id, max(r) + 1 AS rows, max(c) + 1 AS cols FROM mo GROUP BY 1)
  SELECT image_id, CAST(l AS INTEGER) AS level, CAST(ceil(rows / power(2, l)) AS INTEGER) AS rows, CAST(ceil(cols / power(2, l)) AS INTEGER) AS cols,
    CAST(0.25 * power(2, l) AS DOUBLE) AS spacing, CAST(power(2, l) AS DOUBLE) AS downsampling, CAST(32 AS INTEGER) AS tile FROM s, (SELECT unnest(generate_series(0, 2)) AS l)""")
def image_levels(spark, sf):
    """Shapes, spacings and downsampling of a stored slide."""
    return slides.levels(spark, _slide(spark, sf))
