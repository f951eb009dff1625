"""Queries of mask indexes: refresh by content, and pixels selected without the mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions.storage import new_path
from tilespark.plans.registry import query
from tilespark.sources import maskindex
from tilespark.sources.fixtures import PATCHES, patches

LABELS = [0, 1, 2, 3]


def _masks(spark, sf, width: str):
    return patches(spark, sf).select("image_id", "r", "c", F.expr(f"cast(q div {width} as int)").alias("label"))


@query("maskstat_refresh", f"""WITH {PATCHES}, m AS (SELECT image_id, r, c, q // 64 AS a, CASE WHEN image_id % 7 = 0 THEN q // 60 ELSE q // 64 END AS b FROM px), f AS (SELECT image_id, bool_or(a <> b) AS fresh FROM m GROUP BY 1)
  SELECT image_id, CAST(b AS INTEGER) AS label, CAST(r // 4 AS INTEGER) AS tile_row, CAST(c // 4 AS INTEGER) AS tile_col, count(*) AS n, fresh FROM m JOIN f USING (image_id) WHERE b BETWEEN 0 AND 3 GROUP BY ALL""")
def maskstat_refresh(spark, sf):
    """Statistics after a part of the masks changed; ``fresh`` marks the images that were counted again."""
    path = new_path(spark, "maskstats")
    first = maskindex.refresh(_masks(spark, sf, "64"), path, LABELS, tile=4)
    last = maskindex.refresh(_masks(spark, sf, "if(image_id % 7 = 0, 60, 64)"), path, LABELS, tile=4)
    found = maskindex.read(spark, path)
    return found.select("image_id", "label", "tile_row", "tile_col", "n", ((F.col("holder") == last) & F.lit(first < last)).alias("fresh"))


@query("select_from_index", f"""WITH {PATCHES}, m AS (SELECT image_id, r, c, CAST(q // 64 AS INTEGER) AS label FROM px WHERE q // 64 BETWEEN 0 AND 3)
  SELECT image_id, label, row_number() OVER (PARTITION BY image_id, label ORDER BY r // 4, c // 4, r, c) - 1 AS k, r, c FROM m""")
def select_from_index(spark, sf):
    """Every pixel of every label, looked up by its number in a stored index."""
    path = new_path(spark, "maskindex")
    maskindex.refresh(_masks(spark, sf, "64"), path, LABELS, tile=4)
    index = maskindex.read(spark, path)
    total = index.groupBy("image_id", "label").agg(F.sum("n").alias("n"))
    wanted = total.select("image_id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    return maskindex.select(index, wanted)
