"""Queries of stored batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions.ordering import numbered
from tilespark.functions.storage import new_path
from tilespark.plans.registry import query
from tilespark.sources import batchstore
from tilespark.sources.fixtures import PATCHES, patches, table

_POSITIONS = "po AS (SELECT vec_id AS image_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS position FROM embeddings)"


def _stored(spark, sf, piece: int) -> str:
    path = new_path(spark, "batches")
    placed = numbered(table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id")), "position", "image_id").withColumn("position", F.col("position") - 1)
    batch = patches(spark, sf).join(placed, "image_id").select("position", "image_id", "label", "r", "c", "q")
    batchstore.write(batch, path, 0, {"order": "bchw", "spacing": "0.5"}, piece)
    batchstore.write(batch.withColumn("q", 255 - F.col("q")), path, 1, {"order": "bchw", "spacing": "1.0"}, piece)
    return path


@query("batch_store_round_trip", f"""WITH {PATCHES}, {_POSITIONS}
  SELECT position, image_id, label, r, c, q FROM px JOIN po USING (image_id) WHERE position >= 70""")
def batch_store_round_trip(spark, sf):
    """All patches stored as two repetitions; the first is read back from position 70."""
    return batchstore.read(spark, _stored(spark, sf, 64), 0, 70, settings={"spacing": "0.5"})


@query("batch_store_manifest", """SELECT CAST(k AS INTEGER) AS repetition, count(*) AS patches, 64 * count(*) AS cells, 0.5::DOUBLE * (1 + k) AS spacing, true AS whole
  FROM embeddings, (SELECT unnest([0, 1]) AS k) GROUP BY k""")
def batch_store_manifest(spark, sf):
    """What is stored, and whether it is what was written."""
    path = _stored(spark, sf, 100)
    held = batchstore.manifest(spark, path).select("repetition", "patches", F.col("settings")["spacing"].cast("double").alias("spacing"))
    return held.join(batchstore.verify(spark, path), "repetition").select("repetition", "patches", "cells", "spacing", "whole")
