"""Driver tables read as rasters, masks, catalogues and epochs, with the same derivations as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 patches: ``image_id, r, c, v, q, label``; q is v on 0..255."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "e"))
    v = F.col("e").cast("double")
    return e.select(
        F.col("vec_id").alias("image_id"), F.expr("cast(p div 8 as int)").alias("r"), (F.col("p") % 8).alias("c"), v.alias("v"),
        F.floor((v + 1) * 127.5).cast("int").alias("q"), "label")


PATCHES = """px AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c, CAST(e AS DOUBLE) AS v,
  CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INTEGER) AS q, label
  FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(generate_series(1, 64)) AS i FROM embeddings))"""


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches laid out 25 in a row as one image: ``image_id, r, c, v, q``."""
    return patches(spark, sf_dir).select(
        F.lit(0).cast("long").alias("image_id"), F.expr("cast((image_id div 25) * 8 + r as int)").alias("r"),
        F.expr("cast((image_id % 25) * 8 + c as int)").alias("c"), "v", "q")


MOSAIC = PATCHES + """, mo AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST((image_id // 25) * 8 + r AS INTEGER) AS r,
  CAST((image_id % 25) * 8 + c AS INTEGER) AS c, v, q FROM px)"""


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items folded to a 256x256 grid: ``r, c, v`` (largest quantity), ``a`` (label of the return flag), ``b`` (of the line status)."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy((F.col("l_partkey") % 256).cast("int").alias("r"), ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 256).cast("int").alias("c")).agg(
        F.max("l_quantity").cast("int").alias("v"), F.max(F.expr("ascii(l_returnflag) % 3 + 1")).alias("a"), F.max(F.expr("ascii(l_linestatus) % 2 + 1")).alias("b"))


HEAT = """ht AS (SELECT CAST(l_partkey % 256 AS INTEGER) AS r, CAST((l_suppkey * 7 + l_orderkey) % 256 AS INTEGER) AS c,
  CAST(max(l_quantity) AS INTEGER) AS v, max(ascii(l_returnflag) % 3 + 1) AS a, max(ascii(l_linestatus) % 2 + 1) AS b FROM lineitem GROUP BY 1, 2)"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day as training epochs: ``epoch, loss, accuracy`` rounded to six places."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("epoch")).agg(
        F.round(F.sum(F.floor(F.col("value") * 100).cast("long")) / F.count("*"), 4).alias("loss"),
        F.round(F.sum(F.when(F.col("event_type") == "error", 0).otherwise(1)) / F.count("*"), 6).alias("accuracy"))


EPOCHS = """ep AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
  round(CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) / count(*), 4) AS loss,
  round(CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS BIGINT) / count(*), 6) AS accuracy FROM events GROUP BY 1)"""
