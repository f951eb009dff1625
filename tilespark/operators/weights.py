"""Class weights of label patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def class_weights(labels: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """``labels(<by>, label, valid)`` -> weight of each label: valid pixels over present classes, over the class's pixels, within low..high."""
    counts = labels.where("valid").groupBy(*by, "label").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg((F.sum("n") / F.count("*")).alias("balanced"))
    joined = counts.join(totals, by) if by else counts.crossJoin(F.broadcast(totals))
    return joined.select(*by, "label", F.least(F.greatest(F.col("balanced") / F.col("n"), F.lit(low)), F.lit(high)).alias("weight"))


def weigh(labels: DataFrame, by: list[str], low: float = 0.0, high: float = 1e9) -> DataFrame:
    """Each pixel's weight, scaled so that the valid pixels' weights add up to their number; invalid pixels weigh 0."""
    w = class_weights(labels, by, low, high)
    joined = labels.join(w, [*by, "label"], "left").withColumn("weight", F.when(F.col("valid"), F.col("weight")).otherwise(0.0))
    sums = joined.groupBy(*by).agg(F.sum("weight").alias("_s"), F.count_if("valid").alias("_n"))
    scaled = joined.join(sums, by) if by else joined.crossJoin(F.broadcast(sums))
    return scaled.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col("_n"), F.col("_s")), F.lit(0.0))).drop("_s", "_n", "valid")


def clean_weights(labels: DataFrame) -> DataFrame:
    return labels.withColumn("weight", F.col("valid").cast("double")).drop("valid")
