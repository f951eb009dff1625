"""Patch batches: sources by label, distribution of a batch over labels and sources, assembly, and axis order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tilespark.functions.ordering import numbered
from tilespark.functions.storage import materialize
from tilespark.operators import maskstats as ms, patches as pt, sampling as sm


def label_sources(sources: DataFrame) -> DataFrame:
    """``sources(image_id, label)`` -> number of open sources of each label."""
    return sources.groupBy("label").agg(F.count_distinct("image_id").alias("n_sources"))


def distribute(sources: DataFrame, ratios: dict[int, float], total: int, seed: int) -> DataFrame:
    """``sources(image_id, label)`` -> ``image_id, label, share``: a batch of ``total`` patches over the labels and then evenly over each label's sources.

    Labels that no source has drop out and leave their ratio to the others; without any label of the ratios it is an error.
    """
    wanted = {k: v for k, v in ratios.items() if v > 0}
    open_ = materialize(sources.where(F.col("label").isin(list(wanted))).select("image_id", "label").distinct(), "sources")
    counts = label_sources(open_)
    there = {r["label"]: wanted[r["label"]] for r in counts.collect()}  # as many rows as ratios
    if not there:
        raise ValueError("no source has any of the labels")
    spark, whole = sources.sparkSession, sum(there.values())
    rows = [(k, v / whole, 0, total) for k, v in sorted(there.items())]
    by_label = sm.allocate(spark.createDataFrame(rows, "key int, ratio double, low long, high long"), total, seed=seed)
    # even shares are rounded, and the first sources of a label in seeded order take what is missing or give what is too much
    share = F.bround(F.col("total") / F.col("n_sources")).cast("long")
    upto = F.sum("n_sources").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1))
    labels = counts.join(by_label.select(F.col("key").alias("label"), F.col("share").alias("total")), "label").withColumn("before", F.coalesce(upto, F.lit(0)))
    ranked = numbered(open_, "place", "label", sm.seeded(seed, "image_id"), "image_id").join(F.broadcast(labels), "label")
    short = F.col("total") - share * F.col("n_sources")
    moved = F.when(F.col("place") - F.col("before") <= F.abs(short), F.signum(short)).otherwise(0).cast("long")
    return ranked.select("image_id", "label", (share + moved).alias("share"))


def assemble(images: DataFrame, masks: DataFrame, ratios: dict[int, float], total: int, size: int, seed: int, value: str = "v", tile: int = 512) -> DataFrame:
    """A batch: ``position, image_id, label, y, x, <value>`` of ``total`` patches of ``size`` x ``size`` around sampled pixels of each label.

    ``images(image_id, r, c, <value>)``, ``masks(image_id, r, c, label)``. Positions follow source, label and draw, so that the patches of a source begin at the
    running sum of the counts before it.
    """
    counts = materialize(ms.label_counts(masks), "counts")
    share = distribute(counts, ratios, total, seed).where("share > 0")
    drawn = sm.sample_indices(counts.join(share, ["image_id", "label"]), F.col("share"), seed + 1)
    drawn = numbered(drawn, "position", "image_id", "label", "i").withColumn("position", F.col("position") - 1)
    found = drawn.join(ms.pixel_of_label(masks, drawn.select("image_id", "label", "k").distinct(), tile), ["image_id", "label", "k"])
    cells = pt.extract(found.select("image_id", F.col("position").alias("patch_id"), F.col("r").alias("row"), F.col("c").alias("col")), images, size, size, value, tile)
    return cells.withColumnRenamed("patch_id", "position").join(found.select("position", "label"), "position").select("position", "image_id", "label", "y", "x", value)


def channels_last(data: Column, channels: int, pixels: int) -> Column:
    """A flat (channel, row, column) array as (row, column, channel)."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels * pixels - 1)), lambda i: F.get(data, (i % channels) * pixels + F.floor(i / channels).cast("int")))


def channels_first(data: Column, channels: int, pixels: int) -> Column:
    """A flat (row, column, channel) array as (channel, row, column)."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels * pixels - 1)), lambda i: F.get(data, (i % pixels) * channels + F.floor(i / pixels).cast("int")))
