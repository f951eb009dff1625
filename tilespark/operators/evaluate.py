"""Evaluation of masks and scores: overlap, objects, accuracy, soft metrics and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tilespark.functions.ordering import running_sums
from tilespark.operators.components import label_components


def pixel_measures(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of two foreground pixel sets, their union and intersection, by image; with Dice and Jaccard (null where undefined)."""
    keys = ["image_id", "r", "c"]
    j = a.select(*keys, F.lit(1).alias("a")).join(b.select(*keys, F.lit(1).alias("b")), keys, "full")
    g = j.groupBy("image_id").agg(F.count("a").alias("size_a"), F.count("b").alias("size_b"), F.count("*").alias("n_union"), F.count(F.col("a") + F.col("b")).alias("n_both"))
    return g.withColumns({"dice": F.try_divide(2 * F.col("n_both"), F.col("size_a") + F.col("size_b")), "jaccard": F.try_divide("n_both", "n_union")})


def _objects(ref: DataFrame, other: DataFrame, full: bool, tile: int) -> tuple[DataFrame, DataFrame]:
    """Labelled pixels of ``ref`` with ``hit`` (in ``other``), and the share of each component that is hit."""
    comp = label_components(ref, full, tile)
    marked = comp.join(other.select("image_id", "r", "c", F.lit(1).alias("hit")), ["image_id", "r", "c"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return marked, marked.groupBy("image_id", "component").agg(F.count("*").alias("size"), F.sum("hit").alias("overlap"))


def object_counts(reference: DataFrame, template: DataFrame, hit: float, false: float, full: bool = True, tile: int = 512) -> DataFrame:
    """True positives: reference objects with overlap/size above ``hit``; false negatives: the others; false positives: template objects not above ``false``."""
    share = F.col("overlap") / F.col("size")
    r = _objects(reference, template, full, tile)[1].groupBy("image_id").agg(F.count_if(share > hit).alias("tp"), F.count_if(~(share > hit)).alias("fn"))
    t = _objects(template, reference, full, tile)[1].groupBy("image_id").agg(F.count_if(~(share > false)).alias("fp"))
    return r.join(t, "image_id", "full").select("image_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("tp", "fn", "fp")])


def region_codes(reference: DataFrame, template: DataFrame, hit: float, full: bool = True, tile: int = 512) -> DataFrame:
    """Pixels coded 1/2 (found/missed pixel of a hit reference object), 3/4 (of a missed one), 5/6 (template only: of a hit or missed template object)."""
    keys = ["image_id", "r", "c"]
    pixels, share = _objects(reference, template, full, tile)
    good = share.select("image_id", "component", (F.col("overlap") / F.col("size") > hit).alias("good"))
    first = pixels.join(good, ["image_id", "component"]).select(*keys, F.when(F.col("good"), 2 - F.col("hit")).otherwise(4 - F.col("hit")).cast("int").alias("code"))
    pixels, share = _objects(template, reference, full, tile)
    good = share.select("image_id", "component", (F.col("overlap") / F.col("size") > hit).alias("good"))
    second = pixels.where("hit = 0").join(good, ["image_id", "component"]).select(*keys, F.when(F.col("good"), 5).otherwise(6).alias("code"))
    return first.unionByName(second)


def batch_accuracy(df: DataFrame, by: str) -> DataFrame:
    """``df(<by>, label (1-based), probs, weight)``: accuracy over rows of positive weight, and the weighted mean of the largest shortfall."""
    right = (F.array_position("probs", F.array_max("probs")) == F.col("label")).cast("int")
    short = F.array_max(F.transform("probs", lambda p, i: F.when(i + 1 == F.col("label"), 1.0).otherwise(0.0) - p))
    seen = F.col("weight") > 0
    return df.groupBy(by).agg(F.avg(F.when(seen, right)).alias("accuracy"), F.try_divide(F.sum(short * F.col("weight")), F.sum("weight")).alias("error"))


def weighted_nll(df: DataFrame, by: str) -> DataFrame:
    loss = -F.log(F.greatest(F.element_at("probs", F.col("label")), F.lit(1e-12)))
    return df.groupBy(by).agg(F.try_divide(F.sum(loss * F.col("weight")), F.sum("weight")).alias("nll"))


def soft_overlap(df: DataFrame, by: list[str], epsilon: float = 1e-7) -> DataFrame:
    """``df(<by>, p, t)``: soft Dice and IoU of a probability and a 0/1 target."""
    both, total = F.sum(F.col("p") * F.col("t")), F.sum("p") + F.sum("t")
    return df.groupBy(*by).agg(((2 * both + epsilon) / (total + epsilon)).alias("soft_dice"), ((both + epsilon) / (total - both + epsilon)).alias("soft_iou"))


def lovasz(df: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """Lovasz extension of the Jaccard loss for each group: errors in descending order times the increments of the loss; only groups with a target.

    ``df(<by>, <tie>, p, t)``, targets 0 or 1. With n rows and s targets up to a row of a group with a targets, the loss so far is
    1 - (a - s) / (a + n - s), and before the row it has n - 1 and s - t: both come from one segmented scan, so no task orders a whole group.
    """
    d = df.select(*by, *tie, F.abs(F.col("t") - F.col("p")).alias("_e"), F.col("t").cast("long").alias("_t"))
    all_ = d.groupBy(*by).agg(F.sum("_t").alias("_all")).where("_all > 0")
    d = running_sums(d, by, [-F.col("_e"), *map(F.col, tie)], {"_s": "_t"}).join(all_, by)
    loss = lambda n, s: 1 - (F.col("_all") - s) / (F.col("_all") + n - s)
    before = F.when(F.col("_n") > 1, loss(F.col("_n") - 1, F.col("_s") - F.col("_t"))).otherwise(0.0)
    return d.groupBy(*by).agg(F.sum(F.col("_e") * (loss(F.col("_n"), F.col("_s")) - before)).alias("loss"))
