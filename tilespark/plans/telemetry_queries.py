"""Queries of training telemetry, buffers and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.operators import telemetry as tl, weights as wt
from tilespark.plans.registry import query
from tilespark.sources.fixtures import EPOCHS, PATCHES, epochs, patches, table


@query("epoch_means", f"WITH {EPOCHS} SELECT * FROM ep")
def epoch_means(spark, sf):
    return epochs(spark, sf)


@query("rolling_metric", f"WITH {EPOCHS} SELECT epoch, round(avg(accuracy) OVER (ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM ep")
def rolling_metric(spark, sf):
    return tl.rolling_mean(epochs(spark, sf), "accuracy", 5).select("epoch", F.round("rolling", 6).alias("rolling"))


PLATEAU = EPOCHS + """, b AS (SELECT epoch, accuracy, max(accuracy) OVER (ORDER BY epoch) AS best FROM ep),
  pl AS (SELECT b.epoch, b.accuracy, CAST(CASE WHEN b.best > b.accuracy THEN b.epoch - (SELECT min(e.epoch) FROM ep e WHERE e.accuracy = b.best) ELSE 0 END AS INTEGER) AS plateau FROM b)"""


@query("plateau", f"WITH {PLATEAU} SELECT epoch, plateau FROM pl")
def plateau(spark, sf):
    return tl.plateau(epochs(spark, sf), "accuracy").select("epoch", "plateau")


@query("best_epoch", f"WITH {PLATEAU} SELECT epoch FROM pl WHERE plateau = 0")
def best_epoch(spark, sf):
    return tl.plateau(epochs(spark, sf), "accuracy").where("plateau = 0").select("epoch")


@query("lr_schedule", f"""WITH RECURSIVE {PLATEAU}, o AS (SELECT epoch, plateau, row_number() OVER (ORDER BY epoch) AS n, min(epoch) OVER () AS e0 FROM pl),
  f AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS epoch, CAST(0.1 AS DOUBLE) AS rate, CAST(NULL AS INTEGER) AS last UNION ALL
    SELECT o.n, o.epoch, CASE WHEN least(o.epoch - coalesce(f.last, o.e0), o.plateau) >= 4 THEN f.rate * 0.5 ELSE f.rate END, CASE WHEN least(o.epoch - coalesce(f.last, o.e0), o.plateau) >= 4 THEN o.epoch ELSE f.last END
    FROM f JOIN o ON o.n = f.n + 1) SELECT epoch, round(rate, 9) AS rate FROM f WHERE n > 0""")
def lr_schedule(spark, sf):
    return tl.learning_rate(tl.plateau(epochs(spark, sf), "accuracy").select("epoch", "plateau"), 0.1, 4, 0.5).withColumn("rate", F.round("rate", 9))


@query("early_stop", f"WITH {PLATEAU} SELECT epoch, plateau FROM pl WHERE epoch <= coalesce((SELECT min(epoch) FROM pl WHERE plateau >= 6), 1000000)")
def early_stop(spark, sf):
    return tl.early_stop(tl.plateau(epochs(spark, sf), "accuracy"), 6).select("epoch", "plateau")


@query("rewind_history", f"WITH {EPOCHS} SELECT epoch, loss FROM ep WHERE epoch < (SELECT min(epoch) + 10 FROM ep)")
def rewind_history(spark, sf):
    e = epochs(spark, sf)
    return tl.rewind(e, e.agg(F.min("epoch")).first()[0] + 10).select("epoch", "loss")


@query("buffer_replay", "SELECT event_id % 64 AS slot, max(event_id) AS seq, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1")
def buffer_replay(spark, sf):
    return tl.replay(table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id"), 64)


ERR = "er AS (SELECT event_id AS slot, CAST(user_id % 1000 AS DOUBLE) / 999 AS error FROM events)"


def _errors(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("slot"), ((F.col("user_id") % 1000).cast("double") / 999).alias("error"))


@query("error_histogram", f"WITH {ERR} SELECT CAST(least(floor(error * 20), 19) AS INTEGER) AS bin, count(*) AS n, (CAST(least(floor(error * 20), 19) AS INTEGER) + 1) / 20 AS right_edge FROM er GROUP BY 1, 3")
def error_histogram(spark, sf):
    return tl.error_histogram(_errors(spark, sf), 20)


@query("hard_example_counts", f"WITH {ERR}, d AS (SELECT count(CASE WHEN error > 0.75 THEN 1 END) AS difficult FROM er) SELECT difficult, CAST(5000 - (difficult - CAST(round_even(difficult * 0.3, 0) AS BIGINT)) AS BIGINT) AS transfer FROM d")
def hard_example_counts(spark, sf):
    d = _errors(spark, sf).agg(F.count_if(F.col("error") > 0.75).alias("difficult"))
    return d.withColumn("transfer", tl.replacement(F.col("difficult"), 5000, 0.3, True))


@query("buffer_partition_order", f"WITH {ERR} SELECT slot, error, CAST(row_number() OVER (ORDER BY error >= 0.5, slot) AS INTEGER) AS position FROM er")
def buffer_partition_order(spark, sf):
    return tl.partition_order(_errors(spark, sf), 0.5)


@query("buffer_partition_order_all", f"WITH {ERR} SELECT slot, error, CAST(row_number() OVER (ORDER BY error >= 0.5, slot) AS INTEGER) AS position FROM er")
def buffer_partition_order_all(spark, sf):
    return tl.partition_order(_errors(spark, sf), 0.5)


LABELS = PATCHES + ", lb AS (SELECT image_id, r, c, q % 4 AS label, q % 7 > 0 AS valid FROM px)"


def _labels(spark, sf):
    return patches(spark, sf).select("image_id", "r", "c", (F.col("q") % 4).alias("label"), (F.col("q") % 7 > 0).alias("valid"))


def _weights(by: str) -> str:
    g, j = (f"{by}, ", f"USING ({by}, label)") if by else ("", "USING (label)")
    p = f"PARTITION BY {by}" if by else ""
    return f"""WITH {LABELS}, n AS (SELECT {g}label, count(*) AS n FROM lb WHERE valid GROUP BY ALL), b AS (SELECT *, sum(n) OVER ({p}) / count(*) OVER ({p}) AS balanced FROM n),
      w AS (SELECT {g}label, least(greatest(balanced / n, 0.5), 4.0) AS w FROM b), x AS (SELECT lb.*, CASE WHEN valid THEN w ELSE 0.0 END AS w FROM lb LEFT JOIN w {j})
      SELECT image_id, r, c, label, round(coalesce(w * count(CASE WHEN valid THEN 1 END) OVER ({p}) / nullif(sum(w) OVER ({p}), 0), 0), 6) AS weight FROM x"""


@query("class_weights_patch", _weights("image_id"))
def class_weights_patch(spark, sf):
    return wt.weigh(_labels(spark, sf), ["image_id"], 0.5, 4.0).withColumn("weight", F.round("weight", 6)).select("image_id", "r", "c", "label", "weight")


@query("class_weights_batch", _weights(""))
def class_weights_batch(spark, sf):
    return wt.weigh(_labels(spark, sf), [], 0.5, 4.0).withColumn("weight", F.round("weight", 6)).select("image_id", "r", "c", "label", "weight")


@query("weights_clean", f"WITH {LABELS} SELECT image_id, r, c, label, CAST(valid AS DOUBLE) AS weight FROM lb")
def weights_clean(spark, sf):
    return wt.clean_weights(_labels(spark, sf))
