"""Queries of mask statistics, regions, morphology, evaluation and inference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilespark.operators import components as cc, evaluate as ev, inference as inf, maskstats as ms, morphology as mo, pointwise as pw
from tilespark.plans.registry import query
from tilespark.sources.fixtures import HEAT, MOSAIC, PATCHES, heat, mosaic, patches, table

KEYS = ["image_id", "r", "c"]
MASK = HEAT + ", m AS (SELECT CAST(0 AS BIGINT) AS image_id, r, c, a AS label FROM ht)"


def _mask(spark, sf):
    return heat(spark, sf).select(F.lit(0).cast("long").alias("image_id"), "r", "c", F.col("a").alias("label"))


TILES = MASK + ", t AS (SELECT image_id, CAST(r // 16 AS INTEGER) AS tile_row, CAST(c // 16 AS INTEGER) AS tile_col, label, count(*) AS n FROM m GROUP BY 1, 2, 3, 4)"


@query("tile_label_bincount", f"WITH {TILES} SELECT * FROM t")
def tile_label_bincount(spark, sf):
    return ms.tile_counts(_mask(spark, sf), 16)


@query("mask_label_counts", f"WITH {MASK} SELECT image_id, label, count(*) AS n FROM m GROUP BY 1, 2")
def mask_label_counts(spark, sf):
    return ms.label_counts(_mask(spark, sf))


@query("tile_prefix_sum", f"WITH {TILES} SELECT *, CAST(sum(n) OVER (PARTITION BY label, tile_row ORDER BY tile_col) AS BIGINT) AS n_cum FROM t")
def tile_prefix_sum(spark, sf):
    return ms.tile_prefix(ms.tile_counts(_mask(spark, sf), 16))


@query("tile_row_prefix", f"""WITH {TILES}, s AS (SELECT image_id, label, tile_row, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1, 2, 3)
  SELECT *, CAST(sum(n) OVER (PARTITION BY label ORDER BY tile_row) AS BIGINT) AS n_cum FROM s""")
def tile_row_prefix(spark, sf):
    return ms.tile_row_prefix(ms.tile_counts(_mask(spark, sf), 16))


@query("homogeneous_tiles", f"""WITH {MASK} SELECT image_id, CAST(r // 2 AS INTEGER) AS tile_row, CAST(c // 2 AS INTEGER) AS tile_col, max(label) AS label FROM m GROUP BY 1, 2, 3 HAVING count(*) = 4 AND min(label) = max(label)""")
def homogeneous_tiles(spark, sf):
    return ms.homogeneous_tiles(ms.tile_counts(_mask(spark, sf), 2), 2)


@query("kth_pixel_of_label", f"""WITH {MASK}, k AS (SELECT image_id, label, r, c, row_number() OVER (PARTITION BY label ORDER BY r // 16, c // 16, r, c) - 1 AS k FROM m)
  SELECT image_id, label, k, r, c FROM k WHERE k % 97 = 5""")
def kth_pixel_of_label(spark, sf):
    mask = _mask(spark, sf)
    wanted = ms.label_counts(mask).withColumn("k", F.explode(F.sequence(F.lit(5).cast("long"), F.greatest(F.col("n") - 1, F.lit(5)), F.lit(97).cast("long")))).where("k < n").select("image_id", "label", "k")
    return ms.pixel_of_label(mask, wanted, 16)


# ---- regions ----

_STEPS = {4: "(0, 1), (1, 0), (0, -1), (-1, 0)", 8: "(0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)"}


def _comp(source: str, fg: str, n: int, name: str = "") -> str:
    """Recursive reach of each foreground pixel; the component is the smallest pixel id reached."""
    return f"""{source}, fg{name} AS ({fg}), st{name}(dr, dc) AS (VALUES {_STEPS[n]}),
  re{name} AS (SELECT image_id, r * 2147483648 + c AS root, r, c FROM fg{name}
    UNION SELECT f.image_id, re{name}.root, f.r, f.c FROM re{name}, st{name} JOIN fg{name} f ON f.image_id = re{name}.image_id AND f.r = re{name}.r + dr AND f.c = re{name}.c + dc),
  co{name} AS (SELECT image_id, r, c, CAST(min(root) AS BIGINT) AS component FROM re{name} GROUP BY 1, 2, 3)"""


FG1, FG2 = "SELECT image_id, r, c FROM px WHERE v >= 0.05", "SELECT image_id, r, c FROM mo WHERE v >= 0.1"


@query("components8_patches", f"WITH RECURSIVE {_comp(PATCHES, FG1, 8)} SELECT * FROM co")
def components8_patches(spark, sf):
    return cc.label_components(patches(spark, sf).where("v >= 0.05"), True)


@query("components4_patches", f"WITH RECURSIVE {_comp(PATCHES, FG1, 4)} SELECT * FROM co")
def components4_patches(spark, sf):
    return cc.label_components(patches(spark, sf).where("v >= 0.05"), False)


@query("components8", f"WITH RECURSIVE {_comp(MOSAIC, FG2, 8)} SELECT * FROM co")
def components8(spark, sf):
    return cc.label_components(mosaic(spark, sf).where("v >= 0.1"), True, tile=16)


@query("components4", f"WITH RECURSIVE {_comp(MOSAIC, FG2, 4)} SELECT * FROM co")
def components4(spark, sf):
    return cc.label_components(mosaic(spark, sf).where("v >= 0.1"), False, tile=16)


BOX = "bx AS (SELECT image_id, component, count(*) AS pixels, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w, CAST(power(max(r) - min(r) + 1, 2) + power(max(c) - min(c) + 1, 2) AS BIGINT) AS diagonal2 FROM co GROUP BY 1, 2)"


@query("component_boxes", f"WITH RECURSIVE {_comp(MOSAIC, FG2, 8)}, {BOX} SELECT * FROM bx")
def component_boxes(spark, sf):
    return cc.boxes(cc.label_components(mosaic(spark, sf).where("v >= 0.1"), True, tile=16))


@query("region_filter", f"WITH RECURSIVE {_comp(MOSAIC, FG2, 8)}, {BOX} SELECT co.* FROM co JOIN bx USING (image_id, component) WHERE diagonal2 > 25")
def region_filter(spark, sf):
    return cc.filter_regions(mosaic(spark, sf).where("v >= 0.1"), 5.0, tile=16)


HOLE = "SELECT image_id, r, c FROM mo WHERE NOT (v >= -0.1)"


@query("hole_fill", f"WITH RECURSIVE {_comp(MOSAIC, HOLE, 4)}, {BOX} SELECT image_id, r, c FROM co JOIN bx USING (image_id, component) WHERE diagonal2 <= 9")
def hole_fill(spark, sf):
    m = mosaic(spark, sf)
    return cc.fill_holes(m.where("v >= -0.1"), m, 3.0, full_connectivity=False, tile=16)


SIZE = "sz AS (SELECT max(r) AS hr, max(c) AS hc FROM mo)"
FG3 = "fg AS (SELECT image_id, r, c FROM mo WHERE v >= 0.25)"
BALL = "ba AS (SELECT a - 2 AS dr, b - 2 AS dc FROM (SELECT unnest(generate_series(0, 4)) AS a), (SELECT unnest(generate_series(0, 4)) AS b) WHERE abs(a - 2) + abs(b - 2) <= 2)"
DILATED = f"di AS (SELECT DISTINCT image_id, CAST(r + dr AS INTEGER) AS r, CAST(c + dc AS INTEGER) AS c FROM fg, ba, sz WHERE r + dr BETWEEN 0 AND hr AND c + dc BETWEEN 0 AND hc)"


def _size(m):
    return tuple(x + 1 for x in m.agg(F.max("r"), F.max("c")).first())


@query("dilate_l1", f"WITH {MOSAIC}, {SIZE}, {FG3}, {BALL}, {DILATED} SELECT * FROM di")
def dilate_l1(spark, sf):
    m = mosaic(spark, sf)
    return mo.dilate(m.where("v >= 0.25"), mo.iterations(1.0, 0.5), *_size(m))


ERODE = "er AS (SELECT f.image_id, f.r, f.c FROM fe f, ba LEFT JOIN fe g ON g.r = f.r + dr AND g.c = f.c + dc GROUP BY 1, 2, 3 HAVING count(*) = count(g.r))"
FE = "fe AS (SELECT image_id, r, c FROM mo WHERE v >= -0.2)"
BALL1 = "ba AS (SELECT a - 1 AS dr, b - 1 AS dc FROM (SELECT unnest(generate_series(0, 2)) AS a), (SELECT unnest(generate_series(0, 2)) AS b) WHERE abs(a - 1) + abs(b - 1) <= 1)"


@query("erode_l1", f"WITH {MOSAIC}, {FE}, {BALL1}, {ERODE} SELECT * FROM er")
def erode_l1(spark, sf):
    m = mosaic(spark, sf)
    return mo.erode(m.where("v >= -0.2"), 1, *_size(m))


@query("region_margins", f"""WITH {MOSAIC}, {SIZE}, {FE}, {BALL1}, {ERODE},
  di AS (SELECT DISTINCT image_id, CAST(r + dr AS INTEGER) AS r, CAST(c + dc AS INTEGER) AS c FROM fe, ba, sz WHERE r + dr BETWEEN 0 AND hr AND c + dc BETWEEN 0 AND hc)
  SELECT *, 'inner' AS side FROM (SELECT * FROM fe EXCEPT SELECT * FROM er) UNION ALL SELECT *, 'outer' FROM (SELECT * FROM di EXCEPT SELECT * FROM fe)""")
def region_margins(spark, sf):
    m = mosaic(spark, sf)
    return mo.margins(m.where("v >= -0.2"), 1, *_size(m))


# ---- evaluation ----

@query("dice_jaccard", f"""WITH {PATCHES}, g AS (SELECT image_id, count(CASE WHEN v >= 0.0 THEN 1 END) AS size_a, count(CASE WHEN q % 3 = 0 THEN 1 END) AS size_b, count(CASE WHEN v >= 0.0 OR q % 3 = 0 THEN 1 END) AS n_union,
  count(CASE WHEN v >= 0.0 AND q % 3 = 0 THEN 1 END) AS n_both FROM px GROUP BY 1) SELECT *, round(2 * n_both / nullif(size_a + size_b, 0), 6) AS dice, round(n_both / nullif(n_union, 0), 6) AS jaccard FROM g WHERE n_union > 0""")
def dice_jaccard(spark, sf):
    p = patches(spark, sf)
    return ev.pixel_measures(p.where("v >= 0.0"), p.where("q % 3 = 0")).withColumns({n: F.round(n, 6) for n in ("dice", "jaccard")})


REF, TEM = "SELECT image_id, r, c FROM mo WHERE v >= 0.12", "SELECT image_id, r, c FROM mo WHERE v >= 0.15 OR (r + c) % 11 = 0"


def _pair(spark, sf):
    m = mosaic(spark, sf)
    return m.where("v >= 0.12"), m.where("v >= 0.15 or (r + c) % 11 = 0")


def _share(name: str, other: str) -> str:
    return f"sh{name} AS (SELECT a.image_id, a.component, count(*) AS size, count(b.r) AS overlap FROM co{name} a LEFT JOIN fg{other} b USING (image_id, r, c) GROUP BY 1, 2)"


_BOTH = f"{_comp(MOSAIC, REF, 4, 'a')}, {_comp('zz AS (SELECT 1)', TEM, 4, 'b')}, {_share('a', 'b')}, {_share('b', 'a')}"


@query("object_tp_fn_fp", f"""WITH RECURSIVE {_BOTH}
  SELECT CAST(0 AS BIGINT) AS image_id, (SELECT count(*) FROM sha WHERE overlap / size > 0.5) AS tp, (SELECT count(*) FROM sha WHERE NOT overlap / size > 0.5) AS fn, (SELECT count(*) FROM shb WHERE NOT overlap / size > 0.25) AS fp""")
def object_tp_fn_fp(spark, sf):
    return ev.object_counts(*_pair(spark, sf), 0.5, 0.25, full=False, tile=32)


@query("region_comparison_codes", f"""WITH RECURSIVE {_BOTH}
  SELECT a.image_id, a.r, a.c, CAST(CASE WHEN overlap / size > 0.5 THEN 2 ELSE 4 END - CASE WHEN b.r IS NULL THEN 0 ELSE 1 END AS INTEGER) AS code FROM coa a JOIN sha USING (image_id, component) LEFT JOIN fgb b ON b.r = a.r AND b.c = a.c
  UNION ALL SELECT b.image_id, b.r, b.c, CASE WHEN overlap / size > 0.5 THEN 5 ELSE 6 END FROM cob b JOIN shb USING (image_id, component) LEFT JOIN fga a ON b.r = a.r AND b.c = a.c WHERE a.r IS NULL""")
def region_comparison_codes(spark, sf):
    return ev.region_codes(*_pair(spark, sf), 0.5, full=False, tile=32)


PROBS = """s AS (SELECT vec_id, label + 1 AS label, unnest(embedding[1:10]) AS x, unnest(generate_series(1, 10)) AS k FROM embeddings), m AS (SELECT vec_id, max(x::DOUBLE) AS m FROM s GROUP BY 1),
  e AS (SELECT s.vec_id, label, k, exp(x::DOUBLE - m) AS e FROM s JOIN m USING (vec_id)), p AS (SELECT vec_id, label, k, e / sum(e) OVER (PARTITION BY vec_id) AS p, CASE WHEN k = label THEN 1 ELSE 0 END AS t FROM e)"""


def _probs(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("s", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")))
    return e.select("vec_id", (F.col("label") + 1).alias("label"), pw.softmax(F.col("s")).alias("probs"), F.lit(0).alias("batch"), (F.col("vec_id") % 3).cast("double").alias("weight"))


@query("batch_accuracy", f"""WITH {PROBS}, a AS (SELECT vec_id, label, arg_max(k, x) AS best FROM s GROUP BY 1, 2), d AS (SELECT vec_id, max(t - p) AS short FROM p GROUP BY 1)
  SELECT 0 AS batch, round(avg(CASE WHEN vec_id % 3 > 0 THEN CASE WHEN best = label THEN 1 ELSE 0 END END), 6) AS accuracy, round(sum(short * (vec_id % 3)) / sum(vec_id % 3), 6) AS error FROM a JOIN d USING (vec_id)""")
def batch_accuracy(spark, sf):
    return ev.batch_accuracy(_probs(spark, sf), "batch").withColumns({n: F.round(n, 6) for n in ("accuracy", "error")})


@query("weighted_nll", f"WITH {PROBS} SELECT 0 AS batch, round(sum(-ln(p) * (vec_id % 3)) / sum(vec_id % 3), 6) AS nll FROM p WHERE t = 1")
def weighted_nll(spark, sf):
    return ev.weighted_nll(_probs(spark, sf), "batch").withColumn("nll", F.round("nll", 6))


def _long(spark, sf):
    p = _probs(spark, sf).select("vec_id", "label", F.posexplode("probs").alias("i", "p"))
    return p.select("vec_id", (F.col("i") + 1).cast("long").alias("k"), "p", F.when(F.col("i") + 1 == F.col("label"), 1).otherwise(0).alias("t"))


@query("soft_overlap_metric", f"""WITH {PROBS} SELECT k, round((2 * sum(p * t) + 1e-7) / (sum(p) + sum(t) + 1e-7), 6) AS soft_dice, round((sum(p * t) + 1e-7) / (sum(p) + sum(t) - sum(p * t) + 1e-7), 6) AS soft_iou FROM p GROUP BY 1""")
def soft_overlap_metric(spark, sf):
    return ev.soft_overlap(_long(spark, sf), ["k"]).withColumns({n: F.round(n, 6) for n in ("soft_dice", "soft_iou")})


@query("lovasz_loss", f"""WITH {PROBS}, o AS (SELECT k, vec_id, t, abs(t - p) AS e, row_number() OVER w AS n, sum(t) OVER w AS s, sum(t) OVER (PARTITION BY k) AS a FROM p WINDOW w AS (PARTITION BY k ORDER BY abs(t - p) DESC, vec_id)),
  j AS (SELECT *, 1 - (a - s) / (a + n - s) AS j FROM o WHERE a > 0), g AS (SELECT *, j - coalesce(lag(j) OVER (PARTITION BY k ORDER BY n), 0) AS g FROM j) SELECT k, round(sum(e * g), 6) AS loss FROM g GROUP BY 1""")
def lovasz_loss(spark, sf):
    return ev.lovasz(_long(spark, sf), ["k"], ["vec_id"]).withColumn("loss", F.round("loss", 6))


# ---- inference ----

@query("tile_plan", """WITH i AS (SELECT n_nationkey AS image_id, 500 + n_nationkey * 37 AS height, 700 + n_regionkey * 111 AS width FROM nation), p AS (SELECT image_id, height, width, unnest(generate_series(0, (height - 1) // 96)) AS i FROM i), q AS (SELECT *, unnest(generate_series(0, (width - 1) // 96)) AS j FROM p)
  SELECT image_id, CAST(i * 96 AS INTEGER) AS "row", CAST(j * 96 AS INTEGER) AS col, CAST(i * 96 - 16 AS INTEGER) AS read_row, CAST(j * 96 - 16 AS INTEGER) AS read_col, CAST(least(96, height - i * 96) AS INTEGER) AS out_height, CAST(least(96, width - j * 96) AS INTEGER) AS out_width FROM q""")
def tile_plan(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("image_id"), (500 + F.col("n_nationkey") * 37).alias("height"), (700 + F.col("n_regionkey") * 111).alias("width"))
    return inf.tile_plan(n, 128, 14, 2)


@query("recon_geometry", """WITH RECURSIVE l AS (SELECT n_nationkey AS model, k, 3 + 2 * ((n_nationkey + k) % 2) AS kernel, 1 + (n_nationkey + k) % 3 % 2 AS stride, k % 2 AS padding FROM nation, (SELECT unnest(generate_series(0, 5)) AS k)),
  f AS (SELECT n_nationkey AS model, 0 AS k, CAST(1 AS BIGINT) AS ds, CAST(0 AS DOUBLE) AS lost FROM nation UNION ALL SELECT f.model, f.k + 1, CAST(f.ds * l.stride AS BIGINT), f.lost + ((l.kernel - 1) / 2 - l.padding) * f.ds FROM f JOIN l ON l.model = f.model AND l.k = f.k)
  SELECT model, ds AS downsampling, lost, CAST(ceil((ds - 1) / 2) AS INTEGER) AS interpolation_lost FROM f WHERE k = 6""")
def recon_geometry(spark, sf):
    n = table(spark, sf, "nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    key = F.col("n_nationkey") + F.col("k")
    return inf.reconstruction(n.select(F.col("n_nationkey").alias("model"), "k", (3 + 2 * (key % 2)).alias("kernel"), (1 + key % 3 % 2).alias("stride"), (F.col("k") % 2).alias("padding")))


@query("tile_skip_by_mask", f"""WITH {MOSAIC}, s AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM mo), t AS (SELECT DISTINCT r // 16 AS i, c // 16 AS j FROM mo WHERE v >= 0.42)
  SELECT CAST(0 AS BIGINT) AS image_id, CAST(i * 16 AS INTEGER) AS "row", CAST(j * 16 AS INTEGER) AS col, CAST(least(16, h - i * 16) AS INTEGER) AS out_height, CAST(least(16, w - j * 16) AS INTEGER) AS out_width FROM t, s""")
def tile_skip_by_mask(spark, sf):
    m = mosaic(spark, sf)
    images = m.groupBy("image_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    return inf.masked_tiles(inf.tile_plan(images, 16, 0), m.where("v >= 0.42"), 16).select("image_id", "row", "col", "out_height", "out_width")


@query("threshold_value", "SELECT n_nationkey, CAST(floor(255 * (n_nationkey / 25.0::DOUBLE)) AS DOUBLE) AS quantized, n_nationkey / 25.0::DOUBLE AS plain FROM nation")
def threshold_value(spark, sf):
    confidence = F.col("n_nationkey") / 25.0
    return table(spark, sf, "nation").select("n_nationkey", inf.threshold_value(confidence, True).alias("quantized"), inf.threshold_value(confidence, False).alias("plain"))


@query("step_paths", """WITH s AS (SELECT n_nationkey AS job, k, name, k = 0 OR (n_nationkey // CAST(power(2, greatest(k - 1, 0)) AS INTEGER)) % 2 = 1 AS enabled FROM nation, (SELECT unnest(generate_series(0, 6)) AS k, unnest(['prediction', 'zoom', 'threshold', 'filter', 'dilate', 'fill', 'outline']) AS name)),
  l AS (SELECT *, max(CASE WHEN enabled THEN k END) OVER (PARTITION BY job) AS last FROM s), o AS (SELECT *, CASE WHEN enabled THEN CASE WHEN k = last THEN 'out.tif' ELSE 'out_' || name || '.tif' END END AS own FROM l)
  SELECT job, CAST(k AS INTEGER) AS k, name, last_value(own IGNORE NULLS) OVER (PARTITION BY job ORDER BY k) AS path FROM o""")
def step_paths(spark, sf):
    names = F.array(*map(F.lit, inf.STEPS))
    s = table(spark, sf, "nation").select(F.col("n_nationkey").alias("job"), F.posexplode(names).alias("k", "name"))
    on = F.when(F.col("k") == 0, True).otherwise(F.expr("(job div cast(power(2, greatest(k - 1, 0)) as int)) % 2 = 1"))
    return inf.step_paths(s.withColumn("enabled", on), "out")


class BoxScorer:
    """Mean over the 3x3 neighbourhood and its negative: a deterministic two-class scorer with one lost pixel."""

    def predict(self, windows: np.ndarray) -> np.ndarray:
        p = np.pad(windows, [(0, 0), (1, 1), (1, 1)])
        h, w = windows.shape[1:]
        mean = sum(p[:, a : a + h, b : b + w] for a in range(3) for b in range(3)) / 9.0
        return np.stack([mean, -mean], axis=1)


@query("infer_scores", f"""WITH {MOSAIC} SELECT m.image_id, m.r, m.c, round(sum(n.q) / 9.0, 6) AS v FROM mo m JOIN (SELECT r + dr AS r, c + dc AS c, q FROM mo, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)) n ON m.r = n.r AND m.c = n.c GROUP BY 1, 2, 3""")
def infer_scores(spark, sf):
    return inf.predict(mosaic(spark, sf), BoxScorer(), tile=32, lost=1, value="q").select(*KEYS, F.round(F.col("scores")[0], 6).alias("v"))


@query("infer_pipeline", f"""WITH RECURSIVE {_comp(PATCHES, 'SELECT image_id, r, c FROM px WHERE v >= 0.08 AND (r + c) % 5 > 0', 8)}, {BOX}, k AS (SELECT co.image_id, co.r, co.c FROM co JOIN bx USING (image_id, component) WHERE diagonal2 > 4)
  SELECT DISTINCT image_id, CAST(r + dr AS INTEGER) AS r, CAST(c + dc AS INTEGER) AS c FROM k, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) d(dr, dc) WHERE r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7""")
def infer_pipeline(spark, sf):
    p = patches(spark, sf)
    return inf.postprocess(p, p, 8, 8, 0.08, min_diagonal=2.0, dilation=1, mask=p.where("(r + c) % 5 > 0"))


@query("patch_segmentation", f"""WITH RECURSIVE {_comp(PATCHES, FG1, 8)}, {BOX}, s AS (SELECT image_id, count(*) AS regions_total, count(CASE WHEN diagonal2 <= 9 THEN 1 END) AS regions_removed, CAST(sum(CASE WHEN diagonal2 > 9 THEN pixels ELSE 0 END) AS BIGINT) AS kept_pixels FROM bx GROUP BY 1)
  SELECT vec_id AS image_id, label, coalesce(kept_pixels, 0) AS kept_pixels, coalesce(regions_total, 0) AS regions_total, coalesce(regions_removed, 0) AS regions_removed FROM embeddings LEFT JOIN s ON image_id = vec_id""")
def patch_segmentation(spark, sf):
    """Threshold, 8-connected regions, small-region filter and a summary per patch."""
    p = patches(spark, sf)
    b = cc.boxes(cc.label_components(p.where(pw.low_threshold(F.col("v"), 0.05) == 1), True))
    kept = F.col("diagonal2") > 9
    s = b.groupBy("image_id").agg(F.count("*").alias("regions_total"), F.count_if(~kept).alias("regions_removed"), F.sum(F.when(kept, F.col("pixels")).otherwise(0)).alias("kept_pixels"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    return e.join(s, "image_id", "left").select("image_id", "label", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("kept_pixels", "regions_total", "regions_removed")])
