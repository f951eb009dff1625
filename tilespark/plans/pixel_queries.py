"""Queries of pixel-wise operators, levels, windows and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.operators import levels as lv, pointwise as pw, raster, resample as rs
from tilespark.plans.registry import query
from tilespark.sources.fixtures import HEAT, MOSAIC, PATCHES, heat, mosaic, patches, table

KEYS = ["image_id", "r", "c"]


@query("px_threshold", f"WITH {PATCHES} SELECT image_id, r, c, CASE WHEN v >= 0.05 THEN 1 ELSE 0 END AS v FROM px")
def px_threshold(spark, sf):
    return patches(spark, sf).select(*KEYS, pw.low_threshold(F.col("v"), 0.05).alias("v"))


@query("px_quantize", f"WITH {PATCHES} SELECT image_id, r, c, CAST(trunc(least(greatest((v + 0.5) / 1.0 * 255, 0), 255)) AS INTEGER) AS q FROM px")
def px_quantize(spark, sf):
    return patches(spark, sf).select(*KEYS, pw.quantize(F.col("v"), -0.5, 0.5).alias("q"))


@query("px_norm01", f"WITH {PATCHES} SELECT image_id, r, c, round(q / 255.0, 6) AS v FROM px")
def px_norm01(spark, sf):
    return patches(spark, sf).select(*KEYS, F.round(pw.zero_one(F.col("q")), 6).alias("v"))


@query("px_norm_rgb", f"WITH {PATCHES} SELECT image_id, r, c, round(q * ((1.0 - -1.0) / 255.0) + -1.0, 6) AS v FROM px")
def px_norm_rgb(spark, sf):
    return patches(spark, sf).select(*KEYS, F.round(pw.rgb_range(F.col("q"), -1.0, 1.0), 6).alias("v"))


@query("px_norm_general", f"WITH {PATCHES} SELECT image_id, r, c, round((q - 0.0) / ((255.0 - 0.0) * (3.0 - 1.0)) + 1.0, 6) AS v FROM px")
def px_norm_general(spark, sf):
    return patches(spark, sf).select(*KEYS, F.round(pw.general_range(F.col("q"), (1.0, 3.0), (0.0, 255.0)), 6).alias("v"))


def _two(spark, sf):
    h = heat(spark, sf).withColumn("image_id", F.lit(0).cast("long"))
    return h.select(*KEYS, "v"), h.where("a > 1").select(*KEYS, (F.col("a") * 90).alias("v"))


def _arith(op: str, singles: bool = False) -> str:
    e = f"CAST(l.v AS BIGINT) {op} r.v"
    v = f"coalesce({e}, l.v, r.v)" if singles else e
    join = "LEFT JOIN" if singles else "JOIN"
    return f"""WITH {HEAT} SELECT CAST(0 AS BIGINT) AS image_id, l.r, l.c, CAST((({v}) % 256 + 256) % 256 AS INTEGER) AS v
      FROM ht l {join} (SELECT r, c, a * 90 AS v FROM ht WHERE a > 1) r ON l.r = r.r AND l.c = r.c"""


@query("px_arith_add", _arith("+"))
def px_arith_add(spark, sf):
    return pw.arithmetic(*_two(spark, sf), "+")


@query("px_arith_sub", _arith("-"))
def px_arith_sub(spark, sf):
    return pw.arithmetic(*_two(spark, sf), "-")


@query("px_arith_mul", _arith("*"))
def px_arith_mul(spark, sf):
    return pw.arithmetic(*_two(spark, sf), "*")


@query("px_arith_singles", _arith("+", True))
def px_arith_singles(spark, sf):
    return pw.arithmetic(*_two(spark, sf), "+", accept_singles=True)


@query("label_remap", f"WITH {HEAT} SELECT r, c, CASE b WHEN 1 THEN 1 WHEN 2 THEN 0 END AS label FROM ht")
def label_remap(spark, sf):
    return pw.remap_labels(heat(spark, sf).select("r", "c", F.col("b").alias("label")), {1: 1, 2: 0}).select("r", "c", "label")


@query("label_valid_map", f"WITH {HEAT} SELECT r, c, CASE a WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 0 END AS label, a IN (1, 3) AS valid FROM ht")
def label_valid_map(spark, sf):
    return pw.remap_labels(heat(spark, sf).select("r", "c", F.col("a").alias("label")), {1: 0, 3: 1}).select("r", "c", "label", "valid")


def _mask(spark, sf, label="a - 1"):
    return heat(spark, sf).select(F.lit(0).cast("long").alias("image_id"), "r", "c", F.expr(f"cast({label} as int)").alias("label"))


@query("mask_normalize_empty", f"""WITH {HEAT}, t AS (SELECT r // 2 AS y, c // 2 AS x, bool_or(a - 1 NOT IN (0, 255)) AS full_ FROM ht GROUP BY 1, 2)
  SELECT CAST(0 AS BIGINT) AS image_id, r, c, CAST(CASE WHEN NOT full_ THEN 9 WHEN a - 1 = 1 THEN 2 WHEN a - 1 = 2 THEN 1 ELSE a - 1 END AS INTEGER) AS label
  FROM ht JOIN t ON r // 2 = y AND c // 2 = x""")
def mask_normalize_empty(spark, sf):
    return pw.normalize_mask(_mask(spark, sf), {1: 2, 2: 1}, 9, tile=2)


@query("empty_tiles", f"""WITH {HEAT} SELECT CAST(0 AS BIGINT) AS image_id, CAST(r // 2 AS INTEGER) AS tile_row, CAST(c // 2 AS INTEGER) AS tile_col,
  bool_or(a - 1 NOT IN (0, 255)) AS nonempty FROM ht GROUP BY 2, 3""")
def empty_tiles(spark, sf):
    return pw.nonempty_tiles(_mask(spark, sf), 2)


@query("stain_lut", f"""WITH {HEAT}, p AS (SELECT r, c, v * 65536 + (v * 2) % 256 * 256 + a AS idx FROM ht)
  SELECT CAST(0 AS BIGINT) AS image_id, r, c, round((idx % 251) / 255.0, 6) AS red, round((idx % 241) / 255.0, 6) AS green, round((idx % 239) / 255.0, 6) AS blue FROM p""")
def stain_lut(spark, sf):
    # the half added keeps the fractions off the integer borders
    rgb = heat(spark, sf).select(F.lit(0).cast("long").alias("image_id"), "r", "c", ((F.col("v") + 0.5) / 255).alias("red"), ((F.col("v") * 2 % 256 + 0.5) / 255).alias("green"), ((F.col("a") + 0.5) / 255).alias("blue"))
    idx = spark.range(51).select(F.col("id").alias("v")).withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(3)))).select((F.col("v") * 65536 + F.col("v") * 2 % 256 * 256 + F.col("a")).alias("idx"))
    lut = idx.select("idx", (F.col("idx") % 251).alias("red"), (F.col("idx") % 241).alias("green"), (F.col("idx") % 239).alias("blue"))
    return pw.stain_lookup(rgb, lut).select(*KEYS, *[F.round(n, 6).alias(n) for n in ("red", "green", "blue")])


# A small overlay palette (label, red, green, blue).
PALETTE = [(1, 255, 0, 0), (2, 0, 255, 0), (3, 0, 0, 255)]


@query("preview_overlay", f"""WITH {HEAT}, i AS (SELECT r, c, v AS red, v * 2 AS green, v * 3 AS blue, a - 1 AS label FROM ht), pal(label, pr, pg, pb) AS (VALUES (1, 255, 0, 0), (2, 0, 255, 0), (3, 0, 0, 255)),
  g AS (SELECT *, 0.2125::DOUBLE * red + 0.7154::DOUBLE * green + 0.0721::DOUBLE * blue AS y FROM i)
  SELECT CAST(0 AS BIGINT) AS image_id, r, c, round(CASE WHEN g.label > 0 THEN y * 0.6::DOUBLE + pr * 0.4::DOUBLE ELSE red END, 4) AS red,
    round(CASE WHEN g.label > 0 THEN y * 0.6::DOUBLE + pg * 0.4::DOUBLE ELSE green END, 4) AS green, round(CASE WHEN g.label > 0 THEN y * 0.6::DOUBLE + pb * 0.4::DOUBLE ELSE blue END, 4) AS blue
  FROM g LEFT JOIN pal ON g.label = pal.label""")
def preview_overlay(spark, sf):
    img = heat(spark, sf).select(F.lit(0).cast("long").alias("image_id"), "r", "c", F.col("v").alias("red"), (F.col("v") * 2).alias("green"), (F.col("v") * 3).alias("blue"), (F.col("a") - 1).alias("label"))
    palette = spark.createDataFrame(PALETTE, "label int, pr int, pg int, pb int")
    return pw.preview(img, palette, 0.4).select(*KEYS, *[F.round(n, 4).alias(n) for n in ("red", "green", "blue")])


@query("onehot", "SELECT vec_id, unnest(generate_series(0, 9)) AS k, CASE WHEN label = unnest(generate_series(0, 9)) THEN 1 ELSE 0 END AS v FROM embeddings")
def onehot(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", F.posexplode(pw.one_hot(F.col("label"), 10)).alias("k", "v")).select("vec_id", F.col("k").cast("long").alias("k"), "v")


@query("argmax_label", """SELECT vec_id, CAST(list_position(s, list_max(s)) AS INTEGER) AS label FROM (SELECT vec_id, list_transform(embedding[1:10], lambda x: CAST(floor(x * 20) AS INTEGER)) AS s FROM embeddings)""")
def argmax_label(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    s = F.transform(F.slice("embedding", 1, 10), lambda x: F.floor(x * 20).cast("int"))
    return e.select("vec_id", pw.argmax_label(s).alias("label"))


@query("softmax_scores", """WITH s AS (SELECT vec_id, unnest(embedding[1:10]) AS x, unnest(generate_series(0, 9)) AS k FROM embeddings), m AS (SELECT vec_id, max(x::DOUBLE) AS m FROM s GROUP BY 1),
  e AS (SELECT s.vec_id, k, exp(x::DOUBLE - m) AS e FROM s JOIN m USING (vec_id)) SELECT vec_id, k, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e""")
def softmax_scores(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("s", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")))
    return e.select("vec_id", F.posexplode(pw.softmax(F.col("s"))).alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("p", 6).alias("p"))


@query("mask_multiply", f"WITH {MOSAIC} SELECT image_id, r, c, CASE WHEN (r // 16 + c // 16) % 2 > 0 THEN v ELSE 0.0 END AS v FROM mo")
def mask_multiply(spark, sf):
    m = mosaic(spark, sf)
    return pw.mask_multiply(m.select(*KEYS, "v"), m.where(F.expr("(r div 16 + c div 16) % 2 > 0")).select(*KEYS, F.lit(1).alias("label"))).select(*KEYS, "v")


@query("channel_pick", f"WITH {PATCHES} SELECT image_id, r, c, CASE label % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 END AS ch, q AS v FROM px WHERE label % 3 IN (2, 0)")
def channel_pick(spark, sf):
    p = patches(spark, sf).select(*KEYS, (F.col("label") % 3).alias("ch"), F.col("q").alias("v"))
    return raster.select_channels(p, [2, 0])


@query("hex_colors", "SELECT r_regionkey, (r_regionkey * 37) % 256 AS red, (r_regionkey * 91) % 256 AS green, (r_regionkey * 53) % 256 AS blue, printf('#%02X%02X%02X', (r_regionkey * 37) % 256, (r_regionkey * 91) % 256, (r_regionkey * 53) % 256) AS color FROM region")
def hex_colors(spark, sf):
    n = spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey", *[(F.col("r_regionkey") * m % 256).alias(x) for m, x in ((37, "red"), (91, "green"), (53, "blue"))])
    d = n.withColumn("color", pw.format_color(F.col("red"), F.col("green"), F.col("blue"))).withColumn("back", pw.parse_color(F.col("color")))
    return d.select("r_regionkey", "back.red", "back.green", "back.blue", "color")


# ---- levels ----

LEVELS = "lv(image_id, level, downsampling, spacing, rows, cols) AS (SELECT n_nationkey, l, CAST(power(2, l) AS DOUBLE), CAST(0.25 * power(2, l) * (1 + n_regionkey * 0.1) AS DOUBLE), CAST(4096 // power(2, l) AS INTEGER), CAST(2048 // power(2, l) AS INTEGER) FROM nation, (SELECT unnest(generate_series(0, 5)) AS l))"


def _levels(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    d = F.pow(F.lit(2.0), F.col("level"))
    return n.select(F.col("n_nationkey").alias("image_id"), "level", d.alias("downsampling"), (0.25 * d * (1 + F.col("n_regionkey") * 0.1)).alias("spacing"),
                    F.floor(4096 / d).cast("int").alias("rows"), F.floor(2048 / d).cast("int").alias("cols"))


def _wanted(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("image_id"), F.explode(F.array(F.lit(0.3), F.lit(1.1), F.lit(2.0), F.lit(50.0))).alias("want"))


WANTED = "w AS (SELECT n_nationkey AS image_id, unnest([0.3, 1.1, 2.0, 50.0])::DOUBLE AS want FROM nation)"
FOUND = f"""{LEVELS}, {WANTED}, f AS (SELECT w.image_id, want, min(CASE WHEN want BETWEEN spacing * 0.75::DOUBLE AND spacing * 1.25::DOUBLE THEN level END) AS level FROM w JOIN lv USING (image_id) GROUP BY 1, 2)"""


@query("level_lookup", f"WITH {FOUND} SELECT f.image_id, want, f.level, round(spacing, 6) AS spacing FROM f LEFT JOIN lv ON f.image_id = lv.image_id AND f.level = lv.level")
def level_lookup(spark, sf):
    return lv.level_by_spacing(_levels(spark, sf), _wanted(spark, sf)).withColumn("spacing", F.round("spacing", 6))


@query("level_test", f"WITH {FOUND} SELECT image_id, want, level IS NOT NULL AS ok FROM f")
def level_test(spark, sf):
    return lv.level_by_spacing(_levels(spark, sf), _wanted(spark, sf)).select("image_id", "want", F.col("level").isNotNull().alias("ok"))


@query("spacing_correct", f"WITH {LEVELS} SELECT lv.image_id, lv.level, round(0.5 * lv.downsampling / o.downsampling, 6) AS spacing FROM lv JOIN lv o ON lv.image_id = o.image_id AND o.level = 1")
def spacing_correct(spark, sf):
    return lv.correct_spacing(_levels(spark, sf), 1, 0.5).select("image_id", "level", F.round("spacing", 6).alias("spacing"))


@query("mask_level_match", f"""WITH {LEVELS}, m AS (SELECT image_id, level - 1 AS level, rows + image_id % 2 AS rows, cols, spacing * 1.3::DOUBLE AS spacing FROM lv WHERE level >= 1)
  SELECT lv.image_id, lv.level, coalesce(min(CASE WHEN lv.rows = m.rows AND lv.cols = m.cols THEN m.level END), min(CASE WHEN lv.spacing BETWEEN m.spacing * 0.75::DOUBLE AND m.spacing * 1.25::DOUBLE THEN m.level END),
    max(CASE WHEN m.spacing <= lv.spacing THEN m.level END)) AS mask_level FROM lv LEFT JOIN m ON lv.image_id = m.image_id GROUP BY 1, 2""")
def mask_level_match(spark, sf):
    l = _levels(spark, sf)
    m = l.where("level >= 1").select("image_id", (F.col("level") - 1).alias("level"), (F.col("rows") + F.col("image_id") % 2).alias("rows"), "cols", (F.col("spacing") * 1.3).alias("spacing"))
    return lv.mask_level(l, m)


@query("writer_defaults", "SELECT n_nationkey AS image_id, CASE WHEN n_regionkey = 0 THEN 'monochrome' ELSE 'rgb' END AS coding, CASE WHEN n_regionkey = 0 THEN 'lzw' ELSE 'jpeg' END AS compression, CASE WHEN n_regionkey = 0 THEN 'nearest' ELSE 'linear' END AS interpolation, n_regionkey = 0 AS skip_empty FROM nation")
def writer_defaults(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("image_id"), F.when(F.col("n_regionkey") == 0, "monochrome").otherwise("rgb").alias("coding"))
    return lv.interpolation_defaults(n)


# ---- windows and tiles ----

@query("window_read_pad", f"""WITH {MOSAIC}, g AS (SELECT CAST(y AS INTEGER) AS r, CAST(x AS INTEGER) AS c FROM (SELECT unnest(generate_series(0, 63)) AS y), (SELECT unnest(generate_series(0, 47)) AS x))
  SELECT CAST(0 AS BIGINT) AS image_id, g.r, g.c, coalesce(q, 0) AS q FROM g LEFT JOIN mo ON mo.r = g.r + 120 AND mo.c = g.c + 170""")
def window_read_pad(spark, sf):
    return raster.window_read(mosaic(spark, sf), 120, 170, 64, 48, value="q")


@query("tile_assembly", f"""WITH {MOSAIC} SELECT image_id, CAST(r // 32 AS INTEGER) AS tile_row, CAST(c // 32 AS INTEGER) AS tile_col, CAST(max(r % 32) + 1 AS INTEGER) AS h, CAST(max(c % 32) + 1 AS INTEGER) AS w,
  string_agg(CAST(q AS VARCHAR), ',' ORDER BY r, c) AS data FROM mo GROUP BY 1, 2, 3""")
def tile_assembly(spark, sf):
    return raster.to_tiles(mosaic(spark, sf), 32, "q").withColumn("data", F.array_join("data", ","))


@query("tile_round_trip", f"WITH {MOSAIC} SELECT image_id, r, c, q FROM mo")
def tile_round_trip(spark, sf):
    return raster.to_pixels(raster.to_tiles(mosaic(spark, sf), 32, "q"), 32, "q")


@query("empty_tile_skip", f"""WITH {MOSAIC}, b AS (SELECT image_id, r, c, CASE WHEN v >= 0.3 THEN 1 ELSE 0 END AS label FROM mo)
  SELECT b.image_id, b.r, b.c, b.label FROM b JOIN (SELECT DISTINCT r // 4 AS y, c // 4 AS x FROM b WHERE label <> 0) t ON b.r // 4 = y AND b.c // 4 = x""")
def empty_tile_skip(spark, sf):
    return raster.skip_empty(mosaic(spark, sf).select(*KEYS, pw.low_threshold(F.col("v"), 0.3).alias("label")), 4)


@query("reflect_pad", f"""WITH {PATCHES}, g AS (SELECT CAST(y AS INTEGER) AS r, CAST(x AS INTEGER) AS c FROM (SELECT unnest(generate_series(0, 13)) AS y), (SELECT unnest(generate_series(0, 13)) AS x)),
  s AS (SELECT r, c, ((r - 3) % 14 + 14) % 14 AS a, ((c - 3) % 14 + 14) % 14 AS b FROM g)
  SELECT image_id, s.r, s.c, q FROM s JOIN px ON px.r = CASE WHEN a < 8 THEN a ELSE 14 - a END AND px.c = CASE WHEN b < 8 THEN b ELSE 14 - b END""")
def reflect_pad(spark, sf):
    return raster.reflect_pad(patches(spark, sf), 8, 8, 3, "q")


@query("axis_order", """WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
  SELECT vec_id, CAST(k % 16 * 4 + k // 16 AS INTEGER) AS place, CAST(x AS DOUBLE) AS x FROM v""")
def axis_order(spark, sf):
    moved = table(spark, sf, "embeddings").select("vec_id", F.posexplode(pw.reorder_axes(F.col("embedding"), 4, 4, 4)).alias("place", "x"))
    return moved.withColumn("x", F.col("x").cast("double"))


# ---- resampling ----

@query("zoom_nearest", f"""WITH {PATCHES}, g AS (SELECT CAST(y AS INTEGER) AS r, CAST(x AS INTEGER) AS c FROM (SELECT unnest(generate_series(0, 12)) AS y), (SELECT unnest(generate_series(0, 4)) AS x))
  SELECT image_id, g.r, g.c, q FROM g JOIN px ON px.r = g.r * 8 // 13 AND px.c = g.c * 8 // 5""")
def zoom_nearest(spark, sf):
    return rs.zoom_nearest(patches(spark, sf), (8, 8), (13, 5), "q")


@query("zoom_nearest_corners", f"""WITH {PATCHES}, g AS (SELECT CAST(y AS INTEGER) AS r, CAST(x AS INTEGER) AS c FROM (SELECT unnest(generate_series(0, 12)) AS y), (SELECT unnest(generate_series(0, 4)) AS x))
  SELECT image_id, g.r, g.c, q FROM g JOIN px ON px.r = (2 * g.r * 7 + 12) // 24 AND px.c = (2 * g.c * 7 + 4) // 8""")
def zoom_nearest_corners(spark, sf):
    return rs.zoom_nearest(patches(spark, sf), (8, 8), (13, 5), "q", corners=True)


def _cubic(name: str, new: int) -> str:
    """SQL table ``name(o, i, w)``: weight of source place i of 8 in target place o, by the cubic spline's impulse response."""
    return f"""{name} AS (SELECT o, CASE WHEN m < 8 THEN m ELSE 15 - m END AS i, sum(w) AS w FROM (
    SELECT o, ((j + k) % 16 + 16) % 16 AS m, CASE WHEN u >= 2 THEN 0 WHEN u >= 1 THEN power(2 - u, 3) / 6 ELSE 2 / 3.0::DOUBLE - u * u + u * u * u / 2 END
      * sqrt(3.0::DOUBLE) * power(sqrt(3.0::DOUBLE) - 2, abs(k)) AS w
    FROM (SELECT o, j, k, abs(o * 7 / {new - 1}.0::DOUBLE - j) AS u
      FROM (SELECT unnest(generate_series(0, {new - 1})) AS o), (SELECT unnest(generate_series(-2, 10)) AS j), (SELECT unnest(generate_series(-30, 30)) AS k))) GROUP BY 1, 2)"""


@query("zoom_spline", f"""WITH {PATCHES}, {_cubic('wr', 12)}, {_cubic('wc', 6)}
  SELECT image_id, CAST(wr.o AS INTEGER) AS r, CAST(wc.o AS INTEGER) AS c, round(sum(q * wr.w * wc.w), 4) + 0 AS q
  FROM px JOIN wr ON px.r = wr.i JOIN wc ON px.c = wc.i GROUP BY 1, 2, 3""")
def zoom_spline(spark, sf):
    return rs.zoom_spline(patches(spark, sf), (8, 8), (12, 6), 3, "q").withColumn("q", F.round("q", 4) + 0)


@query("zoom_bilinear", f"""WITH {PATCHES}, g AS (SELECT CAST(y AS INTEGER) AS r, CAST(x AS INTEGER) AS c, y * 7 / 14.0::DOUBLE AS fy, x * 7 / 10.0::DOUBLE AS fx FROM (SELECT unnest(generate_series(0, 14)) AS y), (SELECT unnest(generate_series(0, 10)) AS x)),
  f AS (SELECT *, least(floor(fy), 6) AS y0, least(floor(fx), 6) AS x0 FROM g)
  SELECT image_id, f.r, f.c, round(sum((CASE WHEN px.r = y0 THEN 1 - (fy - y0) ELSE fy - y0 END) * (CASE WHEN px.c = x0 THEN 1 - (fx - x0) ELSE fx - x0 END) * q), 4) AS q
  FROM f JOIN px ON px.r BETWEEN y0 AND y0 + 1 AND px.c BETWEEN x0 AND x0 + 1 GROUP BY 1, 2, 3""")
def zoom_bilinear(spark, sf):
    return rs.zoom_bilinear(patches(spark, sf), (8, 8), (15, 11), "q").withColumn("q", F.round("q", 4))


@query("zoom_to_template", f"""WITH {PATCHES}, g AS (SELECT CAST(y AS INTEGER) AS r, CAST(x AS INTEGER) AS c FROM (SELECT unnest(generate_series(0, 15)) AS y), (SELECT unnest(generate_series(0, 15)) AS x))
  SELECT image_id, g.r, g.c, q FROM g JOIN px ON px.r = g.r // 2 AND px.c = g.c // 2""")
def zoom_to_template(spark, sf):
    target = rs.target_shape((8, 8), rs.zoom_factor((8, 8), (16, 16)))
    return rs.zoom_nearest(patches(spark, sf), (8, 8), target, "q")


@query("pyramid_nearest", f"""WITH {MOSAIC} SELECT image_id, CAST(l AS INTEGER) AS level, CAST(r // power(2, l) AS INTEGER) AS r, CAST(c // power(2, l) AS INTEGER) AS c, q
  FROM mo, (SELECT unnest([0, 1, 2, 3]) AS l) WHERE r % power(2, l) = 0 AND c % power(2, l) = 0""")
def pyramid_nearest(spark, sf):
    return rs.pyramid(mosaic(spark, sf), 3, "nearest", "q")


@query("pyramid_mean", f"""WITH {MOSAIC}, l1 AS (SELECT image_id, r // 2 AS r, c // 2 AS c, avg(q) AS q FROM mo GROUP BY 1, 2, 3), l2 AS (SELECT image_id, r // 2 AS r, c // 2 AS c, avg(q) AS q FROM l1 GROUP BY 1, 2, 3)
  SELECT image_id, CAST(level AS INTEGER) AS level, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(q, 6) AS q FROM
  (SELECT *, 0 AS level FROM (SELECT image_id, r, c, q::DOUBLE AS q FROM mo) UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2)""")
def pyramid_mean(spark, sf):
    m = mosaic(spark, sf).withColumn("q", F.col("q").cast("double"))
    return rs.pyramid(m, 2, "linear", "q").withColumn("q", F.round("q", 6))
