"""Queries of batches, stored statistics, level matching, regrouping and the full post-processing chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions.storage import new_path
from tilespark.operators import annotation as an, augment as au, batches as ba, inference as inf, levels as lv, pointwise as pw
from tilespark.plans.mask_queries import _comp, _mask, BOX, TILES
from tilespark.plans.registry import query
from tilespark.plans.source_queries import SEED
from tilespark.sources import maskstats
from tilespark.sources.fixtures import MOSAIC, PATCHES, mosaic, patches, table

KEYS = ["image_id", "r", "c"]
OPEN = "so AS (SELECT DISTINCT doc_id AS image_id, quality AS label FROM labels UNION SELECT doc_id, toxic + 2 FROM labels)"


def _sources(spark, sf):
    """Labelled documents as sources; quality gives labels 0 and 1, toxicity 2 and 3."""
    l = table(spark, sf, "labels")
    return l.select(F.col("doc_id").alias("image_id"), F.col("quality").alias("label")).union(l.select("doc_id", F.col("toxic") + 2)).distinct()


@query("crossing_label_counts", f"WITH {OPEN} SELECT label, count(*) AS n_sources FROM so GROUP BY 1")
def crossing_label_counts(spark, sf):
    return ba.label_sources(_sources(spark, sf))


def _shares(seed: int, ratio: str) -> str:
    """Even shares over the sources of each label in ``so``, corrected in seeded order."""
    return f"""la AS (SELECT label, count(*) AS n, {ratio} AS total FROM so GROUP BY 1),
  ro AS (SELECT image_id, label, total, n, CAST(round_even(total / n, 0) AS BIGINT) AS s, row_number() OVER (PARTITION BY label ORDER BY {SEED.format(seed, 'image_id')}, image_id) AS k FROM so JOIN la USING (label)),
  sh AS (SELECT image_id, label, CAST(s + CASE WHEN k <= abs(total - s * n) THEN sign(total - s * n) ELSE 0 END AS BIGINT) AS share FROM ro WHERE total IS NOT NULL)"""


@query("patch_distribution", f"WITH {OPEN}, {_shares(6, 'CASE label WHEN 0 THEN 400 WHEN 1 THEN 300 WHEN 2 THEN 200 END')} SELECT * FROM sh")
def patch_distribution(spark, sf):
    # label 9 has no source: its ratio goes to the others
    return ba.distribute(_sources(spark, sf), {0: 0.4, 1: 0.3, 2: 0.2, 9: 0.1}, 900, 6)


@query("batch_assembly", f"""WITH {PATCHES}, m AS (SELECT image_id, r, c, q, q % 3 AS label FROM px), so AS (SELECT DISTINCT image_id, label FROM m), {_shares(4, 'CASE label WHEN 0 THEN 30 ELSE 15 END')},
  cn AS (SELECT image_id, label, count(*) AS n FROM m GROUP BY 1, 2), i AS (SELECT image_id, label, n, unnest(generate_series(0, share - 1)) AS i FROM sh JOIN cn USING (image_id, label) WHERE share > 0),
  d AS (SELECT image_id, label, CAST(row_number() OVER (ORDER BY image_id, label, i) - 1 AS INTEGER) AS position, {SEED.format(5, "image_id || '|' || label || '|' || i")} % n AS k FROM i),
  o AS (SELECT image_id, label, r, c, row_number() OVER (PARTITION BY image_id, label ORDER BY r, c) - 1 AS k FROM m), f AS (SELECT * FROM d JOIN o USING (image_id, label, k)),
  g AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT unnest(generate_series(0, 2)) AS y), (SELECT unnest(generate_series(0, 2)) AS x))
  SELECT position, f.image_id, f.label, y, x, coalesce(px.q, 0) AS q FROM f CROSS JOIN g LEFT JOIN px ON px.image_id = f.image_id AND px.r = f.r - 1 + y AND px.c = f.c - 1 + x""")
def batch_assembly(spark, sf):
    p = patches(spark, sf)
    return ba.assemble(p, p.select(*KEYS, (F.col("q") % 3).alias("label")), {0: 0.5, 1: 0.25, 2: 0.25}, 60, 3, 4, "q", 16)


@query("channels_last", "SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(embedding[(i % 4) * 16 + i // 4 + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)")
def channels_last(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(ba.channels_last(F.col("embedding"), 4, 16)).alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query("channels_round_trip", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)")
def channels_round_trip(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e", ba.channels_last(F.col("embedding"), 4, 16))
    return e.select("vec_id", F.posexplode(ba.channels_first(F.col("e"), 4, 16)).alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query("maskstat_round_trip", f"WITH {TILES} SELECT *, CAST(16 AS INTEGER) AS tile, CAST(0.5 AS DOUBLE) AS spacing FROM t")
def maskstat_round_trip(spark, sf):
    """Built and stored by the first call, read by the second."""
    path = new_path(spark, "maskstats")
    maskstats.open_or_build(_mask(spark, sf), path, 16, 0.5)
    return maskstats.open_or_build(_mask(spark, sf), path, 16, 0.5)


@query("stats_level_match", """WITH i AS (SELECT n_nationkey AS image_id, k AS level, 4096 >> k AS height, 2048 >> k AS width, 0.25::DOUBLE * (1 << k) AS spacing FROM nation, (SELECT unnest(generate_series(0, 4)) AS k)),
  s AS (SELECT n_nationkey AS image_id, 4096 >> (n_regionkey % 5) AS height, 2048 >> (n_regionkey % 5) AS width, 0.25::DOUBLE * (1 << (n_regionkey % 5)) + (n_nationkey % 4) * 0.1::DOUBLE AS spacing FROM nation)
  SELECT i.image_id, CAST(min(level) AS INTEGER) AS level FROM i JOIN s ON i.image_id = s.image_id AND i.height = s.height AND i.width = s.width AND abs(i.spacing - s.spacing) < 0.25 GROUP BY 1""")
def stats_level_match(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("image_id"), (F.col("n_regionkey") % 5).alias("own"))
    shape = lambda k: (F.expr(f"shiftright(4096, {k})").alias("height"), F.expr(f"shiftright(2048, {k})").alias("width"))
    images = n.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("image_id", "level", *shape("level"), (0.25 * F.expr("shiftleft(1, level)")).alias("spacing"))
    stats = n.select("image_id", *shape("own"), (0.25 * F.expr("shiftleft(1, own)") + F.col("image_id") % 4 * 0.1).alias("spacing"))
    return lv.match_stats(images, stats, 0.25)


@query("mask_low_resolution", f"""WITH {MOSAIC}, k AS (SELECT r, c, q % 3 AS label FROM mo WHERE r < 30 AND c < 40)
  SELECT mo.image_id, mo.r, mo.c, mo.q, coalesce(label, 0) AS label FROM mo LEFT JOIN k ON k.r = mo.r // 4 AND k.c = mo.c // 4""")
def mask_low_resolution(spark, sf):
    m = mosaic(spark, sf).select(*KEYS, "q")
    return pw.mask_at(m, m.where("r < 30 and c < 40").withColumn("label", F.col("q") % 3), 4)


@query("score_upsample_hard", f"""WITH {PATCHES}, z AS (SELECT unnest([0, 1]) AS d) SELECT image_id, CAST(r * 2 + a.d AS INTEGER) AS r, CAST(c * 2 + b.d AS INTEGER) AS c, q FROM px, z a, z b""")
def score_upsample_hard(spark, sf):
    return inf.upsample(patches(spark, sf), (8, 8), 2, False, "q")


def _bilinear(source: str, size: int, target: int) -> str:
    """Corner-aligned zoom of ``source(image_id, r, c, v)``, square."""
    return f"""zg AS (SELECT CAST(y AS INTEGER) AS r, CAST(x AS INTEGER) AS c, y * {size - 1} / {target - 1}.0::DOUBLE AS fy, x * {size - 1} / {target - 1}.0::DOUBLE AS fx FROM (SELECT unnest(generate_series(0, {target - 1})) AS y), (SELECT unnest(generate_series(0, {target - 1})) AS x)),
  zf AS (SELECT *, least(floor(fy), {size - 2}) AS y0, least(floor(fx), {size - 2}) AS x0 FROM zg),
  zo AS (SELECT image_id, zf.r, zf.c, round(sum((CASE WHEN s.r = y0 THEN 1 - (fy - y0) ELSE fy - y0 END) * (CASE WHEN s.c = x0 THEN 1 - (fx - x0) ELSE fx - x0 END) * v), 4) AS v
    FROM zf JOIN {source} s ON s.r BETWEEN y0 AND y0 + 1 AND s.c BETWEEN x0 AND x0 + 1 GROUP BY 1, 2, 3)"""


@query("score_upsample_soft", f"WITH {PATCHES}, qx AS (SELECT image_id, r, c, q AS v FROM px), {_bilinear('qx', 8, 16)} SELECT * FROM zo")
def score_upsample_soft(spark, sf):
    return inf.upsample(patches(spark, sf).select(*KEYS, F.col("q").alias("v")), (8, 8), 2, True).withColumn("v", F.round("v", 4))


_MIRROR = "CASE WHEN ({0} + 14) % 14 < 8 THEN ({0} + 14) % 14 ELSE 14 - ({0} + 14) % 14 END"


@query("aug_scaling", f"""WITH {PATCHES}, gp AS (SELECT y AS r, x AS c, {_MIRROR.format('(y - 4)')} AS sr, {_MIRROR.format('(x - 4)')} AS sc FROM (SELECT unnest(generate_series(0, 15)) AS y), (SELECT unnest(generate_series(0, 15)) AS x)),
  pd AS (SELECT image_id, gp.r, gp.c, q AS v FROM gp JOIN px ON px.r = sr AND px.c = sc), {_bilinear('pd', 16, 8)} SELECT * FROM zo""")
def aug_scaling(spark, sf):
    return au.scaling(patches(spark, sf).select(*KEYS, F.col("q").alias("v")), (8, 8), 0.5).withColumn("v", F.round("v", 4))


@query("aug_pool", f"""WITH {PATCHES}, h AS (SELECT DISTINCT image_id, {SEED.format(21, 'image_id')} AS u FROM px), f AS (SELECT image_id, CASE WHEN u < 1431655765 THEN 7 - r ELSE r END AS r, c, q FROM px JOIN h USING (image_id))
  SELECT image_id, CAST(7 - c AS INTEGER) AS r, CAST(r AS INTEGER) AS c, q FROM f""")
def aug_pool(spark, sf):
    """Each image is flipped or passed on, one to two; then all are turned."""
    flip, turn = lambda p: au.flip(p, "vertical", 8, 8), lambda p: au.rotate90(p, 1, 8, 8)
    return au.apply_pool(patches(spark, sf).select(*KEYS, "q"), [(False, [(flip, 1.0), (au.pass_through, 2.0)]), (True, [(turn, 1.0)])], 21)


def _tree(spark, sf):
    from tilespark.plans.patch_queries import _groups

    items = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("grp"))
    return items, _groups(spark, sf)


@query("regroup_group", """SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 'fresh' ELSE r_name END AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, CASE WHEN r_regionkey < 2 THEN 'west' ELSE 'east' END FROM region UNION ALL SELECT unnest(['west', 'east', 'fresh']), NULL""")
def regroup_group(spark, sf):
    items, groups = _tree(spark, sf)
    name = table(spark, sf, "nation").where("n_nationkey = 3").first()["n_name"]
    return an.regroup(items, groups, "fresh", moved=name)[1]


@query("regroup_items", """WITH k AS (SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 > 0)),
  g AS (SELECT n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT IN (SELECT n_name FROM k)),
  h AS (SELECT r_name AS name, CASE WHEN r_regionkey < 2 THEN 'west' ELSE 'east' END AS parent FROM region WHERE r_name IN (SELECT parent FROM g))
  SELECT * FROM g UNION ALL SELECT * FROM h UNION ALL SELECT unnest(['west', 'east', 'fresh']), NULL""")
def regroup_items(spark, sf):
    """Every third supplier moves; nations that lose all of theirs go."""
    items, groups = _tree(spark, sf)
    return an.regroup(items, groups, "fresh", item=F.expr("s_suppkey % 3 = 0"))[1]


ZOOMED = PATCHES + ", zz AS (SELECT unnest([0, 1]) AS d), z AS (SELECT image_id, CAST(r * 2 + a.d AS INTEGER) AS r, CAST(c * 2 + b.d AS INTEGER) AS c, v FROM px, zz a, zz b)"


@query("infer_chain", f"""WITH RECURSIVE {_comp(ZOOMED, 'SELECT image_id, r, c FROM z WHERE v >= 0.08', 8)}, {BOX}, k AS (SELECT co.image_id, co.r, co.c FROM co JOIN bx USING (image_id, component) WHERE diagonal2 > 16),
  di AS (SELECT DISTINCT image_id, CAST(r + dr AS INTEGER) AS r, CAST(c + dc AS INTEGER) AS c FROM k, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) d(dr, dc) WHERE r + dr BETWEEN 0 AND 15 AND c + dc BETWEEN 0 AND 15)
  SELECT 'zoom' AS step, image_id, r, c FROM z UNION ALL SELECT 'threshold', image_id, r, c FROM fg UNION ALL SELECT 'filter', * FROM k UNION ALL SELECT 'dilate', * FROM di""")
def infer_chain(spark, sf):
    """Zoom, threshold, region filter and dilation with the rasters of all steps."""
    steps = inf.chain(patches(spark, sf).select(*KEYS, "v"), (8, 8), 0.08, zoom=2, min_diagonal=4.0, dilation=1, outline=False)
    out = None
    for name in ("zoom", "threshold", "filter", "dilate"):
        part = steps[name].select(F.lit(name).alias("step"), *KEYS)
        out = part if out is None else out.unionByName(part)
    return out
