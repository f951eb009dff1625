"""Queries of catalogues, file joins, sampling and text redaction."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tilespark.operators import sampling as sm
from tilespark.plans.registry import query
from tilespark.sources import catalog as ct
from tilespark.sources.fixtures import table


def _membership(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 4 == 0, "validation").otherwise("training").alias("purpose"), "source")


MEMBER = "me AS (SELECT doc_id AS id, lang AS category, CASE WHEN doc_id % 4 = 0 THEN 'validation' ELSE 'training' END AS purpose, source FROM documents)"


@query("source_select", f"WITH {MEMBER} SELECT DISTINCT id FROM me WHERE category IN ('en', 'de') AND purpose IN ('training')")
def source_select(spark, sf):
    return ct.select_items(_membership(spark, sf), ["en", "de"], ["training"])


@query("source_union", f"WITH {MEMBER} SELECT source FROM me WHERE category = 'de' UNION SELECT source FROM me WHERE category = 'fr'")
def source_union(spark, sf):
    m = _membership(spark, sf)
    return m.where("category = 'de'").select("source").union(m.where("category = 'fr'").select("source")).distinct()


@query("source_intersect", f"WITH {MEMBER} SELECT source FROM me WHERE category = 'de' INTERSECT SELECT source FROM me WHERE category = 'fr'")
def source_intersect(spark, sf):
    m = _membership(spark, sf)
    return m.where("category = 'de'").select("source").intersect(m.where("category = 'fr'").select("source"))


@query("source_except", "SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def source_except(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("source_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def source_semi(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("source_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def source_anti(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("categories_of_purpose", f"WITH {MEMBER} SELECT DISTINCT category FROM me WHERE purpose = 'validation'")
def categories_of_purpose(spark, sf):
    return ct.categories_of_purpose(_membership(spark, sf), "validation")


@query("source_counts", f"WITH {MEMBER} SELECT category, purpose, count(DISTINCT id) AS n FROM me GROUP BY 1, 2")
def source_counts(spark, sf):
    return ct.counts_by_group(_membership(spark, sf))


@query("label_unknown", "SELECT DISTINCT quality + 2 * toxic AS label FROM labels WHERE quality + 2 * toxic NOT IN (0, 1, 2)")
def label_unknown(spark, sf):
    seen = table(spark, sf, "labels").select((F.col("quality") + 2 * F.col("toxic")).alias("label")).distinct()
    return seen.join(spark.createDataFrame([(0,), (1,), (2,)], "label int"), "label", "left_anti")


IMAGES = "im AS (SELECT '/data/images/img' || page_id || CASE WHEN page_id % 7 = 0 THEN '_mask' ELSE '' END || '.tif' AS path FROM pages), mk AS (SELECT '/data/masks/img' || page_id || '_mask.tif' AS path FROM pages WHERE page_id % 3 = 0)"


def _files(spark, sf):
    p = table(spark, sf, "pages").select("page_id")
    images = p.select(F.concat(F.lit("/data/images/img"), "page_id", F.when(F.col("page_id") % 7 == 0, "_mask").otherwise(""), F.lit(".tif")).alias("path"))
    return images, p.where("page_id % 3 = 0").select(F.concat(F.lit("/data/masks/img"), "page_id", F.lit("_mask.tif")).alias("path"))


@query("job_assembly", f"""WITH {IMAGES}, n AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS name FROM im), k AS (SELECT regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS key, path AS mask FROM mk)
  SELECT path AS image, mask, '/out/' || name || '_result.tif' AS output FROM n LEFT JOIN k ON key = name || '_mask' WHERE name NOT IN (SELECT name || '_mask' FROM n)""")
def job_assembly(spark, sf):
    images, masks = _files(spark, sf)
    return ct.assemble_jobs(images, masks, "{image}_mask", "/out/{image}_result.tif")


@query("source_join_mask_stat", """WITH i AS (SELECT page_id AS name, '/i/' || page_id AS image FROM pages), m AS (SELECT page_id AS name, '/m/' || page_id AS mask FROM pages WHERE page_id % 3 = 0), s AS (SELECT page_id AS name, '/s/' || page_id AS stat FROM pages WHERE page_id % 5 = 0)
  SELECT name, image, mask, stat FROM i LEFT JOIN m USING (name) LEFT JOIN s USING (name) WHERE mask IS NOT NULL OR stat IS NOT NULL""")
def source_join_mask_stat(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("name"))
    at = lambda d, tag: d.select("name", F.concat(F.lit(f"/{tag}/"), "name").alias("path"))
    return ct.join_sources(at(p, "i"), at(p.where("name % 3 = 0"), "m"), at(p.where("name % 5 = 0"), "s"))


@query("path_expand", "SELECT page_id, '/mnt/a/images/' || page_id || '.tif' AS path FROM pages")
def path_expand(spark, sf):
    return table(spark, sf, "pages").select("page_id", ct.expand_path(F.concat(F.lit("{root}/{kind}/"), "page_id", F.lit(".tif")), {"root": "/mnt/a", "kind": "images"}).alias("path"))


@query("path_tags", "SELECT page_id, '/mnt/' || page_id % 3 AS root, '{root}/images/' || page_id || '.tif' AS image, '{root}/masks/' || page_id || '.tif' AS mask FROM pages")
def path_tags(spark, sf):
    p = table(spark, sf, "pages").select("page_id", *[F.concat(F.lit("/mnt/"), F.col("page_id") % 3, F.lit(f"/{k}s/"), "page_id", F.lit(".tif")).alias(k) for k in ("image", "mask")])
    return ct.tag_paths(p, ["image", "mask"]).select("page_id", "root", "image", "mask")


@query("file_check_counts", "SELECT source, count(CASE WHEN page_id IS NOT NULL THEN 1 END) AS ok, count(CASE WHEN page_id IS NULL THEN 1 END) AS missing FROM documents LEFT JOIN pages ON doc_id = page_id GROUP BY 1")
def file_check_counts(spark, sf):
    return ct.check_files(table(spark, sf, "documents").select("source", F.col("doc_id").alias("path")), table(spark, sf, "pages").select(F.col("page_id").alias("path")), ["source"])


@query("skip_existing", "SELECT doc_id AS output FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def skip_existing(spark, sf):
    return ct.skip_existing(table(spark, sf, "documents").select(F.col("doc_id").alias("output")), table(spark, sf, "pages").select(F.col("page_id").alias("path")))


@query("folder_listing", f"WITH {IMAGES} SELECT path FROM im WHERE regexp_matches(path, '^/data/images/[^/]*$') AND regexp_matches(regexp_extract(path, '[^/]*$'), '^img1[0-9]*\\.tif')")
def folder_listing(spark, sf):
    return ct.list_folder(_files(spark, sf)[0], "/data/images", r"img1[0-9]*\.tif", False)


@query("content_hash", "SELECT page_id, sha256(html) AS digest FROM pages")
def content_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@query("redact_text", "SELECT doc_id, regexp_replace(text, '[0-9]', '#', 'g') AS text FROM documents")
def redact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[0-9]", "#").alias("text"))


# ---- sampling ----

SEED = "('0x' || substr(md5('{}|' || {}), 1, 8))::BIGINT"


@query("purpose_split", f"""WITH r AS (SELECT doc_id AS id, lang AS category, row_number() OVER (PARTITION BY lang ORDER BY {SEED.format(4, "lang || '|' || doc_id")}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  SELECT id, category, CASE WHEN k <= round_even(0.6::DOUBLE * n, 0) THEN 'training' WHEN k <= round_even(0.9::DOUBLE * n, 0) THEN 'validation' ELSE 'test' END AS purpose FROM r""")
def purpose_split(spark, sf):
    return sm.purpose_split(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category")), [("training", 0.6), ("validation", 0.3), ("test", 0.1)], 4)


@query("random_indices", f"""WITH n AS (SELECT CAST(0 AS BIGINT) AS image_id, quality AS label, count(*) AS n FROM labels GROUP BY 2), i AS (SELECT *, unnest(generate_series(0, 49)) AS i FROM n)
  SELECT image_id, label, CAST(i AS INTEGER) AS i, {SEED.format(8, "image_id || '|' || label || '|' || i")} % n AS k FROM i""")
def random_indices(spark, sf):
    n = table(spark, sf, "labels").groupBy(F.lit(0).cast("long").alias("image_id"), F.col("quality").alias("label")).agg(F.count("*").alias("n"))
    return sm.sample_indices(n, 50, 8)


@query("read_order", f"SELECT doc_id AS id, toxic > 0 AS hard, CAST(row_number() OVER (ORDER BY toxic > 0, {SEED.format(2, 'doc_id')}, doc_id) AS INTEGER) AS position FROM labels")
def read_order(spark, sf):
    return sm.read_order(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).alias("hard")), 2, "hard")


@query("allocate_population", "SELECT lang AS key, CAST(round_even(1000 * (1.0::DOUBLE / 4), 0) AS BIGINT) AS share FROM documents GROUP BY 1")
def allocate_population(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.col("lang").alias("key")).count().select("key", F.lit(0.25).alias("ratio"), F.lit(0).cast("long").alias("low"), F.lit(1000).cast("long").alias("high"))
    return sm.allocate(g, 1000)


@query("allocate_bounded", f"""WITH n AS (SELECT source AS key, count(*) AS n FROM documents GROUP BY 1), f AS (SELECT key, greatest(3, least(20, CAST(round_even(137 * (n / (SELECT sum(n) FROM n)), 0) AS BIGINT))) AS share, {SEED.format(1, 'key')} AS h FROM n),
  d AS (SELECT *, 137 - (SELECT sum(share) FROM f) AS short FROM f), u AS (SELECT key, short, unnest(generate_series(1, CASE WHEN short > 0 THEN 20 - share ELSE share - 3 END)) AS t, h FROM d),
  k AS (SELECT key, count(*) AS moved FROM (SELECT *, row_number() OVER (ORDER BY t, h, key) AS nth FROM u) WHERE nth <= abs(short) GROUP BY 1)
  SELECT key, CAST(share + sign(short) * coalesce(moved, 0) AS BIGINT) AS share FROM d LEFT JOIN k USING (key)""")
def allocate_bounded(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return sm.allocate(g.select("key", (F.col("n") / total).alias("ratio"), F.lit(3).cast("long").alias("low"), F.lit(20).cast("long").alias("high")), 137, seed=1)


@query("source_sample", f"""WITH d AS (SELECT DISTINCT doc_id AS id, lang AS category, quality AS label FROM documents JOIN labels USING (doc_id)), k AS (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY {SEED.format(6, "category || '|' || label || '|' || id")}, id) AS k FROM d)
  SELECT id, category, label FROM k WHERE k <= 5""")
def source_sample(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("quality").alias("label"))
    wanted = d.groupBy("category", "label").agg(F.count("*").alias("n")).select("category", "label", F.least(F.col("n"), F.lit(5)).alias("share"))
    return sm.select_sources(d, wanted, 6)
