"""Source catalogues: membership sets, file joins by name template, path tags, checks, and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def select_items(membership: DataFrame, categories: list[str] | None = None, purposes: list[str] | None = None) -> DataFrame:
    """``membership(id, category, purpose)``: ids in the union of the categories and in the union of the purposes."""
    hit = F.lit(True)
    if categories is not None:
        hit &= F.col("category").isin(categories)
    if purposes is not None:
        hit &= F.col("purpose").isin(purposes)
    return membership.where(hit).select("id").distinct()


def categories_of_purpose(membership: DataFrame, purpose: str) -> DataFrame:
    return membership.where(F.col("purpose") == purpose).select("category").distinct()


def counts_by_group(membership: DataFrame) -> DataFrame:
    return membership.groupBy("category", "purpose").agg(F.countDistinct("id").alias("n"))


def push(catalogue: DataFrame, items: DataFrame) -> DataFrame:
    """Append items; repeated ones count once."""
    return catalogue.unionByName(items).distinct()


def base_name(path: Column) -> Column:
    """Last path part without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def assemble_jobs(images: DataFrame, masks: DataFrame, mask_template: str, output_template: str) -> DataFrame:
    """``images(path)``, ``masks(path)`` -> ``image, mask, output``; templates hold ``{image}``.

    An image whose base name is itself some image's mask name is left out (anti join); images without a mask keep null.
    """
    fill = lambda template, name: F.replace(F.lit(template), F.lit("{image}"), name)
    named = images.select("path", base_name(F.col("path")).alias("name")).withColumn("key", fill(mask_template, F.col("name")))
    keys = named.select(F.col("key").alias("name")).distinct()
    found = masks.select(F.col("path").alias("mask"), base_name(F.col("path")).alias("key"))
    return named.join(keys, "name", "left_anti").join(found, "key", "left").select(
        F.col("path").alias("image"), "mask", fill(output_template, F.col("name")).alias("output"))


def join_sources(images: DataFrame, masks: DataFrame, stats: DataFrame) -> DataFrame:
    """Sources with a mask or statistics: ``name, image, mask, stat``; others are dropped."""
    j = images.select("name", F.col("path").alias("image")).join(masks.select("name", F.col("path").alias("mask")), "name", "left")
    return j.join(stats.select("name", F.col("path").alias("stat")), "name", "left").where("mask is not null or stat is not null")


def expand_path(path: Column, tags: dict[str, str]) -> Column:
    """Replace ``{tag}`` parts."""
    for tag, value in sorted(tags.items()):
        path = F.replace(path, F.lit("{" + tag + "}"), F.lit(value))
    return path


def tag_paths(paths: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the longest common directory prefix of the columns by ``{root}``."""
    parts = {c: F.slice(F.split(c, "/"), 1, F.greatest(F.size(F.split(c, "/")) - 1, F.lit(0))) for c in columns}
    n = F.least(*[F.size(p) for p in parts.values()]) if len(parts) > 1 else F.size(parts[columns[0]])
    first = parts[columns[0]]
    same = lambda i: F.forall(F.array(*[F.get(p, i) for p in parts.values()]), lambda x: x == F.get(first, i))
    common = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
                         lambda s, i: F.struct(F.when(s["on"] & same(i) & (i < n), s["k"] + 1).otherwise(s["k"]).alias("k"), (s["on"] & same(i) & (i < n)).alias("on")), lambda s: s["k"])
    d = paths.withColumn("_k", common)
    d = d.withColumn("root", F.array_join(F.slice(F.split(columns[0], "/"), F.lit(1), F.col("_k")), "/"))
    return d.withColumns({c: F.when(F.col("_k") > 0, F.concat(F.lit("{root}"), F.substring(F.col(c), F.length("root") + 1, F.length(c)))).otherwise(F.col(c)) for c in columns}).drop("_k")


def check_files(wanted: DataFrame, present: DataFrame, by: list[str]) -> DataFrame:
    """Counters of paths that exist and that are missing."""
    p = present.select("path").distinct().withColumn("_ok", F.lit(True))
    return wanted.join(p, "path", "left").groupBy(*by).agg(F.count_if("_ok").alias("ok"), F.count_if(F.col("_ok").isNull()).alias("missing"))


def skip_existing(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Jobs whose output does not exist yet."""
    return jobs.join(outputs.select(F.col("path").alias("output")).distinct(), "output", "left_anti")


def list_folder(paths: DataFrame, folder: str, pattern: str, recursive: bool) -> DataFrame:
    """Paths below a folder whose base name matches; without ``recursive`` the folder's own entries only."""
    rest = F.substring(F.col("path"), len(folder) + 2, 1 << 20)
    below = F.col("path").startswith(folder + "/") & (F.lit(recursive) | ~rest.contains("/"))
    return paths.where(below & F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{pattern})"))


def merge_parameters(defaults: dict, override: dict, replace: frozenset = frozenset()) -> dict:
    """Overrides of existing keys only; nested dictionaries merge unless their key is in ``replace``."""
    out = dict(defaults)
    for key, value in override.items():
        if key in out:
            nested = isinstance(out[key], dict) and isinstance(value, dict) and key not in replace
            out[key] = merge_parameters(out[key], value, replace) if nested else value
    return out


def read_catalogue(spark, path: str) -> DataFrame:
    """A multi-line JSON file of ``{purpose: {category: [items]}}`` as ``purpose, category, item``."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    one = parsed.select(F.explode("m").alias("purpose", "c")).select("purpose", F.explode("c").alias("category", "i"))
    return one.select("purpose", "category", F.explode("i").alias("item"))


def write_catalogue(items: DataFrame, path: str) -> None:
    """Inverse of ``read_catalogue``: one JSON document (catalogues are driver-sized configuration)."""
    inner = items.groupBy("purpose", "category").agg(F.array_sort(F.collect_set("item")).alias("i"))
    outer = inner.groupBy("purpose").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "i")))).alias("c"))
    doc = outer.select(F.to_json(F.create_map("purpose", "c")).alias("j")).groupBy().agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.expr("substring(j, 2, length(j) - 2)"))), ","), F.lit("}")).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def purposes_valid(ratios: DataFrame, wanted: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``ratios(purpose, ratio)`` normalised against ``wanted(purpose, ratio)``: one row, ``valid``."""
    norm = lambda d, n: d.crossJoin(F.broadcast(d.agg(F.sum("ratio").alias("_s")))).select("purpose", F.try_divide("ratio", "_s").alias(n))
    j = norm(wanted, "w").join(norm(ratios, "h"), "purpose", "left")
    return j.agg(F.bool_and(F.coalesce(F.abs(F.col("w") - F.col("h")) <= tolerance * F.greatest(F.abs("w"), F.abs("h")), F.lit(False))).alias("valid"))
