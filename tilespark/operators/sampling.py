"""Seeded sampling: shared hash, allocation of counts by ratio, purpose splits, source selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tilespark.functions.ordering import numbered


def seeded(seed: int, *keys) -> Column:
    """A number of 32 bits from md5 of ``seed|key|...``; the same in any engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def allocate(groups: DataFrame, total: int | Column, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``groups(<by>, key, ratio, low, high)`` -> ``share``: half-even rounding of ratio * total within low..high, then one-by-one correction to the total.

    Correction goes round the entries that can still move, in seeded order: with d the missing (or surplus) amount, the entry that is
    k-th in that order moves once in every round in which d lasts. Expressed by capacity: a round lasts as long as entries have room,
    so shares are found by counting, without loops. ``by`` allocates several independent sets; each set's sums of low and high
    must enclose the total, which may be a column that is the same throughout a set.
    """
    total = total if isinstance(total, Column) else F.lit(total)
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    first = F.least(F.greatest(F.bround(F.col("ratio") * total).cast("long"), F.col("low")), F.col("high"))
    d = groups.withColumn("share", first).withColumn("short", total - F.sum("share").over(w))
    d = d.withColumn("room", F.when(F.col("short") > 0, F.col("high") - F.col("share")).otherwise(F.col("share") - F.col("low")))
    d = d.withColumn("need", F.abs("short")).withColumn("order", seeded(seed, "key"))
    # every set as one ordered array: entry k takes a step in round t while t < room; the fold spends `need` step by step over rounds
    entry = F.struct("order", "key", "room", "share")
    sets = d.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("e"), F.max("need").alias("need"), F.max("short").alias("short"))
    # the last round that all entries with room share: found by halving, one fold over the entries a bit
    spent = "aggregate(e, 0L, (a, x) -> a + least(x.room, l + b))"
    level = f"aggregate(transform(sequence(0, 62), i -> shiftleft(1L, 62 - i)), 0L, (l, b) -> if(l + b <= need and {spent} <= need, l + b, l))"
    sets = sets.withColumn("level", F.expr(level))
    sets = sets.withColumn("left", F.expr("need - aggregate(e, 0L, (a, x) -> a + least(x.room, cast(level as bigint)))"))
    sets = sets.withColumn("open", F.expr("transform(filter(e, x -> x.room > level), x -> x.key)"))
    one = sets.select(*by, "short", "level", "left", "open", F.explode("e").alias("x"))
    extra = F.when((F.array_position("open", F.col("x.key")) > 0) & (F.array_position("open", F.col("x.key")) <= F.col("left")), 1).otherwise(0)
    moved = F.least(F.col("x.room"), F.col("level").cast("long")) + extra
    return one.select(*by, F.col("x.key").alias("key"), (F.col("x.share") + F.when(F.col("short") >= 0, moved).otherwise(-moved)).alias("share"))


def sample_indices(counts: DataFrame, k: int | Column, seed: int) -> DataFrame:
    """``counts(image_id, label, n)`` -> k indices below n for each label, with replacement: ``image_id, label, i, k``; k may be a column of 1 and more."""
    drawn = counts.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), (k if isinstance(k, Column) else F.lit(k)).cast("int") - 1)))
    return drawn.select("image_id", "label", "i", F.pmod(seeded(seed, "image_id", "label", "i"), F.col("n")).alias("k"))


def purpose_split(items: DataFrame, ratios: list[tuple[str, float]], seed: int) -> DataFrame:
    """``items(id, category)`` -> ``purpose``: each category in seeded order, cut into contiguous slices at the rounded cumulative ratios."""
    order = Window.partitionBy("category").orderBy(seeded(seed, "category", "id"), "id")
    ranked = items.withColumns({"k": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("category"))})
    upto, choice = 0.0, None
    for purpose, ratio in ratios:
        upto += ratio
        hit = F.col("k") <= F.bround(F.lit(round(upto, 9)) * F.col("n"))
        choice = F.when(hit, purpose) if choice is None else choice.when(hit, purpose)
    return ranked.select("id", "category", choice.otherwise(ratios[-1][0]).alias("purpose"))


def select_sources(sources: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """``sources(id, category, label)``, ``wanted(category, label, share)`` -> ids sampled without replacement, label by label.

    A source may carry several labels: labels are served in order, each from what earlier labels left over.
    """
    out = None
    for label in [r[0] for r in wanted.select("label").distinct().orderBy("label").collect()]:
        pool = sources.where(F.col("label") == label).select("id", "category", "label").distinct()
        if out is not None:
            pool = pool.join(out.select("id", "category"), ["id", "category"], "left_anti")
        order = Window.partitionBy("category").orderBy(seeded(seed, "category", "label", "id"), "id")
        picked = pool.withColumn("k", F.row_number().over(order)).join(F.broadcast(wanted.where(F.col("label") == label)), ["category", "label"]).where("k <= share").select("id", "category", "label")
        out = picked if out is None else out.unionByName(picked)
    return out


def read_order(df: DataFrame, seed: int, flag: str | None = None, key: str = "id") -> DataFrame:
    """Position of each row in seeded order; rows whose flag is false come first."""
    first = [F.col(flag)] if flag else []
    return numbered(df, "position", *first, seeded(seed, key), key)


def ticks(n: int, wanted: int = 50) -> list[int]:
    """About ``wanted`` axis ticks of 0..n-1: half-even rounded multiples of n/wanted, with the last index."""
    step = max(1, n / wanted)
    out = sorted({round(i * step) for i in range(int(n / step) + 1) if round(i * step) < n} | ({n - 1} if n else set()))
    return out


def source_round(sources: DataFrame, categories: DataFrame, labels: DataFrame, pool: int, seed: int, strict: bool = False) -> DataFrame:
    """One round of sources, drawn without replacement by category and label: ``id, category, step``.

    ``sources(id, category, label)`` has a row for each label of a source, ``categories(category, ratio)`` and ``labels(label, ratio)`` the wanted
    shares. The pool, or all sources if fewer, is shared out to the categories and each category's part to the labels (at least one
    each where there are enough). In each category the labels come in seeded order, each takes its part in seeded order from what is left
    (``step`` is the label), then any other source of the category fills up (``fill``), and last those of all categories that carry a wanted
    label (``top-up``). With ``strict`` a wanted label that no drawn source carries is an error.

    A label's part comes from its first candidates, as many as all parts up to its own, so what one task sees is bounded by pool and labels.
    """
    from tilespark.functions.storage import materialize

    known = materialize(sources.join(F.broadcast(categories.select("category")), "category", "left_semi").select("id", "category", "label").distinct(), "sources")
    single = known.select("id", "category").distinct()
    total = min(pool, single.count())
    shares = lambda ratios, n: allocate(ratios.withColumns({"low": F.when((F.col("n_keys") <= n) & (F.col("ratio") > 0), 1).otherwise(0).cast("long"), "high": n}), n, by=None)
    n_categories, n_labels = categories.count(), labels.count()  # parameters of the caller
    per_category = shares(categories.select(F.col("category").alias("key"), "ratio").withColumn("n_keys", F.lit(n_categories)), F.lit(total).cast("long"))
    per_category = materialize(per_category.select(F.col("key").alias("category"), F.col("share").alias("part")).where("part > 0"), "parts")
    sets = per_category.crossJoin(labels.select(F.col("label").alias("key"), "ratio")).withColumn("n_keys", F.lit(n_labels))  # categories by labels: both are parameters
    sets = sets.withColumns({"low": F.when((F.col("n_keys") <= F.col("part")) & (F.col("ratio") > 0), 1).otherwise(0).cast("long"), "high": F.col("part")})
    parts = allocate(sets.select("category", "part", "key", "ratio", "low", "high"), F.col("part"), by=["category", "part"])
    turn = Window.partitionBy("category").orderBy(seeded(seed, "category", "label"), "label")
    parts = parts.select("category", F.col("key").alias("label"), "share").withColumn("turn", F.row_number().over(turn))
    parts = materialize(parts.withColumn("upto", F.sum("share").over(turn.rowsBetween(Window.unboundedPreceding, 0))), "parts")
    drawn = seeded(seed, "category", "label", "id")
    rank = F.row_number().over(Window.partitionBy("category", "label").orderBy(drawn, "id"))
    near = known.withColumn("rank", rank).join(F.broadcast(parts), ["category", "label"]).where("rank <= upto")
    lists = near.groupBy("category", "turn", "label", "share").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    turns = lists.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("turn", "label", "share", "ids"))).alias("turns"))
    kind = known.schema["id"].dataType.simpleString()
    fold = f"""aggregate(turns, cast(array() as array<struct<id:{kind},step:string>>), (s, t) -> concat(s,
        transform(slice(array_except(t.ids, transform(s, x -> x.id)), 1, int(t.share)), i -> named_struct('id', i, 'step', t.label))))"""
    by_label = materialize(turns.select("category", F.explode(F.expr(fold)).alias("x")).select("x.id", "category", "x.step"), "drawn")
    held = by_label.groupBy("category").agg(F.count("*").alias("held"))
    rest = single.join(by_label.select("id", "category"), ["id", "category"], "left_anti")
    fill = rest.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(seeded(seed, F.lit("fill"), "category", "id"), "id")))
    fill = fill.join(F.broadcast(per_category.join(held, "category", "left").select("category", (F.col("part") - F.coalesce("held", F.lit(0))).alias("open"))), "category").where("rank <= open")
    chosen = materialize(by_label.unionByName(fill.select("id", "category", F.lit("fill").alias("step"))), "drawn")
    missing = total - chosen.count()
    if missing > 0:
        wanted = known.join(F.broadcast(labels.select("label")), "label", "left_semi").select("id", "category").distinct()
        more = wanted.join(chosen.select("id", "category"), ["id", "category"], "left_anti").orderBy(seeded(seed, F.lit("top-up"), "category", "id"), "category", "id").limit(missing)
        chosen = chosen.unionByName(more.select("id", "category", F.lit("top-up").alias("step")))
    if strict:
        carried = known.join(chosen.select("id", "category"), ["id", "category"], "left_semi").select("label").distinct()
        if lost := [r["label"] for r in labels.where("ratio > 0").join(carried, "label", "left_anti").select("label").collect()]:
            raise ValueError(f"no drawn source carries {sorted(lost)}")
    return chosen
