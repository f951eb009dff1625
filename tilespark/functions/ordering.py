"""Row numbers over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tilespark.functions.storage import materialize


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``: the row's number from 1 in ascending ``order``.

    Rows are dealt by ranges of the order and stored, so that partitions stay as they are; a row's number is its number in
    its partition after the rows of all earlier ones. Only counts by partition meet in one task.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys)]).repartitionByRange(*keys)
    stored = materialize(dealt.withColumn("_part", F.spark_partition_id()), "ordered")
    counts = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return stored.withColumn(name, own).join(F.broadcast(offsets), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).select(*df.columns, name)


def running_sums(df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums by group in ascending ``order``: each of ``sums`` (new name to column) up to and with the row, and ``_n``, the row's number in its group.

    A segmented scan: rows are dealt by ranges of group and order and stored, sums run inside tasks, and a table of the tasks' totals by
    group carries them on. A group of any size is spread over tasks; only totals by task and group meet.
    """
    from tilespark.functions.naming import unused

    names = [unused(df.columns, f"_o{i}") for i in range(len(order))]
    part = unused(df.columns, "_part")
    dealt = df.select("*", *[o.alias(k) for o, k in zip(order, names)]).repartitionByRange(*groups, *names)
    stored = materialize(dealt.withColumn(part, F.spark_partition_id()), "ordered")
    counted = {"_n": F.lit(1).cast("long"), **{new: F.col(old) for new, old in sums.items()}}
    totals = stored.groupBy(part, *groups).agg(*[F.sum(v).alias(f"{k}_total") for k, v in counted.items()])
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(part, *groups, *[F.coalesce(F.sum(f"{k}_total").over(earlier), F.lit(0)).alias(f"{k}_before") for k in counted])
    own = Window.partitionBy(part, *groups).orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    summed = stored.select("*", *[F.sum(v).over(own).alias(f"{k}_own") for k, v in counted.items()])
    return summed.join(before, [part, *groups]).select(*df.columns, *[(F.col(f"{k}_own") + F.col(f"{k}_before")).alias(k) for k in counted])
