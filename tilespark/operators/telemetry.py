"""Training telemetry: means by epoch, rolling means, plateaus, learning rate, stopping, replay buffer, error histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tilespark.functions.ordering import numbered


def rolling_mean(epochs: DataFrame, value: str, length: int, run: list[str] | None = None) -> DataFrame:
    """Mean of the last ``length`` values, the current one included."""
    w = Window.partitionBy(*(run or [])).orderBy("epoch").rowsBetween(1 - length, 0)
    return epochs.withColumn("rolling", F.avg(value).over(w))


def plateau(epochs: DataFrame, value: str, run: list[str] | None = None) -> DataFrame:
    """``plateau``: epochs since the first best value so far if it is strictly better than the current one, else 0 (higher is better)."""
    upto = Window.partitionBy(*(run or [])).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col("epoch")).alias("e"))).over(upto)
    return epochs.withColumn("_b", best).withColumn(
        "plateau", F.when(F.col("_b.v") > F.col(value), F.col("epoch") + F.col("_b.e")).otherwise(0).cast("int")).drop("_b")


def learning_rate(epochs: DataFrame, start: float, patience: int, factor: float) -> DataFrame:
    """``epochs(epoch, plateau)`` of one run -> ``rate`` after each epoch: multiplied by ``factor`` when the plateau and the epochs since the last change reach ``patience``.

    A run has a bounded number of epochs; the recurrence folds over them in order.
    """
    state = "struct(cast({start} as double) as rate, cast(-1 as int) as last, cast(array() as array<struct<epoch:int,rate:double>>) as out)"
    fold = f"""aggregate(e, {state.format(start=start)},
      (s, x) -> named_struct(
        'rate', if(least(x.epoch - coalesce(nullif(s.last, -1), e[0].epoch), x.plateau) >= {patience}, s.rate * {factor}, s.rate),
        'last', if(least(x.epoch - coalesce(nullif(s.last, -1), e[0].epoch), x.plateau) >= {patience}, x.epoch, s.last),
        'out', concat(s.out, array(named_struct('epoch', x.epoch,
          'rate', if(least(x.epoch - coalesce(nullif(s.last, -1), e[0].epoch), x.plateau) >= {patience}, s.rate * {factor}, s.rate))))),
      s -> s.out)"""
    one = epochs.groupBy().agg(F.array_sort(F.collect_list(F.struct("epoch", "plateau"))).alias("e"))
    return one.select(F.explode(F.expr(fold)).alias("x")).select("x.epoch", "x.rate")


def early_stop(epochs: DataFrame, limit: int) -> DataFrame:
    """Epochs up to the first whose plateau reaches the limit."""
    first = epochs.where(F.col("plateau") >= limit).agg(F.min("epoch").alias("_stop"))
    return epochs.crossJoin(F.broadcast(first)).where(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop"))).drop("_stop")


def rewind(epochs: DataFrame, index: int) -> DataFrame:
    return epochs.where(F.col("epoch") < index)


def replay(pushes: DataFrame, capacity: int) -> DataFrame:
    """A ring buffer's content after all ``pushes(seq, ...)``: the latest row of each slot ``seq mod capacity``."""
    names = [c for c in pushes.columns if c != "seq"]
    latest = F.max_by(F.struct("seq", *names), "seq")
    return pushes.groupBy(F.pmod("seq", F.lit(capacity)).alias("slot")).agg(latest.alias("x")).select("slot", "x.*")


def error_histogram(errors: DataFrame, bins: int, value: str = "error") -> DataFrame:
    """Equal bins on 0..1, the last one closed: ``bin, right_edge, n``."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return errors.where(F.col(value).between(0, 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).withColumn("right_edge", (F.col("bin") + 1) / bins)


def replacement(difficult: Column, size: int, ratio: float, switched: bool) -> Column:
    """Patches to transfer: all but the difficult ones that are kept, after the mode switch; else the whole buffer."""
    return F.lit(size) - (difficult - F.bround(difficult * ratio).cast("long")) if switched else F.lit(size)


def partition_order(buffer: DataFrame, threshold: float) -> DataFrame:
    """Easy patches (error under the threshold) before hard ones, each in slot order."""
    return numbered(buffer, "position", F.col("error") >= threshold, "slot")


def update_errors(buffer: DataFrame, errors: DataFrame) -> DataFrame:
    """``buffer(slot, error, ...)`` with the errors of ``errors(slot, error)``, the largest where a slot is named twice; errors outside 0..1 are an error."""
    fine = F.col("error").between(0, 1)
    new = errors.withColumn("error", F.when(fine, F.col("error")).otherwise(F.raise_error(F.lit("classification errors must be from 0 to 1")).cast("double")))
    new = new.groupBy("slot").agg(F.max("error").alias("_error"))
    return buffer.join(new, "slot", "left").withColumn("error", F.coalesce("_error", "error")).select(*buffer.columns)


def write_order(buffer: DataFrame, threshold: float, seed: int) -> DataFrame:
    """``position`` in which slots are overwritten: easy patches (error under the threshold) before hard ones, each kind shuffled by a seeded hash.

    A threshold of 0 keeps the order of the slots.
    """
    from tilespark.operators.sampling import seeded

    if threshold <= 0:
        return numbered(buffer, "position", "slot")
    return numbered(buffer, "position", F.col("error") >= threshold, seeded(seed, "slot"), "slot")


def push(buffer: DataFrame, order: DataFrame, patches: DataFrame) -> DataFrame:
    """``patches(seq, value)`` put in the slots of ``order(slot, position)``, one after the other and round again; new entries have error 1.

    ``buffer(slot, error, value)``; of patches that meet in one slot the last one stays.
    """
    capacity = order.count()
    last = patches.groupBy((F.pmod("seq", F.lit(capacity)) + 1).cast("int").alias("position")).agg(F.max_by("value", "seq").alias("_value"), F.count("*").alias("_n"))
    met = order.select("slot", "position").join(last, "position").select("slot", "_value", "_n")
    return buffer.join(met, "slot", "left").select("slot", F.when(F.col("_n") > 0, F.lit(1.0)).otherwise(F.col("error")).alias("error"), F.when(F.col("_n") > 0, F.col("_value")).otherwise(F.col("value")).alias("value"))
