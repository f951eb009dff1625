"""Jobs that fail one by one: an operator over a table of jobs, with a result or an error for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_ENVELOPE = ("ok boolean", "error string")


def attempt(jobs: DataFrame, work: Callable[[dict], dict], result: str, keys: list[str], retries: int = 0) -> DataFrame:
    """``work`` on every job -> ``<keys>, ok, error, <result>``: the columns that it returns, or the error's kind and text.

    ``result`` is the DDL of the returned columns. A job that fails leaves the others alone; ``retries`` further tries are made at once. An
    executor's own failure is Spark's business: its tasks run anew, so ``work`` must bear that.
    """
    names = [part.split()[0] for part in result.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for job in batch.to_dict("records"):
                found, error = {}, None
                for _ in range(retries + 1):
                    try:
                        found, error = work(job), None
                        break
                    except Exception as e:  # the envelope's purpose: the error becomes the job's result
                        error = f"{type(e).__name__}: {e}"
                rows.append([*(job[k] for k in keys), error is None, error, *(found.get(n) for n in names)])
            yield pd.DataFrame(rows, columns=[*keys, "ok", "error", *names])

    types = dict(jobs.dtypes)
    return jobs.mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), *_ENVELOPE, result]))


def checked(jobs: DataFrame, **rules: tuple[Column, str]) -> DataFrame:
    """``error``: the text of the first rule (name to condition that must hold and text) that a job breaks, null where none is; a null condition breaks its rule."""
    error = F.coalesce(*[F.when(~F.coalesce(condition, F.lit(False)), F.concat(F.lit(f"{name}: "), F.lit(text))) for name, (condition, text) in rules.items()])
    return jobs.withColumn("error", error)


def through(jobs: DataFrame, step: Callable[[DataFrame], DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Runs ``step`` over the data of the jobs without an error: (the step's result, the jobs with ``error``); a job of which the step gives no row has failed in it."""
    out = step(jobs.where("error is null"))
    seen = out.select(key).distinct().withColumn("_seen", F.lit(True))
    left = jobs.join(seen, key, "left")
    return out, left.withColumn("error", F.when(F.col("error").isNull() & F.col("_seen").isNull(), F.lit("no result")).otherwise(F.col("error"))).drop("_seen")


def summary(jobs: DataFrame) -> DataFrame:
    """``error, n``: jobs by the kind of their error (up to the colon), those that went well under ``ok``."""
    kind = F.coalesce(F.substring_index("error", ":", 1), F.lit("ok"))
    return jobs.groupBy(kind.alias("error")).agg(F.count("*").alias("n"))
