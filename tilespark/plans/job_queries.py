"""Queries of jobs with error capture."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilespark.operators import jobs
from tilespark.plans.registry import query
from tilespark.sources.fixtures import table


def foreground(job: dict) -> dict:
    """Pixels of an 8x8 patch over its limit; a patch that holds a very low value is broken."""
    patch = np.asarray(job["embedding"], float).reshape(8, 8)
    if patch.min() < -0.45:
        raise ValueError("value out of range")
    return {"pixels": int((patch >= job["threshold"]).sum())}


@query("job_results", """SELECT vec_id, NOT low AS ok, CASE WHEN low THEN 'ValueError: value out of range' END AS error, CASE WHEN NOT low THEN CAST(len(list_filter(embedding, lambda x: x::DOUBLE >= (vec_id % 5) / 10.0::DOUBLE)) AS BIGINT) END AS pixels
  FROM (SELECT *, list_min(list_transform(embedding, lambda x: x::DOUBLE)) < -0.45::DOUBLE AS low FROM embeddings)""")
def job_results(spark, sf):
    """A job a patch; the broken ones give an error and no result."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), ((F.col("vec_id") % 5) / 10.0).alias("threshold"))
    return jobs.attempt(e, foreground, "pixels long", ["vec_id"])


@query("job_checks", """SELECT page_id, CASE WHEN url NOT LIKE 'http%' OR url IS NULL THEN 'address: no web address' WHEN length(html) < 1000 THEN 'size: too short' END AS error FROM pages""")
def job_checks(spark, sf):
    """Jobs checked by rules before any work."""
    p = table(spark, sf, "pages")
    return jobs.checked(p, address=(F.col("url").like("http%"), "no web address"), size=(F.length("html") >= 1000, "too short")).select("page_id", "error")


@query("job_summary", """SELECT CASE WHEN url NOT LIKE 'http%' OR url IS NULL THEN 'address' WHEN length(html) < 1000 THEN 'size' ELSE 'ok' END AS error, count(*) AS n FROM pages GROUP BY 1""")
def job_summary(spark, sf):
    return jobs.summary(job_checks(spark, sf))
