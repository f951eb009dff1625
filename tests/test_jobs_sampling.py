"""Jobs with error capture, source rounds, buffer errors, segmented sums."""

import pytest
from pyspark.sql import functions as F

from tilespark.functions.ordering import running_sums
from tilespark.operators import jobs, sampling, telemetry


def _work(job):
    if job["x"] == 3:
        raise KeyError("three")
    return {"y": job["x"] * 2}


def test_one_broken_job_fails_alone(spark):
    df = spark.createDataFrame([(i, i) for i in range(6)], "id long, x long")
    got = {r.id: (r.ok, r.error, r.y) for r in jobs.attempt(df, _work, "y long", ["id"]).collect()}
    assert got.pop(3) == (False, "KeyError: 'three'", None)
    assert got == {i: (True, None, 2 * i) for i in (0, 1, 2, 4, 5)}
    assert jobs.attempt(df.limit(0), _work, "y long", ["id"]).collect() == []


def test_rules_and_steps(spark):
    df = jobs.checked(spark.createDataFrame([(0, 1), (1, None), (2, -1)], "id long, x long"), positive=(F.col("x") > 0, "x must be positive"))
    out, after = jobs.through(df, lambda d: d.where("id > 5").select("id"), "id")
    assert out.count() == 0
    assert {r.id: r.error for r in after.collect()} == {0: "no result", 1: "positive: x must be positive", 2: "positive: x must be positive"}
    assert {r.error: r.n for r in jobs.summary(after).collect()} == {"no result": 1, "positive": 2}


def test_strict_round_needs_every_label(spark):
    sources = spark.createDataFrame([(i, "c", "a" if i else "b") for i in range(50)], "id long, category string, label string")
    categories = spark.createDataFrame([("c", 1.0)], "category string, ratio double")
    labels = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("z", 0.1)], "label string, ratio double")
    with pytest.raises(ValueError, match="z"):
        sampling.source_round(sources, categories, labels, 10, 1, strict=True)
    got = sampling.source_round(sources, categories, labels, 10, 1).collect()
    assert len({r.id for r in got}) == 10 and sum(r.step == "b" for r in got) == 1 and sum(r.step == "a" for r in got) == 5


def test_errors_outside_the_range_are_errors(spark):
    buffer = spark.createDataFrame([(0, 1.0, 5.0)], "slot long, error double, value double")
    with pytest.raises(Exception, match="from 0 to 1"):
        telemetry.update_errors(buffer, spark.createDataFrame([(0, 1.5)], "slot long, error double")).collect()


def test_running_sums(spark):
    rows = [(i % 3 if i % 2 else 0, i * 7 % 31, i) for i in range(200)]
    got = running_sums(spark.createDataFrame(rows, "g int, o int, v long"), ["g"], [F.col("o"), F.col("v")], {"s": "v"}).collect()
    for g in range(3):
        total = 0
        for n, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == g)):
            total += v
            assert any((r.g, r.o, r.v, r.s, r["_n"]) == (g, o, v, total, n + 1) for r in got)
