import numpy as np
import pytest

from tilespark.llm import topk


def brute(rows, k, every):
    kept = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, a in kept.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shard,block,queries", [(8192, 128, 4096), (16, 4, 3), (50, 7, 1)])
def test_equals_brute_force(spark, shard, block, queries):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(300)]
    rows[10:60] = [(i, rows[5][1]) for i in range(10, 60)]  # a common vector: ties
    rows += [(1000, None), (1005, [None] * 8), (1010, [float("nan")] * 8), (1015, [float("inf")] * 8), (1020, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    got = {tuple(r) for r in topk.search(df, 5, 5, shard, block, queries).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, 5, 5)


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    centres = np.repeat(np.eye(16) * 200, 64, axis=0)
    d = (centres + rng.integers(-5, 6, centres.shape)).astype(np.int64)
    s = topk.Shard(np.arange(len(d)), np.arange(len(d)), d, 64)
    s.search(np.arange(0, len(d), 64), d[::64], 5, np.full(16, -np.inf))
    assert s.opened < 16 * 16 / 4


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema)).count() == 0
    assert topk.search(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in topk.search(spark.createDataFrame([(0, [1.0]), (1, [0.5])], schema)).collect()] == [(0, 1, 1, 256 * 128)]


def test_huge_components_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1.0]), (7, [0.5]), (7, [9.0]), (7, [9.0]), (1, [3e6]), (2, [1e300]), (3, [-1e300]), (50, [2.0**40]), (4, [float("inf")]), (5, [1e308])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, schema), 4, shard_size=2, block=1).collect()}
    # 5's components times 256 are no finite numbers, 2's scores end the range of a long
    assert [got[0, r] for r in (1, 2, 3, 4)] == [(2, 2**63 - 1), (50, 256 * 256 * 2**40), (1, 256 * 256 * 3_000_000), (7, 9 * 65_536)]
    assert [got[50, r][0] for r in (1, 2, 3, 4)] == [1, 2, 7, 7] and got[50, 1][1] == 2**63 - 1 and got[50, 3][1] == 9 * 65_536 * 2**40
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 1, 3) * 10.0 ** rng.integers(3, 7)).tolist()) for i in range(60)]
    whole = {i: [int(np.floor(x * 256)) for x in v] for i, v in rows}
    want = {(q, r + 1, i, -s) for q in (0, 50) for r, (s, i) in enumerate(sorted((-sum(x * y for x, y in zip(whole[q], whole[i])), i) for i in whole if i != q)[:5])}
    assert max(abs(w[3]) for w in want) > 2**53
    for most in (1, 1 << 26):
        assert {tuple(r) for r in topk.search(spark.createDataFrame(rows, schema), shard_size=7, block=3, max_shared=most).select("query_id", "rank", "vec_id", "score").collect()} == want


def test_every_row_stands_for_itself(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(7, [9.0]), (7, [9.0]), (0, [1.0]), (0, [2.0]), (50, [1.0]), (50, [1.0])]
    for shard, block in ((8192, 128), (2, 1)):
        got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, schema), 5, shard_size=shard, block=block).select("query_id", "rank", "vec_id", "score").collect())
        want = []
        for i, (q, a) in enumerate(rows):
            if q % 50 == 0:
                scored = sorted((-int(a[0] * b[0] * 65_536), v) for j, (v, b) in enumerate(rows) if j != i)
                want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:5])]
        assert got == sorted(want)


def test_queries_are_dealt_out_not_broadcast(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.search(df, 5, 5, 16, 4, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan
    for most in (1 << 26, 1024, 64):  # 60 queries of 64 bytes: 1, 4 and 60 parts
        assert {tuple(r) for r in topk.search(df, 5, 5, 16, 4, 3, max_meeting=most).select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 5, 5)


def test_one_huge_query_beside_small_ones(spark):
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(400)] + [(1000, [2.0**60, 1.0])]
    whole = {i: [int(x * 256) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(whole[q], whole[i])))), i) for i in whole if i != q)
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])}
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, shard_size=50, block=7)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
