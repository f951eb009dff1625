import os

import pytest

import corpus_pipeline
from tests.llm.helpers import AWKWARD, documents
from tilespark.llm import quality, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_in_order_and_their_columns(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= total
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out())
            want = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
            assert {r.doc_id for r in out.collect()} == want
        if name == "simhash_near_dedup":
            want = {r.doc_id for r in simhash.near_duplicates(docs).where("doc_id = component_id").collect()}
            assert {r.doc_id for r in out.collect()} == want
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert rows and all(sum(n for _, n in v) <= 2048 for v in held.values())


def test_stages_bear_awkward_rows(spark):
    docs = documents(spark, AWKWARD + ["repeated id"], [None, *range(1, len(AWKWARD)), 3])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns or name == "best_fit_packing", name
        stage(spark, docs.limit(0), SF).collect()
        if name == "simhash_near_dedup":
            ids = [r.doc_id for r in rows]
            assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_stages_bear_clashing_names_and_leaks_without_an_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    names = ["_score", "_predicted", "_n", "_more", "_id", "_hash", "_digest"]
    rows = [(None, item, *range(7)), (None, "a clean text of a few words", *range(7)), (5, item, *range(7)), (5, "another clean text", *range(7)), (6, None, *range(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).collect()
        assert all(r[2:] == tuple(range(7)) for r in out), name
        if name == "benchmark_decontamination":
            assert sorted((r.text or "") for r in out) == ["", "a clean text of a few words", "another clean text"]
