import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, documents
from tests.oracle import SF
from tilespark.llm import quality


def corpus(n):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        w = rng.choice(words, rng.integers(30, 90)).tolist()
        bad = i % 4 == 0
        if bad:
            w = [w[0]] * len(w) if i % 8 else [x.upper() + "!!" for x in w]
        texts.append(" ".join(w))
        labels.append(0 if bad else 1)
    return texts, labels


def test_learns_and_scores_every_document(spark):
    texts, labels = corpus(400)
    docs = documents(spark, texts + AWKWARD)
    table = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)] + [(0, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, table.where(~quality.held_out()))
    rows = quality.score(docs, model).withColumn("held_out", quality.held_out()).collect()
    assert len(rows) == len(texts) + len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id < 400]
    assert len(own) > 40 and np.mean([r.predicted == labels[r.doc_id] for r in own]) > 0.97
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(5), model).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)
    assert len({round(r.score, 9) for r in rows if r.doc_id in (406, 407)}) == 1


def test_scores_equal_brute_force_voting():
    rng = np.random.default_rng(1)
    x = rng.random((60, quality.N_TERMS)).astype(np.float32)
    model = quality.NeighbourModel(np.ones(quality.N_TERMS, np.float32), rng.standard_normal((quality.N_TERMS, 8)).astype(np.float32), np.zeros((0, 8), np.float32), rng.integers(0, 2, 60).astype(float), 7)
    model.vectors = model.project(x)
    got = model.score(x[:20], block=7)
    for i in range(20):
        cos = model.project(x[i : i + 1])[0] @ model.vectors.T
        best = np.argsort(-cos)[:7]
        w = np.maximum(cos[best], 1e-6).astype(np.float64) ** 8
        assert abs(got[i] - (w * model.labels[best]).sum() / w.sum()) < 1e-6


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(spark, ["a b"])
    assert quality.score(docs, quality.fit(docs, none)).first().score == 0.5
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_held_out_accuracy_on_the_given_table(spark):
    from tilespark.llm.queries import op3_quality_classifier

    got = op3_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.a > 0.95 and SF
