"""Corpus preparation in five stages: quality filter, near-duplicate removal, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and
hands the reread table to the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tilespark.functions.naming import unused
from tilespark.functions.storage import materialize
from tilespark.llm import decontam, packing, pii, quality, simhash


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Null and empty texts are scored like any other, equal texts alike; without labels every score is 0.5 and all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    score, predicted = unused(docs.columns, "_score"), unused(docs.columns, "_predicted")
    scored = quality.score(docs, quality.fit(docs, labels), score_col=score, predicted_col=predicted)
    return scored.where(F.col(predicted) == 1).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each SimHash component.

    Rows that repeat a doc_id count as one document, of which the smallest text stays. Rows without a doc_id are kept. Null and
    empty texts are copies of one another.
    """
    found = materialize(simhash.near_duplicates(docs).select("doc_id", "component_id"), "components")
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct().join(kept, "doc_id", "left_anti")
    left = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id").join(kept, "doc_id", "left_semi")
    if not repeated.take(1):
        return left
    n = unused(docs.columns, "_n")
    again = left.join(repeated, "doc_id", "left_semi").withColumn(n, F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again.where(F.col(n) == 1).select(docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark.

    Texts are told apart by their 64-bit hash, so that rows without a doc_id and rows that repeat one are judged by their own
    text. Null and empty texts leak nothing; an empty benchmark leaves all rows.
    """
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaked = decontam.leaks(by_text, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    digest = unused(docs.columns, "_digest")
    marked = docs.withColumn(digest, F.xxhash64("text"))
    return marked.join(leaked.withColumnRenamed("doc_id", digest), digest, "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by tags; null texts stay null, all rows stay."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining texts into sequences of at most 2048 tokens; null and empty texts give one piece with the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo=200_000)  # workers outlive the stages


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the trained classifier or the tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
