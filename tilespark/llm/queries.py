"""The registered queries of this subpackage and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.shards import order_documents

    return order_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)[0]


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.topk import search

    return search(_table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.quality import fit, held_out, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.decontam import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.licenses import scan, templates_table

    return scan(_table(spark, sf_dir, "documents"), templates_table(spark))


#: The fixed host/path rules of the URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.urls import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.unigram import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.pii import find, report

    return report(find(_table(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.align import report

    return report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.sharding import assign

    return assign(_table(spark, sf_dir, "documents")).drop("grp")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, f in globals().items() if (name.startswith("op") or name == "pipeline") and callable(f)}


ORACLE: dict[str, str] = {}

#: Integer inner products of every query against every other valid vector.
ORACLE["op2_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

#: Exact scores of every document that shares a term with an item. A-Z alone are lower-cased.
ORACLE["op13_ranked_search"] = r"""
WITH w AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
tf AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM w GROUP BY rid, term),
n AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY rid),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
d AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
m AS (SELECT rid, 100 - 50 + (50 * n * docs) // total AS m FROM n, c),
s AS (
  SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN d USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
