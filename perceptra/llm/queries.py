"""The corpus operators as registered queries, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from perceptra.llm import (
    codec,
    collocations,
    decontamination,
    divergence,
    licences,
    packing,
    passages,
    quality_model,
    ranking,
    secrets,
    sharding,
    simhash,
    topk,
)
from perceptra.llm.common import table


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_rules(table(spark, sf_dir, "documents"))


def op3_block_max_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op5_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_distribution_divergence": op2_distribution_divergence,
    "op3_block_max_topk": op3_block_max_topk,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_licence_digests": op5_licence_digests,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_hypergeometric_shards": op7_hypergeometric_shards,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_ranked_search": op11_ranked_search,
    "op12_winnowing": op12_winnowing,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}

TOP_K_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

#: The others are beyond SQL on whole tables; tests hold them against brute force.
ORACLES = {
    "op3_block_max_topk": TOP_K_SQL,
    "op5_licence_digests": licences.oracle_sql(),
    "op11_ranked_search": ranking.oracle_sql(),
    "op12_winnowing": decontamination.oracle_sql(),
    "op13_collocations": collocations.oracle_sql(),
}
