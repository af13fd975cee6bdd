"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import additive_quantization, bloom_cascade, bpe_automaton, packing, partenum, pii, sorted_lists, substring_dedup, token_counts, toxicity
from .common import table


def op1_additive_quantization(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index, books = additive_quantization.build(vectors)
    return additive_quantization.nearest(index, books, vectors.filter(f"vec_id % {additive_quantization.EVERY} = 0"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(table(spark, sf_dir, "documents"), 3, 90, 100)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_cascade.judge(table(spark, sf_dir, "pages"))


def op9_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(table(spark, sf_dir, "documents"))


def op10_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return sorted_lists.top_k(vectors, vectors.filter(f"vec_id % {sorted_lists.EVERY} = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": bloom_cascade.ORACLE_SQL, "op10_sorted_lists": sorted_lists.ORACLE_SQL}
