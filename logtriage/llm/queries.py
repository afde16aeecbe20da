"""Registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.llm import (
    decontam,
    divergence,
    dual_tree,
    kd_search,
    line_templates,
    near_dups,
    packing,
    parity,
    suffix_index,
    token_file,
    token_rollups,
    toxicity,
    url_templates,
)
from logtriage.session import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.digest(suffix_index.without_repeats(table(spark, sf_dir, "documents"), length=400))


def op3_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-file")
    token_file.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer(), end_id=2)
    return token_file.token_digest(spark, path)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), end_id=0, capacity=2048)


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_digest(table(spark, sf_dir, "documents"))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return token_rollups.corpus_rollup(docs, labels, new_folder(spark, "rollup"))


def op11_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.jaccard_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_suffix_dedup,
        op3_kd_search,
        op4_token_file,
        op5_near_duplicates,
        op6_decontamination,
        op7_packing,
        op8_url_templates,
        op9_line_dedup,
        op10_token_rollups,
        op11_parity_join,
        op12_vector_codes,
        op13_source_divergence,
    )
}
