"""Training-text pipeline: five stages over ``documents``, each of which calls one operator.

Every stage reads what the one before it has written. All stages but the last return the columns of ``documents``, whatever
they are called. Stages decide for rows, not for ids, so null and repeated ids are told apart: toxicity and decontamination
judge each row in the scan that passes it on; near-duplicates tells rows by their place in the files they were read from.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.llm import decontam, line_templates, near_dups, packing, toxicity
from logtriage.llm.common import drop_stored, keyed, stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be toxic go."""
    model = toxicity.trained(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents stay."""
    return line_templates.drop_recurring(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the smallest by id, then by place; null ids come last."""
    rows, key = keyed(docs)
    order = F.struct(F.col("doc_id").isNull().alias("is_null"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    found = near_dups.near_duplicates(rows.select(order.alias("doc_id"), "text"), words=5, percent=80)
    gone = stored(found.where(~F.col("kept")).select("doc_id.key.*"), "near-duplicates-gone")
    place = (F.col(key)["file"] == gone["file"]) & (F.col(key)["row"] == gone["row"])
    return rows.join(gone, place, "left_anti").drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontam.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_recurring_lines),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the classifier, the tokenizer or the packing; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_stored(before)  # the next stage's rows are written, so nothing reads these any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
