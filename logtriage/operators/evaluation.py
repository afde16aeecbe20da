"""Evaluation of detectors over splits, error typing and dataset statistics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logtriage.operators.detect import DISPLAY_NAMES, literal_map, model_threshold
from logtriage.operators.metrics import confusion_of_counts, ranking_of_counts, rates, score_counts
from logtriage.session import cut_lineage

UNAVAILABLE_NOTE = "model artifact or tokenizer unavailable"
ERROR_EXPLANATION = "Model score disagreed with the dataset label at the evaluation threshold."

# Columns of the comparison, prediction and error tables.
COMPARISON_COLUMNS = [
    "model",
    "test_set",
    "accuracy",
    "precision",
    "recall",
    "f1",
    "roc_auc",
    "pr_auc",
    "fpr",
    "fnr",
    "latency_ms",
    "throughput_lps",
    "tp",
    "fp",
    "tn",
    "fn",
    "positive_support",
    "negative_support",
    "threshold",
    "metric_note",
]
PREDICTION_COLUMNS = [
    "model",
    "id",
    "test_set",
    "true_label",
    "pred_label",
    "score",
    "threshold",
    "raw_log",
    "normalized_log",
    "obfuscation_type",
    "source",
]
ERROR_COLUMNS = [
    "model",
    "test_set",
    "id",
    "source",
    "raw_log",
    "normalized_log",
    "true_label",
    "pred_label",
    "score",
    "threshold",
    "error_type",
    "obfuscation_type",
    "explanation",
]


def predictions(scored: DataFrame, models: list[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """Long prediction table from one row per line with a ``score_<model>`` column per model.

    A narrow explode: the lines are not shuffled, and a null score (no such model) leaves no row.
    """
    entries = F.array(*[F.struct(F.lit(m).alias("key"), F.col(f"score_{m}").alias("score")) for m in models])
    kept = [c for c in scored.columns if c not in {f"score_{m}" for m in models}]
    long = scored.select(*kept, F.explode(entries).alias("_e")).select(*kept, "_e.key", "_e.score")
    long = long.filter(F.col("score").isNotNull()).withColumn(
        "threshold", model_threshold(F.col("key"), thresholds)
    )
    return long.select(
        display_name(F.col("key")).alias("model"),
        "id",
        F.col("split").alias("test_set"),
        F.col("label").alias("true_label"),
        (F.col("score") >= F.col("threshold")).cast("int").alias("pred_label"),
        "score",
        "threshold",
        "raw_log",
        "normalized_log",
        "obfuscation_type",
        "source",
    )


def display_name(key: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(DISPLAY_NAMES), key), key)


def evaluate(
    preds: DataFrame,
    models: list[str] | None = None,
    latency_ms: dict[str, float] | None = None,
    ranking: bool = True,
) -> DataFrame:
    """One metric row per (model, test set) over ``predictions``; without ``ranking`` AUC and AP stay null.

    With ``models``, a pair without predictions gets a row of nulls and a note. ``latency_ms`` holds measured
    times by model name; throughput follows from it.
    """
    group = ["model", "test_set", "threshold"]
    # Distinct scores with their counts are all that follows needs, so lines are scored once.
    counts = score_counts(preds.withColumn("label", F.col("true_label")), group)
    if ranking or models is not None:  # read more than once
        counts = cut_lineage(counts)
    table = rates(confusion_of_counts(counts, group, F.col("threshold")))
    if ranking:
        found = ranking_of_counts(counts.drop("threshold"), ["model", "test_set"])
        table = table.join(found, ["model", "test_set"], "left")
    else:
        none = F.lit(None).cast("double")
        table = table.withColumns({"roc_auc": none, "pr_auc": none})
    if models is not None:
        wanted = counts.select("test_set").distinct().select(
            F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), "test_set"
        )
        table = wanted.join(table, ["model", "test_set"], "left").withColumn(
            "metric_note", F.coalesce("metric_note", F.lit(UNAVAILABLE_NOTE))
        )
    known = literal_map(latency_ms) if latency_ms else None
    measured = F.try_element_at(known, F.col("model")) if known is not None else F.lit(None).cast("double")
    speed = F.when(F.col("latency_ms") > 0, F.lit(1000.0) / F.col("latency_ms"))
    return table.withColumn("latency_ms", measured).withColumn("throughput_lps", speed).select(*COMPARISON_COLUMNS)


def measured_latency(lines: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, float]:
    """Milliseconds a line of scoring all ``lines`` with each model, by model name, as one run has taken them.

    Rows are counted where they are scored (an observed metric), so the run computes scores only and keeps none. The time is
    that of the whole cluster: more cores lower it. A model without lines has no entry.
    """
    found = {}
    for model, scorer in scorers.items():
        seen = Observation(f"scored {model}")
        scored = scorer(lines).observe(seen, F.count(F.lit(1)).alias("rows"))
        started = time.perf_counter()
        scored.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - started
        if rows := seen.get["rows"]:
            found[model] = took * 1000 / rows
    return found


def unavailable(comparison: DataFrame) -> DataFrame:
    """Warning text for each (model, test set) without metrics."""
    return comparison.filter(F.col("metric_note") == UNAVAILABLE_NOTE).select(
        F.format_string("%s unavailable for %s; metrics left as NaN.", "model", "test_set").alias("warning")
    )


def mismatches(preds: DataFrame) -> DataFrame:
    return preds.filter(F.col("pred_label") != F.col("true_label"))


def error_type(pred: Column, family: Column) -> Column:
    return (
        F.when((pred == 1) & family.contains("documentation"), F.lit("false_positive_documentation_example"))
        .when(pred == 1, F.lit("false_positive_keyword_only"))
        .when(family.contains("double"), F.lit("false_negative_double_encoding"))
        .when(family.contains("nested"), F.lit("false_negative_nested_lookup"))
        .otherwise(F.lit("false_negative_unknown_obfuscation"))
    )


def error_analysis(preds: DataFrame) -> DataFrame:
    kind = error_type(F.col("pred_label"), F.col("obfuscation_type"))
    return (
        mismatches(preds)
        .withColumns({"error_type": kind, "explanation": F.lit(ERROR_EXPLANATION)})
        .select(*ERROR_COLUMNS)
    )


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("model", "test_set", "error_type").agg(F.count(F.lit(1)).alias("errors"))


def model_errors(errors: DataFrame) -> DataFrame:
    return errors.groupBy("model").agg(F.count(F.lit(1)).alias("model_error_count"))


def family_rates(preds: DataFrame) -> DataFrame:
    """Share of rows called malicious: recall of malicious families, false-positive rate of benign ones."""
    return preds.groupBy("true_label", "obfuscation_type", "model").agg(
        F.count(F.lit(1)).alias("support"), F.avg("pred_label").alias("rate")
    )


def stats_cells(df: DataFrame) -> DataFrame:
    """Counts by split, label, source and type: what all statistics are sums of, and what can be kept split by split."""
    return df.groupBy("split", "label", "source", "obfuscation_type").agg(F.count(F.lit(1)).alias("n"))


def stats_of_cells(cells: DataFrame) -> DataFrame:
    """Counts by split, by label, by source, by type, and in total."""
    facets = F.array(
        F.struct(F.lit("by_split").alias("statistic"), F.col("split").alias("value")),
        F.struct(F.lit("by_label").alias("statistic"), F.col("label").cast("string").alias("value")),
        F.struct(F.lit("by_source").alias("statistic"), F.col("source").alias("value")),
        F.struct(F.lit("by_obfuscation_type").alias("statistic"), F.col("obfuscation_type").alias("value")),
        F.struct(F.lit("total_rows").alias("statistic"), F.lit("").alias("value")),
    )
    long = cells.select("n", F.explode(facets).alias("_f"))
    return long.groupBy(F.col("_f.statistic").alias("statistic"), F.col("_f.value").alias("value")).agg(
        F.sum("n").alias("rows")
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    """Counts by split, by label, by source, by type, and in total: one pass over the table."""
    # The five groupings are exploded after a first aggregation on the full key, so the explode is small.
    return stats_of_cells(stats_cells(df))


def split_label_matrix(df: DataFrame) -> DataFrame:
    counts = df.groupBy("split").pivot("label", [0, 1]).agg(F.count(F.lit(1))).na.fill(0)
    return counts.select("split", F.col("0").alias("benign"), F.col("1").alias("malicious"))
