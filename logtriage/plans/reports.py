"""Report tables over the comparison, prediction, error and alert tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtriage.operators.detect import literal_map
from logtriage.schema import TRAINING_SPLITS

SIGNATURE, RAW, NORMALIZED, SIGNAL = "Signature", "Raw density", "Canonical density", "Signal share"

# Experiments, split names and orders of the reports.
EXPERIMENTS = [
    ("Raw text model", "Baseline text model on unnormalized logs", RAW),
    ("Normalized text model", "Tests canonicalization value", NORMALIZED),
    ("Normalized text + canonical signal", "Tests explicit signal features", SIGNAL),
    ("Signature only", "Signature-based comparison", SIGNATURE),
]
EXPECTED_RESULT = "Improves robustness or exposes a weakness under fair split evaluation."
CHALLENGE_SPLITS = {
    "test": "Standard held-out",
    "adversarial_evasion_test": "Adversarial evasion",
    "hard_negative_test": "Hard negatives",
    "blind_manual_test": "Manual blind",
    "ood_stress_test": "Frozen OOD stress",
}
CHALLENGE_MODELS = [SIGNATURE, RAW]
HEATMAP_MODELS = [SIGNATURE, RAW, NORMALIZED, SIGNAL]
HEATMAP_SPLITS = [
    "test",
    "unseen_obfuscation_test",
    "adversarial_evasion_test",
    "hard_negative_test",
    "external_greedybear_test",
    "external_splunk_test",
    "external_foxit_pcap_test",
    "external_benign_web_test",
    "blind_manual_test",
    "ood_stress_test",
]


def rank_in(values: list[str], key: Column) -> Column:
    """Place of a key in a fixed order, from 0; null when absent."""
    return F.try_element_at(literal_map({v: i for i, v in enumerate(values)}), key)


def with_dim(df: DataFrame, values: dict[str, object], key: str, name: str) -> DataFrame:
    """Look a small literal dimension up by key."""
    return df.withColumn(name, F.try_element_at(literal_map(values), F.col(key)))


def subset(df: DataFrame, test_sets: list[str], models: list[str], required: list[str] | None = None) -> DataFrame:
    rows = df.filter(F.col("test_set").isin(test_sets) & F.col("model").isin(models))
    return rows.na.drop(subset=required) if required else rows


def metric_value(comparison: DataFrame, model: str, test_set: str, metric: str) -> DataFrame:
    return comparison.filter((F.col("model") == model) & (F.col("test_set") == test_set)).select(
        "model", "test_set", F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value")
    )


def ablation(comparison: DataFrame, errors: DataFrame) -> DataFrame:
    """Experiments with the metrics of six splits and their error count."""
    per_model = comparison.groupBy("model").agg(
        *[
            F.max(F.when(F.col("test_set") == split, F.col(metric))).alias(name)
            for split, metric, name in [
                ("test", "f1", "test_f1"),
                ("unseen_obfuscation_test", "f1", "unseen_f1"),
                ("adversarial_evasion_test", "f1", "adversarial_evasion_f1"),
                ("ood_stress_test", "f1", "ood_stress_f1"),
                ("ood_stress_test", "recall", "ood_stress_recall"),
                ("ood_stress_test", "fpr", "ood_stress_fpr"),
                ("blind_manual_test", "f1", "blind_manual_f1"),
                ("hard_negative_test", "fpr", "hard_negative_fpr"),
                ("test", "threshold", "threshold"),
            ]
        ]
    )
    counts = errors.groupBy("model").agg(F.count(F.lit(1)).alias("_errors"))
    experiments = comparison.sparkSession.createDataFrame(
        EXPERIMENTS, "experiment string, purpose string, model string"
    )
    return (
        experiments.join(per_model, "model", "left")
        .join(counts, "model", "left")
        .withColumns(
            {
                "model_error_count": F.coalesce("_errors", F.lit(0)),
                "expected_result": F.lit(EXPECTED_RESULT),
            }
        )
        .drop("_errors")
    )


def family_recall(preds: DataFrame, test_set: str, models: list[str]) -> DataFrame:
    """Malicious families of one split: support, and misses and recall per model.

    Support and misses come from one aggregation over the predictions.
    """
    rows = preds.filter((F.col("test_set") == test_set) & (F.col("true_label") == 1) & F.col("model").isin(models))
    table = rows.groupBy("obfuscation_type", "model").agg(
        F.count(F.lit(1)).alias("support"), F.sum((F.col("pred_label") == 0).cast("long")).alias("misses")
    )
    return table.withColumns(
        {
            "missed": F.concat(F.col("misses").cast("string"), F.lit("/"), F.col("support").cast("string")),
            "recall": (F.col("support") - F.col("misses")) / F.col("support"),
        }
    )


def family_recall_joined(dataset: DataFrame, errors: DataFrame, test_set: str, models: list[str]) -> DataFrame:
    """The same from a dataset table and an error table, as a left join on (type, model)."""
    support = (
        dataset.filter((F.col("split") == test_set) & (F.col("label") == 1))
        .groupBy("obfuscation_type")
        .agg(F.count(F.lit(1)).alias("support"))
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    )
    missed = (
        errors.filter((F.col("test_set") == test_set) & (F.col("true_label") == 1) & (F.col("pred_label") == 0))
        .groupBy("obfuscation_type", "model")
        .agg(F.count(F.lit(1)).alias("_misses"))
    )
    table = support.join(missed, ["obfuscation_type", "model"], "left").withColumn(
        "misses", F.coalesce("_misses", F.lit(0))
    )
    return table.withColumns(
        {
            "missed": F.concat(F.col("misses").cast("string"), F.lit("/"), F.col("support").cast("string")),
            "recall": (F.col("support") - F.col("misses")) / F.col("support"),
        }
    ).drop("_misses")


def missed_families(rates: DataFrame) -> DataFrame:
    """Per model: families with at least one miss, and the number of misses."""
    return rates.filter(F.col("misses") > 0).groupBy("model").agg(
        F.concat_ws(", ", F.array_sort(F.collect_set("obfuscation_type"))).alias("missed_families"),
        F.sum("misses").alias("missed_rows"),
    )


def overview_kpis(dataset: DataFrame, comparison: DataFrame) -> DataFrame:
    """Dataset rows, evaluation rows, model variants, test splits."""
    held_out = (~F.col("split").isin(TRAINING_SPLITS)).cast("long")
    rows = dataset.agg(F.count(F.lit(1)).alias("dataset_rows"), F.sum(held_out).alias("evaluation_rows"))
    models = comparison.agg(F.countDistinct("model").alias("n")).select("n").scalar()
    splits = comparison.agg(F.countDistinct("test_set").alias("n")).select("n").scalar()
    return rows.withColumns({"model_variants": models, "test_splits": splits})


def alert_kpis(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("stored_alerts"), F.count_if(F.col("risk_level") == "critical").alias("critical_alerts")
    )


def top_families(dataset: DataFrame, k: int = 14) -> DataFrame:
    counts = dataset.groupBy("obfuscation_type").agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.col("rows").desc(), "obfuscation_type").limit(k)


def split_counts(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).orderBy("split")


def model_ranking(comparison: DataFrame, metric: str = "f1", test_set: str = "test") -> DataFrame:
    """Models of one split by metric, ascending."""
    rows = comparison.filter(F.col("test_set") == test_set).na.drop(subset=[metric])
    return rows.select("model", metric).orderBy(metric, "model")


def split_order(comparison: DataFrame, fixed: list[str] = HEATMAP_SPLITS) -> DataFrame:
    """Splits in report order: the fixed ones first, then any others by name."""
    present = comparison.select("test_set").distinct()
    place = F.coalesce(rank_in(fixed, F.col("test_set")), F.lit(len(fixed)))
    return present.withColumn("place", place).orderBy("place", "test_set")


def other_splits(comparison: DataFrame, fixed: list[str] = HEATMAP_SPLITS) -> DataFrame:
    return comparison.select("test_set").distinct().filter(~F.col("test_set").isin(fixed))


def f1_heatmap(comparison: DataFrame) -> DataFrame:
    """F1 by split and model, zero where missing, in report order."""
    known = comparison.filter(F.col("test_set").isin(HEATMAP_SPLITS))
    grid = known.groupBy("test_set").pivot("model", HEATMAP_MODELS).agg(F.first("f1")).na.fill(0.0)
    return grid.withColumn("place", rank_in(HEATMAP_SPLITS, F.col("test_set"))).orderBy("place")


def evasion_pivot(comparison: DataFrame) -> DataFrame:
    """Recall on the standard and the evasion split."""
    rows = subset(
        comparison, ["test", "adversarial_evasion_test"], [SIGNATURE, RAW, NORMALIZED], required=["recall"]
    )
    grid = rows.groupBy("model").pivot("test_set", ["test", "adversarial_evasion_test"]).agg(F.first("recall"))
    return grid.select(
        "model",
        F.col("test").alias("standard_test"),
        F.col("adversarial_evasion_test").alias("adversarial_evasion"),
    )


def evasion_duel(comparison: DataFrame) -> DataFrame:
    """F1 and missed payloads of two models on the evasion split."""
    rows = subset(comparison, ["adversarial_evasion_test"], CHALLENGE_MODELS)
    total = F.col("tp") + F.col("fn")
    missed = F.concat(F.col("fn").cast("string"), F.lit("/"), total.cast("string"))
    return rows.select("model", "f1", missed.alias("missed"))


def ood_view(comparison: DataFrame) -> DataFrame:
    rows = subset(comparison, ["ood_stress_test"], [SIGNATURE, RAW, NORMALIZED], required=["recall", "fpr"])
    return rows.select("model", F.col("recall").alias("malicious_recall"), F.col("fpr").alias("benign_fpr"))


def challenge_summary(comparison: DataFrame) -> DataFrame:
    """Five splits by two models in report order."""
    rows = subset(comparison, list(CHALLENGE_SPLITS), CHALLENGE_MODELS)
    rows = with_dim(rows, CHALLENGE_SPLITS, "test_set", "split_name")
    rows = rows.withColumns(
        {
            "split_place": rank_in(list(CHALLENGE_SPLITS), F.col("test_set")),
            "model_place": rank_in(CHALLENGE_MODELS, F.col("model")),
        }
    )
    kept = ["f1", "recall", "precision", "fpr", "tp", "tn", "fp", "fn"]
    return rows.select("split_name", "model", "split_place", "model_place", *kept).orderBy("split_place", "model_place")
