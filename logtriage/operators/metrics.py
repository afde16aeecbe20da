"""Binary metrics, ranking metrics and threshold calibration, grouped.

Every metric starts from counts per (group, score), so the scored lines are shuffled once, pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtriage.operators.ordered import running_totals

# The calibration grid and the tolerance of equal F1 scores.
GRID_FROM, GRID_TO, GRID_STEPS = 0.05, 0.95, 180
RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE = 1e-5, 1e-8
SINGLE_CLASS_NOTE = "single-class test set; ROC-AUC and PR-AUC are undefined"


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def confusion(df: DataFrame, group: list[str], threshold: Column | float) -> DataFrame:
    """``tp, fp, tn, fn`` per group; ``label`` is 0/1, ``score`` a double."""
    hit = F.col("score") >= threshold
    positive = F.col("label") == 1

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    return df.groupBy(*group).agg(
        count(hit & positive).alias("tp"),
        count(hit & ~positive).alias("fp"),
        count(~hit & ~positive).alias("tn"),
        count(~hit & positive).alias("fn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Rates over confusion counts; a zero denominator gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    both = (tp + fn > 0) & (tn + fp > 0)
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "fpr": _ratio(fp, fp + tn),
            "fnr": _ratio(fn, fn + tp),
            "positive_support": tp + fn,
            "negative_support": tn + fp,
            "metric_note": F.when(both, F.lit("")).otherwise(F.lit(SINGLE_CLASS_NOTE)),
        }
    )


def confusion_of_counts(counts: DataFrame, group: list[str], threshold: Column | float) -> DataFrame:
    """``confusion`` from the output of :func:`score_counts`."""
    hit = F.col("score") >= threshold

    def total(name: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(name))), F.lit(0))

    return counts.groupBy(*group).agg(
        total("p", hit).alias("tp"), total("n", hit).alias("fp"), total("n", ~hit).alias("tn"), total("p", ~hit).alias("fn")
    )


def binary_metrics(df: DataFrame, group: list[str], threshold: Column | float) -> DataFrame:
    return rates(confusion(df, group, threshold))


def score_counts(df: DataFrame, group: list[str]) -> DataFrame:
    """Positives ``p`` and negatives ``n`` per distinct score."""
    return df.groupBy(*group, "score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") == 0).cast("long")).alias("n")
    )


def cumulative_counts(df: DataFrame, group: list[str]) -> DataFrame:
    """``p, n`` per score with ``cum_p`` (TP) and ``cum_n`` (FP) by descending score; equal scores stay together."""
    return running_totals(score_counts(df, group), group, [F.col("score").desc()], ["p", "n"])


def ranking_metrics(df: DataFrame, group: list[str]) -> DataFrame:
    """``roc_auc`` and ``pr_auc`` per group; null where a class is missing.

    AUC counts ties as half. Average precision is the step form, not an interpolated area.
    """
    return ranking_of_counts(score_counts(df, group), group)


def ranking_of_counts(counts: DataFrame, group: list[str]) -> DataFrame:
    """``ranking_metrics`` from the output of :func:`score_counts`."""
    curve = running_totals(counts, group, [F.col("score").desc()], ["p", "n"])
    # Doubles: products of two large counts overflow a long.
    p, n, tp, fp = (F.col(c).cast("double") for c in ("p", "n", "cum_p", "cum_n"))
    sums = curve.groupBy(*group).agg(
        F.sum(n * (tp - p) + n * p * F.lit(0.5)).alias("_pairs"),
        F.sum(p * (tp / (tp + fp))).alias("_steps"),
        F.sum(p).alias("_p"),
        F.sum(n).alias("_n"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return sums.select(
        *group,
        F.when(both, F.col("_pairs") / F.col("_p") / F.col("_n")).alias("roc_auc"),
        F.when(both, F.col("_steps") / F.col("_p")).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, group: list[str]) -> DataFrame:
    return ranking_metrics(df, group).select(*group, "roc_auc")


def average_precision(df: DataFrame, group: list[str]) -> DataFrame:
    return ranking_metrics(df, group).select(*group, "pr_auc")


def grid_threshold(index: Column) -> Column:
    """Threshold ``index`` of the calibration grid."""
    step = (GRID_TO - GRID_FROM) / GRID_STEPS
    return F.lit(GRID_FROM) + index * F.lit(step)


def grid_index(score: Column) -> Column:
    """Highest grid index whose threshold does not exceed the score; -1 below the grid."""
    guess = F.floor((score - GRID_FROM) / ((GRID_TO - GRID_FROM) / GRID_STEPS)).cast("int")
    low = F.greatest(F.least(guess, F.lit(GRID_STEPS)) - 1, F.lit(-1))
    # The division can be off by one; the two neighbours decide with the exact thresholds.
    for _ in range(2):
        up = F.least(low + 1, F.lit(GRID_STEPS))
        low = F.when((up > low) & (grid_threshold(up) <= score), up).otherwise(low)
    return low


def threshold_sweep(df: DataFrame, group: list[str]) -> DataFrame:
    """F1 at each of the 181 grid thresholds, per group.

    Each line falls into one of 182 score bins, so one aggregation replaces a comparison of every line with
    every threshold. What follows has at most 182 rows per group.
    """
    binned = df.withColumn("_bin", grid_index(F.col("score")))
    positive = F.col("label") == 1
    bins = binned.groupBy(*group, "_bin").agg(
        F.sum(positive.cast("long")).alias("_p"), F.sum((~positive).cast("long")).alias("_n")
    )
    totals = bins.groupBy(*group).agg(F.sum("_p").alias("_all"))
    empty = totals.select(
        *group,
        F.explode(F.sequence(F.lit(-1), F.lit(GRID_STEPS))).alias("_bin"),
        F.lit(0).cast("long").alias("_p"),
        F.lit(0).cast("long").alias("_n"),
    )
    full = bins.unionByName(empty).groupBy(*group, "_bin").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    above = Window.partitionBy(*group).orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    swept = full.withColumns(
        {"_tp": F.sum("_p").over(above), "_fp": F.sum("_n").over(above), "_all": F.sum("_p").over(whole)}
    ).filter(F.col("_bin") >= 0)
    f1 = _ratio(2 * F.col("_tp"), F.col("_tp") + F.col("_fp") + F.col("_all"))
    return swept.select(*group, grid_threshold(F.col("_bin")).alias("threshold"), f1.alias("f1"))


def nearest(df: DataFrame, group: list[str], preferred: Column | float) -> DataFrame:
    """Threshold nearest to the preferred one, the lower one on a tie."""
    distance = F.struct(F.abs(F.col("threshold") - preferred), F.col("threshold"))
    return df.groupBy(*group).agg(F.min_by("threshold", distance).alias("threshold"), F.max("f1").alias("best_f1"))


def calibrate(df: DataFrame, group: list[str], preferred: Column | float = 0.50) -> DataFrame:
    """Per group the grid threshold of best F1, ties resolved towards ``preferred``."""
    swept = threshold_sweep(df, group)
    best = F.max("f1").over(Window.partitionBy(*group))
    close = F.abs(F.col("f1") - F.col("_best")) <= ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * F.abs(F.col("_best"))
    return nearest(swept.withColumn("_best", best).filter(close), group, preferred)


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight of each class: n / (2 * n_class)."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    # Two rows at most.
    total = F.sum("rows").over(Window.partitionBy())
    return counts.withColumn("class_weight", total / (2 * F.col("rows")))


def with_class_weight(df: DataFrame) -> DataFrame:
    """Attach the class weight to each row, as two scalar subqueries rather than a join.

    A row with a column ``rows`` stands for that many lines and weighs as much as all of them.
    """
    rows = F.col("rows") if "rows" in df.columns else F.lit(1)
    positives = df.agg(F.sum((F.col("label") == 1).cast("long") * rows).alias("v")).select("v").scalar()
    total = df.agg(F.sum(rows).alias("v")).select("v").scalar()
    size = F.when(F.col("label") == 1, positives).otherwise(total - positives)
    return df.withColumn("class_weight", total / (2 * size) * rows)
