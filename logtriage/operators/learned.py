"""Learned detectors: character n-gram models on Spark ML.

Whole texts are hashed into n-gram counts, whatever their length; the model is a weighted logistic
regression. Variants: ``raw`` text, ``normalized`` text, and ``signal`` (normalized text plus signals).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.operators.canonical import canonicalize
from logtriage.operators.detect import DEFAULT_THRESHOLDS
from logtriage.operators.features import signal_vector
from logtriage.operators.metrics import with_class_weight
from logtriage.schema import SIGNAL_KEYS

VARIANTS = {"raw": "raw_log", "normalized": "normalized_log", "signal": "normalized_log"}
GRAM_SIZES = (2, 3, 4)
HASH_BITS = 16


@dataclass(frozen=True)
class Trained:
    variant: str
    model: PipelineModel
    reg_param: float
    validation_loss: float | None


def feature_table(df: DataFrame) -> DataFrame:
    """Canonical text, signals and the signal vector: shared by all variants."""
    return signal_vector(df if "signals" in df.columns else canonicalize(df))


def pipeline(variant: str, reg_param: float = 1e-4, max_iter: int = 30) -> Pipeline:
    column = VARIANTS[variant]
    chars = RegexTokenizer(
        inputCol=column, outputCol="_chars", pattern="(?s).", gaps=False, toLowercase=False, minTokenLength=1
    )
    grams = [NGram(n=n, inputCol="_chars", outputCol=f"_grams{n}") for n in GRAM_SIZES]
    # One hashed bag of terms: assembling vectors would name every one of the hashed features in the schema.
    # The signals that are set join the bag as thirteen more binary features.
    bags = [f"_grams{n}" for n in GRAM_SIZES]
    if variant == "signal":
        bags.append("transform(detected_patterns, p -> concat('signal ', p))")
    together = SQLTransformer(statement=f"SELECT *, concat({', '.join(bags)}) AS _terms FROM __THIS__")
    hashed = HashingTF(inputCol="_terms", outputCol="_features", numFeatures=1 << HASH_BITS)
    regression = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="class_weight", regParam=reg_param, maxIter=max_iter
    )
    return Pipeline(stages=[chars, *grams, together, hashed, regression])


def train(df: DataFrame, variant: str, reg_param: float = 1e-4, max_iter: int = 30) -> PipelineModel:
    """Fit one variant on a labelled feature table with balanced class weights."""
    return pipeline(variant, reg_param, max_iter).fit(with_class_weight(df))


def _without_summary(model: PipelineModel) -> PipelineModel:
    """A copy that tasks can be sent: the summary of the training holds the session, which is not sent once it has observed a query."""
    *others, last = model.stages
    if not last.hasSummary:
        return model
    bare = last.copy()
    bare._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return PipelineModel([*others, bare])


def score(df: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    """Add the probability of the malicious class as ``name``."""
    scored = _without_summary(model).transform(df)
    return scored.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def log_loss(scored: DataFrame, name: str) -> float:
    p = F.greatest(F.least(F.col(name), F.lit(1 - 1e-7)), F.lit(1e-7))
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    return scored.agg(F.avg(loss)).first()[0]


def select_model(
    train_df: DataFrame, val_df: DataFrame, variant: str, grid: tuple[float, ...] = (1e-4, 1e-2), max_iter: int = 30
) -> Trained:
    """Fit each regularization of the grid and keep the one with the least loss on the fixed validation split."""
    best: Trained | None = None
    for reg_param in grid:
        model = train(train_df, variant, reg_param, max_iter)
        loss = log_loss(score(val_df, model, "_p"), "_p")
        if best is None or loss < best.validation_loss:
            best = Trained(variant, model, reg_param, loss)
    return best


def train_all(df: DataFrame, variants: list[str] | None = None, max_iter: int = 30) -> dict[str, PipelineModel]:
    """All variants on one feature table, read once and cached for the iterations."""
    table = feature_table(df).cache()
    try:
        return {variant: train(table, variant, max_iter=max_iter) for variant in variants or list(VARIANTS)}
    finally:
        table.unpersist()


def score_all(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    table = feature_table(df)
    for variant, model in models.items():
        table = score(table, model, f"score_{variant}")
    return table


def training_history(spark: SparkSession, model: PipelineModel, variant: str) -> DataFrame:
    """Objective value per iteration."""
    values = list(model.stages[-1].summary.objectiveHistory)
    rows = [(variant, number, float(v)) for number, v in enumerate(values)]
    return spark.createDataFrame(rows, "model string, iteration int, objective double")


def save_model(model: PipelineModel, vocab: DataFrame | None, path: str) -> None:
    """Persist a fitted pipeline, and the character vocabulary next to it."""
    model.write().overwrite().save(f"{path}/pipeline")
    if vocab is not None:
        vocab.write.mode("overwrite").parquet(f"{path}/vocab")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/pipeline")


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vocab")


def runtime_info(
    spark: SparkSession,
    models: list[str],
    model_name: str = "raw",
    thresholds: dict[str, float] | None = None,
    vocab_loaded: bool = False,
) -> DataFrame:
    """One row: loaded models, signal keys, thresholds and the detector that answers."""
    row = (
        sorted(models),
        vocab_loaded,
        SIGNAL_KEYS,
        {**DEFAULT_THRESHOLDS, **(thresholds or {})},
        model_name if models else "signature",
    )
    schema = (
        "loaded_models array<string>, tokenizer_loaded boolean, signal_keys array<string>, "
        "thresholds map<string,double>, fallback string"
    )
    return spark.createDataFrame([row], schema)
