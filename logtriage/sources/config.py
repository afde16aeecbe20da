"""Threshold configuration."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.functions.signature import MALICIOUS_FROM, SUSPICIOUS_FROM
from logtriage.operators.detect import DEFAULT_THRESHOLDS, literal_map

_MAP = "map<string,double>"
_NESTED = f"binary_thresholds {_MAP}, calibrated_thresholds {_MAP}, risk_bands {_MAP}"
_REST = "validation_metrics map<string,map<string,double>>, generated_at string, notes map<string,string>"
CONFIG_COLUMNS = [
    "binary_thresholds",
    "calibrated_thresholds",
    "risk_bands",
    "validation_metrics",
    "generated_at",
    "notes",
]


def _defaults() -> Column:
    return literal_map(DEFAULT_THRESHOLDS)


def _bands() -> Column:
    return literal_map(
        {
            "benign_max_exclusive": SUSPICIOUS_FROM,
            "suspicious_min": SUSPICIOUS_FROM,
            "malicious_min": MALICIOUS_FROM,
        }
    )


def _over_defaults(loaded: Column) -> Column:
    kept = F.map_filter(_defaults(), lambda k, _: ~F.array_contains(F.map_keys(loaded), k))
    return F.map_concat(kept, loaded)


def default_config(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        _defaults().alias("binary_thresholds"),
        _defaults().alias("calibrated_thresholds"),
        _bands().alias("risk_bands"),
        F.create_map().cast("map<string,map<string,double>>").alias("validation_metrics"),
        F.lit(None).cast("string").alias("generated_at"),
        F.create_map().cast("map<string,string>").alias("notes"),
    )


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """One row of configuration. The flat form ``{model: threshold}`` is upgraded; defaults fill the rest.

    A missing file gives the defaults; any other failure, malformed JSON included, is raised.
    """
    try:
        text = spark.read.text(path, wholetext=True).select("value")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return default_config(spark)
    return upgrade(text)


def upgrade(text: DataFrame) -> DataFrame:
    """Configuration columns from JSON text in ``value``, nested or flat."""
    parsed = text.select(
        F.from_json("value", f"{_NESTED}, {_REST}").alias("c"), F.from_json("value", _MAP).alias("flat")
    )
    nested = F.col("c.binary_thresholds").isNotNull()
    broken = F.raise_error(F.lit("thresholds are neither nested nor flat JSON")).cast(_MAP)
    flat = F.when(F.col("flat").isNull(), broken).otherwise(_over_defaults(F.col("flat")))
    none = F.create_map().cast(_MAP)
    return parsed.select(
        F.when(nested, F.col("c.binary_thresholds")).otherwise(flat).alias("binary_thresholds"),
        F.when(nested, F.coalesce("c.calibrated_thresholds", none)).otherwise(flat).alias("calibrated_thresholds"),
        F.coalesce("c.risk_bands", _bands()).alias("risk_bands"),
        F.coalesce("c.validation_metrics", F.create_map().cast("map<string,map<string,double>>")).alias(
            "validation_metrics"
        ),
        F.col("c.generated_at").alias("generated_at"),
        F.coalesce("c.notes", F.create_map().cast("map<string,string>")).alias("notes"),
    )


def threshold_table(config: DataFrame) -> DataFrame:
    """``(model, threshold)`` rows of the binary thresholds."""
    return config.select(F.explode("binary_thresholds").alias("model", "threshold"))


def load_thresholds(config: DataFrame) -> dict[str, float]:
    """The binary thresholds as a plain dictionary: one small row."""
    return dict(config.select("binary_thresholds").first()[0])


def config_from_calibration(calibrated: DataFrame, metrics: DataFrame | None, generated_at: str) -> DataFrame:
    """Configuration row from ``calibrate`` output (``model, threshold``) and optional metric rows per model."""
    chosen = calibrated.agg(F.map_from_entries(F.collect_list(F.struct("model", "threshold"))).alias("_m"))
    notes = {"selection": "Thresholds maximize validation F1 with ties resolved toward the model default."}
    row = chosen.select(
        _over_defaults(F.col("_m")).alias("binary_thresholds"),
        F.col("_m").alias("calibrated_thresholds"),
        _bands().alias("risk_bands"),
        F.lit(generated_at).alias("generated_at"),
        literal_map(notes).alias("notes"),
    )
    if metrics is None:
        return row.withColumn(
            "validation_metrics", F.create_map().cast("map<string,map<string,double>>")
        ).select(*CONFIG_COLUMNS)
    names = [c for c, t in metrics.dtypes if c != "model" and t in ("double", "bigint", "int")]
    entry = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    measured = metrics.agg(F.map_from_entries(F.collect_list(F.struct("model", entry))).alias("_v"))
    return row.withColumn("validation_metrics", measured.select("_v").scalar()).select(*CONFIG_COLUMNS)


def write_thresholds(config: DataFrame, path: str) -> None:
    config.select(F.to_json(F.struct(*CONFIG_COLUMNS)).alias("value")).write.mode("overwrite").text(path)
