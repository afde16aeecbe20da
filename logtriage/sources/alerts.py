"""Alert history and curated samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.schema import ALERT_SCHEMA, SAMPLE_SCHEMA

# Fixed value: advice attached to every alert.
RECOMMENDATION = "Inspect outbound LDAP/RMI/DNS traffic and verify Log4j patch status."


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert lines of either writer; a field the writer lacks is null."""
    return spark.read.schema(ALERT_SCHEMA).json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Curated samples: a JSON array."""
    return spark.read.schema(SAMPLE_SCHEMA).option("multiLine", True).json(path)


def by_group(samples: DataFrame, groups: list[str]) -> DataFrame:
    return samples.filter(F.col("group").isin(groups))


def alert_rows(detected: DataFrame, stamp: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Alert shape of detected rows, after the ``keep`` columns. ``stamp`` defaults to the processing time, UTC."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return detected.select(
        *(keep or []),
        (F.concat(now, F.lit("+00:00")) if stamp is None else stamp).alias("timestamp"),
        "label",
        F.col("score").alias("risk_score"),
        "risk_level",
        "raw_log",
        "normalized_log",
        "detected_patterns",
        F.lit(RECOMMENDATION).alias("recommendation"),
    )
