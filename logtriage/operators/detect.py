"""Line detection: signature score, learned scores, bands and explanation. No shuffle, no Python."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtriage.functions import signature as G
from logtriage.operators.canonical import (
    _RAW,
    drop_internal,
    flat_signals,
    hold,
    label_columns,
    with_signals,
)
from logtriage.functions.text import contains
from logtriage.schema import SIGNAL_KEYS
from logtriage.session import built_once

# Detector keys, display names, and thresholds used where a configuration names none.
DISPLAY_NAMES = {
    "signature": "Signature",
    "raw": "Raw density",
    "normalized": "Canonical density",
    "signal": "Signal share",
}
DEFAULT_THRESHOLDS = {"signature": 0.70, "raw": 0.50, "normalized": 0.50, "signal": 0.50}


def literal_map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


@built_once
def _match_step() -> Column:
    raw_flags = G.pattern_flags(F.col(_RAW), G.RAW_PATTERNS)
    norm_flags = G.pattern_flags(F.col("normalized_log"), G.NORMALIZED_PATTERNS)
    listed = G.listed(G.RAW_PATTERNS, raw_flags) + G.listed(G.NORMALIZED_PATTERNS, norm_flags)
    # Every pattern needs an opener, a scheme separator or an encoded opener, so most lines skip all ten.
    markers = [(_RAW, "${"), (_RAW, "%2"), (_RAW, "://"), ("normalized_log", "${"), ("normalized_log", "://")]
    possible = reduce(or_, [contains(F.col(name), marker) for name, marker in markers])
    none = F.array().cast("array<string>")
    return F.when(possible, F.array_compact(F.array(*listed))).otherwise(none)


@built_once
def _score_step() -> Column:
    return G.signature_score(F.size("matched_patterns") > 0, flat_signals(), F.col(_RAW))


def with_signature(df: DataFrame, col: str = "raw_log") -> DataFrame:
    """Flat signals plus ``matched_patterns`` and ``sig_score``; keeps the internal columns."""
    df = with_signals(df, col).withColumn("matched_patterns", _match_step()).withColumn("sig_score", _score_step())
    return hold(df, ["matched_patterns", "sig_score"])


def signature(df: DataFrame, col: str = "raw_log", threshold: float = G.SIGNATURE_THRESHOLD) -> DataFrame:
    """Signature result: ``sig_label``, ``sig_score``, ``matched_patterns``, ``normalized_log``."""
    out = with_signature(df, col).withColumn("sig_label", G.signature_label(F.col("sig_score"), threshold))
    return drop_internal(out).drop(*SIGNAL_KEYS)


def score_map(scores: dict[str, Column]) -> Column:
    """Available scores by detector, rounded to six digits; a null score leaves no entry."""
    built = F.create_map(*[part for key, c in scores.items() for part in (F.lit(key), F.round(c, 6))])
    return built if len(scores) == 1 else F.map_filter(built, lambda _, v: v.isNotNull())


def final_score(scores: dict[str, Column], model: str) -> Column:
    """Score of the asked detector; else the raw-text detector; else the signature."""
    if model == "signature":
        return scores["signature"]
    preferred = [scores[key] for key in (model, "raw") if key in scores]
    return F.coalesce(*preferred, scores["signature"])


def detect(df: DataFrame, col: str = "raw_log", model: str = "signature", learned: dict[str, str] | None = None) -> DataFrame:
    """Classify one text column.

    ``learned`` names columns that already hold learned scores (``{'raw': 'score_raw'}``); they enter the score
    map and can be the final score. ``latency_ms`` is null: a batch has no per-line latency.
    """
    out = with_signature(df, col).withColumns(label_columns())
    scores = {"signature": F.col("sig_score"), **{key: F.col(name) for key, name in (learned or {}).items()}}
    chosen = final_score(scores, model)
    out = out.withColumns(
        {
            "score": F.round(chosen, 6),
            "label": G.label_from_score(chosen),
            "risk_level": G.risk_level(chosen),
            "model_scores": score_map(scores),
            "latency_ms": F.lit(None).cast("double"),
        }
    )
    out = out.withColumn("explanation", G.explanation(F.col("detected_patterns"), F.col("label")))
    return drop_internal(out).drop("matched_patterns", "sig_score", *SIGNAL_KEYS)


def alerts(df: DataFrame) -> DataFrame:
    """Suspicious and critical rows."""
    return df.filter(F.col("risk_level").isin("suspicious", "critical"))


def model_threshold(model: Column, thresholds: dict[str, float] | None = None) -> Column:
    """Configured threshold, else the default of the detector, else 0.5."""
    known = literal_map({**DEFAULT_THRESHOLDS, **(thresholds or {})})
    return F.coalesce(F.try_element_at(known, model), F.lit(G.LEARNED_THRESHOLD))


def score_table(detected: DataFrame, keys: list[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row per line and detector: score, threshold, decision and role."""
    long = detected.select(*keys, F.explode("model_scores").alias("model", "model_score"))
    long = long.withColumn("threshold", model_threshold(F.col("model"), thresholds))
    return long.select(
        *keys,
        "model",
        F.coalesce(F.try_element_at(literal_map(DISPLAY_NAMES), F.col("model")), F.col("model")).alias("detector"),
        F.col("model_score").alias("score"),
        "threshold",
        F.when(F.col("model_score") >= F.col("threshold"), F.lit("malicious"))
        .otherwise(F.lit("benign"))
        .alias("decision"),
        F.when(F.col("model") == "raw", F.lit("final detector")).otherwise(F.lit("comparison signal")).alias("role"),
    )


def scan_samples(samples: DataFrame, model: str = "signature") -> DataFrame:
    """Curated samples with expected and found label."""
    return detect(samples, "log", model).select(
        F.col("name").alias("sample"),
        "group",
        "expected",
        "label",
        "risk_level",
        "score",
        "latency_ms",
        F.concat_ws(", ", "detected_patterns").alias("patterns"),
        "log",
    )
