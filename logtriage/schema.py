"""Table schemas and the presence check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The eleven columns of a labelled log table, in file order.
DATASET_COLUMNS = [
    "id",
    "timestamp",
    "source",
    "raw_log",
    "normalized_log",
    "label",
    "attack_family",
    "obfuscation_type",
    "field",
    "split",
    "risk_level",
]

# The thirteen signals, in feature-vector order.
SIGNAL_KEYS = [
    "has_jndi",
    "has_ldap",
    "has_rmi",
    "has_dns",
    "has_ldaps",
    "has_lookup_syntax",
    "has_nested_lookup",
    "has_url_encoding",
    "has_html_entity",
    "has_unicode_escape",
    "has_lower_upper_lookup",
    "has_env_fallback",
    "has_fragmented_jndi",
]

# The splits an evaluation needs.
REQUIRED_SPLITS = [
    "train",
    "val",
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
TRAINING_SPLITS = ["train", "val"]
EVALUATION_SPLITS = [name for name in REQUIRED_SPLITS if name not in TRAINING_SPLITS]

DATASET_SCHEMA = T.StructType(
    [T.StructField(name, T.IntegerType() if name == "label" else T.StringType()) for name in DATASET_COLUMNS]
)

PACKET_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("frame_time", "ip_src", "method", "host", "uri", "user_agent")]
)

# Both alert writers: the monitor adds ``recommendation``, the demo writer adds ``source``.
ALERT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("raw_log", T.StringType()),
        T.StructField("normalized_log", T.StringType()),
        T.StructField("detected_patterns", T.ArrayType(T.StringType())),
        T.StructField("recommendation", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

SAMPLE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("name", "group", "log", "expected", "story")]
)


def validate_schema(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Return ``df``; raise when a required column is absent. Extra columns pass."""
    missing = [name for name in (required or DATASET_COLUMNS) if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
