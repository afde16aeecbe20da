"""The thirteen signals, the pattern list and the obfuscation label.

``n`` is canonical text, ``raw`` the input line. Where a test on the lower-cased raw line only
involves letters that no other character folds to, the raw line is matched case-insensitively instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtriage.functions.html import has_reference
from logtriage.functions.text import WS, contains
from logtriage.schema import SIGNAL_KEYS


def has_jndi(n: Column) -> Column:
    return contains(n, "j") & n.rlike(rf"j{WS}*[^a-z0-9]?{WS}*n{WS}*[^a-z0-9]?{WS}*d{WS}*[^a-z0-9]?{WS}*i")


def _protocol(n: Column, name: str) -> Column:
    return contains(n, f"{name}://")


def has_ldap(n: Column) -> Column:
    return _protocol(n, "ldap")


def has_rmi(n: Column) -> Column:
    return _protocol(n, "rmi")


def has_dns(n: Column) -> Column:
    return _protocol(n, "dns")


def has_ldaps(n: Column) -> Column:
    return _protocol(n, "ldaps")


def has_lookup_syntax(n: Column, raw: Column) -> Column:
    return contains(n, "${") | contains(raw, "${")


def has_nested_lookup(raw: Column) -> Column:
    """More than one opener."""
    return contains(raw, "${") & raw.rlike(r"(?s)\$\{.*\$\{")


def has_url_encoding(raw: Column, passes: Column) -> Column:
    """``passes`` alone decides: each literal marker (%25, %24, ...) is a valid escape, so it costs a pass."""
    return passes > 0


def has_html_entity(raw: Column) -> Column:
    return has_reference(raw)


def has_unicode_escape(raw: Column) -> Column:
    return contains(raw, "\\u") & raw.rlike(r"\\u[0-9a-fA-F]{4}")


def has_lower_upper_lookup(raw: Column) -> Column:
    return contains(raw, "${") & raw.rlike(rf"(?i)\$\{{{WS}*(?:lower|upper){WS}*:")


def has_env_fallback(raw: Column) -> Column:
    return contains(raw, ":-") | (contains(raw, "${") & raw.rlike(r"(?i)\$\{env:"))


def has_fragmented_jndi(raw: Column, n: Column) -> Column:
    in_raw = contains(raw, "${::-") & raw.rlike(r"(?i)\$\{::-[jndi]\}")
    return in_raw | (contains(n, "j") & n.rlike(r"j[^a-z0-9]+n[^a-z0-9]+d[^a-z0-9]+i"))


def signal_columns(n: Column, raw: Column, passes: Column) -> dict[str, Column]:
    """All signals by key, in feature order."""
    values = [
        has_jndi(n),
        has_ldap(n),
        has_rmi(n),
        has_dns(n),
        has_ldaps(n),
        has_lookup_syntax(n, raw),
        has_nested_lookup(raw),
        has_url_encoding(raw, passes),
        has_html_entity(raw),
        has_unicode_escape(raw),
        has_lower_upper_lookup(raw),
        has_env_fallback(raw),
        has_fragmented_jndi(raw, n),
    ]
    return dict(zip(SIGNAL_KEYS, values, strict=True))


def detected_patterns(signals: dict[str, Column]) -> Column:
    """Names of the signals that are set, without their prefix, in feature order."""
    names = [F.when(flag, F.lit(key.removeprefix("has_"))) for key, flag in signals.items()]
    return F.array_compact(F.array(*names))


def obfuscation_type(signals: dict[str, Column], raw: Column, passes: Column) -> Column:
    url = F.when((passes > 1) | contains(raw, "%25"), F.lit("double_url_encoded")).otherwise(F.lit("url_encoded"))
    parts = F.concat_ws(
        "_",
        F.when(signals["has_url_encoding"], url),
        F.when(signals["has_unicode_escape"], F.lit("unicode_escape")),
        F.when(signals["has_html_entity"], F.lit("html_entity")),
        F.when(signals["has_nested_lookup"], F.lit("nested_lookup")),
        F.when(signals["has_lower_upper_lookup"], F.lit("lower_upper_lookup")),
        F.when(signals["has_env_fallback"], F.lit("env_fallback")),
        F.when(signals["has_fragmented_jndi"], F.lit("fragmented_tokens")),
    )
    hidden = (
        signals["has_url_encoding"]
        | signals["has_unicode_escape"]
        | signals["has_html_entity"]
        | signals["has_nested_lookup"]
        | signals["has_lower_upper_lookup"]
        | signals["has_env_fallback"]
        | signals["has_fragmented_jndi"]
    )
    return (
        F.when(hidden, parts).when(signals["has_jndi"], F.lit("plain")).otherwise(F.lit("none"))
    )
