"""Signature matching, scoring, bands and explanation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtriage.functions.text import WS, bind, contains, is_ascii

# The seven raw-text and three canonical-text signatures, case-insensitive. The text is what is
# reported as matched; each comes with a literal that every match holds, used as a cheap guard.
RAW_PATTERNS = [
    (r"\$\{\s*j\s*n\s*d\s*i\s*:", "${"),
    (r"jndi\s*:\s*(ldap|rmi|dns|ldaps)\s*://", "://"),
    (r"%24%7b", "%24%7"),
    (r"%2524%257b", "%2524%257"),
    (r"\$\{\s*(lower|upper)\s*:", "${"),
    (r"\$\{\s*env\s*:[^{}]*:-", "${"),
    (r"\$\{::-[jndi]\}", "${::-"),
]
NORMALIZED_PATTERNS = [
    (r"\$\{\s*jndi\s*:\s*(ldap|rmi|dns|ldaps)\s*://", "://"),
    (r"jndi\s*:\s*(ldap|rmi|dns|ldaps)\s*://", "://"),
    (r"\$\{\s*jndi\s*:", "${"),
]
# Fixed value: wording that marks a payload as quoted material.
HARD_NEGATIVE_CONTEXT = (
    r"\\\$\{|escaped payload|as text|documentation page|blog article"
    r"|security scanner report mentions|user searched|developer opened"
)

# Scores, decision threshold and bands.
SCORE_PROTOCOL = 0.95
SCORE_MATCH = 0.75
SCORE_HINT = 0.45
CONTEXT_CAP = 0.30
SIGNATURE_THRESHOLD = 0.70
LEARNED_THRESHOLD = 0.50
SUSPICIOUS_FROM = 0.35
MALICIOUS_FROM = 0.70

PROTOCOL_SIGNALS = ["has_ldap", "has_rmi", "has_dns", "has_ldaps"]


def java_pattern(pattern: str) -> str:
    """The same pattern for the JVM: full Unicode whitespace and case folding."""
    return "(?iu)" + pattern.replace(r"\s", WS)


def pattern_flags(c: Column, patterns: list[tuple[str, str]]) -> list[Column]:
    return [contains(c, literal) & c.rlike(java_pattern(pattern)) for pattern, literal in patterns]


def listed(patterns: list[tuple[str, str]], flags: list[Column]) -> list[Column]:
    return [F.when(flag, F.lit(pattern)) for (pattern, _), flag in zip(patterns, flags, strict=True)]


def raw_matches(c: Column) -> Column:
    return F.array_compact(F.array(*listed(RAW_PATTERNS, pattern_flags(c, RAW_PATTERNS))))


def norm_matches(c: Column) -> Column:
    return F.array_compact(F.array(*listed(NORMALIZED_PATTERNS, pattern_flags(c, NORMALIZED_PATTERNS))))


def hard_negative_context(c: Column) -> Column:
    """Plain substring tests on ASCII text; other text needs the pattern's Unicode case folding."""
    phrases = HARD_NEGATIVE_CONTEXT.replace("\\", "").split("|")
    phrases[0] = "\\${"
    lowered = bind(F.lower(c), lambda t: reduce(or_, [contains(t, phrase) for phrase in phrases]))
    return F.when(is_ascii(c), lowered).otherwise(c.rlike(java_pattern(HARD_NEGATIVE_CONTEXT)))


def any_protocol(signals: dict[str, Column]) -> Column:
    ldap, rmi, dns, ldaps = (signals[key] for key in PROTOCOL_SIGNALS)
    return ldap | rmi | dns | ldaps


def signature_score(matched: Column, signals: dict[str, Column], raw: Column) -> Column:
    """``matched`` tells whether any pattern matched. The context is only looked up where it can lower a score."""
    base = (
        F.when(signals["has_jndi"] & any_protocol(signals), F.lit(SCORE_PROTOCOL))
        .when(matched, F.lit(SCORE_MATCH))
        .when(signals["has_jndi"] | signals["has_lookup_syntax"], F.lit(SCORE_HINT))
    )
    scored = matched | signals["has_jndi"] | signals["has_lookup_syntax"]
    return F.when(~scored, F.lit(0.0)).when(hard_negative_context(raw), F.lit(CONTEXT_CAP)).otherwise(base)


def signature_label(score: Column, threshold: float | Column = SIGNATURE_THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= MALICIOUS_FROM, F.lit("critical"))
        .when(score >= SUSPICIOUS_FROM, F.lit("suspicious"))
        .otherwise(F.lit("low"))
    )


def label_from_score(score: Column) -> Column:
    return (
        F.when(score >= MALICIOUS_FROM, F.lit("malicious"))
        .when(score >= SUSPICIOUS_FROM, F.lit("suspicious"))
        .otherwise(F.lit("benign"))
    )


# The four explanation texts.
EXPLAIN_BENIGN = "No Log4Shell lookup pattern was found after canonicalization."
EXPLAIN_JNDI = "The log contains a Java Naming and Directory Interface lookup pattern after canonicalization."
EXPLAIN_OBFUSCATION = "The log contains suspicious obfuscation features associated with Log4Shell payloads."
EXPLAIN_COMBINED = "The detector assigned elevated risk based on combined signature and model evidence."


def explanation(patterns: Column, label: Column) -> Column:
    hidden = F.array_contains(patterns, "url_encoding") | F.array_contains(patterns, "nested_lookup")
    return (
        F.when(label == "benign", F.lit(EXPLAIN_BENIGN))
        .when(F.array_contains(patterns, "jndi"), F.lit(EXPLAIN_JNDI))
        .when(hidden, F.lit(EXPLAIN_OBFUSCATION))
        .otherwise(F.lit(EXPLAIN_COMBINED))
    )


def status_tag(risk: Column) -> Column:
    return (
        F.when(risk == "critical", F.lit("[CRITICAL]"))
        .when(risk == "suspicious", F.lit("[SUSPICIOUS]"))
        .otherwise(F.lit("[OK]"))
    )
