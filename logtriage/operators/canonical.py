"""Canonicalization as a chain of projections (no shuffle), and as one expression for array elements."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtriage.functions import signals as S
from logtriage.functions import text as X
from logtriage.functions.html import html_unescape
from logtriage.schema import SIGNAL_KEYS
from logtriage.session import built_once

_RAW = "_lt_raw"
_TEXT = "_lt_text"
_PASSES = "_lt_passes"
_MORE = "_lt_more"


def hold(df: DataFrame, names: list[str]) -> DataFrame:
    """Compute the named columns here, once.

    The optimizer copies a later filter below a projection, with every column replaced by its definition; over a
    chain of decoding steps that copy grows exponentially. It does not move a filter below a generator, so the
    columns pass through a one-element ``inline``: a narrow step. Filters on other columns still reach the scan.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


@built_once
def _text_steps() -> list[tuple[str, Column]]:
    """Stages from the raw line to the canonical text, in order.

    Each stage reads its input several times, and a projection per stage keeps it computed once.
    Percent-decoding stops by itself: a pass without effect leaves nothing to decode. Texts that the last column still
    changes are decoded to the end in a loop.
    """
    names = [_RAW, *[f"_lt_d{n}" for n in range(1, X.COLUMN_PASSES + 1)]]
    steps = [(names[1], X.percent_decode(F.col(_RAW)))]
    for earlier, last, name in zip(names, names[1:], names[2:], strict=False):
        moved = F.col(last) != F.col(earlier)
        steps.append((name, F.when(moved, X.percent_decode(F.col(last))).otherwise(F.col(last))))
    changed = [(F.col(after) != F.col(before)).cast("int") for before, after in zip(names, names[1:], strict=False)]
    steps.append((_PASSES, reduce(add, changed)))
    start = F.struct(F.col(names[-1]).alias("text"), F.lit(0).alias("passes"))
    looped = X.percent_decode_n(F.col(names[-1]))
    steps.append((_MORE, F.when(F.col(names[-1]) != F.col(names[-2]), looped).otherwise(start)))
    steps.append((_PASSES, F.col(_PASSES) + F.col(_MORE)["passes"]))
    steps.append((_TEXT, F.col(_MORE)["text"]))
    steps.append((_TEXT, html_unescape(F.col(_TEXT))))
    steps.append((_TEXT, X.unicode_unescape(F.col(_TEXT))))
    steps.append((_TEXT, X.resolve_lookups(F.col(_TEXT), lowercased_later=True)))
    steps.append(("normalized_log", X.cleanup(F.col(_TEXT))))
    return steps


@built_once
def _signal_steps() -> dict[str, Column]:
    return S.signal_columns(F.col("normalized_log"), F.col(_RAW), F.col(_PASSES))


def with_signals(df: DataFrame, col: str = "raw_log") -> DataFrame:
    """Canonical text plus the thirteen signals as flat boolean columns; keeps the internal columns."""
    df = df.withColumn(_RAW, F.coalesce(F.col(col), F.lit("")))
    for name, step in _text_steps():
        df = df.withColumn(name, step)
    df = df.withColumns(_signal_steps())
    decoded = [f"_lt_d{n}" for n in range(1, X.COLUMN_PASSES + 1)]
    return hold(df.drop(_TEXT, _MORE, *decoded), ["normalized_log", _RAW, _PASSES, *SIGNAL_KEYS])


def flat_signals() -> dict[str, Column]:
    return {key: F.col(key) for key in SIGNAL_KEYS}


@built_once
def label_columns() -> dict[str, Column]:
    """Pattern list and obfuscation label over the columns of ``with_signals``."""
    flags = flat_signals()
    return {
        "detected_patterns": S.detected_patterns(flags),
        "obfuscation_type": S.obfuscation_type(flags, F.col(_RAW), F.col(_PASSES)),
    }


def drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(_RAW, _PASSES)


def canonicalize(df: DataFrame, col: str = "raw_log") -> DataFrame:
    """Add ``normalized_log``, ``signals``, ``detected_patterns`` and ``obfuscation_type``."""
    out = with_signals(df, col)
    packed = F.struct(*[F.col(key) for key in SIGNAL_KEYS])
    return drop_internal(out.withColumns({"signals": packed, **label_columns()})).drop(*SIGNAL_KEYS)


def canonical_text(c: Column) -> Column:
    """The canonical text as a single expression, for use inside array lambdas."""
    decoded = X.bind(c, lambda t: X.percent_decode_n(t)["text"])
    plain = X.bind(X.bind(decoded, html_unescape), X.unicode_unescape)
    resolved = X.bind(plain, lambda t: X.resolve_lookups(t, lowercased_later=True))
    return X.cleanup(resolved)


def names_remote_lookup(c: Column) -> Column:
    """Canonical form has a jndi token and a protocol."""
    return X.bind(
        canonical_text(c),
        lambda n: S.has_jndi(n) & (S.has_ldap(n) | S.has_rmi(n) | S.has_dns(n) | S.has_ldaps(n)),
    )
