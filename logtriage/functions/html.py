"""HTML character references as a native expression.

Text without ``&`` is returned untouched and the pipeline stays inside the JVM. The name table
is the HTML5 list that Python's standard library ships; it travels as one constant-folded map,
split by first letter so that a lookup scans one short map.
"""

from __future__ import annotations

import html.entities
import json
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtriage.functions.text import REPLACEMENT, bind, contains

_TOKEN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_NUMERIC = r"&#(?:[0-9]|[xX][0-9a-fA-F])"


@cache
def _legacy_pattern() -> str:
    """Names valid without a semicolon, longest first, so that a prefix match is the longest one."""
    names = [name for name in html.entities.html5 if not name.endswith(";")]
    return "^&(" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + ")"


@cache
def _names_json() -> str:
    nested: dict[str, dict[str, str]] = {}
    for name, text in html.entities.html5.items():
        nested.setdefault(name[0], {})[name] = text
    return json.dumps(nested)


def _named_table() -> Column:
    return F.from_json(F.lit(_names_json()), "map<string, map<string, string>>")


def _named_value(name: Column) -> Column:
    """Text of a complete reference name (semicolon included where it has one), or null."""
    return F.try_element_at(F.try_element_at(_named_table(), F.substring(name, 1, 1)), name)


def _c1_table() -> Column:
    """References to 0x80-0x9F mean Windows-1252 characters; the five unassigned ones stay."""
    table = {}
    for code in range(0x80, 0xA0):
        try:
            table[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            table[code] = chr(code)
    return F.from_json(F.lit(json.dumps(table)), "map<string, string>")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric_text(code: Column) -> Column:
    non_char = (
        code.between(0x1, 0x8)
        | code.between(0xE, 0x1F)
        | (code == 0xB)
        | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF)
        | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    return (
        F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit(REPLACEMENT))
        .when(code.between(0x80, 0x9F), F.try_element_at(_c1_table(), code.cast("string")))
        .when(non_char, F.lit(""))
        .otherwise(_char(code))
    )


def _numeric(token: Column) -> Column:
    digits = F.regexp_extract(token, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
    base = F.when(token.rlike("^&#[xX]"), F.lit(16)).otherwise(F.lit(10))

    def value(d: Column) -> Column:
        # More than eight significant digits cannot be a character; null means out of range.
        hexed = F.conv(d, 16, 10).cast("long")
        decimal = F.conv(d, 10, 10).cast("long")
        number = F.when(base == 16, hexed).otherwise(decimal)
        return F.when(d == "", F.lit(0).cast("long")).when(F.length(d) <= 8, number)

    return bind(bind(digits, value), _numeric_text)


def _named(token: Column) -> Column:
    full = _named_value(F.substring(token, 2, 33))
    prefix = F.regexp_extract(token, _legacy_pattern(), 1)
    by_prefix = bind(
        prefix,
        lambda p: F.when(p == "", token).otherwise(
            F.concat(_named_value(p), F.substr(token, F.length(p) + F.lit(2)))
        ),
    )
    return F.coalesce(full, by_prefix)


def _decoded(token: Column) -> Column:
    return F.when(token.startswith("&#"), _numeric(token)).otherwise(_named(token))


def html_unescape(c: Column) -> Column:
    """HTML5 references: numeric, named, and the longest legacy name without semicolon. One pass."""
    tokens = F.transform(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), _decoded)
    joined = F.zip_with(F.split(c, _TOKEN, -1), tokens, lambda gap, t: F.concat(gap, F.coalesce(t, F.lit(""))))
    return F.when(contains(c, "&"), F.array_join(joined, "")).otherwise(c)


def has_reference(c: Column) -> Column:
    """True where ``html_unescape`` would change the text."""
    tokens = F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))

    def decodes(token: Column) -> Column:
        return (
            token.rlike(_NUMERIC)
            | token.rlike(_legacy_pattern())
            | (token.endswith(";") & _named_value(F.substring(token, 2, 33)).isNotNull())
        )

    return contains(c, "&") & F.exists(tokens, decodes)
