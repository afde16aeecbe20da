"""Text decoding and encoding as native Spark expressions.

Each function costs next to nothing on text without its marker character: the work sits in the
taken branch of a ``when``. A function may read its argument several times, so callers pass a
column or a lambda variable (see ``bind``), never a long expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 Unicode whitespace characters, as a Java character class.
_WIDE = r"\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Printable ASCII is excluded first: for ordinary characters the class is one range check.
WS = rf"[[^!-~]&&[\t-\r\x1c-\x20{_WIDE}]]"
# The same plus every control character that clean-up blanks.
_BLANK = rf"[[^!-~]&&[\x00-\x20\x7f{_WIDE}]]"
# Line boundaries of universal newlines plus VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

REPLACEMENT = "\N{REPLACEMENT CHARACTER}"
#: Decoding passes that are columns of their own; texts that still change are decoded further in a loop.
COLUMN_PASSES = 4


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def contains(c: Column, marker: str) -> Column:
    return F.contains(c, F.lit(marker))


def swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


# -- decoding ---------------------------------------------------------------------------------


def percent_decode(c: Column) -> Column:
    """One pass; ``+`` stays, malformed ``%`` stays, invalid UTF-8 becomes U+FFFD per bad byte run."""
    ready = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    # The JVM folds an encoded surrogate into one replacement character; keep one per byte.
    ready = F.regexp_replace(ready, r"%[eE][dD](?=%[abAB][0-9a-fA-F])", "%EF%BF%BD")
    return F.when(contains(c, "%"), F.url_decode(swap(ready, "+", "%2B"))).otherwise(c)


def percent_decode_n(c: Column) -> Column:
    """Struct ``(text, passes)``: decode until nothing changes.

    A pass that changes the text makes it two characters shorter at least, which bounds their number; once one has had
    no effect, the rest are skipped.
    """
    start = F.struct(c.alias("text"), F.lit(0).alias("passes"), F.lit(True).alias("moved"))

    def step(state: Column, _: Column) -> Column:
        decoded = bind(
            percent_decode(state["text"]),
            lambda text: F.struct(
                text.alias("text"),
                (state["passes"] + (text != state["text"]).cast("int")).alias("passes"),
                (text != state["text"]).alias("moved"),
            ),
        )
        return F.when(state["moved"], decoded).otherwise(state)

    most = F.greatest(F.lit(1), F.floor(F.length(c) / 2).cast("int"))
    looped = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s.dropFields("moved"))
    return F.when(contains(c, "%"), looped).otherwise(start.dropFields("moved"))


def unicode_unescape(c: Column) -> Column:
    """Backslash-u escapes, one pass. A lone surrogate half becomes U+FFFD."""
    hexes = F.regexp_extract_all(c, F.lit(r"\\u([0-9a-fA-F]{4})"), F.lit(1))
    gaps = F.split(c, r"\\u[0-9a-fA-F]{4}", -1)

    def join(gap: Column, h: Column) -> Column:
        char = (
            F.when(h.isNull(), F.lit(""))
            .when(h.rlike("^[dD][89a-fA-F]"), F.lit(REPLACEMENT))
            .otherwise(F.decode(F.unhex(h), "UTF-16BE"))
        )
        return F.concat(gap, char)

    return F.when(contains(c, "\\u"), F.array_join(F.zip_with(gaps, hexes, join), "")).otherwise(c)


# The five lookup rules, in the order they are applied within a round.
LOWER_RULE = rf"(?i)\$\{{{WS}*lower{WS}*:{WS}*([^{{}}]*)\}}"
UPPER_RULE = rf"(?i)\$\{{{WS}*upper{WS}*:{WS}*([^{{}}]*)\}}"
ENV_RULE = rf"(?i)\$\{{{WS}*env{WS}*:[^{{}}]*:-([^{{}}]*)\}}"
DEFAULT_RULE = rf"\$\{{{WS}*::-{WS}*([^{{}}]*)\}}"
SHORT_RULE = rf"\$\{{{WS}*:-([^{{}}]*)\}}"
# A text no rule can touch fails this test, which ends the rounds early.
_ANY_RULE = rf"(?i)\$\{{{WS}*(?:(?:lower|upper|env){WS}*:|::-|:-)"


def _cased(c: Column, rule: str, change: Callable[[Column], Column]) -> Column:
    bodies = F.transform(F.regexp_extract_all(c, F.lit(rule), F.lit(1)), change)
    joined = F.zip_with(F.split(c, rule, -1), bodies, lambda gap, b: F.concat(gap, F.coalesce(b, F.lit(""))))
    return F.array_join(joined, "")


def lower_lookup(c: Column) -> Column:
    return _cased(c, LOWER_RULE, F.lower)


def upper_lookup(c: Column) -> Column:
    return _cased(c, UPPER_RULE, F.upper)


def env_fallback_lookup(c: Column) -> Column:
    return F.regexp_replace(c, ENV_RULE, "$1")


def default_fragment(c: Column) -> Column:
    return F.regexp_replace(c, DEFAULT_RULE, "$1")


def short_default(c: Column) -> Column:
    return F.regexp_replace(c, SHORT_RULE, "$1")


def _plain_round(c: Column) -> Column:
    for rule in (LOWER_RULE, UPPER_RULE, ENV_RULE, DEFAULT_RULE, SHORT_RULE):
        c = F.regexp_replace(c, rule, "$1")
    return c


def _cased_round(c: Column) -> Column:
    return bind(lower_lookup(c), lambda t: short_default(default_fragment(env_fallback_lookup(upper_lookup(t)))))


def _rounds(c: Column, one_round: Callable[[Column], Column]) -> Column:
    """Rounds until no rule applies: each one removes an opener, so there are at most as many as openers."""
    openers = F.greatest(F.length(c) - F.length(swap(c, "${", "$")), F.lit(1))
    return F.aggregate(
        F.sequence(F.lit(1), openers),
        c,
        lambda text, _: F.when(text.rlike(_ANY_RULE), one_round(text)).otherwise(text),
    )


def resolve_lookups(c: Column, lowercased_later: bool = False) -> Column:
    """Resolve lookup expressions to a fixpoint.

    With ``lowercased_later`` the case of ASCII text no longer matters, so the two case rules keep
    their argument as it is. Text with other letters always takes the exact rules: their upper
    and lower forms do not round-trip.
    """
    exact = _rounds(c, _cased_round)
    if lowercased_later:
        exact = F.when(is_ascii(c), _rounds(c, _plain_round)).otherwise(exact)
    return F.when(contains(c, "${") & c.rlike(_ANY_RULE), exact).otherwise(c)


def cleanup(c: Column) -> Column:
    """Blank control characters, collapse whitespace, trim, lower-case."""
    # A lone space is left alone, so ordinary lines are scanned but not rebuilt.
    collapsed = F.regexp_replace(c, rf"{_BLANK}(?:(?<! )|(?={_BLANK})){_BLANK}*", " ")
    return F.lower(F.trim(collapsed))


# -- encoding ---------------------------------------------------------------------------------


def percent_encode(c: Column) -> Column:
    """Percent-encode everything but ASCII letters, digits and ``_ . - ~``."""
    return swap(swap(swap(F.url_encode(c), "+", "%20"), "*", "%2A"), "%7E", "~")


def percent_encode_n(c: Column, passes: int) -> Column:
    for _ in range(passes):
        c = percent_encode(c)
    return c


# Characters written as escapes by the two partial encoders.
PERCENT_U = [("$", "%u0024"), ("{", "%u007B"), ("}", "%u007D"), (":", "%u003A"), ("/", "%u002F")]
ENTITIES = [("$", "&#36;"), ("{", "&#123;"), ("}", "&#125;"), (":", "&#58;"), ("/", "&#47;")]


def percent_u_encode(c: Column) -> Column:
    for char, escape in PERCENT_U:
        c = swap(c, char, escape)
    return c


def entity_encode(c: Column) -> Column:
    for char, escape in ENTITIES:
        c = swap(c, char, escape)
    return c


def base64_text(c: Column) -> Column:
    # Spark folds the output into lines of 76 characters; the plain form has none.
    return swap(F.base64(F.encode(c, "UTF-8")), "\r\n", "")


def split_lines(c: Column) -> Column:
    """Lines of a whole text; a final line break does not open another line."""
    pieces = F.split(c, LINE_BREAK, -1)
    kept = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(kept)
