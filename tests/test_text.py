"""Column functions against the standard library, on random strings built from tricky pieces."""

import html
import random
import re
import urllib.parse

from pyspark.sql import functions as F

from logtriage.functions import text as X
from logtriage.functions.html import has_reference, html_unescape

B = chr(92)
SPACES = "".join(chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000))


def strings(pieces, n=1500, longest=10, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def compare(spark, texts, column, expected):
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", column(F.col("s")).alias("got")).collect()
    wrong = [(r.s, r.got, expected(r.s)) for r in rows if r.got != expected(r.s)]
    assert not wrong, wrong[:3]


PERCENT = ["%", "%25", "%2", "%24", "%7B", "%ed", "%a0", "%80", "%e2", "%82", "%ac", "%C3", "%A9", "+", "a", chr(233), "%f0%9f", "%ff", "%u0024"]


def test_percent_decode(spark):
    compare(spark, strings(PERCENT), X.percent_decode, urllib.parse.unquote)


def decoded(text):
    passes = 0
    while urllib.parse.unquote(text) != text:
        text, passes = urllib.parse.unquote(text), passes + 1
    return text, passes


def test_percent_decode_n_counts_passes(spark):
    six = "${a}"
    for _ in range(6):
        six = urllib.parse.quote(six, "")
    texts = strings(PERCENT) + [six] + [urllib.parse.quote(urllib.parse.quote(urllib.parse.quote("${a}", ""), ""), "")]
    compare(spark, texts, X.percent_decode_n, lambda s: decoded(s))


def test_html_unescape(spark):
    pieces = ["&", "#", "x", "1", "6", ";", "amp", "lt", "copy", "&notit", "&notin;", "&#106;", "&#x6A;", "&#0;", "&#128;", "&#x81;"]
    pieces += ["&#xD800;", "&#1114112;", "&#99999999999999;", "&#11;", "&#xFFFE;", "a", " ", "<", "\t", "&nbsp", "&hearts;", chr(233)]
    pieces += ["&CounterClockwiseContourIntegral;", "&#000000000000065;", "&#x1F600;", chr(0x1F600)]
    texts = strings(pieces)
    compare(spark, texts, html_unescape, html.unescape)
    compare(spark, texts, has_reference, lambda s: html.unescape(s) != s)


def test_unicode_unescape(spark):
    pieces = [B + "u006a", B + "ud83d", B + "u0", B, "u006a", "a", B + "u00e9", B + "U0041"]

    def char(match):
        code = int(match.group(1), 16)
        return chr(0xFFFD) if 0xD800 <= code < 0xE000 else chr(code)

    compare(spark, strings(pieces), X.unicode_unescape, lambda s: re.sub(r"\\u([0-9a-fA-F]{4})", char, s))


def resolved(text):
    """The five rules, one at a time, until nothing changes."""
    heads = [("lower", str.lower), ("upper", str.upper)]
    while True:
        before = text
        for word, change in heads:
            text = re.sub(r"(?i)\$\{\s*" + word + r"\s*:\s*([^{}]*)\}", lambda m, f=change: f(m[1]), text)
        for rule in (r"(?i)\$\{\s*env\s*:[^{}]*:-([^{}]*)\}", r"\$\{\s*::-\s*([^{}]*)\}", r"\$\{\s*:-([^{}]*)\}"):
            text = re.sub(rule, lambda m: m[1], text)
        if text == before:
            break
    return text


def cleaned(text):
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", text)
    return re.sub(r"\s+", " ", text).strip().lower()


LOOKUPS = ["${", "}", "lower", ":", "env", "::-", ":-", "j", "N", "${lower:", "${upper:", "${env:X:-", "${::-", chr(223), chr(305), chr(304), chr(931), " ", chr(160), "$", "}", "}"]


def test_resolve_lookups(spark):
    texts = strings(LOOKUPS, longest=16) + ["${lower:" * 10 + "J" + "}" * 10 + "ndi"]
    compare(spark, texts, X.resolve_lookups, resolved)
    fast = lambda c: X.cleanup(X.resolve_lookups(c, lowercased_later=True))
    compare(spark, texts, fast, lambda s: cleaned(resolved(s)))


def test_cleanup_lines_and_strip(spark):
    pieces = [*SPACES, *(chr(c) for c in range(9)), chr(127), chr(0x200B), "A", "b", " ", "  ", chr(304), chr(931), "\r\n"]
    texts = strings(pieces)
    compare(spark, texts, X.cleanup, cleaned)
    compare(spark, texts, X.split_lines, str.splitlines)
    compare(spark, texts, X.strip, str.strip)


def test_encoders(spark):
    pieces = ["$", "{", "}", ":", "/", "a", " ", "+", "~", "*", "-", "_", ".", chr(233), chr(0x1F600), "%"]
    texts = strings(pieces, n=500)
    quote = lambda s: urllib.parse.quote(urllib.parse.quote(s, safe=""), safe="")
    compare(spark, texts, lambda c: X.percent_encode_n(c, 2), quote)
    upper = lambda s: "".join(f"%u{ord(ch):04X}" if ch in "${}:/" else ch for ch in s)
    compare(spark, texts, X.percent_u_encode, upper)
    compare(spark, texts, X.entity_encode, lambda s: "".join(f"&#{ord(ch)};" if ch in "${}:/" else ch for ch in s))


def test_long_lines_are_processed_whole(spark):
    text = "a" * 200_000 + "%24%7Bjndi" + " " * 1000 + "&amp;" + '"' * 5000
    compare(spark, [text], lambda c: X.cleanup(html_unescape(X.percent_decode(c))), lambda s: cleaned(html.unescape(urllib.parse.unquote(s))))
