"""Feed ingestion: header rejection, token extraction, observations and importers. No shuffle per line."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtriage.functions.text import WS, bind, strip
from logtriage.operators.canonical import canonicalize, hold, names_remote_lookup
from logtriage.operators.ordered import first_distinct
from logtriage.schema import DATASET_COLUMNS
from logtriage.session import built_once

# Header cells, token patterns, request prefixes and JSON keys.
HEADER_MARKERS = ["@timestamp", "@version", "_id", "_index", "_score", "_type"]
ENCODED_TOKEN = r"(?iu)(%24%7b[^\s\"',]+)"
LOOKUP_TOKEN = (
    r"(?iu)(\$\{[^\s\"',]*(?:jndi|ldap://|rmi://|dns://|ldaps://|lower:|upper:|env:|::-|:-)[^\s\"',]*\})"
)
REQUEST_PREFIXES = ["get ", "post ", "put ", "delete ", "patch ", "head ", "options ", "request from "]
JSON_TEXT_KEYS = [
    "payload",
    "raw_log",
    "message",
    "request",
    "url",
    "uri",
    "user_agent",
    "http_user_agent",
    "requestFullURI",
    "requestURI",
]
INDICATOR_SKIPPED = ["uuid", "event", "type"]

_QUOTES = "\"'"
_NOT_SPACE = r"[^\s\"',\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _unquote_ends(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{_QUOTES}]+|[{_QUOTES}]+$", "")


def _token_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s\"',]", _NOT_SPACE)


# One CSV cell: a quoted cell runs to its closing quote, or to the end when that is missing.
_CELL = r'\G(?:^|,)("(?:[^"]++|"")*+(?:"[^,]*|$)|[^,]*)'


def is_header_like(c: Column) -> Column:
    """An exported CSV header row: its first cell is ``@timestamp`` and other markers follow."""
    bare = _unquote_ends(F.regexp_replace(strip(c), r"^\x{feff}+", ""))
    cells = F.regexp_extract_all(bare, F.lit(_CELL), F.lit(1))

    def clean(cell: Column) -> Column:
        opened = F.regexp_replace(cell, r'^"((?:[^"]++|"")*+)"?', "$1")
        value = F.when(cell.startswith('"'), F.replace(opened, F.lit('""'), F.lit('"'))).otherwise(cell)
        return F.lower(_unquote_ends(strip(value)))

    def judge(names: Column) -> Column:
        second = F.coalesce(F.try_element_at(names, F.lit(2)) == "@version", F.lit(False))
        known = F.array_intersect(names, F.array(*[F.lit(m) for m in HEADER_MARKERS]))
        return (F.element_at(names, 1) == "@timestamp") & (second | (F.size(known) >= 3))

    # Only text that opens with the first marker can be a header, so other rows skip the parsing.
    maybe = F.contains(c, F.lit("@")) & c.rlike(rf"^(?i)[{WS}\x{{feff}}{_QUOTES}]*@timestamp")
    return F.when(maybe, bind(F.transform(cells, clean), judge)).otherwise(F.lit(False))


def is_request_shaped(c: Column) -> Column:
    return strip(c).rlike("^(?i)(?:" + "|".join(REQUEST_PREFIXES) + ")")


def lookup_tokens(c: Column) -> Column:
    """Candidate tokens: all encoded openers, then all lookup expressions, in text order."""

    def found(pattern: str, marker: str) -> Column:
        none = F.array().cast("array<string>")
        hits = F.regexp_extract_all(c, F.lit(_token_pattern(pattern)), F.lit(1))
        return F.when(F.contains(c, F.lit(marker)), hits).otherwise(none)

    tokens = F.concat(found(ENCODED_TOKEN, "%24%7"), found(LOOKUP_TOKEN, "${"))
    return F.transform(tokens, _unquote_ends)


def extract_token(c: Column) -> Column:
    """First token whose canonical form names jndi and a protocol, or null."""
    return F.try_element_at(F.filter(lookup_tokens(c), names_remote_lookup), F.lit(1))


def _observation(candidate: Column) -> Column:
    """Observation of one stripped candidate text, or null."""

    def shape(token: Column) -> Column:
        compact = F.concat(
            F.lit("Request from User-Agent: "), token, F.lit(" | Method: GET | Host: external-feed | Path: /")
        )
        shown = F.when(is_request_shaped(candidate), candidate).otherwise(compact)
        return F.when(token.isNotNull() & (token != ""), shown)

    usable = (candidate != "") & ~is_header_like(candidate)
    return F.when(usable, bind(extract_token(candidate), shape))


def _json_texts(value: object) -> list[str]:
    """Strings of a JSON value: preferred keys first, then every nested container; lists in order."""
    found: list[str] = []
    pending = [value]
    while pending:
        item = pending.pop()
        if isinstance(item, dict):
            preferred = [item[key] for key in JSON_TEXT_KEYS if key in item]
            nested = [part for part in item.values() if isinstance(part, (dict, list))]
            pending.extend(reversed(preferred + nested))
        elif isinstance(item, list):
            pending.extend(reversed(item))
        elif item is not None:
            found.append(str(item))
    return found


_JSON_SPACE = re.compile(r"[ \t\n\r]*")
_JSON_SCALAR = re.compile(r"-?Infinity|NaN|true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def load_deep(text: str) -> object:
    """``json.loads`` without recursion, for values of any depth. Raises ``ValueError`` for other text."""
    root: list = []
    stack: list[dict | list] = [root]
    keys: list[str] = []
    at, state = 0, "value"  # what comes next: value, first (value or end), key, first key (key or end), more
    while True:
        at = _JSON_SPACE.match(text, at).end()
        char, top = text[at : at + 1], stack[-1]
        if state == "more":
            if len(stack) == 1:
                if char:
                    raise ValueError(f"extra text at {at}")
                return root[0]
            if char == ("}" if isinstance(top, dict) else "]"):
                stack.pop()
            elif char == ",":
                state = "key" if isinstance(top, dict) else "value"
            else:
                raise ValueError(f"comma or end expected at {at}")
            at += 1
        elif state in ("key", "first key"):
            if char == "}" and state == "first key":
                stack.pop()
                at, state = at + 1, "more"
                continue
            if char != '"':
                raise ValueError(f"key expected at {at}")
            key, at = scanstring(text, at + 1, True)
            at = _JSON_SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"colon expected at {at}")
            keys.append(key)
            at, state = at + 1, "value"
        elif char == "]" and state == "first":
            stack.pop()
            at, state = at + 1, "more"
        else:
            if char in ("[", "{"):
                value = [] if char == "[" else {}
                at += 1
            elif char == '"':
                value, at = scanstring(text, at + 1, True)
            else:
                found = _JSON_SCALAR.match(text, at)
                if found is None:
                    raise ValueError(f"value expected at {at}")
                value, at = json.loads(found[0]), found.end()
            if isinstance(top, dict):
                top[keys.pop()] = value
            else:
                top.append(value)
            if char in ("[", "{"):
                stack.append(value)
            state = {"[": "first", "{": "first key"}.get(char, "more")


def _flatten_text(text: str | None) -> list[str] | None:
    if text is None:
        return None
    try:
        return _json_texts(json.loads(text))
    except RecursionError:
        pass
    except ValueError:
        return []
    try:
        return _json_texts(load_deep(text))
    except ValueError:
        return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _flatten(texts: pd.Series) -> pd.Series:
    return texts.map(_flatten_text)


def flatten_json(c: Column) -> Column:
    """Strings of a JSON text of any depth; empty for other text, null for null."""
    return _flatten(c)


def candidates(df: DataFrame, col: str = "raw_log") -> DataFrame:
    """One row per candidate text: position 0 is the row itself, then its JSON strings.

    Only rows that can be JSON hand their text to Python; the others hand over a null.
    """
    json_like = F.when(F.col(col).rlike(rf'^{WS}*[\[{{"0-9tfnIN-]'), F.col(col))
    texts = F.concat(F.array(F.col(col)), F.coalesce(flatten_json(json_like), F.array().cast("array<string>")))
    return df.select("*", F.posexplode(texts).alias("pos", "candidate"))


@built_once
def _own_observation() -> Column:
    return _observation(F.col("_raw"))


@built_once
def _json_observation() -> Column:
    found = F.filter(F.transform("_flat", lambda t: bind(strip(t), _observation)), lambda o: o.isNotNull())
    return F.try_element_at(found, F.lit(1))


def extract_observation(df: DataFrame, col: str = "raw_log", name: str = "observation") -> DataFrame:
    """Add the observation of each feed row, or null.

    JSON is only parsed (in Python) for rows whose own text yields nothing; the others hand over a null.
    """
    df = df.withColumn("_raw", strip(F.coalesce(F.col(col), F.lit(""))))
    df = hold(df.withColumn("_own", _own_observation()), ["_raw", "_own"])
    parse = F.col("_own").isNull() & F.col("_raw").rlike(r'^[\[{"]') & ~is_header_like(F.col("_raw"))
    df = df.withColumn("_flat", flatten_json(F.when(parse, F.col("_raw"))))
    df = df.withColumn(name, F.coalesce("_own", _json_observation())).drop("_raw", "_own", "_flat")
    return hold(df, [name])


@dataclass(frozen=True)
class FeedSpec:
    """Where an imported feed row comes from."""

    prefix: str
    source: str
    field: str
    split: str


# The two feed importers.
HONEYPOT_FEED = FeedSpec("GB", "greedybear_log4pot", "honeypot_feed", "external_greedybear_test")
SIMULATION_FEED = FeedSpec("SP", "splunk_attack_data", "access_log", "external_splunk_test")


def numbered_id(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}-%06d", number)


def import_feed(df: DataFrame, spec: FeedSpec, day: str, line: str = "line", col: str = "raw_log") -> DataFrame:
    """Feed lines to labelled rows; the id carries the line number."""
    seen = extract_observation(df, col).filter(F.col("observation").isNotNull())
    rows = seen.select(F.col(line).alias("_line"), F.col("observation").alias("raw_log"))
    return (
        canonicalize(rows)
        .withColumns(
            {
                "id": numbered_id(spec.prefix, F.col("_line")),
                "timestamp": F.lit(day),
                "source": F.lit(spec.source),
                "label": F.lit(1),
                "attack_family": F.lit("log4shell"),
                "field": F.lit(spec.field),
                "split": F.lit(spec.split),
                "risk_level": F.lit("critical"),
            }
        )
        .select(*DATASET_COLUMNS)
    )


def request_line() -> Column:
    """Request text of a packet row."""
    return F.format_string(
        "Request from %s User-Agent: %s | Method: %s | Host: %s | Path: %s",
        "ip_src",
        "user_agent",
        "method",
        "host",
        "uri",
    )


def import_requests(packets: DataFrame, day: str, line: str = "line") -> DataFrame:
    """Packet rows to labelled rows; the jndi signal decides the label."""
    packets = packets.na.fill("", ["frame_time", "ip_src", "method", "host", "uri", "user_agent"])
    rows = packets.select(F.col(line).alias("_line"), "frame_time", request_line().alias("raw_log"))
    attack = F.col("signals.has_jndi")
    return (
        canonicalize(rows)
        .withColumns(
            {
                "id": numbered_id("FX", F.col("_line")),
                "timestamp": F.when(F.col("frame_time") == "", F.lit(day)).otherwise(F.col("frame_time")),
                "source": F.lit("foxit_pcap_http"),
                "label": attack.cast("int"),
                "attack_family": F.when(attack, F.lit("log4shell")).otherwise(F.lit("benign")),
                "field": F.lit("pcap_http"),
                "split": F.lit("external_foxit_pcap_test"),
                "risk_level": F.when(attack, F.lit("critical")).otherwise(F.lit("low")),
            }
        )
        .select(*DATASET_COLUMNS)
    )


def request_observations(packets: DataFrame, line: str = "line", n: int | None = 40) -> DataFrame:
    """First ``n`` distinct request lines that hold an observation (all when None); keeps the request line itself."""
    packets = packets.na.fill("", ["frame_time", "ip_src", "method", "host", "uri", "user_agent"])
    lines = packets.select(F.col(line).alias("line"), request_line().alias("raw_log"))
    seen = extract_observation(lines).filter(F.col("observation").isNotNull())
    return first_distinct(seen, "raw_log", n, F.col("line"))


def first_observations(df: DataFrame, order: Column, n: int | None = 80, col: str = "raw_log") -> DataFrame:
    return first_distinct(extract_observation(df, col), "observation", n, order)


def benign_candidates(df: DataFrame, order: Column, n: int = 200, col: str = "raw_log") -> DataFrame:
    """First ``n`` distinct non-blank lines without a jndi signal."""
    lines = df.withColumn("_text", strip(F.coalesce(F.col(col), F.lit("")))).filter(F.col("_text") != "")
    clean = canonicalize(lines, "_text").filter(~F.col("signals.has_jndi"))
    return first_distinct(clean, "_text", n, order).withColumnRenamed("_text", "candidate")


def indicator_lines(df: DataFrame, col: str = "raw_log") -> DataFrame:
    """Indicator lines: not blank, not a header word."""
    lowered = F.lower(col)
    skipped = F.lit(False)
    for word in INDICATOR_SKIPPED:
        skipped = skipped | lowered.startswith(word)
    return df.filter((strip(F.col(col)) != "") & ~skipped).withColumn("indicator", strip(F.col(col)))


def indicator_preview(df: DataFrame, order: Column, source: str, k: int = 5, col: str = "raw_log") -> DataFrame:
    """Per source: number of lines and the first ``k`` indicators.

    The rank filter is applied inside every map task before the shuffle, so a large source stays cheap.
    """
    ordered = df.withColumn("_o", order)
    counts = ordered.groupBy(source).agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.partitionBy(source).orderBy("_o"))
    best = indicator_lines(ordered, col).withColumn("_rn", place).filter(F.col("_rn") <= k)
    preview = best.groupBy(source).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "indicator"))), lambda e: e["indicator"]).alias(
            "indicator_preview"
        )
    )
    return counts.join(preview, source, "left").select(
        source, "rows", F.coalesce("indicator_preview", F.array().cast("array<string>")).alias("indicator_preview")
    )


def with_fallback(feed: DataFrame, fallback: DataFrame, source: str) -> DataFrame:
    """Feed rows, or the fallback rows when the feed holds none; ``source`` tells which."""
    empty = ~feed.select(F.lit(1)).exists()
    return feed.withColumn("source", F.lit(source)).unionByName(
        fallback.withColumn("source", F.lit(f"{source}_fallback")).filter(empty)
    )


def source_meta(df: DataFrame, sources: list[str]) -> DataFrame:
    """For every one of ``sources``, with rows or without: its rows and whether they are fallback rows."""
    own = F.regexp_replace("source", "_fallback$", "")
    counts = df.groupBy(own.alias("source"), F.col("source").endswith("_fallback").alias("used_fallback"))
    counts = counts.agg(F.count(F.lit(1)).alias("rows"))
    named = df.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    found = named.join(counts, "source", "left")
    return found.select(
        "source", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("used_fallback", F.lit(False)).alias("used_fallback")
    )
