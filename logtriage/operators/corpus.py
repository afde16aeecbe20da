"""Corpus assembly: template expansion, line shapes, splits, records, ids, quotas and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.functions import text as X
from logtriage.functions.text import swap
from logtriage.operators.canonical import canonicalize
from logtriage.operators.detect import literal_map
from logtriage.operators.ingest import numbered_id
from logtriage.operators.ordered import number_rows
from logtriage.plans.templates import (
    FAMILY_SPLITS,
    FIELDS,
    HARD_NEGATIVE,
    OOD_FIELDS,
    PATHS,
    USER_AGENTS,
    WHOLE_LINE_FAMILIES,
)
from logtriage.schema import DATASET_COLUMNS

OOD_SPLIT = "ood_stress_test"
OOD_FIRST_NUMBER = 900001


def pick(values: list[str], index: Column) -> Column:
    """Element of a short literal list, round-robin."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int") + 1)


def _literal_rows(rows: list[tuple], names: list[str]) -> Column:
    return F.array(
        *[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows]
    )


def expand(hosts: DataFrame, templates: list[tuple], names: list[str]) -> DataFrame:
    """Every template for every host row: a narrow explode of a literal template list, ``tpl_no`` from 0.

    ``hosts`` has ``host``; the texts ``payload`` (and ``line``) have their host filled in.
    """
    out = hosts.select("*", F.posexplode(_literal_rows(templates, names)).alias("tpl_no", "_t"))
    out = out.select(*hosts.columns, "tpl_no", *[F.col(f"_t.{n}").alias(n) for n in names])
    return out.withColumn("payload", F.replace(F.col("payload"), F.lit("{h}"), F.col("host")))


def percent_passes(df: DataFrame, passes: str = "passes", most: int = 3) -> DataFrame:
    """Percent-encode ``payload`` as often as its row says."""
    for number in range(1, most + 1):
        again = F.when(F.col(passes) >= number, X.percent_encode(F.col("payload"))).otherwise(F.col("payload"))
        df = df.withColumn("payload", again)
    return df.drop(passes)


def expand_payloads(hosts: DataFrame, templates: list[tuple[str, int, str]]) -> DataFrame:
    """Malicious payloads: host filled in, then percent-encoded."""
    return percent_passes(expand(hosts, templates, ["payload", "passes", "family"]))


def expand_hard_negatives(hosts: DataFrame, templates: list[tuple[str, str, str, str]] = HARD_NEGATIVE) -> DataFrame:
    """Benign lines that quote a payload in one of six encodings."""
    out = expand(hosts, templates, ["line", "payload", "encoding", "family"])
    p = F.col("payload")
    encoded = (
        F.when(F.col("encoding") == "percent", X.percent_encode(p))
        .when(F.col("encoding") == "percent2", X.percent_encode_n(p, 2))
        .when(F.col("encoding") == "percent_u", X.percent_u_encode(p))
        .when(F.col("encoding") == "entity", X.entity_encode(p))
        .when(F.col("encoding") == "base64", X.base64_text(p))
        .otherwise(p)
    )
    return out.withColumn("raw_log", F.replace(F.col("line"), F.lit("{p}"), encoded)).drop(
        "line", "payload", "encoding"
    )


def replicate(df: DataFrame, n: int, name: str = "sample_no") -> DataFrame:
    """``n`` copies of every row, numbered from 0."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))


def make_line(payload: Column, field: Column, variant: Column) -> Column:
    """Place a payload in the line shape of its field; ``variant`` rotates agent and path."""
    agent, path = pick(USER_AGENTS, variant), pick(PATHS, variant)
    lit = F.lit
    return (
        F.when(field == "minimal_query", F.concat(lit("GET /?q="), payload, lit(" HTTP/1.1")))
        .when(
            field == "uri_param", F.concat(lit("GET /api/check?debug="), payload, lit(" HTTP/1.1 Host: app.local"))
        )
        .when(
            field == "user_agent",
            F.concat(
                lit("Request from User-Agent: "), payload, lit(" | Method: GET | Host: app.local | Path: "), path
            ),
        )
        .when(field == "user_agent_minimal", F.concat(lit("Request from User-Agent: "), payload))
        .when(
            field == "x_api_version",
            F.concat(
                lit("Request from User-Agent: "),
                agent,
                lit(" | Method: GET | Host: app.local | Path: "),
                path,
                lit(" | X-Api-Version: "),
                payload,
            ),
        )
        .when(
            field == "path",
            F.concat(lit("GET /search?q="), payload, lit(" HTTP/1.1 Host: app.local User-Agent: "), agent),
        )
        .when(field == "body", F.concat(lit("POST /search HTTP/1.1 Host: app.local Body: query="), payload))
        .otherwise(payload)
    )


def contextualize(df: DataFrame) -> DataFrame:
    """Rotate the field by ``sample_no`` and build ``raw_log``; whole-line families stay as they are."""
    whole = F.col("family").isin(WHOLE_LINE_FAMILIES)
    field = F.when(whole, F.lit("context")).otherwise(pick(FIELDS, F.col("sample_no")))
    variant = F.col("sample_no") + F.col("tpl_no")
    return df.withColumn("field", field).withColumn(
        "raw_log", make_line(F.col("payload"), F.col("field"), variant)
    )


def contextualize_ood(df: DataFrame, number: str = "number") -> DataFrame:
    """The four line shapes of the out-of-distribution set."""
    field, n, p = F.col("field"), F.col(number).cast("string"), F.col("payload")
    lit = F.lit
    line = (
        F.when(
            field == "query",
            F.concat(
                lit("GET /api/audit?trace="), p, lit("&request_id=ood-"), n, lit(" HTTP/1.1 Host: victim.local")
            ),
        )
        .when(
            field == "json",
            F.concat(
                lit('POST /ingest HTTP/1.1 Host: victim.local Content-Type: application/json Body: {"ua":"'),
                p,
                lit('","host":"'),
                F.col("host"),
                lit('"}'),
            ),
        )
        .when(
            field == "header",
            F.concat(
                lit("Request from User-Agent: Mozilla/5.0 | X-Forwarded-For: 10.0.0."),
                F.pmod(F.col(number), F.lit(250)).cast("string"),
                lit(" | X-Api-Version: "),
                p,
            ),
        )
        .when(
            field == "cookie",
            F.concat(
                lit("GET /profile HTTP/1.1 Host: victim.local Cookie: prefs=light; tracking="),
                p,
                lit("; sid=ood"),
                n,
            ),
        )
        .otherwise(p)
    )
    return df.withColumn("field", pick(OOD_FIELDS, F.col("sample_no"))).withColumn("raw_log", line)


def ood_rows(hosts: DataFrame, malicious: list[tuple], benign: list[tuple], samples: int = 4) -> DataFrame:
    """Out-of-distribution rows with their number: all malicious rows first, then the benign ones."""
    attack = expand(hosts, malicious, ["payload", "family"]).withColumn("label", F.lit(1))
    quoted = expand(hosts, benign, ["payload", "family"]).withColumn("label", F.lit(0))
    rows = replicate(attack.unionByName(quoted), samples)
    order = [F.col("label").desc(), F.col("host_no"), F.col("tpl_no"), F.col("sample_no")]
    rows = number_rows(rows, order, "number", OOD_FIRST_NUMBER)
    shaped = contextualize_ood(rows)
    suffix = F.when(F.col("sample_no") > 0, F.concat(F.lit(" trace_id=benign-ood-"), F.col("number"))).otherwise(
        F.lit("")
    )
    attack_row = F.col("label") == 1
    return shaped.withColumns(
        {
            "raw_log": F.when(attack_row, F.col("raw_log")).otherwise(F.concat(F.col("payload"), suffix)),
            "field": F.when(attack_row, F.col("field")).otherwise(F.lit("mixed")),
            "source": F.when(attack_row, F.lit("ood_stress_malicious")).otherwise(
                F.lit("ood_stress_hard_negative")
            ),
            "split": F.lit(OOD_SPLIT),
            "id": numbered_id("OOD", F.col("number")),
            "override": F.col("family"),
        }
    )


def assign_split(df: DataFrame, splits: list[tuple[str, str]] = FAMILY_SPLITS) -> DataFrame:
    """Split of each family; the table of families is a literal, so no join is needed."""
    return df.withColumn("split", F.try_element_at(literal_map(dict(splits)), F.col("family")))


def to_records(df: DataFrame, day: str) -> DataFrame:
    """The eleven columns from ``id, source, raw_log, label, family, field, split`` and optional ``override``.

    A malicious row without override takes the canonical type; a benign one takes its family.
    """
    override = F.col("override") if "override" in df.columns else F.lit(None).cast("string")
    attack = F.col("label") == 1
    typed = canonicalize(df.withColumn("_override", override))
    chosen = F.coalesce("_override", F.when(attack, F.col("obfuscation_type")).otherwise(F.col("family")))
    return typed.withColumns(
        {
            "timestamp": F.lit(day),
            "obfuscation_type": chosen,
            "attack_family": F.when(attack, F.lit("log4shell")).otherwise(F.lit("benign")),
            "risk_level": F.when(attack, F.lit("critical")).otherwise(F.lit("low")),
        }
    ).select(*DATASET_COLUMNS)


def assign_ids(df: DataFrame, order: list[Column], prefix: str = "LS", start: int = 1) -> DataFrame:
    """Sequential ids in ``order``; see ``number_rows``."""
    return number_rows(df, order, "_no", start).withColumn("id", numbered_id(prefix, F.col("_no"))).drop("_no")


def with_trace_id(raw: Column, tag: Column, number: Column) -> Column:
    """Suffix that keeps repeated lines apart."""
    return F.concat(raw, F.lit(" trace_id="), tag, F.lit("-"), F.format_string("%04d", number))


def draw_number(seed: int, split: Column, draw: Column) -> Column:
    """Non-negative 60-bit number of a seeded draw, the same on every engine."""
    text = F.concat(F.lit(f"{seed}:"), split, F.lit(":"), draw.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draws(spark: SparkSession, quotas: list[tuple[str, int]]) -> DataFrame:
    """One row per draw: ``split, draw_no``."""
    table = spark.createDataFrame(quotas, "split string, n int")
    return table.select("split", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("draw_no"))


def sample_quota(pool: DataFrame, quotas: list[tuple[str, int]], seed: int = 42) -> DataFrame:
    """Draw with replacement from a pool numbered ``pool_no`` from 0 without gaps, as many rows per split as its quota."""
    size = pool.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    wanted = draws(pool.sparkSession, quotas).withColumn(
        "pool_no", F.pmod(draw_number(seed, F.col("split"), F.col("draw_no")), size)
    )
    return wanted.join(pool, "pool_no")


def hard_negative_set(pool: DataFrame, n: int = 180) -> DataFrame:
    """``n`` rows round-robin over a pool numbered ``pool_no`` from 0, with ids and trace ids."""
    size = pool.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    rows = pool.sparkSession.range(1, n + 1).withColumn("pool_no", F.pmod(F.col("id") - 1, size))
    joined = rows.join(pool, "pool_no")
    return joined.withColumns(
        {
            "raw_log": with_trace_id(F.col("raw_log"), F.lit("standalone-hardneg"), F.col("id")),
            "id": numbered_id("HN", F.col("id")),
            "source": F.lit("hard_negative"),
            "label": F.lit(0),
            "override": F.col("family"),
            "field": F.lit("mixed"),
            "split": F.lit("hard_negative_test"),
        }
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def class_balance(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def leakage(train: DataFrame, heldout: DataFrame, col: str = "obfuscation_type") -> DataFrame:
    """Types present on both sides."""
    return train.select(col).intersect(heldout.select(col))


def leakage_checked(df: DataFrame, train_split: str, heldout: list[str]) -> DataFrame:
    """Shared types by stored type and by the type recomputed from the text, in one pass over the rows."""
    found = canonicalize(df.withColumnRenamed("obfuscation_type", "stored_type"))
    bases = F.array(
        F.struct(F.lit("stored").alias("basis"), F.col("stored_type").alias("shared_type")),
        F.struct(F.lit("recomputed").alias("basis"), F.col("obfuscation_type").alias("shared_type")),
    )
    long = found.select("split", F.inline(bases))
    sides = long.groupBy("basis", "shared_type").agg(
        F.bool_or(F.col("split") == train_split).alias("_in_train"),
        F.bool_or(F.col("split").isin(heldout)).alias("_held_out"),
    )
    return sides.filter(F.col("_in_train") & F.col("_held_out")).select("basis", "shared_type")


def merge_taxonomy(old: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """Descriptions by type, the new ones winning."""
    return {**old, **new}


def merge_types(old: DataFrame, new: DataFrame) -> DataFrame:
    """``obfuscation_type``, ``description`` of two tables; where both describe a type, the new description stands."""
    added = new.select("obfuscation_type", F.col("description").alias("new"))
    both = old.join(added, "obfuscation_type", "full_outer")
    return both.select("obfuscation_type", F.coalesce("new", "description").alias("description"))
