"""URL filters: path rules, and a path-template tree for what no rule decides; DataFrame and SQL functions only.

1. Urls are counted by host and *masked* path, in which every run of digits is ``*``: variable segments by form. All
   further steps work on these counts, not on urls.
2. Level by level from the host down, a segment keeps a branch of its own if it has ``support`` urls and its labelled share
   of good urls differs from that of its node by ``z2`` (squared standard errors) or more. All others of the node, being
   rare or statistically similar to it, merge into the wildcard branch ``*``. Below ``LEVELS`` levels this goes on as long
   as a node has support and labels of both kinds, so that a branch can pass there or deeper; ``**`` takes what is left of
   a path after its last own branch, so every url has a template.
3. A template's purity is its share of good labels, smoothed by ``weight`` pseudo-labels with the share of its host, which
   is smoothed in turn with the share of all labels. Templates of a purity under one half are rejected.

Counting combines on the map side; urls meet verdicts by host and masked path in a join that adaptive execution can split.

Cases: a null url, or one without ``://``, has an empty host and path; a url without any label near it gets the overall
share's verdict, allow where there are no labels at all; repeated rows count each; a null ``page_id`` is carried along; an
empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtriage.llm.common import stored

#: Levels in which wildcards tell paths of different length apart; it is no bound on the depth of branches.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the query: verdict and rule (host, then path).
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, own).otherwise(verdict)
    return rule, verdict


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "good")]


def _split(now: DataFrame, level: int, support: int, z2: float, rest: str) -> DataFrame:
    """``now`` with one more segment in ``template``: its own where the branch passes, else ``rest``."""
    child = now.where(F.size("segments") > level).withColumn("segment", F.col("segments")[level])
    branch = child.groupBy("host", "template", "segment").agg(*_sums())
    node = branch.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in ("labelled", "good")))
    off = F.col("good") * F.col("all_labelled") - F.col("all_good") * F.col("labelled")
    spread = F.col("labelled") * F.col("all_good") * (F.col("all_labelled") - F.col("all_good"))
    differs = off.cast("double") * off.cast("double") >= F.lit(z2) * spread.cast("double")
    own = branch.join(node, ["host", "template"]).where((F.col("n") >= support) & (spread > 0) & differs)
    own = own.select("host", "template", "segment", F.col("segment").alias("own"))
    joined = now.withColumn("segment", F.get("segments", F.lit(level))).join(own, ["host", "template", "segment"], "left")
    step = F.when(F.col("segment").isNull(), "").otherwise(F.concat(F.lit("/"), F.coalesce("own", F.lit(rest))))
    return stored(joined.withColumn("template", F.concat("template", step)).drop("segment", "own"), "masked-paths")


def templates(counts: DataFrame, support: int, z2: float) -> DataFrame:
    """``counts`` (``host``, ``masked``, ``n``, ``labelled``, ``good``) with the ``template`` of each masked path."""
    segments = F.filter(F.split("masked", "/"), lambda s: s != "")
    now = stored(counts.withColumns({"segments": segments, "template": F.lit("")}), "masked-paths")
    level, depth = 0, F.size("segments")
    while level < LEVELS:
        now = _split(now, level, support, z2, "*")
        level += 1
    done, now = now.where(depth <= level), now.where(depth > level)
    while not now.isEmpty():
        # A node of less support, or with labels of one kind only, has no branch that passes, here or deeper.
        node = now.groupBy("host", "template").agg(*_sums())
        open_ = node.where((F.col("n") >= support) & (F.col("good") > 0) & (F.col("good") < F.col("labelled")))
        open_ = open_.select("host", "template", F.lit(True).alias("open"))
        now = stored(now.join(open_, ["host", "template"], "left"), "masked-paths")
        closed = now.where("open is null").withColumn("template", F.concat("template", F.lit("/**")))
        now = now.where("open").drop("open")
        done = done.unionByName(closed.drop("open"))
        if now.isEmpty():
            break
        now = _split(now, level, support, z2, "**")
        level += 1
        done, now = done.unionByName(now.where(depth <= level)), now.where(depth > level)
    # What no branch follows is one rest of any length.
    return done.withColumn("template", F.regexp_replace("template", r"(/[*][*])+$", "/**")).drop("segments")


def template_verdicts(urls: DataFrame, support: int = 5, z2: float = 3.84, weight: float = 4.0) -> DataFrame:
    """``host``, ``masked``, ``template``, ``purity``, ``method`` for ``urls`` (``host``, ``masked``, ``label``: 1 good, 0
    bad, null unknown)."""
    label = F.col("label")
    counts = urls.groupBy("host", "masked").agg(
        F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("good")
    )
    found = stored(templates(counts, support, z2), "templates")
    sums = lambda prefix: [F.sum(c).alias(f"{prefix}_{c}") for c in ("labelled", "good")]
    smooth = lambda good, n, prior: (F.col(good) + F.lit(weight) * prior) / (F.col(n) + F.lit(weight))
    hosts = found.groupBy("host").agg(*sums("host"))
    everything = found.agg(*sums("all"))  # one row
    share = F.when(F.col("all_labelled") > 0, F.col("all_good") / F.col("all_labelled")).otherwise(1.0)
    total = everything.select(share.alias("share")).first()
    prior = F.lit(total["share"])
    hosts = hosts.withColumn("host_share", smooth("host_good", "host_labelled", prior)).select("host", "host_share")
    leaves = found.groupBy("host", "template").agg(*sums("own")).join(hosts, "host")
    purity = smooth("own_good", "own_labelled", F.col("host_share"))
    leaves = leaves.select("host", "template", purity.alias("purity"))
    method = F.when(F.col("purity") < 0.5, "block").otherwise("allow").alias("method")
    return found.select("host", "masked", "template").join(leaves, ["host", "template"]).select(
        "host", "masked", "template", "purity", method
    )


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, **options: float) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every url; urls that a rule decides are the labelled ones."""
    host, path = host_and_path(pages["url"])
    own = pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decided = matching_rule(F.col("host"), F.col("path"), rules)
    masked = F.regexp_replace("path", "[0-9]+", "*")
    own = own.withColumns({"rule": rule, "decided": decided, "masked": masked})
    label = F.when(F.col("decided") == "allow", 1).when(F.col("decided") == "block", 0).alias("label")
    found = template_verdicts(own.select("host", "masked", label), **options).select("host", "masked", "method")
    verdict = F.coalesce("decided", "method").alias("verdict")
    return own.join(found, ["host", "masked"]).select("page_id", "host", "path", "rule", verdict)
